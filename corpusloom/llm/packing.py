"""Packing of tokenized documents into sequences of several context sizes.

A document's tokens fill whole windows of the longest size first; what remains is routed to the
smallest size that holds it.  Each size is packed from the longest to the shortest: a remainder
opens a window of its size, and the gap behind it is filled from remainders of shorter sizes, the
largest that fits first, the last one cut to fit.  Windows of every size are powers of two, so
that full ones need no padding, and are put together in step groups of equally many tokens.

Each task packs its own documents in blocks of bounded size; no ids are moved between tasks.  The windows
of a size are then numbered over all tasks by the tasks' counts, and each so many make a step group.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.llm.common import batches
from corpusloom.operators.scratch import settle

SIZES = (2048, 1024, 512, 256)
END = 1
#: Tokens whose windows make up one step group.
STEP = 32 * 2048
#: Tokens held for packing at a time: bounds a task's memory.
BLOCK = 4_000_000
#: Bytes of remembered parts of texts and their ids, about, the longest part that is remembered, and what one takes beside.
REMEMBERED_BYTES = 96 << 20
LONGEST = 64
OVERHEAD = 200
#: Sequence numbers: the task above these bits, the count within it below.
BITS = 36

#: Fixed value: the public pattern by which byte-level vocabularies cut texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BEHIND_SPACE = re.compile(r"\s ")

Piece = tuple[int, int, int]  # document, start, length


class Encoder:
    """Ids of whole texts as the vocabulary file defines them, END behind each.

    Byte-level pre-tokenizing always cuts before a blank that follows a non-blank, so the parts
    of a text at single blanks can be encoded apart and remembered.  Texts with a blank behind
    other white space, or with the name of a special token, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = _Parts(_part_encoder(path) or self._whole)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> np.ndarray:
        if BEHIND_SPACE.search(text) or any(n in text for n in self.special):
            return np.array([*self._whole(text), END], "<u4")
        first, *rest = text.split(" ")
        joined = b"".join(map(self.known.__getitem__, rest))
        return np.frombuffer(_bytes(self.known.encode(first)) + joined + _bytes([END]), "<u4")


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Parts(dict):
    """The ids, as bytes, of a part with the blank before it; forgets all when they take too many bytes."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.held = encode, 0

    def __missing__(self, part: str) -> bytes:
        found = _bytes(self.encode(" " + part))
        if len(part) <= LONGEST:
            if self.held > REMEMBERED_BYTES:
                self.clear()
                self.held = 0
            self.held += OVERHEAD + len(part) + len(found)
            self[part] = found
        return found


def _part_encoder(path: str):
    """A faster encoder of the same vocabulary, or None when the file is of another kind.

    Where every merge makes the token whose id is next, ids are ranks, and merging by rank gives
    the same ids several times faster.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if model.get("type") != "BPE" or not plain or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
        return None
    vocab = model["vocab"]
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if any(vocab.get(m) != 256 + i for i, m in enumerate(merges)):
        return None
    byte_of = {c: b for b, c in _byte_letters().items()}
    names = {t for t in vocab if vocab[t] < 256 + len(merges)}
    ranks = {bytes(byte_of[c] for c in t): vocab[t] for t in names}
    return tiktoken.Encoding("parts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if visible, else one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def pack(lengths: Iterable[int], sizes: tuple[int, ...] = SIZES) -> Iterator[tuple[int, list[Piece]]]:
    """(window size, pieces) for documents of the given lengths; each token lies in one piece.

    All windows are full but one at most, which is given as the longest size.
    """
    longest = sizes[0]
    pool: list[tuple[int, int, int]] = []  # (length, document, start) of remainders
    for doc, n in enumerate(lengths):
        for start in range(0, n - longest + 1, longest):
            yield longest, [(doc, start, longest)]
        if n % longest:
            pool.append((n % longest, doc, n - n % longest))
    pool.sort()
    for size, shorter in zip(sizes, (*sizes[1:], 0), strict=True):
        while pool and pool[-1][0] > shorter:
            n, doc, start = pool.pop()
            window, gap = [(doc, start, n)], size - n
            while gap and pool:
                at = bisect_right(pool, gap, key=lambda p: p[0])
                n, doc, start = pool.pop(max(at - 1, 0))
                if n > gap:  # the shortest is too long: cut it
                    insort(pool, (n - gap, doc, start + gap))
                    n = gap
                window.append((doc, start, n))
                gap -= n
            if not gap:
                yield size, window
            else:
                yield from _tail(window, sizes)


def _tail(window: list[Piece], sizes: tuple[int, ...]) -> Iterator[tuple[int, list[Piece]]]:
    """The last tokens: full windows of shorter sizes as long as they last."""
    left = sum(n for _, _, n in window)
    while left:
        size = next((s for s in sizes if s <= left), left)
        taken, need = [], size
        while need:
            doc, start, n = window.pop(0)
            if n > need:
                window.insert(0, (doc, start + need, n - need))
                n = need
            taken.append((doc, start, n))
            need -= n
        yield size if size in sizes else sizes[0], taken
        left -= size


def packed(
    docs: DataFrame,
    tokenizer: str,
    sizes: tuple[int, ...] = SIZES,
    step: int = STEP,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step_group.

    ``tokenizer`` is the path of a vocabulary file on every machine.  A null text counts as empty
    and still has its end id.  Repeated rows are packed as often as given.  Unfilled windows, a few
    per block of BLOCK tokens, are padded to the longest size unless their tokens are a power of
    two by chance.  ``with_ids`` adds the ids of each piece.
    """
    numbers = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "nth"]
    schema = pa.schema([(n, pa.int64()) for n in ["doc_id", *numbers]] + ([("ids", pa.list_(pa.int64()))] if with_ids else []))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        sequence, nth = TaskContext.get().partitionId() << BITS, dict.fromkeys(sizes, 0)

        def flush(names: list, ids: list[np.ndarray]):
            nonlocal sequence
            for size, window in pack([len(x) for x in ids], sizes):
                at = 0
                for doc, start, n in window:
                    part = ids[doc][start : start + n]
                    row = (names[doc], start, n, zlib.crc32(part.tobytes()), len(ids[doc]), sequence, at, size, nth[size])
                    yield (*row, part.tolist()) if with_ids else row
                    at += n
                nth[size] += 1
                sequence += 1

        def rows():
            names, ids, held = [], [], 0
            for batch in it:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    some, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                    new = [encoder(t) for t in texts]
                    names += some
                    ids += new
                    held += sum(map(len, new))
                    if held >= BLOCK:
                        yield from flush(names, ids)
                        names, ids, held = [], [], 0
            yield from flush(names, ids)

        yield from batches(rows(), schema)

    columns = ", ".join(f"{f.name} {'array<bigint>' if f.name == 'ids' else 'bigint'}" for f in schema)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = settle(narrow.mapInArrow(run, columns), "pieces")
    return _grouped(pieces, sizes, step).select("doc_id", *numbers[:-1], "step_group", *["ids"] * with_ids)


def _grouped(pieces: DataFrame, sizes: tuple[int, ...], step: int) -> DataFrame:
    """``pieces`` with ``step_group``: windows of a size are numbered task after task, each step // size of them are a group."""
    task = F.shiftright("sequence_id", BITS)
    counts = pieces.groupBy("window", task.alias("task")).agg((F.max("nth") + 1).alias("n"))
    # one row per task and size
    before = Window.partitionBy("window").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = settle(counts.select("window", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "firsts")
    place = F.coalesce(*[F.when(F.col("window") == s, F.lit(i)) for i, s in enumerate(sizes)])
    group = F.call_function("div", F.col("first") + F.col("nth"), F.call_function("div", F.lit(step), F.col("window")))
    joined = pieces.withColumn("task", task).join(firsts, ["window", "task"])
    return joined.withColumn("step_group", (group * len(sizes) + place).cast("long"))
