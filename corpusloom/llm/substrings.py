"""Repeated passages between and inside documents, by seed and extend.

Seeds: hashes of GRAM words; of every run of them that fits into WINDOW words the smallest,
rightmost of equal ones, is an anchor.  A sequence of WINDOW words that occurs twice has the same
anchor at the same place in both, so sequences whose anchor is found only once cannot repeat.
Extend: around every anchor that joins different places, the sequences of WINDOW words that have
it as their anchor are tried at all offsets to both sides, by 128-bit hashes.  All occurrences of
a sequence but the first, by (doc_id, start), are repeats; overlapping ones run together to
maximal passages of at least WINDOW words.

Rows grow with the text, never with pairs: places that share an anchor or a sequence are combined
by their minimum, on the map side first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from corpusloom.functions.text import quoted
from corpusloom.llm.common import attach, parts, utf8
from corpusloom.operators.scratch import settle

WINDOW = 20
GRAM = 4
#: Bytes of text hashed at a time.
PIECE = 1 << 20
#: Sorts rows without an id behind all others.
LAST = 2**63 - 1

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = _mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POWER = _powers(0xD6E8FEB86659FD93)
_INVERSE = _powers(pow(0xD6E8FEB86659FD93, -1, 2**64))


def _pieces(text: bytes) -> Iterator[np.ndarray]:
    """The text in pieces that are cut at blanks; a longer word is cut only if it fills a piece."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            cut = max(text.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut < at:  # one word of over a piece: it is hashed apart
                end = min((e for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (e := text.find(c, at)) >= 0), default=len(text))
            else:
                end = cut + 1
        yield np.frombuffer(text, np.uint8, min(end, len(text)) - at, at)
        at = end


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word, in order."""
    out = []
    for a in _pieces(text):
        if len(a) > PIECE:
            words = a.tobytes().split()
            out.append(np.array([int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in words], np.uint64))
            continue
        solid = np.empty(len(a) + 2, bool)
        solid[0] = solid[-1] = False
        solid[1:-1] = (a != 32) & ((a < 9) | (a > 13))
        turns = np.flatnonzero(solid[1:] != solid[:-1])
        starts, ends = turns[::2], turns[1::2]
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(_LETTER[a] * _POWER[: len(a)], out=sums[1:])
        raw = (sums[ends] - sums[starts]) * _INVERSE[starts]
        out.append(_mixed(raw + (ends - starts).astype(np.uint64) * _ODD))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _runs(hashes: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash of every n words in a row."""
    out = hashes[: len(hashes) - n + 1].copy()
    for i in range(1, n):
        out *= np.uint64(base)
        out += hashes[i : len(hashes) - n + 1 + i]
    return _mixed(out)


def anchors(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(gram hashes, the anchor's place for every window start)."""
    if len(hashes) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    grams = _runs(hashes, gram, 0xA24BAED4963EE407)
    span, width = window - gram + 1, 1
    best = np.arange(len(grams))

    def lower(step: int, a: np.ndarray) -> np.ndarray:
        left, right = a[:-step], a[step:]
        return np.where(grams[right] <= grams[left], right, left)

    while 2 * width <= span:
        best = lower(width, best)
        width *= 2
    if width < span:
        best = lower(span - width, best)
    return grams, best


def _distinct(places: np.ndarray) -> np.ndarray:
    """Each of the ascending places once."""
    return places[np.concatenate([[True], places[1:] != places[:-1]])] if len(places) else places


def windows(hashes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every window."""
    return _runs(hashes, window, 0x8EBC6AF09C88C6E3), _runs(hashes ^ _ODD, window, 0xDB4F0B9175AE2165)


def _columns(df: DataFrame, each, schema: str, arrow: pa.Schema, size: int = 200_000) -> DataFrame:
    """``each``, given the values of a row, gives arrays, one per column; they are put together."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0

        def together():
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow
            )

        for batch in it:
            for i in range(batch.num_rows):
                arrays = each(*[c[i].as_py() for c in batch.columns])
                if len(arrays[0]):
                    held.append(arrays)
                    n += len(arrays[0])
                if n >= size:
                    yield together()
                    held, n = [], 0
        if held:
            yield together()

    return df.mapInArrow(run, schema)


def _longs(*names: str) -> pa.Schema:
    return pa.schema([(n, pa.int32() if n in ("pos", "tag", "start") else pa.int64()) for n in names])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'long'}" for f in schema)


def _full(n: int, value: int, kind=np.int64) -> np.ndarray:
    return np.full(n, value, kind)


def _cut(docs: DataFrame, window: int, with_text: bool, carried: Sequence[str]) -> DataFrame:
    """``repeats``, behind the carried columns by the names of ``_named``."""
    texts = _named(docs, []).withColumn("tag64", F.xxhash64("text"))

    # exact copies: all their windows are in the first one too
    narrow = texts.select("doc", "tag", F.md5("text").alias("digest"))
    first = settle(narrow.groupBy("digest").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1"), "texts")
    copies = settle(
        attach(narrow, first.select("digest", "first"), "digest", first.select("digest", "n"))
        .where("doc > first").select("doc", "tag").distinct(), "copies",
    )

    # seeds: anchors found at more than one place; copies of a text count as one place
    h_v = _longs("h", "v")

    def seeds(tag64: int, text: bytes):
        grams, best = anchors(word_hashes(text), window)
        at = _distinct(best)
        # different for any two places of a text, as mixing is one-to-one
        place = _mixed(at.astype(np.uint64)) ^ np.uint64(tag64 & (2**64 - 1))
        return grams[at].view(np.int64), place.view(np.int64)

    found = _columns(texts.select("tag64", "text"), seeds, _ddl(h_v), h_v)
    shared = settle(
        found.groupBy("h").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("*").alias("n")).where("a <> b").select("h", "n"),
        "seeds",
    )

    # the places of these anchors, by document
    h_pos = _longs("h", "doc", "tag", "pos")

    def places(doc: int, tag: int, text: bytes):
        grams, best = anchors(word_hashes(text), window)
        at = _distinct(best)
        return grams[at].view(np.int64), _full(len(at), doc), _full(len(at), tag, np.int32), at.astype(np.int32)

    at = _columns(texts.select("doc", "tag", "text"), places, _ddl(h_pos), h_pos)
    met = attach(at, shared.select("h", F.lit(True).alias("met")), "h", shared).where("met")
    joined = settle(met.groupBy("doc", "tag").agg(F.collect_set("pos").alias("places")), "places")

    # extension: windows around these anchors; of each sequence the first place stays
    by_doc = _named(docs, carried).repartition(parts(docs), "doc", "tag")
    w_start = _longs("one", "two", "doc", "tag", "start")

    def around(doc: int, tag: int, text: bytes, *others):
        hashes = word_hashes(text)
        starts = _candidates(hashes, others[-1], window)
        one, two = windows(hashes, window)
        return (
            one[starts].view(np.int64), two[starts].view(np.int64), _full(len(starts), doc),
            _full(len(starts), tag, np.int32), starts.astype(np.int32),
        )

    # carried columns are read here as well, so that both uses share one shuffle of the texts
    tried = _columns(by_doc.join(joined, ["doc", "tag"]), around, _ddl(w_start), w_start)
    stays = (
        tried.groupBy("one", "two")
        .agg(F.min(F.struct("doc", "start", "tag")).alias("m"))
        .groupBy(F.col("m.doc").alias("doc"), F.col("m.tag").alias("tag"))
        .agg(F.collect_list("m.start").alias("firsts"))
    )
    marks = (
        joined.join(stays, ["doc", "tag"], "left")
        .join(copies.withColumn("copy", F.lit(True)), ["doc", "tag"], "full")
        .select("doc", "tag", "places", "firsts", F.coalesce("copy", F.lit(False)).alias("copy"))
    )
    span = "spans array<struct<start: long, end: long>>"
    schema = StructType(
        [StructField(f"_c{i}", docs.schema[c].dataType) for i, c in enumerate(carried)]
        + StructType.fromDDL(f"doc_id long, n_words long, n_removed long, kept_sha256 string, {span}" + ", kept_text string" * with_text).fields
    )
    names = [f"_c{i}" for i in range(len(carried))]

    def cut(doc: int, text: bytes, places_: list[int] | None, firsts: list[int] | None, copy: bool | None) -> tuple:
        words = text.split()
        gone = np.zeros(len(words), bool)
        if copy and len(words) >= window:
            gone[:] = True
        elif places_:
            starts = _candidates(word_hashes(text), places_, window)
            again = np.setdiff1d(starts, np.array(firsts or [], np.int64), assume_unique=True)
            edges = np.zeros(len(words) + 1, np.int64)
            np.add.at(edges, again, 1)
            np.add.at(edges, again + window, -1)
            gone = np.cumsum(edges[:-1]) > 0
        removed = int(gone.sum())
        kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if removed else words)
        turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        spans = [{"start": s, "end": e} for s, e in turns.reshape(-1, 2).tolist()]
        row = (None if doc == LAST else doc, len(words), removed, hashlib.sha256(kept).hexdigest(), spans)
        if not with_text:
            return row
        return (*row, kept.decode() if removed else text.decode())

    arrow = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
    columns = schema.fieldNames()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, 1_000):
                batch = whole.slice(at, 1_000)
                rows = [cut(*[x.as_py() for x in r]) for r in zip(*[batch.column(n) for n in ("doc", "text", "places", "firsts", "copy")], strict=True)]
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow, strict=False)]
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *made], names=columns)

    return by_doc.join(marks, ["doc", "tag"], "left").mapInArrow(run, schema)


def _named(docs: DataFrame, carried: Sequence[str]) -> DataFrame:
    """Identity, text and carried columns of every row, by names of our own."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.coalesce(quoted("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
        F.xxhash64(text).bitwiseAND(F.lit(2**31 - 1)).cast("int").alias("tag"),
        utf8(F.col("text")).alias("text"),
        *[quoted(c).alias(f"_c{i}") for i, c in enumerate(carried)],
    )


def _candidates(hashes: np.ndarray, places: list[int], window: int) -> np.ndarray:
    """Starts of the windows whose anchor is one of the places."""
    _, best = anchors(hashes, window)
    return np.flatnonzero(np.isin(best, np.array(places, np.int64)))


def repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row, with ``spans`` of removed words and,
    if asked for, ``kept_text``: the whole text if nothing goes.

    A word goes if a window over it has its sequence also at an earlier place: in a smaller doc_id
    or earlier in the same document.  Kept words are joined by one blank.  Null texts have no words.
    Rows without an id come after all others and count as one document; rows that repeat an id and
    a text get the same result each, further texts of an id are ordered by a hash of the text.
    """
    return _cut(docs, window, with_text, [])


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the repeated words; texts that lose none stay as they are.

    Documents that lose all their words go.  ``n_chars``, where there is one, follows the text.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = _cut(docs, window, True, rest).where("n_removed < n_words OR n_words = 0")
    new = {c: F.col(f"_c{i}") for i, c in enumerate(rest)}
    new["doc_id"] = F.col("doc_id").cast(docs.schema["doc_id"].dataType)
    new["text"] = F.col("kept_text")
    if "n_chars" in rest:
        length = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("n_removed") > 0, length).otherwise(new["n_chars"])
    return cut.select(*[new[c].alias(c) for c in docs.columns])
