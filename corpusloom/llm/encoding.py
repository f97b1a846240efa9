"""Ids of whole texts for vocabulary files of the kind with word ends.

Such a file lower-cases, drops white space and marks the last letter of a word.  Texts of ASCII and accented
Latin letters are cut into words here; words are merged by rank (``tiktoken``) and remembered, by bytes, which
gives the ids of the file's own library several times faster: every merge of the file makes the token whose id
is next, so ids are ranks.  As white space always parts words, other texts are cut at blanks, and the parts with
other letters, or with the name of a special token, go to the library as they are.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable

#: Bytes of remembered words and their ids, about, and the longest word that is remembered.
REMEMBERED_BYTES = 128 << 20
LONGEST = 64
#: What one entry takes beside its content.
OVERHEAD = 200
#: Characters that are cut into words at a time.
CHUNK = 1 << 20

#: Texts of these letters are cut here, as composing and lower-casing have no surprises on them.
PLAIN = re.compile("[ -~\t\n\rÀ-ÖØ-öø-ÿ]*")
#: Fixed value: the word pattern of the public vocabulary, with the letters that PLAIN leaves.
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\s0-9a-zß-öø-ÿ]+")
FILE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Words(dict):
    """The ids, as bytes, of words; forgets all when they take too many bytes."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode, self.held = encode, 0

    def __missing__(self, word: str) -> bytes:
        ids = packed(self.encode(word))
        if len(word) <= LONGEST:
            if self.held > REMEMBERED_BYTES:
                self.clear()
                self.held = 0
            self.held += OVERHEAD + len(word) + len(ids)
            self[word] = ids
        return ids


class WordEncoder:
    """Ids of a text as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # a name with a blank, or one that takes blanks beside it, could reach over two parts
        apart = _parts_words(spec) and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        fast = _by_rank(spec) if apart else None
        self.words = Words(fast) if fast else None

    def _whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def _chunk(self, text: str) -> bytes:
        if self._plain(text):
            return b"".join(map(self.words.__getitem__, WORDS.findall(text.lower())))
        parts = [self._chunk(p) if self._plain(p) else self._whole(p) for p in text.split(" ")]
        return b"".join(parts)

    def __call__(self, text: str) -> bytes:
        if self.words is None:
            return self._whole(text)
        if len(text) <= CHUNK:
            return self._chunk(text)
        out, at = [], 0
        while at < len(text):
            end = text.find(" ", at + CHUNK)
            end = len(text) if end < 0 else end
            out.append(self._chunk(text[at:end]))
            at = end
        return b"".join(out)


def _parts_words(spec: dict) -> bool:
    """Whether the file composes letters, makes white space blanks, lower-cases, and cuts words by FILE_PATTERN."""
    normal = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if normal != ["NFC", "Replace", "Lowercase"] or [c.get("type") for c in cuts] != ["Split", "ByteLevel"]:
        return False
    blanks, (words, letters) = spec["normalizer"]["normalizers"][1], cuts
    return (
        blanks["pattern"] == {"Regex": "\\s+"} and blanks["content"] == " " and words["pattern"] == {"Regex": FILE_PATTERN}
        and words["behavior"] == "Removed" and words["invert"] and not letters["add_prefix_space"] and not letters["use_regex"]
    )


def _by_rank(spec: dict) -> Callable[[str], list[int]] | None:
    """An encoder of one word by rank, or None where ids are no ranks.

    Each symbol that words of PLAIN letters hold, a byte or a byte that ends a word, is one byte here.
    """
    import tiktoken

    from corpusloom.llm.packing import _byte_letters

    model, letters = spec["model"], _byte_letters()
    ending, vocab = model.get("end_of_word_suffix"), model["vocab"]
    if model.get("type") != "BPE" or not ending or model.get("dropout") or model.get("ignore_merges"):
        return None
    if sorted(vocab.get(c + e, -1) for c in letters.values() for e in ("", ending)) != list(range(512)):
        return None
    chars = [c for c in map(chr, range(0x100)) if PLAIN.fullmatch(c) and not c.isspace()]
    heads = sorted({b for c in chars for b in c.lower().encode()})
    tails = sorted({c.lower().encode()[-1] for c in chars})
    symbols = [letters[b] for b in heads] + [letters[b] + ending for b in tails]
    written = {s: bytes([i]) for i, s in enumerate(symbols)}
    ranks = {w: vocab[s] for s, w in written.items()}
    for i, merge in enumerate(model["merges"]):
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        if vocab.get(a + b) != 512 + i:
            return None
        if a in written and b in written:
            written[a + b] = written[a] + written[b]
            ranks[written[a + b]] = 512 + i
    # bytes that stand for nothing never occur
    ranks |= {bytes([b]): len(vocab) + 1000 + b for b in range(len(symbols), 256)}
    merged = tiktoken.Encoding("words", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
    inner, last = bytearray(256), bytearray(256)
    for i, b in enumerate(heads):
        inner[b] = i
    for i, b in enumerate(tails, len(heads)):
        last[b] = i
    inner, last = bytes(inner), bytes(last)

    def encode(word: str) -> list[int]:
        raw = word.encode()
        return merged(raw[:-1].translate(inner) + raw[-1:].translate(last))

    return encode


_known: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of a vocabulary file, kept for later tasks of the same worker."""
    if path not in _known:
        _known[path] = WordEncoder(path)
    return _known[path]
