"""Quality by the perplexity of an interpolated modified Kneser-Ney model over the words of trusted text.

N-grams of WORDS words of all trusted texts are counted over shards; lower orders count the different words
before an n-gram.  An n-gram is in the shard of its middle word, as are its context, its lower order and the context
of that: only the counts of its last word come from another one.  A text's likelihood is a sum over its n-grams,
so all of them meet the model in these shards, slice by slice, and are added up per text.  Rows hold packed numbers,
many n-grams each, so that few rows go between tasks.  A word that the model does not know is spelled: by a model
of order four over characters folded to 32 classes, whose 32**4 numbers each task holds.

Texts are dealt to two folds by their hash and each is scored by the model of the other one.  So a trusted text
never meets its own n-grams, and the bounds it helps to set hold for texts that no model has seen.  A document's
perplexity, per character, is held against quantiles of the trusted documents of its language.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.text import quoted
from corpusloom.llm.common import attach, parts, utf8
from corpusloom.operators.scratch import discard, settle, shuffles_removed

#: Order of the model of words.
WORDS = 3
#: What stands before and behind the words of a text, among their hashes; the lowest bit is the fold.
BEGIN, END = 0x3C6EF372FE94F82A, 0x510E527FADE682D0
#: Bits by which the hashes of an n-gram's words are rotated against each other.
TURN = 21
#: The hash of a word: its bytes as digits of a number to this base, and how that is mixed.
BASE = 0x9E6C63D0676A9A99
MIX = ((32, 0xD6E8FEB86659FD93), (29, 0xFF51AFD7ED558CCD))
#: Bytes of text whose n-grams are held at a time.
PART = 1 << 20
#: Rows that are put in order at a time.
PLACES = 1 << 20
#: Bytes of a column that are held against the model at a time.
PIECE = 1 << 21
#: Slices in which a fold's model is made and met by the texts, one after the other: one per so many
#: characters of trusted texts, and at most so many.
SLICE, SLICES = 5_000_000, 3
LEAST_SHARDS = 6
#: A middle word that occurs so often in trusted texts is dealt over several shards; of a part of the texts, words
#: that are less than one in RARE are not counted for that.
HOT, RARE = 1_000_000, 2048
#: Order of the model of characters.
ORDER = 4
BITS = 5
CLASSES = 1 << BITS
#: Quantiles of trusted perplexities outside of which a document is rejected.
LOW, HIGH = 0.002, 0.998
#: Documents of all languages that count beside a language's own trusted ones, so that few of its own decide little:
#: in its typical loss, which few tell well, and in its quantiles, which take many.
SHARED_LOSS, SHARED = 5, 100
#: Characters of a typical text of its language that are added to every text, which steadies short ones.
PRIOR = 100
ACCURACY = 20_000
#: How much a bound may differ by rounding.
ROUNDING = 1e-12
CHUNK = 1 << 20
NONE = "(none)"

BLANK, UPPER, DIGIT, MARK, SYMBOL, OTHER = 0, 27, 28, 29, 30, 31
MARKS = ".,;:!?'\"()-"
LETTERS, OTHER_SCRIPTS = 26, 0x250


def _class(c: str) -> int:
    if c.isspace():
        return BLANK
    if c.isdigit():
        return DIGIT
    if c.isalpha():
        base = unicodedata.normalize("NFD", c)[0]
        if c.isupper():
            return UPPER
        if "a" <= base <= "z":
            return ord(base) - ord("a") + 1
        # letters of other scripts are dealt over the classes of letters, so that their order tells as well
        return OTHER if ord(c) < OTHER_SCRIPTS else 1 + ord(base) % LETTERS
    return MARK if c in MARKS or unicodedata.category(c)[0] == "P" and ord(c) > 127 else SYMBOL


#: Classes of the first code points; of those behind, the letters begin at FAR_LETTERS.
KNOWN, FAR_LETTERS = 0x10000, 0x20000
FOLD = np.array([_class(chr(i)) for i in range(KNOWN)] + [SYMBOL], np.int32)


#: Classes of the characters that one byte holds, and which of them stand between words, for bytes.translate.
FOLDED, BETWEEN = (bytes(x) for x in (FOLD[:256].tolist(), [c == 32 or 9 <= c <= 13 for c in range(256)]))


def _classes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all characters, and which of them stand between words."""
    try:
        data = text.encode("latin-1")
        return np.frombuffer(data.translate(FOLDED), np.uint8), np.frombuffer(data.translate(BETWEEN), bool)
    except UnicodeEncodeError:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = FOLD[np.minimum(points, KNOWN)]
    if points.max() >= FAR_LETTERS:
        folded = np.where(points >= FAR_LETTERS, 1 + points % LETTERS, folded)
    return folded, (points == 32) | (points >= 9) & (points <= 13)


def _numbers(classes: np.ndarray, order: int) -> np.ndarray:
    x = np.zeros(len(classes) + order - 1, np.int32)
    x[order - 1 :] = classes
    out = x[: len(classes)].copy()
    for i in range(1, order):
        out <<= BITS
        out |= x[i : i + len(classes)]
    return out


def grams(text: str, order: int = ORDER) -> np.ndarray:
    """Numbers of all n-grams that end in a character of the text; blanks stand before it."""
    return _numbers(_classes(text)[0], order)


def counts(texts: DataFrame) -> DataFrame:
    """(g, c): occurrences of every n-gram in the column ``text``, by dense sums per task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**ORDER, np.int64)
        for batch in it:
            held, size = [], 0
            for text in batch.column("text"):
                held.append(grams(text.as_py()))
                size += len(held[-1])
                if size > CHUNK:
                    total += np.bincount(np.concatenate(held), minlength=len(total))
                    held, size = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=len(total))
        found = np.flatnonzero(total)
        for at in range(0, len(found), 100_000):
            part = found[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["g", "c"])

    return texts.mapInArrow(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def _discounts(counted: DataFrame) -> list[float]:
    """Discounts of n-grams counted once, twice and more often, from the counts of counts."""
    n = counted.agg(*[F.sum((F.col("c") == i).cast("long")) for i in (1, 2, 3, 4)]).head()
    return _cuts(*(x or 0 for x in n))


def _cuts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    if not n1 or not n2:
        return [0.5, 0.75, 1.0]
    y = n1 / (n1 + 2 * n2)
    d1, d2 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return [min(max(d1, 0.05), 1.0), min(max(d2, 0.05), 2.0), min(max(d3, 0.05), 3.0)]


def probabilities(top: DataFrame) -> DataFrame:
    """(g, p) for all CLASSES**ORDER n-grams: the probability of the last symbol after the others."""
    spark = top.sparkSession
    tables = {ORDER: top}
    for n in range(ORDER - 1, 0, -1):
        # continuation counts: the different symbols before
        suffix = F.col("g").bitwiseAND(F.lit((1 << BITS * n) - 1))
        tables[n] = settle(tables[n + 1].groupBy(suffix.alias("g")).agg(F.count("*").alias("c")), f"continuations-{n}")
    below = None
    for n in range(1, ORDER + 1):
        counted = tables[n]
        d = _discounts(counted)
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        context = F.shiftright("g", BITS)
        contexts = counted.groupBy(context.alias("ctx")).agg(
            F.sum("c").alias("total"), (F.sum(cut) / F.sum("c")).alias("gamma")
        )
        every = spark.range(CLASSES**n).select(F.col("id").alias("g"), F.shiftright("id", BITS).alias("ctx"))
        joined = every.join(counted.select("g", "c", cut.alias("cut")), "g", "left").join(contexts, "ctx", "left")
        if below is None:
            joined = joined.withColumn("lower", F.lit(1.0 / CLASSES))
        else:
            joined = joined.withColumn("tail", F.col("g").bitwiseAND(F.lit((1 << BITS * (n - 1)) - 1))).join(
                below.select(F.col("g").alias("tail"), F.col("p").alias("lower")), "tail", "left"
            )
        own = F.coalesce((F.col("c") - F.col("cut")) / F.col("total"), F.lit(0.0))
        below = settle(
            joined.select("g", (own + F.coalesce("gamma", F.lit(1.0)) * F.col("lower")).alias("p")), f"probabilities-{n}"
        )
    return below


def train(texts: DataFrame) -> np.ndarray:
    """Natural logarithms of all probabilities: CLASSES**ORDER numbers, whatever the corpus."""
    found = probabilities(settle(counts(texts), "grams")).toArrow()
    out = np.zeros(CLASSES**ORDER, np.float32)
    out[found["g"].to_numpy()] = np.log(found["p"].to_numpy())
    return out


def _key(text: Column) -> Column:
    """The hash of a text, whose lowest bit is its fold."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of BASE modulo 2**64, and those of its inverse."""
    found = np.full((2, n), [[BASE], [pow(BASE, -1, 1 << 64)]], np.uint64)
    found[:, 0] = 1
    return tuple(np.multiply.accumulate(found, axis=1))


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in MIX:
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: Sequence[bytes], folds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as hashes that carry the fold of each, with begins and end, and the places where texts begin."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    blank = (data == 32) | (data - np.uint8(9) <= 4)
    edges = np.diff(blank.astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1) + 1, np.flatnonzero(edges == 1) + 1
    power, inverse = _powers(1 << max(len(data) - 1, 1).bit_length())
    digits = data + np.uint64(1)
    digits *= power[: len(data)]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(digits, out=sums[1:])
    h = _mixed((sums[ends] - sums[starts]) * inverse[starts])
    froms = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(starts, froms)
    begins = first + WORDS * np.arange(len(texts) + 1)
    x = np.full(begins[-1], END, np.uint64)
    for i in range(WORDS - 1):
        x[begins[:-1] + i] = BEGIN
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    x[np.arange(len(h)) + WORDS * text + WORDS - 1] = h
    return x & ~np.uint64(1) | np.repeat(folds.astype(np.uint64), np.diff(begins)), begins


def _parts(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, list]]:
    """Texts, their keys and a third column, in parts of at most PART bytes or one text."""
    for batch in it:
        held, size = [], 0
        for row in zip(*[batch.column(n).to_pylist() for n in batch.schema.names], strict=True):
            if held and size + len(row[0]) > PART:
                yield _columns(held)
                held, size = [], 0
            held.append(row)
            size += len(row[0])
        if held:
            yield _columns(held)


def _columns(held: list[tuple]) -> tuple[list[bytes], np.ndarray, list]:
    texts, keys, third = zip(*held, strict=True)
    return list(texts), np.array(keys, np.int64), list(third)


def _once(texts: DataFrame) -> DataFrame:
    """(text, key, m): every text once, as bytes, with how many rows have it."""
    each = texts.groupBy(_key(F.col("text")).alias("key")).agg(F.first("text").alias("text"), F.count("*").alias("m"))
    return each.select(utf8(F.col("text")).alias("text"), "key", "m")


def _of_fold(texts: DataFrame, fold: int) -> DataFrame:
    return texts.where(F.col("key").bitwiseAND(F.lit(1)) == fold)


def _turned(x: np.ndarray, times: int) -> np.ndarray:
    return (x << np.uint64(TURN * times)) | (x >> np.uint64(64 - TURN * times))


def gram_hashes(*words: np.ndarray) -> np.ndarray:
    """The hashes of n-grams whose first, second and so on words are given."""
    return reduce(np.bitwise_xor, [_turned(x, i) if i else x for i, x in enumerate(reversed(words))])


def _slices(x: np.ndarray, slices: int) -> np.ndarray:
    """The slices of the model to which hashed words belong."""
    return (x >> np.uint64(8)) % np.uint64(slices)


def _shards(x: np.ndarray, shards: int) -> np.ndarray:
    return (x >> np.uint64(40)) % np.uint64(shards)


def _routes(x1: np.ndarray, x2: np.ndarray, shards: int, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shards of n-grams: that of the middle word, or one of several by the word before for a word that is hot."""
    shard, (words, fans) = _shards(x2, shards), hot
    if len(words):
        place = np.minimum(np.searchsorted(words, x2), len(words) - 1)
        at = np.flatnonzero(words[place] == x2)
        shard[at] = (shard[at] + (x1[at] >> np.uint64(20)) % fans[place[at]]) % np.uint64(shards)
    return shard


def _order(group: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The places of at most PLACES rows in order of their group, their hash, as far as its bits go, and themselves."""
    number = group.astype(np.uint64) << np.uint64(48) | (x >> np.uint64(16) & np.uint64((1 << 28) - 1)) << np.uint64(20)
    number |= np.arange(len(x), dtype=np.uint64)
    number.sort()  # a sort of numbers takes a third of the time of one of places
    return (number & np.uint64(PLACES - 1)).astype(np.intp)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the one before."""
    if not len(columns[0]):
        return np.zeros(0, np.intp)
    return np.flatnonzero(np.concatenate(([True], reduce(np.logical_or, [c[1:] != c[:-1] for c in columns]))))


def _short(x: np.ndarray) -> np.ndarray:
    """The upper 48 bits of hashes."""
    return x.view(np.uint8).reshape(-1, 8)[:, 2:]


def _long(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = data.reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _cells(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A cell of bytes for the values between each two bounds."""
    values = np.ascontiguousarray(values)
    offsets = (bounds * (values.nbytes // max(len(values), 1))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _values(table: pa.Table, name: str, kind: type) -> np.ndarray:
    """The values in all cells of a column."""
    return np.frombuffer(b"".join(c for c in table.column(name).to_pylist() if c), kind)


def _sizes(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.array([len(c) for c in table.column(name).to_pylist()], np.int64) // np.dtype(kind).itemsize


def _batch(schema: str, **columns: pa.Array) -> pa.RecordBatch:
    """A record batch with the columns of a schema; what is not given is null."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names = dict(c.split() for c in schema.split(", "))
    n = len(next(iter(columns.values())))
    arrays = [columns[c].cast(kinds[k]) if c in columns else pa.nulls(n, kinds[k]) for c, k in names.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(names))


def _tables(batches: list[pa.RecordBatch], schema: str) -> pa.Table:
    return pa.Table.from_batches(batches or [_batch(schema, **{schema.split()[0]: pa.nulls(0)})])


def frequent_words(texts: DataFrame, least: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words that occur ``least`` times in order, so one in ``least`` at most, and over how many shards each is dealt.

    Only words that are frequent in a part of the texts are counted there: one that is missed costs time in one task.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, keys, copies in _parts(it):
            x, begins = word_hashes(found, keys & 1)
            words, n = np.unique(x, return_counts=True)
            often = n * RARE >= len(x)
            yield pa.RecordBatch.from_arrays([pa.array(words[often].view(np.int64)), pa.array(n[often])], names=["x", "n"])

    counted = texts.mapInArrow(run, "x long, n long").groupBy("x").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = counted.toArrow()
    words, n = found.column("x").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(words)
    return words[order], np.minimum(n[order] // least + 1, shards).astype(np.uint64)


#: The n-grams of a part of the texts that go to a shard: hashes of first and last words, of middle words in runs, and for each the
#: copies or the place of its text, of ``n`` texts, whose keys one row of the part holds.
GRAMS = "shard int, batch long, n int, keys binary, x1 binary, x2 binary, run binary, x3 binary, of binary"


def word_grams(texts: DataFrame, slices: int, at: int | None, shards: int, hot: tuple, trusted: bool) -> DataFrame:
    """The n-grams of WORDS words of all texts, to be met by their middle word: those of one slice or, with the slice told by the shard, of all.

    Those of trusted texts make the model of the texts' own fold, others are held against that of the other one.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for part, (found, keys, copies) in enumerate(_parts(it)):
            x, begins = word_hashes(found, keys & 1 if trusted else 1 - (keys & 1))
            text = np.repeat(np.arange(len(found)), np.diff(begins))
            where = np.flatnonzero(text[WORDS - 1 :] == text[: 1 - WORDS])
            if at is not None and slices > 1:
                where = where[_slices(x[where + 1], slices) == at]
            of = np.array(copies, np.int32) if trusted else np.arange(len(found), dtype=_kind(len(found)))
            rest = [keys]
            for begin in range(0, len(where), PLACES):
                here = where[begin : begin + PLACES]
                x1, x2, x3 = x[here], x[here + 1], x[here + 2]
                shard = _routes(x1, x2, shards, hot)
                if at is None:
                    shard += _slices(x2, slices) * np.uint64(shards)
                order = _order(shard, x2)
                x2, shard = x2[order], shard[order]
                runs = _changes(shard, x2)
                rows = _changes(shard)
                bounds, of_runs = np.append(rows, len(order)), np.searchsorted(runs, np.append(rows, len(order)))
                yield _batch(
                    GRAMS,
                    shard=pa.array(shard[rows]),
                    batch=pa.array(np.full(len(rows), task + part)),
                    n=pa.array(np.full(len(rows), len(found))),
                    keys=pa.array([k.tobytes() for k in rest] + [None] * (len(rows) - len(rest)), pa.binary()),
                    x1=_cells(_short(x1[order]), bounds),
                    x2=_cells(x2[runs], of_runs),
                    run=_cells(np.diff(np.append(runs, len(order))).astype(np.int32), of_runs),
                    x3=_cells(_short(x3[order]), bounds),
                    of=_cells(of[text[here[order]]], bounds),
                )
                rest = []

    return texts.mapInArrow(run, GRAMS)


def _kind(texts: int) -> type:
    """What numbers the texts of a part."""
    return np.uint16 if texts <= 1 << 16 else np.uint32


def _words_of(grams: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First words, runs of middle words, their lengths and last words."""
    return _long(_values(grams, "x1", np.uint8)), _values(grams, "x2", np.uint64), _values(grams, "run", np.int32), _long(_values(grams, "x3", np.uint8))


class Types:
    """The different n-grams of trusted texts with a middle word of a shard."""

    def __init__(self, grams: pa.Table, hot: tuple):
        x1, x2, run, x3 = _words_of(grams)
        x2 = np.repeat(x2, run)
        h = gram_hashes(x1, x2, x3)
        order = np.argsort(h)
        first = _changes(h[order])
        pick = order[first]
        self.x1, self.x2, self.x3, self.h = x1[pick], x2[pick], x3[pick], h[pick]
        #: Occurrences, and those in texts that differ: copies would spoil the counts of counts that discounts are made of.
        self.c = np.add.reduceat(_values(grams, "of", np.int32)[order], first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
        self.u = np.diff(np.append(first, len(h)))
        self.pairs = gram_hashes(self.x2, self.x3)
        order = np.argsort(self.pairs)
        first = _changes(self.pairs[order])
        #: The last two words, and how many different words stand before; of hot middle words that is a part of them.
        self.y2, self.y3, self.before = self.x2[order[first]], self.x3[order[first]], np.diff(np.append(first, len(order)))
        self.hot = np.isin(self.y2, hot[0])

    def asked(self, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shards and words, in order, of the last words whose counts are needed, and how many different words stand before."""
        words, n = np.unique(self.y3[~self.hot], return_counts=True)
        shard = _shards(words, shards)
        order = np.argsort(shard, kind="stable")
        return shard[order], words[order], n[order]


def _counts_of_counts(c: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(c, 5), minlength=6)[1:5]


#: What shards of n-grams send to those of their last words: words and the number of those before, or for hot middle words all three numbers.
ASKED = "shard int, asker int, x2 binary, x3 binary, n binary, stats binary"
#: What they get: numbers of all different words before, in the order of their words, or with the words of hot middle ones.
#: ``kind`` 0 holds the words of the shard itself, ``kind`` 2 numbers for the discounts.
COUNTED = "kind int, shard int, asked int, x2 binary, x3 binary, c binary, d binary"


def word_counts(texts: DataFrame, slices: int, shards: int, hot: tuple) -> DataFrame:
    """COUNTED for the n-grams of trusted texts of a fold: one count of all, before their probabilities are known."""

    def ask(key: tuple, grams: pa.Table) -> pa.Table:
        found, out = Types(grams, hot), []
        stats = np.concatenate((_counts_of_counts(found.u), _counts_of_counts(found.before[~found.hot]))).astype(np.int64)
        shard, words, n = found.asked(shards)
        rows = _changes(shard)
        bounds = np.append(rows, len(shard))
        at = pa.array([key[0].as_py()])
        out.append(_batch(ASKED, shard=pa.array([key[0].as_py() % shards]), asker=at, stats=pa.array([stats.tobytes()])))
        if len(rows):
            ats = pa.array(np.full(len(rows), key[0].as_py()))
            out.append(_batch(ASKED, shard=pa.array(shard[rows]), asker=ats, x3=_cells(words, bounds), n=_cells(n.astype(np.int32), bounds)))
        y2, y3, n = (c[found.hot] for c in (found.y2, found.y3, found.before))
        shard = _shards(y3, shards)
        order = np.argsort(shard, kind="stable")
        rows = _changes(shard[order])
        if len(rows):
            bounds, ats = np.append(rows, len(shard)), pa.array(np.full(len(rows), key[0].as_py()))
            cells = {c: _cells(v[order], bounds) for c, v in (("x2", y2), ("x3", y3), ("n", n.astype(np.int32)))}
            out.append(_batch(ASKED, shard=pa.array(shard[order][rows]), asker=ats, **cells))
        return pa.Table.from_batches(out)

    def answer(key: tuple, asked: pa.Table) -> pa.Table:
        at, out = key[0].as_py(), []
        plain = asked.filter(pc.and_(pc.is_valid(asked["x3"]), pc.is_null(asked["x2"])))
        words, n = _values(plain, "x3", np.uint64), _values(plain, "n", np.int32)
        # of hot middle words, numbers of several shards are added up first
        spread = asked.filter(pc.is_valid(asked["x2"]))
        y2, y3, before = _values(spread, "x2", np.uint64), _values(spread, "x3", np.uint64), _values(spread, "n", np.int32)
        h = gram_hashes(y2, y3)
        order = np.argsort(h)
        first = _changes(h[order])
        before = np.add.reduceat(before[order], first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
        y2, y3 = y2[order[first]], y3[order[first]]
        known, of = np.unique(np.concatenate((words, y3)), return_inverse=True)
        c = np.bincount(of, weights=np.concatenate((n, np.ones(len(y3)))), minlength=len(known)).astype(np.int64)
        stats = sum((np.frombuffer(s, np.int64) for s in asked.column("stats").to_pylist() if s), np.zeros(8, np.int64))
        stats[4:] += _counts_of_counts(before)
        stats = np.concatenate((stats, _counts_of_counts(c), [len(known), c.sum()])).astype(np.int64)
        for kind, cells in ((0, {"x3": known, "c": c.astype(np.int32)}), (2, {"c": stats})):
            out.append(_batch(COUNTED, kind=pa.array([kind]), shard=pa.array([at]), **{k: pa.array([v.tobytes()]) for k, v in cells.items()}))
        if len(plain):
            bounds = np.cumsum(np.append(0, _sizes(plain, "n", np.int32)))
            same = {"kind": pa.array(np.ones(len(plain))), "asked": pa.array(np.full(len(plain), at))}
            out.append(_batch(COUNTED, shard=plain["asker"].combine_chunks(), c=_cells(c[of[: len(words)]].astype(np.int32), bounds), **same))
        if len(y2):
            c = c[of[len(words) :]].astype(np.int32)
            fan = hot[1][np.searchsorted(hot[0], y2)]
            for i in range(int(fan.max())):
                own = np.flatnonzero(fan > i)
                shard = _slices(y2[own], slices) * np.uint64(shards) + (_shards(y2[own], shards) + np.uint64(i)) % np.uint64(shards)
                order = np.argsort(shard, kind="stable")
                own, rows = own[order], _changes(shard[order])
                cells = {k: _cells(v[own], np.append(rows, len(own))) for k, v in (("x2", y2), ("x3", y3), ("c", c), ("d", before.astype(np.int32)))}
                same = {"kind": pa.array(np.ones(len(rows))), "asked": pa.array(np.full(len(rows), at))}
                out.append(_batch(COUNTED, shard=pa.array(shard[order][rows]), **cells, **same))
        return pa.Table.from_batches(out)

    grams = word_grams(texts, slices, None, shards, hot, True).select("shard", "x1", "x2", "run", "x3", "of")
    return grams.groupBy("shard").applyInArrow(ask, ASKED).groupBy("shard").applyInArrow(answer, COUNTED)


class Numbers:
    """What the whole model has in common: discounts by order and, by fold, the occurrences of words and what an unknown one costs besides its spelling."""

    def __init__(self, counted: Sequence[DataFrame]):
        stats = np.zeros((2, 14), np.int64)
        for fold, of in enumerate(counted):
            for r in of.where("kind = 2").select("c").collect():
                stats[fold] += np.frombuffer(r.c, np.int64)
        n = stats.sum(0).tolist()
        self.cuts = {i: np.array([0.0, *_cuts(*n[at : at + 4])]) for i, at in ((3, 0), (2, 4), (1, 8))}
        self.total = stats[:, 13].tolist()
        self.unknown = []
        for n1, n2, *_, words, total in stats[:, 8:].tolist():
            left = self.cuts[1] @ [0, n1, n2, words - n1 - n2]
            self.unknown.append(math.log(left / total) if total else 0.0)

    def cut(self, n: int, c: np.ndarray) -> np.ndarray:
        return self.cuts[n][np.minimum(c, 3)]

    def p(self, fold: int, c: np.ndarray) -> np.ndarray:
        """The probabilities of words that stand behind ``c`` different ones."""
        return (c - self.cut(1, c)) / max(self.total[fold], 1)


class Places:
    """Finds hashes among those given."""

    def __init__(self, h: np.ndarray):
        """``h`` is in order and without repeats."""
        bits = max(len(h).bit_length(), 1)
        self.shift = np.uint64(64 - bits)
        edges = np.arange(1 << bits, dtype=np.uint64) << self.shift
        self.start, self.h = np.searchsorted(h, edges).astype(np.int32), np.append(h, np.uint64((1 << 64) - 1))

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``h`` are found, and their places."""
        at, place, known = np.arange(len(h)), self.start[h >> self.shift], self.h[:-1]
        held = []
        # few share the bits that a search begins with
        while len(at):
            met, wanted = self.h[place], h[at]
            hit = (met == wanted) & (place < len(known))
            held.append((at[hit], place[hit]))
            on = np.flatnonzero(met < wanted)
            at, place = at[on], place[on] + 1
        found, places = (np.concatenate(c) for c in zip(*held, strict=True)) if held else (np.zeros(0, np.intp), np.zeros(0, np.int32))
        return found, places


class WordModel:
    """The model of the n-grams with a middle word of a shard.

    With p the probability of an n-gram's last word after the others, a seen n-gram has log p, less that of the next
    lower order and the weight which its context gives to that; an n-gram that is a context has the logarithm of
    that weight besides.  The sum over all n-grams of a text, spellings of unknown words included, is its log likelihood.
    """

    def __init__(self, found: Types, counted: pa.Table, numbers: Numbers, fold: int, shards: int):
        plain = counted.filter(pc.is_null(counted["x2"])).sort_by("asked")
        _, words, _ = found.asked(shards)
        c = _values(plain, "c", np.int32)
        if len(c) != len(words):
            raise ValueError(f"{len(words)} words were asked for, {len(c)} answered")
        order = np.argsort(words)
        own = ~found.hot
        c = c[order][np.searchsorted(words[order], found.y3[own])] if len(words) else c
        hot = counted.filter(pc.is_valid(counted["x2"]))
        y2 = np.concatenate((found.y2[own], _values(hot, "x2", np.uint64)))
        y3 = np.concatenate((found.y3[own], _values(hot, "x3", np.uint64)))
        p1 = numbers.p(fold, np.concatenate((c, _values(hot, "c", np.int32))))
        before = np.concatenate((found.before[own], _values(hot, "d", np.int32)))
        pairs = gram_hashes(y2, y3)
        order = np.argsort(pairs)
        pairs, y2, p1, before = (x[order] for x in (pairs, y2, p1, before))
        words, total, gamma, of = self._contexts(y2, before, numbers.cut(2, before))
        p2 = (before - numbers.cut(2, before)) / total[of] + gamma[of] * p1
        self.words, self.word_values = Places(words), np.log(gamma)
        self.pairs, self.pair_values = Places(pairs), np.log(p2) - np.log(p1) - np.log(gamma[of])
        lower = np.zeros(len(found.h))
        at, place = self.pairs.of(found.pairs)
        lower[at] = p2[place]
        contexts, total, gamma, of = self._contexts(gram_hashes(found.x1, found.x2), found.c, numbers.cut(3, found.c))
        p3 = (found.c - numbers.cut(3, found.c)) / total[of] + gamma[of] * lower
        self.contexts, self.context_values = Places(contexts), np.log(gamma)
        self.longest, self.longest_values = Places(found.h), np.log(p3) - np.log(lower) - np.log(gamma[of])

    @staticmethod
    def _contexts(h: np.ndarray, c: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, ...]:
        """Different contexts, what is counted in each, the weight it gives to the next lower order, and where each of ``h`` is among them."""
        order = np.argsort(h)
        first = _changes(h[order])
        of = np.empty(len(h), np.intp)
        of[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
        total = np.add.reduceat(c[order], first)
        return h[order[first]], total, np.add.reduceat(cut[order], first) / total, of

    def values(self, x1: np.ndarray, x2: np.ndarray, run: np.ndarray, x3: np.ndarray) -> np.ndarray:
        """What every n-gram adds to the likelihood of its text, besides that of its last word."""
        out = np.zeros(len(x1))
        found, place = self.words.of(x2)
        known = np.zeros(len(x2))
        known[found] = self.word_values[place]
        seen = np.zeros(len(x2), bool)
        seen[found] = True
        at = np.flatnonzero(np.repeat(seen, run))
        out[at] = np.repeat(known[seen], run[seen])
        x1, x2, x3 = x1[at], np.repeat(x2[seen], run[seen]), x3[at]
        found, place = self.contexts.of(gram_hashes(x1, x2))
        out[at[found]] += self.context_values[place]
        within = np.zeros(len(at), bool)
        within[found] = True
        found, place = self.pairs.of(gram_hashes(x2, x3))
        out[at[found]] += self.pair_values[place]
        both = found[within[found]]
        found, place = self.longest.of(gram_hashes(x1[both], x2[both], x3[both]))
        out[at[both[found]]] += self.longest_values[place]
        return out


def spellings(text: str, table: np.ndarray) -> np.ndarray:
    """The log likelihood of the characters of every word and of the one behind it."""
    classes, between = _classes(text)
    blank = np.ones(len(classes) + 2, bool)
    blank[1:-1] = between
    sums = np.zeros(len(classes) + 1)
    np.cumsum(np.take(table, _numbers(classes, ORDER)), dtype=np.float64, out=sums[1:])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    return sums[np.minimum(ends + 1, len(classes))] - sums[starts]


#: Words of a part of the texts, in runs: for each text that has one its place, how often it has it, and what that costs where the word is not known.
SINGLES = "shard int, batch long, n int, keys binary, x2 binary, run binary, of binary, k binary, s binary"
#: Places of texts in a part and what is added up for them.
SUMS = "batch long, n int, keys binary, at binary, sum binary"


def single_words(texts: DataFrame, shards: int, model: np.ndarray, unknown: list[float]) -> DataFrame:
    """The words of all texts, each with its end, to be met by the words of the other fold's model."""
    shared = texts.sparkSession.sparkContext.broadcast((model, unknown))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, missing = shared.value
        task = TaskContext.get().partitionId() << 32
        for part, (found, keys, _) in enumerate(_parts(it)):
            x, begins = word_hashes(found, 1 - (keys & 1))
            text = np.repeat(np.arange(len(found)), np.diff(begins))
            cost = np.zeros(len(x))
            costs = [spellings(t.decode(), table) + missing[1 - (k & 1)] for t, k in zip(found, keys.tolist(), strict=True)]
            cost[np.concatenate([np.arange(len(c)) + b + WORDS - 1 for c, b in zip(costs, begins)])] = np.concatenate(costs)
            before = np.zeros(len(x), bool)
            for i in range(WORDS - 1):
                before[begins[:-1] + i] = True
            where = np.flatnonzero(~before)
            rest = [keys]
            for begin in range(0, len(where), PLACES):
                here = where[begin : begin + PLACES]
                shard = _shards(x[here], shards)
                order = _order(shard, x[here])
                here, shard = here[order], shard[order]
                first = _changes(x[here], text[here])
                k, s = np.diff(np.append(first, len(here))), np.add.reduceat(cost[here], first)
                here, shard = here[first], shard[first]
                runs, rows = _changes(x[here]), _changes(shard)
                bounds, of_runs = np.append(rows, len(here)), np.searchsorted(runs, np.append(rows, len(here)))
                yield _batch(
                    SINGLES,
                    shard=pa.array(shard[rows]),
                    batch=pa.array(np.full(len(rows), task + part)),
                    n=pa.array(np.full(len(rows), len(found))),
                    keys=pa.array([k.tobytes() for k in rest] + [None] * (len(rows) - len(rest)), pa.binary()),
                    x2=_cells(_short(x[here[runs]]), of_runs),
                    run=_cells(np.diff(np.append(runs, len(here))).astype(np.int32), of_runs),
                    of=_cells(text[here].astype(_kind(len(found))), bounds),
                    k=_cells(k.astype(np.int32), bounds),
                    s=_cells(s.astype(np.float32), bounds),
                )
                rest = []

    return texts.mapInArrow(run, SINGLES)


def _numbered(rows: pa.Table, name: str, n: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Places of texts in parts of ``n`` texts as places among all, where those of a part begin at ``base``."""
    cells = zip(rows.column(name).to_pylist(), n.tolist(), base.tolist())
    return np.concatenate([np.frombuffer(c, _kind(m)).astype(np.int64) + b for c, m, b in cells])


def _pieces(rows: pa.Table, name: str) -> Iterator[pa.Table]:
    """Rows in pieces whose cells of a column hold about PIECE bytes each."""
    held = np.cumsum(pc.binary_length(rows.column(name)).to_numpy())
    bounds = np.append(_changes(held // PIECE), len(rows)).tolist()
    for begin, end in zip(bounds, bounds[1:]):
        yield rows.slice(begin, end - begin)


def _sums(rows: pa.Table, name: str, values: Callable[[pa.Table], np.ndarray]) -> pa.Table:
    """SUMS of the values of all rows of GRAMS or SINGLES, found piece by piece, which bounds what is held beside them."""
    return pa.concat_tables([_tables([], SUMS), *(_added(piece, values(piece)) for piece in _pieces(rows, name))])


def _added(rows: pa.Table, values: np.ndarray) -> pa.Table:
    n = rows.column("n").to_numpy()
    base = np.cumsum(np.append(0, n))
    of = _numbered(rows, "of", n, base)
    total = np.bincount(of, weights=values, minlength=base[-1]).astype(np.float64)
    there = np.flatnonzero(total)
    bounds = np.searchsorted(there, base)
    at = there - np.repeat(base[:-1], np.diff(bounds))
    kinds = [_kind(m) for m in n.tolist()]
    cells = [at[a:b].astype(k).tobytes() for a, b, k in zip(bounds, bounds[1:], kinds)]
    same = {c: rows.column(c).combine_chunks() for c in ("batch", "n", "keys")}
    return pa.Table.from_batches([_batch(SUMS, at=pa.array(cells, pa.binary()), sum=_cells(total[there], bounds), **same)])


def sums_of_words(words: DataFrame, counted: DataFrame, numbers: Numbers, fold: int) -> DataFrame:
    """SUMS of the values of single words: log p, or what an unknown one costs; the tables meet by shards."""

    def met(texts: pa.Table, known: pa.Table) -> pa.Table:
        words, costs = Places(_values(known, "x3", np.uint64)), np.log(numbers.p(fold, _values(known, "c", np.int32)))

        def values(piece: pa.Table) -> np.ndarray:
            x, run = _long(_values(piece, "x2", np.uint8)), _values(piece, "run", np.int32)
            value, seen = np.zeros(len(x)), np.zeros(len(x), bool)
            found, place = words.of(x)
            value[found], seen[found] = costs[place], True
            return np.where(np.repeat(seen, run), _values(piece, "k", np.int32) * np.repeat(value, run), _values(piece, "s", np.float32))

        return _sums(texts, "k", values)

    known = counted.where("kind = 0").select("shard", "x3", "c")
    return words.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(met, SUMS)


def sums_of_grams(grams: DataFrame, trusted: DataFrame, counted: DataFrame, numbers: Numbers, fold: int, shards: int, hot: tuple) -> DataFrame:
    """SUMS of the values of the n-grams of texts, by the model of trusted ones; the tables meet by shards."""

    def met(texts: pa.Table, model: pa.Table) -> pa.Table:
        found, answers = Types(model.filter(pc.is_valid(model["x1"])), hot), model.filter(pc.is_valid(model["c"]))
        known = WordModel(found, answers, numbers, fold, shards)
        return _sums(texts, "x1", lambda piece: known.values(*_words_of(piece)))

    rows = trusted.select("shard", "x1", "x2", "run", "x3", "of").unionByName(counted.select("shard", "asked", "x2", "x3", "c", "d"), allowMissingColumns=True)
    return grams.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(met, SUMS)


def by_text(sums: DataFrame, tasks: int) -> DataFrame:
    """(key, sum): what shards have added up for the texts of every part."""

    def total(rows: pa.Table) -> pa.Table:
        n, batch = rows.column("n").to_numpy(), rows.column("batch").to_numpy()
        _, first, of = np.unique(batch, return_index=True, return_inverse=True)
        base = np.cumsum(np.append(0, n[first]))
        at = _numbered(rows, "at", n, base[of])
        total = np.bincount(at, weights=_values(rows, "sum", np.float64), minlength=base[-1]).astype(np.float64)
        keys = np.empty(base[-1], np.int64)
        for i, k in enumerate(rows.column("keys").to_pylist()):
            if k:
                keys[base[of[i]] : base[of[i] + 1]] = np.frombuffer(k, np.int64)
        return pa.table({"key": keys, "sum": total})

    placed = sums.withColumn("task", F.pmod(F.xxhash64("batch"), F.lit(tasks)))
    return placed.groupBy("task").applyInArrow(total, "key long, sum double")


def keyed(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, lang, n_points, key); null counts as empty.  Carried columns come first, by the names _c0, _c1 and so on."""
    return docs.select(
        *[quoted(c).alias(f"_c{i}") for i, c in enumerate(carry)],
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("lang", F.lit(NONE)).alias("lang"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_points"),
        _key(F.col("text")).alias("key"),
    )


class Scorer:
    """The losses of the texts of ``docs`` by a model of the trusted ones among them, a row per text."""

    def __init__(self, docs: DataFrame, trusted: DataFrame, settled: bool = False):
        """``settled`` trusted texts are removed."""
        spelling = train(trusted)
        slices = min(1 + (trusted.agg(F.sum(F.length("text"))).head()[0] or 0) // SLICE, SLICES)
        once = settle(_once(trusted), "trusted-once")
        if settled:
            discard(trusted)
        shards = max(parts(docs) // 5, LEAST_SHARDS)
        hot = frequent_words(once, HOT, shards) if slices == SLICES else (np.zeros(0, np.uint64),) * 2
        given = docs.where("text <> ''").select(utf8(F.col("text")).alias("text"), _key(F.col("text")).alias("key"), F.lit(1).alias("m"))
        counted = [settle(word_counts(_of_fold(once, f), slices, shards, hot), "word-counts", by="kind") for f in (0, 1)]
        numbers, sums = Numbers(counted), []
        for f in (0, 1):
            texts, model = _of_fold(given, 1 - f), _of_fold(once, f)
            words = single_words(texts, shards, spelling, numbers.unknown)
            sums.append(settle(by_text(sums_of_words(words, counted[f], numbers, f), shards), "word-sums"))
            answers = counted[f].where("kind = 1").withColumn("slice", F.expr(f"shard div {shards}")).withColumn("shard", F.expr(f"shard % {shards}"))
            for at in range(slices):
                grams, trusted_grams = (word_grams(t, slices, at, shards, hot, own) for t, own in ((texts, False), (model, True)))
                met = sums_of_grams(grams, trusted_grams, answers.where(F.col("slice") == at), numbers, f, shards, hot)
                sums.append(settle(by_text(met, shards), "word-sums"))
            discard(counted[f])
        discard(once)
        sums = reduce(DataFrame.unionByName, sums).groupBy("key").agg((-F.sum("sum")).alias("sum"))
        self.rows = settle(keyed(docs).groupBy("key").agg(F.count("*").alias("n")), "texts")
        # the copies of a text have met the same n-grams each
        self.losses = settle(self.rows.join(sums, "key").select("key", (F.col("sum") / F.col("n")).alias("loss")), "losses")

    def scores(self, docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
        """``keyed`` with the loss of every text: its negative log likelihood."""
        found = attach(keyed(docs, carry), self.losses, "key", self.rows)
        return found.drop("key").withColumn("loss", F.coalesce("loss", F.lit(0.0)))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that every label row calls good and none toxic."""
    return (
        labels.where("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
        .where("q = 1 AND t = 0")
        .select("doc_id")
    )


class Bounds:
    """What decides: the models, and per language the typical loss and the bounds of the perplexity."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        with shuffles_removed(docs.sparkSession):
            self._found(docs, labels)

    def _found(self, docs: DataFrame, labels: DataFrame) -> None:
        ids = settle(trusted_ids(labels), "trusted")
        texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        # ids grow with the corpus, so they are never broadcast: the plan is the same at every size
        trusted = settle(texts.join(ids.hint("merge"), "doc_id", "left_semi").select("text"), "trusted-texts")
        self.scorer = Scorer(docs, trusted, settled=True)
        self.each = settle(self.scorer.scores(docs), "scores")
        self.rows = settle(self.each.groupBy("lang").agg(F.count("*").alias("n")), "languages")
        known = settle(self.each.join(ids, "doc_id", "left_semi").where("n_points > 0"), "known")
        loss, points = known.agg(F.sum("loss"), F.sum("n_points")).head()
        self.mean = loss / points if points else 0.0
        own = known.groupBy("lang").agg((F.sum("loss") / F.sum("n_points")).alias("typical"), F.count("*").alias("n"))
        self.typical = settle(own.select("lang", self._shared("typical", self.mean, SHARED_LOSS).alias("typical")), "typical")
        # how far a text is from the typical loss of its language is comparable over languages;
        # map-side sketches of fixed size, so a language may hold most rows
        away = F.log("perplexity") - F.coalesce("typical", F.lit(self.mean))
        cuts = F.percentile_approx("away", [LOW, HIGH], ACCURACY).alias("q")
        steady = settle(self.steady(known).withColumn("away", away), "steady")
        overall = steady.agg(cuts).head()[0] or [None, None]
        self.overall = [math.exp(self.mean + z) if z is not None else None for z in overall]
        bounds = steady.groupBy("lang").agg(cuts, F.count("*").alias("n"), F.first("typical").alias("t"))
        cut = [F.exp(F.col("t") + self._shared(F.col("q")[i], overall[i], SHARED)) for i in (0, 1)]
        # one row per language
        self.table = settle(self.typical.join(bounds.select("lang", F.array(*cut).alias("q")), "lang", "left"), "bounds")

    @staticmethod
    def _shared(own: str | Column, all_: float | None, others: int) -> Column:
        """A language's value, with that of all languages counted as ``others`` documents more: it moves without a jump."""
        value = F.col(own) if isinstance(own, str) else own
        return (F.col("n") * value + F.lit(others) * F.lit(all_).cast("double")) / (F.col("n") + F.lit(others))

    def steady(self, scored: DataFrame, table: DataFrame | None = None) -> DataFrame:
        """Scored rows with their perplexity, PRIOR characters of typical loss included."""
        found = attach(scored, self.typical if table is None else table, "lang", self.rows)
        typical, n = F.coalesce("typical", F.lit(self.mean)), F.col("n_points")
        value = F.exp((F.col("loss") + F.lit(PRIOR) * typical) / (n + F.lit(PRIOR)))
        return found.withColumn("perplexity", F.when(n > 0, value))

    def judged(self, scored: DataFrame) -> DataFrame:
        """Scored rows with perplexity, low, high and kept."""
        low, high = (F.coalesce(F.col("q")[i], F.lit(self.overall[i]).cast("double")) for i in (0, 1))
        out = self.steady(scored, self.table).withColumns({"low": low, "high": high})
        # the documents that the quantiles are taken from are inside, whatever order their sums were rounded in
        inside = F.col("perplexity").between(F.col("low") * F.lit(1 - ROUNDING), F.col("high") * F.lit(1 + ROUNDING))
        inside = F.coalesce(inside, F.lit(True))
        return out.withColumn("kept", F.col("perplexity").isNotNull() & inside)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, n_points, perplexity, low, high, kept) for every row of ``docs``.

    Empty and null texts have no perplexity and are rejected.  Rows that repeat an id are judged
    by their own text.  Without any trusted text nothing tells good from bad, and all others are kept.
    """
    bounds = Bounds(docs, labels)
    columns = ("n_points", "perplexity", "low", "high", "kept")
    return bounds.judged(bounds.each).select("doc_id", F.nullif("lang", F.lit(NONE)).alias("lang"), *columns)


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Losses are joined with them by text, so that rows that repeat an id are judged by their own.
    """
    kept = Bounds(docs, labels)
    kept = kept.judged(kept.scorer.scores(docs, docs.columns)).where("kept")
    return kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
