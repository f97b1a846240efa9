"""Document fingerprints by winnowing.

Rolling hashes of K characters; the smallest of every WINDOW hashes in a row is chosen, the
rightmost of equal ones, and kept with its position.  Two texts that share K + WINDOW - 1
characters in a row share a fingerprint hash there; shorter than K they share none by chance.
Texts whose first two thirds are shorter than that keep all their hashes, which hold those any
window would choose: two short texts that share K characters in a row share a hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.text import quoted
from corpusloom.llm.common import batches, parts

K = 8
WINDOW = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def gram_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """32-bit hashes of all runs of k code points; a shorter text is one run."""
    x = _mixed(points.astype(np.uint64) + np.uint64(0x1234567))
    k = min(k, len(x))
    out = np.zeros(len(x) - k + 1, np.uint64)
    power = _powers(k)
    n = len(out)
    # a sum of k shifted copies: as cheap as rolling here, and free of its carried state
    for i in range(k):
        out += x[i : i + n] * power[k - 1 - i]
    return (_mixed(out) >> np.uint64(32)).astype(np.uint64)


def winnow(points: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of a text given as code points; positions ascend."""
    if not len(points):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes = gram_hashes(points, k)
    low = np.uint64(0xFFFFFFFF)
    # hash above, position reversed below: the minimum is the smallest hash, rightmost of equal ones
    keys = (hashes << np.uint64(32)) | (low - np.arange(len(hashes), dtype=np.uint64))
    width = 1
    window = min(window, len(keys))
    while 2 * width <= window:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    if width < window:
        keys = np.minimum(keys[: len(keys) - (window - width)], keys[window - width :])
    chosen = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return chosen >> np.uint64(32), (low - (chosen & low)).astype(np.int64)


def written(hashes: np.ndarray, positions: np.ndarray) -> str:
    """``hash:position`` items, both hexadecimal, joined by blanks."""
    pairs = np.empty(2 * len(hashes), np.int64)
    pairs[0::2], pairs[1::2] = hashes, positions
    return (("%08x:%x " * len(hashes)) % tuple(pairs.tolist()))[:-1]


def written_after(before: str, one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> str:
    """``written(*other)``, given that of ``one``: what both begin with is not written again."""
    n = min(len(one[0]), len(other[0]))
    differ = np.flatnonzero((one[0][:n] != other[0][:n]) | (one[1][:n] != other[1][:n]))
    same = int(differ[0]) if len(differ) else n
    # eight digits, a colon, the digits of the position and a blank each
    size, least = 11 * same, 16
    while same and least <= one[1][same - 1]:
        size += same - int(np.searchsorted(one[1][:same], least))
        least *= 16
    rest = written(other[0][same:], other[1][same:])
    return before[:size] + rest if rest else before[: max(size - 1, 0)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared share of the different hashes of both; 1 for two empty texts."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def chosen(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of a text; all of them where two thirds of it guarantee no shared window."""
    short = len(text) - len(text) // 3 < k + window - 1
    return winnow(_points(text), k, 1 if short else window)


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """(doc_id, hash long, position long): one row per chosen hash, for joins on shared passages."""
    schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("position", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in it:
                for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    h, p = chosen(text.as_py(), k, window)
                    for pair in zip(h.tolist(), p.tolist(), strict=True):
                        yield (i, *pair)

        yield from batches(rows(), schema, 50_000)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, hash long, position long")


def _bucket(bounds: list[int], doc_id: Column) -> Column:
    """How many of the descending bounds lie above doc_id, by halving steps."""
    if not bounds:
        return F.lit(0)
    held = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: F.when((at + s <= len(bounds)) & (F.get(held, at + s - 1) > doc_id), at + s).otherwise(at),
    )


def edited_fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    The edited text has its last third replaced by as much of the start of the next document in
    descending doc_id (after the last: the first).  Null texts are empty, null ids come last, and
    rows that repeat an id follow each other by text.  Every row gives one row.

    Texts are moved once, to ranges of doc_id; the first document of each range is copied to the
    range before, so each range holds the followers of all its documents.
    """
    spark = docs.sparkSession
    narrow = docs.select(quoted("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # null ids are put behind all others
    last = F.lit(-(2**63)).cast("long")
    narrow = narrow.withColumn("_key", F.coalesce("doc_id", last))
    ranges = 4 * parts(docs)
    shares = [i / ranges for i in range(ranges - 1, 0, -1)]
    cuts = narrow.agg(F.percentile_approx("_key", shares, 10 * ranges)).head()[0] or []
    bounds = sorted(set(cuts), reverse=True)
    dealt = narrow.withColumn("_range", _bucket(bounds, F.col("_key")))
    # one row per range: the bounds of a range partitioning, on the driver as Spark holds its own
    firsts = sorted(dealt.groupBy("_range").agg(F.max("_key").alias("_key")).collect())
    before = [(r["_key"], firsts[i - 1]["_range"]) for i, r in enumerate(firsts)]
    guests = dealt.drop("_range").join(F.broadcast(spark.createDataFrame(before, "_key long, _range int")), "_key")
    moved = (
        dealt.withColumn("_guest", F.lit(False))
        .unionByName(guests.withColumn("_guest", F.lit(True)))
        .repartition(parts(docs), "_range")
        .sortWithinPartitions("_range", "_guest", F.desc("_key"), "text")
        .select("_range", "_guest", "doc_id", "text")
    )
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
         ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    )

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(one: tuple, after: tuple) -> tuple:
            doc_id, text, (h, p) = one
            n = len(text)
            third = n // 3
            edited = text[: n - third] + after[1][:third]
            eh, ep = chosen(edited, k, window)
            digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            print_ = written(h, p)
            return doc_id, n, digest, print_, written_after(print_, (h, p), (eh, ep)), likeness(h, eh), likeness(h, after[2][0])

        def rows():
            held, at = None, None  # the document that waits for its follower, and its range
            done = True
            for batch in it:
                for r, guest, doc_id, text in zip(
                    batch.column("_range").to_pylist(), batch.column("_guest").to_pylist(),
                    batch.column("doc_id").to_pylist(), batch.column("text"), strict=True,
                ):
                    if r != at:
                        held, at, done = None, r, False
                    if done:  # more rows that repeat the guest's id
                        continue
                    text = text.as_py()
                    now = (doc_id, text, chosen(text, k, window))
                    if held is not None:
                        yield compared(held, now)
                    held, done = now, guest

        yield from batches(rows(), schema, 2_000)

    return moved.mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
