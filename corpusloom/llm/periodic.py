"""Maximal periodic runs of words, found by internal pattern matching.

If a run has period p, the words that equal those p places on are at least max(p, 12 - p) in a row,
so they hold a block of a fixed grid: blocks of 4 words at every third word for periods up to 14,
blocks of b = 8, 16, ... words at multiples of b for periods from 2b - 1 to 4b - 2.  The occurrences
of a block in a window of b + 1 places form one arithmetic progression.  They are asked of a wavelet
tree over the suffix array: the block's suffixes are an interval of the array, and the next place in
it from the window's start on is a range successor.  The differences are candidate periods; each is
extended to both sides by the names of equal dyadic blocks, and kept if the run is long enough.

Texts are taken in batches of bounded size (one text, if longer) by numpy; equal words of different
texts get different names, so a batch is one text to the method.  Only words whose next four recur
in their text enter the suffix array.  Memory is 4 bytes a word and level, of which there are as many
as the longest repeat of a text has doublings.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.functions.text import quoted
from corpusloom.llm.common import utf8

#: A run has at least so many words, and twice its period.
SHORTEST = 12
#: Words taken at a time.
BATCH = 200_000
#: Least block, as the number of doublings of one word, and the grid and periods of such blocks.
FIRST_LEVEL, FIRST_STEP, FIRST_PERIODS = 2, 3, 14


class Wavelet:
    """A wavelet tree over ``values`` below ``size``; queries are arrays and answered at once."""

    def __init__(self, values: np.ndarray, size: int):
        self.levels = []
        for bit in reversed(range(size.bit_length())):
            high = values >> bit & 1 == 1
            self.levels.append((bit, np.concatenate(([0], np.cumsum(~high)))))
            values = np.concatenate((values[~high], values[high]))

    def below(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many of the values at low..high - 1 are smaller than ``value``, at most ``size``."""
        found = np.zeros(len(low), np.int64)
        for bit, zeros in self.levels:
            one = value >> bit & 1 == 1
            a, b = zeros[low], zeros[high]
            found += np.where(one, b - a, 0)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return found

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest, from 0, of the values at low..high - 1."""
        found = np.zeros(len(low), np.int64)
        for bit, zeros in self.levels:
            a, b = zeros[low], zeros[high]
            one = k >= b - a
            found |= np.where(one, 1 << bit, 0)
            k = np.where(one, k - (b - a), k)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return found


def block_names(text: np.ndarray) -> list[np.ndarray]:
    """For every level k the names of the blocks of 2**k words, -1 where a block occurs once.

    Names are in the order of the blocks, so that they sort suffixes.  ``text`` holds -1 behind every document.
    """
    names: list[np.ndarray] = []
    key, at = text[text >= 0], np.flatnonzero(text >= 0)
    while len(at):
        _, place, n = np.unique(key, return_inverse=True, return_counts=True)
        again = n > 1
        if not again.any():
            break
        level = np.full(len(text), -1, np.int32)
        level[at] = np.where(again, np.cumsum(again) - 1, -1)[place]
        names.append(level)
        width = 1 << len(names) - 1
        at = np.flatnonzero(level[:-width] >= 0)
        at = at[level[at + width] >= 0]
        key = level[at].astype(np.int64) * len(text) + level[at + width]
    return names


def _same_after(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from i < j on are equal."""
    out, last = np.zeros(len(i), np.int64), len(names[0]) - 1
    for k in reversed(range(len(names))):
        a, b = names[k][np.minimum(i + out, last)], names[k][np.minimum(j + out, last)]
        out += np.where((a == b) & (a >= 0), 1 << k, 0)
    return out


def _same_before(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before i < j are equal."""
    out = np.zeros(len(i), np.int64)
    for k in reversed(range(len(names))):
        at = i - out - (1 << k)
        a, b = names[k][np.maximum(at, 0)], names[k][np.maximum(at, 0) + j - i]
        out += np.where((at >= 0) & (a == b) & (a >= 0), 1 << k, 0)
    return out


def _candidates(names: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j): block i occurs again at j, and j - i may be the period of a run."""
    places = np.flatnonzero(names[FIRST_LEVEL] >= 0)
    order = np.lexsort([level[places] for level in reversed(names[FIRST_LEVEL:])])
    tree = Wavelet(order, len(places))
    found = []
    for k in range(FIRST_LEVEL, len(names)):
        width = 1 << k
        step, low, high = (FIRST_STEP, 1, FIRST_PERIODS) if k == FIRST_LEVEL else (width, 2 * width - 1, 4 * width - 2)
        blocks = places[(places % step == 0) & (names[k][places] >= 0)]
        listed = names[k][places[order]]
        alive = np.flatnonzero(listed >= 0)
        listed, own = listed[alive], names[k][blocks]
        first = alive[np.searchsorted(listed, own)]
        behind = alive[np.searchsorted(listed, own, "right") - 1] + 1
        for start in range(low, high + 1, width + 1):
            stop = min(start + width, high)
            a, b = np.searchsorted(places, blocks + start), np.searchsorted(places, blocks + stop, "right")
            some = a < b
            found.append(_in_window(names, tree, places, blocks[some], first[some], behind[some], a[some], b[some]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _in_window(names, tree, places, blocks, first, behind, a, b) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) for the occurrences of each block at places[a..b - 1]."""
    before = tree.below(first, behind, a)
    n = tree.below(first, behind, b) - before
    some = n > 0
    blocks, first, behind, before, n = (x[some] for x in (blocks, first, behind, before, n))
    nearest = places[tree.smallest(first, behind, before)]
    many = n > 1
    gap = np.zeros(len(blocks), np.int64)
    gap[many] = places[tree.smallest(first[many], behind[many], before[many] + 1)] - nearest[many]
    # Three or more overlap, so that all have the gap as a period.  If the block's own stretch of this
    # period reaches them, a run with another period here would have a smaller one as well.
    most = n > 2
    inside = np.zeros(len(blocks), bool)
    inside[most] = _same_after(names, blocks[most], blocks[most] + gap[most]) >= nearest[most] - blocks[most]
    n = np.where(inside, nearest - blocks == gap, n)
    i = np.repeat(blocks, n)
    nth = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
    return i, np.repeat(nearest, n) + nth * np.repeat(gap, n)


def find_runs(text: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal runs, by start and period; -1 in ``text`` ends a document.

    ``shortest`` is 12 at least: shorter runs need not hold a block.
    """
    if shortest < SHORTEST:
        raise ValueError(f"runs of under {SHORTEST} words are not looked for")
    names = block_names(text)
    if len(names) <= FIRST_LEVEL:
        return (np.zeros(0, np.int64),) * 3
    i, j = _candidates(names)
    period = j - i
    start, end = i - _same_before(names, i, j), j + _same_after(names, i, j)
    long = end - start >= np.maximum(shortest, 2 * period)
    start, end, period = start[long], end[long], period[long]
    # the same stretch is met from several blocks, and with multiples of its period
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.append(True, (np.diff(start) != 0) | (np.diff(end) != 0))[: len(start)]
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


def _batch_runs(texts: list[list[bytes]]) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """The runs of each text, and the text without the words of a run after its first period."""
    number = defaultdict(count().__next__)
    sizes = np.array([len(t) for t in texts], np.int64)
    firsts = np.cumsum(sizes + 1) - (sizes + 1)
    ids = [np.fromiter(map(number.__getitem__, t), np.int64, len(t)) for t in texts]
    text = np.full(int(sizes.sum()) + len(texts), -1, np.int64)
    for n, (first, part) in enumerate(zip(firsts.tolist(), ids, strict=True)):
        text[first : first + len(part)] = part + n * len(number)
    start, length, period = find_runs(text)
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.cumsum(change) == 0
    bounds = np.searchsorted(start, np.append(firsts, len(text))).tolist()
    for n, (first, words) in enumerate(zip(firsts.tolist(), texts, strict=True)):
        own = slice(bounds[n], bounds[n + 1])
        if own.start == own.stop:
            yield [], b" ".join(words)
        else:
            found = zip((start[own] - first).tolist(), length[own].tolist(), period[own].tolist(), strict=True)
            yield list(found), b" ".join(compress(words, kept[first : first + len(words)].tolist()))


def runs(
    docs: DataFrame,
    edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed) for every row of ``docs``.

    Words are the longest stretches without space, tab and line ends; ``start`` counts them from 0.
    Runs are in the order of start and period.  ``collapsed`` is the text without words that a run
    holds after its first period, joined by single spaces.  A null text has no words; repeated rows and
    null ids give a row each.  ``edit`` may change the words, given in UTF-8, before they are searched.
    """
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", run_type), ("collapsed", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
            found, collapsed = zip(*_batch_runs(texts), strict=True)
            named = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in some] for some in found]
            columns = (ids, [len(t) for t in texts], named, collapsed)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        ids, texts, held = [], [], 0
        for batch in it:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = text.as_py().split()
                if edit:
                    words = edit(doc_id, words)
                if texts and held + len(words) > BATCH:
                    yield flush(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(doc_id)
                texts.append(words)
                held += len(words) + 1
        if texts:
            yield flush(ids, texts)

    narrow = docs.select(quoted(id_col).cast("long").alias("doc_id"), utf8(quoted(text_col)).alias("text"))
    found = narrow.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """For one id in ten the words from a place on become repetitions of the first of them; a null id changes nothing."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    at = g % n
    part = words[at : at + 1 + (n - at) // (3 + g % 8)]
    return words[:at] + (part * (-(-(n - at) // len(part))))[: n - at]


def report(found: DataFrame) -> DataFrame:
    """Digests of ``runs`` and its longest run: of equal length the first, then that with the smaller period."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("_b", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_b.s")).alias("start"),
        F.col("_b.n").alias("length"),
        (-F.col("_b.p")).alias("period"),
        F.expr("1000 * _b.n div -_b.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
