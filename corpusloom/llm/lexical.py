"""Ranked lexical search by exact inner products in sparse ball trees.

A document is a vector with one axis per term of the queries: the term's weight times its
saturated frequency, in 64-bit integers.  A query asks for the documents with the largest sum
over its axes.  Every task builds ball trees over blocks of its documents: a node keeps the
centroid of its documents, the radius of the ball round it, and how far it reaches along each
axis.  No document below a node can score above

    min(<q, centroid> + |q| * radius, <q, centroid + reach>),

which is rounded up, so best-first search ends at the first node below the k-th best score found
and loses nothing.  Documents in leaves are scored in integers.  The best of every task are merged.

Queries are taken in blocks of bounded size, each held against all documents.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.text import quoted
from corpusloom.llm.common import utf8
from corpusloom.operators.scratch import settle

TOP = 50
#: Documents in a leaf, and documents and vector entries in one tree: they bound a task's memory.
LEAF = 32
BLOCK_DOCS = 16_384
BLOCK_ENTRIES = 2_000_000
#: Terms of queries that are searched for at a time: bounds what a task is handed.
QUERY_TERMS = 200_000
#: Bytes of a text that are cut into terms at a time.
CHUNK = 1 << 22
#: Share by which a bound is raised: above the error of a sum of 2**20 doubles.
SLACK = 2.0**-32
#: Tasks' best rows are merged in so many parts of a query before they meet.
MERGE = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What each byte of UTF-8 becomes: letters and digits stay, A-Z lower-cased, bytes from 128 on belong to terms.
FOLD = bytes(b | 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: Column) -> Column:
    """Array of the terms of ``text``, repeats included; empty for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({TERM})"), F.lit(1))


def term_counts(text: bytes) -> Counter:
    """How often each term occurs in a text given in UTF-8."""
    if len(text) <= CHUNK:
        return Counter(text.translate(FOLD).split())
    folded, out, at = text.translate(FOLD), Counter(), 0
    while at < len(folded):
        end = folded.find(b" ", at + CHUNK)
        end = len(folded) if end < 0 else end
        out.update(folded[at:end].split())
        at = end
    return out


def _vectors(docs: DataFrame, axes: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, axes, tf): number of terms, and the query terms met with their frequencies."""
    ints = pa.list_(pa.int32())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                total, met, tf, ends = [], [], [], [0]
                for text in part.column("text"):
                    counts = term_counts(text.as_py())
                    total.append(counts.total())
                    shared = counts.keys() & axes.keys()
                    met += map(axes.__getitem__, shared)
                    tf += map(counts.__getitem__, shared)
                    ends.append(len(met))
                offsets = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32()), type=ints) for x in (met, tf)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(total, pa.int64()), *lists], ["doc_id", "n", "axes", "tf"])

    narrow = docs.select(quoted(id_col).cast("long").alias("doc_id"), utf8(quoted(text_col)).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n long, axes array<int>, tf array<int>")


class BallTree:
    """Documents as rows (starts, axes, values) of integers > 0, none empty, under nested balls."""

    def __init__(self, starts: np.ndarray, axes: np.ndarray, values: np.ndarray, width: int, leaf: int = LEAF):
        lengths = np.diff(np.append(starts, len(axes)))
        order = np.arange(len(starts))
        self.spans, self.children, self.radius = [(0, len(starts))], [None], []
        kept = []  # (axes, node, centroid, highest) of each node
        at = 0
        while at < len(self.spans):
            low, high = self.spans[at]
            rows = order[low:high]
            ends = np.cumsum(lengths[rows])
            firsts = ends - lengths[rows]
            entries = np.arange(ends[-1]) + np.repeat(starts[rows] - firsts, lengths[rows])
            a, v = axes[entries], values[entries]
            met, place = np.unique(a, return_inverse=True)
            centre = np.rint(np.bincount(place, weights=v) / len(rows))
            highest = np.zeros(len(met), np.int64)
            np.maximum.at(highest, place, v)
            kept.append((met, np.full(len(met), at), centre, highest))
            # |d - c|^2 = |c|^2 + sum of d * (d - 2c) over the axes of d
            part = v * (v - 2.0 * centre[place])
            base = float(centre @ centre)
            far = np.add.reduceat(part, firsts)
            error = (np.add.reduceat(np.abs(part), firsts).max() + base) * SLACK
            self.radius.append(math.sqrt(max(far.max() + base, 0.0) + error) * (1 + SLACK))
            if len(rows) > leaf:
                dense = np.zeros(len(met))
                one = int(far.argmax())
                towards = self._dots(one, place, v, firsts, ends, dense)
                other = int((np.add.reduceat(v.astype(float) ** 2, firsts) - 2 * towards).argmax())
                turned = np.argsort(towards - self._dots(other, place, v, firsts, ends, dense), kind="stable")
                order[low:high] = rows[turned]
                middle = (low + high) // 2
                self.children[at] = (len(self.spans), len(self.spans) + 1)
                self.spans += [(low, middle), (middle, high)]
                self.children += [None, None]
            at += 1
        self.order = order
        ends = np.cumsum(lengths[order])
        self.starts = np.append(ends - lengths[order], ends[-1])
        entries = np.arange(ends[-1]) + np.repeat(starts[order] - self.starts[:-1], lengths[order])
        self.axes, self.values = axes[entries], values[entries]
        self.radius = np.array(self.radius)
        by_axis, node, centre, highest = (np.concatenate(x) for x in zip(*kept, strict=True))
        sort = np.argsort(by_axis, kind="stable")
        self.node, self.centre, self.highest = node[sort], centre[sort], highest[sort].astype(float)
        self.first = np.searchsorted(by_axis[sort], np.arange(width + 1))

    @staticmethod
    def _dots(row: int, place: np.ndarray, v: np.ndarray, firsts: np.ndarray, ends: np.ndarray, dense: np.ndarray) -> np.ndarray:
        own = slice(firsts[row], ends[row])
        dense[:] = 0
        dense[place[own]] = v[own]
        return np.add.reduceat(v * dense[place], firsts)

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """For every node a number that no score below it exceeds; sums of integers in doubles are exact here."""
        spans = [slice(self.first[a], self.first[a + 1]) for a in query]
        node = np.concatenate([self.node[s] for s in spans])
        n = len(self.radius)
        reach = np.bincount(node, np.concatenate([self.highest[s] for s in spans]), n)
        centre = np.bincount(node, np.concatenate([self.centre[s] for s in spans]), n)
        ball = (centre + math.sqrt(len(query)) * self.radius) * (1 + SLACK) + 1
        return np.minimum(reach, ball)

    def search(self, query: np.ndarray, marks: np.ndarray, best: list, top: int, keys: list) -> int:
        """Put the best rows for the axes ``query``, which ``marks`` holds as ones, into the heap ``best`` of (score, -key).

        Returns how many leaves were scored.
        """
        bounds = self.bounds(query).tolist()
        todo, scored = [(-bounds[0], 0)], 0
        while todo:
            bound, node = heapq.heappop(todo)
            # an equal score may still win by its smaller id
            if bound == 0 or (len(best) == top and -bound < best[0][0]):
                break
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(todo, (-bounds[child], child))
                continue
            scored += 1
            low, high = self.spans[node]
            own = slice(self.starts[low], self.starts[high])
            scores = np.add.reduceat(self.values[own] * marks[self.axes[own]], self.starts[low:high] - self.starts[low])
            least = max(best[0][0], 1) if len(best) == top else 1
            for i in np.flatnonzero(scores >= least).tolist():
                found = (int(scores[i]), -keys[self.order[low + i]])
                if len(best) < top:
                    heapq.heappush(best, found)
                else:
                    heapq.heappushpop(best, found)
        return scored


#: Stands for a null doc_id: behind all others among equal scores.
NO_ID = 2**63


def _searched(vectors: DataFrame, queries: list[tuple], weights: np.ndarray, documents: int, length: int, top: int) -> DataFrame:
    """(item_id, doc_id, score, part): the best documents of each task for every query."""
    asked = [(item, np.array(axes)) for item, axes in queries if axes]
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64()), ("part", pa.int32())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in asked]
        marks = np.zeros(len(weights), np.int64)

        def search(held: list) -> None:
            keys, sizes, axes, values = (np.concatenate(x) if i else [k for y in x for k in y] for i, x in enumerate(zip(*held, strict=True)))
            tree = BallTree(np.cumsum(sizes) - sizes, axes, values, len(weights))
            for (_, query), found in zip(asked, best, strict=True):
                marks[query] = 1
                tree.search(query, marks, found, top, keys)
                marks[query] = 0

        held, docs, entries = [], 0, 0
        for batch in it:
            for at in range(0, batch.num_rows, 2_048):
                part = _weighed(batch.slice(at, 2_048), weights, documents, length)
                if len(part[1]):
                    held.append(part)
                    docs, entries = docs + len(part[1]), entries + len(part[2])
                if docs >= BLOCK_DOCS or entries >= BLOCK_ENTRIES:
                    search(held)
                    held, docs, entries = [], 0, 0
        if held:
            search(held)
        number = TaskContext.get().partitionId() % MERGE
        rows = [(item, None if key == -NO_ID else -key, score, number) for (item, _), found in zip(asked, best, strict=True) for score, key in found]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return vectors.mapInArrow(run, "item_id long, doc_id long, score long, part int")


def _weighed(batch: pa.RecordBatch, weights: np.ndarray, documents: int, length: int) -> tuple:
    """(keys, entries per document, axes, values) of the documents with an entry of weight above 0."""
    lists, tfs = batch.column("axes"), batch.column("tf")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    axes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    tf = tfs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    n = batch.column("n").to_pylist()
    m = np.array([50 + 50 * x * documents // length for x in n], np.int64) if length else np.zeros(len(n), np.int64)
    values = weights[axes] * (1_000_000_000 * tf // (1_000 * tf + 20 * np.repeat(m, sizes)))
    some = values > 0
    row = np.repeat(np.arange(len(sizes)), sizes)[some]
    sizes = np.bincount(row, minlength=len(sizes))
    keys = [NO_ID if k is None else k for k in batch.column("doc_id").to_pylist()]
    full = np.flatnonzero(sizes)
    return [keys[i] for i in full.tolist()], sizes[full], axes[some], values[some]


def rank(
    docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    query_col: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents with the highest score above 0 for every item.

    Equal scores are ranked by ascending doc_id, a null id last.  Rows of ``docs`` are ranked one by one,
    also where they repeat an id; rows of ``items`` that repeat an id, or have none, are one item with the
    terms of all.  Null and empty texts have no terms; an item without terms, or an empty table, gives no rows.
    """
    asked = (
        items.select(quoted(item_col).cast("long").alias("item_id"), F.explode(F.array_distinct(terms(quoted(query_col)))).alias("term"))
        .groupBy("item_id")
        .agg(F.collect_set("term").alias("terms"))
    )
    asked = settle(asked, "items")
    size = asked.agg(F.sum(F.size("terms"))).head()[0] or 0
    blocks = -(-size // QUERY_TERMS)
    out = None
    for block in range(blocks):
        # a block of queries: QUERY_TERMS terms, by a hash of their ids, at a time on the driver
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        found = _ranked(docs, [(r["item_id"], r["terms"]) for r in part], top, id_col, text_col)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out


def _ranked(docs: DataFrame, queries: list[tuple], top: int, id_col: str, text_col: str) -> DataFrame:
    axes = {t: i for i, t in enumerate(sorted({t for _, some in queries for t in some}))}
    vectors = settle(_vectors(docs, {t.encode(): i for t, i in axes.items()}, id_col, text_col), "vectors")
    documents, length = vectors.where("n > 0").agg(F.count("*"), F.sum("n")).head()
    weights = np.zeros(len(axes), np.int64)
    # one row per term of the block
    for axis, df in vectors.select(F.explode("axes").alias("axis")).groupBy("axis").agg(F.count("*").alias("df")).collect():
        weights[axis] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    asked = [(item, sorted(axes[t] for t in some)) for item, some in queries]
    found = _searched(vectors, asked, weights, documents, length or 0, top)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["item_id", "part"], ["item_id"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents),
s AS (SELECT (count(*) FILTER (len(terms) > 0))::BIGINT AS docs, sum(len(terms))::BIGINT AS total FROM d),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
t AS MATERIALIZED (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term, docs),
m AS (SELECT r, doc_id, 50 + (50 * len(terms) * docs) // total AS m FROM d, s WHERE len(terms) > 0),
x AS (SELECT item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0
) WHERE rank <= {TOP}
"""
