"""Text files in splits where what a place means depends on all text before it.

Whether a line end stands inside a quoted cell, or how deep in a JSON document a brace is, can be told for
any split of a file once the state at its start is known.  One pass tells for every split what it does to
each possible state; these are put together along each file, one row per split, and a second pass starts
every split from its own state.  Texts are read twice and never moved; units that reach over a split's end
are put together from their parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusloom.operators.scratch import settle

#: What a split does: the state after it, and what it adds to a count, if it starts in state 0 and in state 1.
Summary = tuple[int, int, int, int]
#: What a split gives: (kind, group, opens, closes, text); a unit that began earlier does not open, one that
#: goes on behind the split does not close.
Unit = tuple[str, int, bool, bool, str]

#: Bytes of small splits that one task takes.
TASK_BYTES = 16 << 20
_SIZE: ContextVar[int | None] = ContextVar("split_bytes", default=None)
#: Splits up to which their states are broadcast: about 100 MB.
MAX_BROADCAST = 1_000_000
UNITS = "file string, start long, n long, kind string, grp long, opens boolean, closes boolean, text string"


@contextmanager
def splits_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Files read in pieces in here are cut into splits of at most ``size`` bytes; other tables are read as ever."""
    token = _SIZE.set(size)
    try:
        yield
    finally:
        _SIZE.reset(token)


@contextmanager
def split_settings(spark: SparkSession) -> Iterator[None]:
    """Spark's settings for the size that splits_of names, for as long as pieces are read."""
    size = _SIZE.get()
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": str(size)} if size else {}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, value in names.items():
            spark.conf.set(k, value)
        yield
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)


def read_pieces(spark: SparkSession, paths: str | list[str], end: str) -> DataFrame:
    """(file, start, line, value): the text between ``end``s, in the order of ``line`` within a split, which is
    told by its ``start`` in the file.

    To be read within split_settings.  A task takes many small splits, whole and one after the other.
    """
    options = {"lineSep": end, "recursiveFileLookup": "true"}
    pieces = spark.read.options(**options).text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    size = _SIZE.get()
    if not size:
        return pieces
    splits = pieces.rdd.getNumPartitions()
    tasks = max(spark.sparkContext.defaultParallelism, -(-splits * size // TASK_BYTES))
    return pieces.coalesce(tasks) if tasks < splits else pieces


def _by_split(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, Iterator[str]]]:
    """Rows of a task as (split, its texts), in order; nothing is held back."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            keys = zip(*[batch.column(n).to_pylist() for n in names], strict=True)
            yield from zip(keys, batch.column("value").to_pylist(), strict=True)

    for key, some in groupby(rows(), key=lambda r: r[0]):
        yield key, (value for _, value in some)


def split_states(pieces: DataFrame, summarise: Callable[[Iterator[str], str], Summary]) -> DataFrame:
    """(file, start, state, count): the state (0 at the start of a file) and the count before every split.

    ``summarise(texts, file)`` tells what a split does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(*key, *summarise(texts, key[0])) for key, texts in _by_split(batches, ["file", "start"])]
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*found, strict=True), [pa.string()] + [pa.int64()] * 5, strict=True)],
                names=["file", "start", "s0", "s1", "c0", "c1"],
            )

    done = settle(
        pieces.select("file", "start", "value").mapInArrow(run, "file string, start long, s0 long, s1 long, c0 long, c1 long"), "splits"
    )
    # one row per split: a split keeps the state, turns it, or ends in the same one from both
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum(F.when((F.col("s0") == 1) & (F.col("s1") == 0), 1).otherwise(0)).over(before), F.lit(0))
    fixed = F.last(F.when(F.col("s0") == F.col("s1"), F.struct(F.col("s0").alias("s"), F.col("turns").alias("t"))), ignorenulls=True)
    known = done.withColumn("turns", turns).withColumn("fixed", fixed.over(before))
    state = F.coalesce(F.col("fixed.s") + F.col("turns") - F.col("fixed.t"), F.col("turns")) % 2
    added = F.when(F.col("state") == 0, F.col("c0")).otherwise(F.col("c1"))
    counted = known.withColumn("state", state).withColumn("count", F.coalesce(F.sum(added).over(before), F.lit(0)))
    return settle(counted.select("file", "start", F.col("state").cast("long").alias("state"), F.col("count").cast("long").alias("count")), "states")


def scan_splits(
    pieces: DataFrame, states: DataFrame | None, scan: Callable[[Iterable[str], int, int, str, int], Iterator[Unit]]
) -> DataFrame:
    """UNITS rows of every split: ``scan(texts, state, count, file, start)`` begins in the split's own state.

    Without ``states`` every split begins in state 0.
    """
    names = ["file", "start", "state", "count"]
    given = pieces
    if states is None:
        given = given.withColumns({"state": F.lit(0).cast("long"), "count": F.lit(0).cast("long")})
    elif states.count() <= MAX_BROADCAST:
        given = given.join(F.broadcast(states), ["file", "start"])
    else:
        given = given.join(states, ["file", "start"]).sortWithinPartitions("file", "start", "line")

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def packed() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["file", "start", "n", "kind", "grp", "opens", "closes", "text"])

        for (file, start, state, count), texts in _by_split(batches, names):
            for n, unit in enumerate(scan(texts, state, count, file, start)):
                held.append((file, start, n, *unit))
                size += len(unit[4])
                if size >= 1 << 23 or len(held) >= 10_000:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    return given.select(*names, "value").mapInArrow(run, UNITS)


def stitched(units: DataFrame) -> DataFrame:
    """UNITS rows, given as a written table, with the parts of each unit put together, at the place where it opens, in the group of where it closes.

    Only parts are moved, at most two of a split, those of a file in one window.
    """
    whole = units.where("opens AND closes")
    parts = units.where("NOT (opens AND closes)")
    order = Window.partitionBy("file").orderBy("start", "n")
    opened = F.last(F.when(F.col("opens"), F.struct("start", "n")), ignorenulls=True)
    owned = parts.withColumn("_of", opened.over(order.rowsBetween(Window.unboundedPreceding, 0)))
    row = F.sort_array(F.collect_list(F.struct("start", "n", "text", "kind", "grp", "closes")))
    last = F.element_at("_r", -1)
    joined = owned.groupBy("file", "_of").agg(row.alias("_r")).select(
        "file",
        F.col("_of.start").alias("start"),
        F.col("_of.n").alias("n"),
        F.element_at("_r", 1)["kind"].alias("kind"),
        last["grp"].alias("grp"),
        F.lit(True).alias("opens"),
        last["closes"].alias("closes"),
        F.array_join(F.transform("_r", lambda r: r["text"]), "").alias("text"),
        last["start"].alias("closed_in"),
    )
    return whole.withColumn("closed_in", F.col("start")).unionByName(settle(joined, "stitched"))
