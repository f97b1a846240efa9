"""Small parts shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions.text import quoted

#: A word is a longest run of characters outside space and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"

#: Share of all rows from which a key counts as hot: at most so many keys can be.
HOT_SHARE = 4096


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of ``text``; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), lambda w: w != "")


def utf8(text: Column) -> Column:
    """The UTF-8 bytes of a text, empty for null: what tasks in Python take."""
    return F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))


def parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def only(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns, whatever else the table has."""
    return df.select(*[quoted(n) for n in names])


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*[batch.column(n).to_pylist() for n in names], strict=True)


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 5_000) -> Iterator[pa.RecordBatch]:
    """Rows put together to record batches of bounded length."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind.type) for column, kind in zip(zip(*held, strict=True), schema, strict=True)], schema=schema
    )


def attach(facts: DataFrame, found: DataFrame, on: str, rows: DataFrame | None = None) -> DataFrame:
    """Left join with ``found``, which has each key once, safe when one key holds a third of the rows.

    Keys with at least 1/HOT_SHARE of the rows, so HOT_SHARE at most, are dealt over as many salts
    as they have such shares, and their rows of ``found`` are repeated for these salts only.
    ``rows`` gives (key, n) when the counts are at hand already.
    """
    counts = rows if rows is not None else facts.groupBy(on).agg(F.count("*").alias("n"))
    counts = counts.where(F.col(on).isNotNull())
    total = counts.agg(F.sum("n")).head()[0] or 0
    share = max(total // HOT_SHARE, 64)
    # at most HOT_SHARE rows by the choice of share, so collecting and broadcasting them is bounded
    hot = counts.where(F.col("n") >= share).select(on, F.ceil(F.col("n") / share).cast("int").alias("_fan")).collect()
    if not hot:
        return facts.join(found, on, "left")
    kind = facts.schema[on].dataType.simpleString()
    fans = facts.sparkSession.createDataFrame([tuple(r) for r in hot], f"`{on}` {kind}, _fan int")
    spread = F.xxhash64(*[quoted(c) for c in facts.columns])
    left = facts.join(F.broadcast(fans), on, "left").withColumn(
        "_salt", F.coalesce(F.pmod(spread, F.col("_fan")), F.lit(0)).cast("int")
    )
    right = found.join(F.broadcast(fans), on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_fan"), F.lit(1)) - 1))
    )
    return left.drop("_fan").join(right.drop("_fan"), [on, "_salt"], "left").drop("_salt")
