"""Writers. Parquet is the native form; CSV is for export."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpusloom.functions.text import quoted
from corpusloom.operators.scratch import settle, swap

BOM = "﻿"


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files that spreadsheet programs read as UTF-8 (each starts with a BOM)."""
    first = df.columns[0]
    marked = df.select(quoted(first).alias(BOM + first), *[quoted(c) for c in df.columns[1:]])
    (
        marked.write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("emptyValue", "")
        .csv(path)
    )


def write_scored(scored: DataFrame, path: str, as_csv: bool = False) -> DataFrame:
    """Two sinks, the papers that passed and all of them, from one computation.

    The parquet sink of all papers is itself the table the other one reads.
    """
    everything = path.rstrip("/") + "_all"
    if as_csv:
        once = settle(scored, "scored")
        write_csv(once, everything)
        write_csv(once.where("passed"), path)
        return once
    scored.write.mode("overwrite").parquet(everything)
    once = scored.sparkSession.read.schema(scored.schema).parquet(everything)
    once.where("passed").write.mode("overwrite").parquet(path)
    return once


def bucket_papers(df: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Papers as a table bucketed by id, one file per bucket.

    Answers and labels are joined on the id; against this table only their own,
    narrow rows are shuffled and the texts stay where they are.
    """
    (
        df.repartition(buckets, "paper_id")
        .write.mode("overwrite")
        .bucketBy(buckets, "paper_id")
        .sortBy("paper_id")
        .option("path", path)
        .saveAsTable(table)
    )
    return df.sparkSession.table(table)


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Put a table in the place of one that it may have been read from: one write, then a rename."""
    swap(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace_dims(df: DataFrame, path: str) -> None:
    """Write the partitions of the dimensions in ``df``; other dimensions stay."""
    settle(df, "dims").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dim").parquet(path)
