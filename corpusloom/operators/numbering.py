"""Exact row numbers without a single-partition window.

The rows are sorted by range over the whole cluster, so neither a global number
nor the number inside one huge group passes through a single task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.text import quoted
from corpusloom.operators.scratch import settle

# monotonically_increasing_id(): partition in the upper bits, row in the lower 33.
ROW_BITS = 33


def number_rows(
    df: DataFrame,
    order: Sequence[Column],
    within: Sequence[str] = (),
    name: str = "pos",
    start: int = 1,
) -> DataFrame:
    """Add ``name``: position of each row in ``order``, inside each ``within`` group.

    ``order`` has to be unique inside a group.  The sorted rows are written once,
    because range bounds come from a sample and must not change between the two
    reads; row counts per partition then give every partition its first number.
    """
    groups = [quoted(g) for g in within]
    row_id = F.monotonically_increasing_id()
    ordered = settle(
        df.repartitionByRange(*groups, *order)
        .sortWithinPartitions(*groups, *order)
        .withColumn("_part", F.shiftright(row_id, ROW_BITS))
        .withColumn("_row", row_id.bitwiseAND(F.lit((1 << ROW_BITS) - 1))),
        "numbered",
    )
    # One row per (partition, group met there): at most partitions + groups rows.
    earlier = (
        Window.partitionBy(*[F.col(f"_g{i}") for i in range(len(groups))])
        .orderBy("_p")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    firsts = settle(
        ordered.groupBy(F.col("_part").alias("_p"), *[g.alias(f"_g{i}") for i, g in enumerate(groups)])
        .agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("long")))
        .drop("_n"),
        "firsts",
    )
    same = reduce(
        lambda a, b: a & b,
        [g.eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)],
        F.col("_part") == F.col("_p"),
    )
    number = (F.col("_before") + F.col("_row") - F.col("_first") + F.lit(start)).cast("long")
    return ordered.join(firsts, same).select(*[quoted(c) for c in df.columns], number.alias(name))


def running_sums(df: DataFrame, order: str, amount: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over all rows before, by the unique column ``order``.

    Sums run inside ranges of the order; one row per range is added up on top.
    """
    part = F.shiftright(F.monotonically_increasing_id(), ROW_BITS)
    ordered = settle(df.repartitionByRange(quoted(order)).withColumn("_part", part), "ranged")
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    above = ordered.groupBy(F.col("_part").alias("_p")).agg(F.sum(amount).alias("_s")).withColumn("_b", F.sum("_s").over(earlier))
    inside = Window.partitionBy("_part").orderBy(quoted(order)).rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum(amount).over(inside), F.lit(0)) + F.coalesce("_b", F.lit(0))
    joined = ordered.join(above, F.col("_part") == F.col("_p"))
    return joined.select(*[quoted(c) for c in df.columns], total.cast("long").alias(name))


def assign_paper_ids(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """1-based ``paper_id`` in the order of the named columns, to be written with the papers.

    Only the order columns, unique together, are sorted; the texts are read and
    moved once, when the numbers are joined back.
    """
    keys = [F.col(f"_k{i}") for i in range(len(order))]
    narrow = df.select(*[quoted(c).alias(f"_k{i}") for i, c in enumerate(order)])
    numbers = number_rows(narrow, keys, name="paper_id")
    same = reduce(lambda a, b: a & b, [quoted(c).eqNullSafe(k) for c, k in zip(order, keys, strict=True)])
    return df.join(numbers, same).drop(*[f"_k{i}" for i in range(len(order))])
