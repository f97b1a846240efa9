"""Joins of a large table with a table that has one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import MapType, VariantType

from corpusloom.functions.text import quoted

UNHASHABLE = (MapType, VariantType)

HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 10_000


def hot_keys(counts: DataFrame, hot_rows: int = HOT_ROWS, count_col: str = "n") -> DataFrame | None:
    """Hot keys and ``_fan``, the shares of ``hot_rows`` rows that each holds; None when there are none.

    The bound is raised with the total, so that at most MAX_HOT_KEYS can qualify.
    """
    total, largest = counts.agg(F.sum(count_col), F.max(count_col)).head()
    bound = max(hot_rows, (total or 0) // MAX_HOT_KEYS)
    if largest is None or largest < bound:
        return None
    fan = F.ceil(F.col(count_col) / F.lit(hot_rows)).cast("int")
    return counts.where(F.col(count_col) >= bound).withColumn("_fan", fan).drop(count_col)


def lookup(
    facts: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    counts: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left join of ``facts`` with ``table``, which holds each key once.

    Catalyst broadcasts ``table`` when its measured size allows and shuffles
    otherwise.  ``counts`` (the key columns and ``n``, rows of ``facts`` per key)
    names the hot keys: their facts are spread over a salt for every ``hot_rows``
    rows and their rows of ``table`` repeated once per salt, so no key stays in one task.
    """
    keys = list(on)
    hot = hot_keys(counts, hot_rows) if counts is not None else None
    if hot is None:
        return facts.join(table, keys, "left")
    # at most MAX_HOT_KEYS rows, see hot_keys
    flagged = F.broadcast(hot.select(*keys, "_fan"))
    spread = [quoted(c) for c in facts.columns]
    # taken from the row itself, so that a recomputed task gives every row the same salt
    row_hash = F.xxhash64(*[quoted(f.name) for f in facts.schema if not isinstance(f.dataType, UNHASHABLE)])
    salt = F.coalesce(F.pmod(row_hash, F.col("_fan")), F.lit(0))
    salted_facts = facts.join(flagged, keys, "left").select(*spread, salt.cast("int").alias("_salt"))
    salts = F.sequence(F.lit(0), F.coalesce(F.col("_fan"), F.lit(1)) - 1)
    salted_table = table.join(flagged, keys, "left").withColumn("_salt", F.explode(salts)).drop("_fan")
    return salted_facts.join(salted_table, [*keys, "_salt"], "left").drop("_salt")
