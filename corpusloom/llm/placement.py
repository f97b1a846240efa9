"""Placement of documents on shards by a permutation-filled lookup table.

Every shard has an order of preference over the slots of a table whose size is prime: it starts at
an offset and goes on by a fixed skip, which visits every slot.  The shards take turns, each
claiming the first slot in its order that is still free, until the table is full.  Shares differ
by one slot at most, and adding or removing a shard moves few slots besides its own.

The table depends on the shards' names alone, never on the data: ``slots`` rows, which bounds what
is broadcast.  A document's slot is a hash of its key, so a hot source does not matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions.text import quoted

SLOTS = 4099
SHARDS = 64
MAX_SLOTS = 1_000_003
#: Hex digits of a hash that fit in a signed long.
DIGITS = 15


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:04d}" for i in range(n)]


def _number(text: str) -> int:
    return int(md5(text.encode()).hexdigest()[:DIGITS], 16)


def fill(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """Number of the shard that holds each slot."""
    if not 0 < len(shards) <= slots <= MAX_SLOTS or len(set(shards)) < len(shards):
        raise ValueError(f"one to {slots} different shards, {MAX_SLOTS} slots at most")
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots has to be prime")
    place = [_number(f"{s}/offset") % slots for s in shards]
    skip = [_number(f"{s}/skip") % (slots - 1) + 1 for s in shards]
    held = [-1] * slots
    for turn in range(slots):
        i = turn % len(shards)
        while held[place[i]] >= 0:
            place[i] = (place[i] + skip[i]) % slots
        held[place[i]] = i
    return held


def lookup_table(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard): one row per slot."""
    held = F.split(F.lit(",".join(map(str, fill(shards, slots)))), ",")
    names = F.split(F.lit("\n".join(shards)), "\n")
    number = F.get(held, F.col("id").cast("int")).cast("int")
    return spark.range(slots).select(F.col("id").alias("slot"), F.get(names, number).alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, DIGITS), 16, 10).cast("long") % slots


def place(docs: DataFrame, shards: Sequence[str], slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``slot`` and ``shard``; columns of these names are replaced.

    Rows with equal ids go to one shard.  A row without an id goes by its text, one with neither
    by the empty string.
    """
    key = F.col(id_col).cast("string")
    if text_col in docs.columns:
        key = F.coalesce(key, F.col(text_col))
    rest = [quoted(c) for c in docs.columns if c.lower() not in ("slot", "shard")]
    placed = docs.select(*rest, slot_of(F.coalesce(key, F.lit("")), slots).alias("slot"))
    return placed.join(F.broadcast(lookup_table(docs.sparkSession, shards, slots)), "slot", "left").select(
        *rest, "slot", "shard"
    )


def oracle(shards: Sequence[str], slots: int = SLOTS) -> str:
    """DuckDB twin over ``documents``: the table is filled claim by claim in a recursive query."""
    names = ", ".join(f"'{s}'" for s in shards)
    number = f"('0x' || substr(md5({{}}), 1, {DIGITS}))::BIGINT"
    return f"""
WITH RECURSIVE shards AS (SELECT unnest([{names}]) AS name, generate_subscripts([{names}], 1) - 1 AS i),
starts AS (SELECT list({number.format("name || '/offset'")} % {slots} ORDER BY i) AS offs,
                  list({number.format("name || '/skip'")} % {slots - 1} + 1 ORDER BY i) AS skips FROM shards),
claims(turn, slot, held) AS (
  SELECT -1::BIGINT, -1::BIGINT, list_transform(range({slots}), lambda x: false) FROM starts
  UNION ALL
  SELECT turn + 1, s, list_concat(held[:s], [true], held[s + 2:])
  FROM (SELECT turn, held,
               list_filter(list_transform(range({slots}), lambda j: (offs[(turn + 1) % {len(shards)} + 1] + j * skips[(turn + 1) % {len(shards)} + 1]) % {slots}),
                           lambda p: NOT held[p + 1])[1] AS s
        FROM claims, starts WHERE turn < {slots - 1})),
table_ AS (SELECT slot, [{names}][turn % {len(shards)} + 1] AS shard FROM claims WHERE turn >= 0),
keyed AS (SELECT doc_id, {number.format("coalesce(doc_id::VARCHAR, text, '')")} % {slots} AS slot FROM documents)
SELECT doc_id, slot, shard FROM keyed JOIN table_ USING (slot)
"""
