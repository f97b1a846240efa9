"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.common import attach
from corpusloom.operators.scratch import settle

MAX_ROUNDS = 100


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b longs) to (node, root): root is the smallest node reachable.

    Every round takes over the smallest grandparent among a node's neighbours, hooks it onto
    the node's parent as well, and halves the way to the root, so the rounds grow with the
    logarithm of the longest way.  Parents gather many children; the join on them is dealt
    out by ``attach`` and the minimum per parent is combined on the map side.  Each round is
    a written table, so a lost executor repeats a part of one round only.
    """
    both = settle(
        links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        .unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        .where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .distinct(),
        "links",
    )
    state = settle(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("parent")), "parents")
    for _ in range(MAX_ROUNDS):
        above = state.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        full = settle(attach(state, above, "parent").select("node", "parent", "grand"), "grandparents")
        near = (
            both.join(full.select(F.col("node").alias("v"), F.col("grand")), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("grand").alias("near"))
        )
        seen = full.join(near, "node").select(
            "node", "parent", "grand", F.least("grand", "near").alias("best")
        )
        offers = seen.select("node", F.col("best").alias("offer"), F.col("parent").alias("was")).unionByName(
            seen.groupBy(F.col("parent").alias("node")).agg(F.min("best").alias("offer")).withColumn("was", F.lit(None).cast("long"))
        )
        new = settle(
            offers.groupBy("node").agg(F.min("offer").alias("parent"), F.max("was").alias("was")), "parents"
        )
        state = new.select("node", "parent")
        if new.where("parent <> was").isEmpty():
            return state.select("node", F.col("parent").alias("root"))
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
