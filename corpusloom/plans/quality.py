"""Rules the prompts state, checked on the answers: rows are flagged, never dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Names too vague for a category, in English and Chinese.
VAGUE_NAMES = [
    "other", "others", "general", "unknown", "miscellaneous", "related research",
    "其他", "综合", "通用", "未知", "相关研究",
]


def bad_scores(scored: DataFrame) -> DataFrame:
    """Scores that are no integer from 1 to 5."""
    s = F.col("score")
    return scored.where(~s.between(1, 5) | (s != F.floor(s)))


def unmapped_labels(chunks: DataFrame, rounds: DataFrame) -> DataFrame:
    """(dim, round, label): labels of a chunk, or categories before it, its answer left unmapped."""
    answered = rounds.where("response_ok").select("dim", "round", "mapping")
    new = chunks.select("dim", "round", F.explode("labels").alias("label"))
    earlier = rounds.select("dim", (F.col("round") + 1).alias("round"), F.explode("categories.name").alias("label"))
    asked = new.unionByName(earlier).distinct()
    given = answered.select("dim", "round", F.explode(F.map_keys("mapping")).alias("label"))
    return asked.join(answered.select("dim", "round"), ["dim", "round"], "left_semi").join(
        given, ["dim", "round", "label"], "left_anti"
    )


def too_many_categories(taxonomy: DataFrame, limit_cats: int) -> DataFrame:
    return taxonomy.groupBy("dim").agg(F.count("*").alias("n")).where(F.col("n") > limit_cats)


def vague_names(taxonomy: DataFrame) -> DataFrame:
    return taxonomy.where(F.lower("name").isin(VAGUE_NAMES))


def repeated_names(taxonomy: DataFrame) -> DataFrame:
    return taxonomy.groupBy("dim", "name").agg(F.count("*").alias("n")).where(F.col("n") > 1)
