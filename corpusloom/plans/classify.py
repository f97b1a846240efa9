"""Classify flow: file papers under the user's own categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions import prompts
from corpusloom.functions.responses import JOINT, with_classes
from corpusloom.functions.text import quoted
from corpusloom.operators.ask import Responder, ask
from corpusloom.plans.common import drop_results, refuse_clashes
from corpusloom.sources.documents import schema_text

RESULTS = ["classify_category", "classify_reason", "classify_keywords", "shape_ok", "response_ok"]


def classify(
    df: DataFrame,
    categories: DataFrame | str,
    text: Column,
    responder: Responder,
    mode: str = "single",
    guide: str | None = None,
    template: str = prompts.CLASSIFY,
    output_lang: str = "English",
    **options: object,
) -> DataFrame:
    """``df`` with classify_category, classify_reason, classify_keywords.

    ``categories`` has pos, name, definition; a text goes into the prompt as it is.
    The default template leaves the paper id out, so equal papers share a call;
    a template of the user's own may hold {{paper_id}}.
    """
    if mode not in ("single", "multi"):
        raise ValueError(f"mode is single or multi, not {mode!r}")
    df = drop_results(df, RESULTS)
    refuse_clashes(df, RESULTS)
    shown = categories if isinstance(categories, str) else schema_text(categories).head().schema_text
    prompt = prompts.render(
        template,
        schema_text=shown,
        classify_mode=mode,
        paper_id=F.col("paper_id"),
        paper_text=text,
        researcher_guide=guide or prompts.NO_GUIDE,
        output_lang=output_lang,
    )
    return with_classes(ask(df, prompt, responder, ["paper_id"], **options), mode)


def assigned(df: DataFrame, column: str = "classify_category", sep: str = JOINT) -> DataFrame:
    """One row per paper and category, blanks dropped; ``column`` becomes ``category``."""
    parts = F.split(quoted(column), F.lit("\\Q" + sep + "\\E"))
    return df.withColumn("category", F.explode(parts)).where(F.col("category") != "")


def category_distribution(df: DataFrame, column: str = "classify_category", sep: str = JOINT) -> DataFrame:
    """Papers per category, most common first."""
    return (
        assigned(df.select(column), column, sep)
        .groupBy("category")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "category")
    )


def flag_categories(df: DataFrame, categories: DataFrame, column: str = "classify_category") -> DataFrame:
    """(paper_id, category, in_schema): was each assigned category among those given?"""
    rows = assigned(df.select("paper_id", column), column).select("paper_id", "category")
    given = categories.select(F.col("name").alias("category"), F.lit(True).alias("known")).distinct()
    return rows.join(given, "category", "left").select(
        "paper_id", "category", F.coalesce("known", F.lit(False)).alias("in_schema")
    )
