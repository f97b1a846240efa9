"""Explore flow: a raw label per paper and dimension."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions import prompts
from corpusloom.functions.responses import dimension_values, label_fields
from corpusloom.functions.text import split_argument
from corpusloom.operators.ask import Responder, ask
from corpusloom.operators.scratch import settle
from corpusloom.plans.common import cap_papers


def ask_labels(
    df: DataFrame,
    text: Column,
    responder: Responder,
    dims: str | Iterable[str] | None = None,
    guide: str | None = None,
    max_papers: int | None = None,
    template: str = prompts.EXPLORE,
    output_lang: str = "English",
    **options: object,
) -> DataFrame:
    """(paper_id, response) for each paper; one call names all dimensions."""
    papers = cap_papers(df, max_papers)
    prompt = prompts.render(
        template,
        dimensions_desc=prompts.dimensions_text(split_argument(dims)),
        paper_id=F.col("paper_id"),
        paper_text=text,
        researcher_guide=guide or prompts.NO_GUIDE,
        output_lang=output_lang,
    )
    return ask(papers, prompt, responder, ["paper_id"], **options).select("paper_id", "response")


def labels_of(responses: DataFrame) -> DataFrame:
    """labels(dim, pos, paper_id, category, reason) of the values that are objects.

    ``pos`` orders a dimension; with one label per paper that is the paper id.
    """
    value = F.col("value")
    return (
        dimension_values(responses)
        .where(F.schema_of_variant(value).startswith("OBJECT<"))
        .select("dim", F.col("paper_id").alias("pos"), "paper_id", *[c.alias(n) for n, c in label_fields(value).items()])
    )


def dims_of(responses: DataFrame) -> DataFrame:
    """dims(dim, n_labels): every dimension answered, also those without any label."""
    is_label = F.schema_of_variant("value").startswith("OBJECT<")
    return dimension_values(responses).groupBy("dim").agg(F.count_if(is_label).alias("n_labels"))


def explore_labels(df: DataFrame, text: Column, responder: Responder, **options: object) -> DataFrame:
    responses = ask_labels(df, text, responder, **options)
    return labels_of(responses if isinstance(responder, Column) else settle(responses, "explored"))
