"""Checks shared by the flows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from corpusloom.functions.text import check_names
from corpusloom.operators.numbering import number_rows


def drop_results(df: DataFrame, results: Iterable[str]) -> DataFrame:
    """Without the result columns (exact names) of an earlier run."""
    results = set(results)
    old = [c for c in df.columns if c in results]
    return df.drop(*old)


def cap_papers(df: DataFrame, max_papers: int | None = None) -> DataFrame:
    """The first ``max_papers`` papers by id (None or 0: all).

    Comes out as a plain filter on the id, which reaches the scan.  Ids may have
    gaps (papers kept by an earlier filter); then the id in that place is looked up.
    """
    if not max_papers:
        return df
    ids = df.select("paper_id")
    bound = max_papers
    if ids.where(F.col("paper_id") <= max_papers).count() < max_papers:
        last = number_rows(ids, [F.col("paper_id")]).where(F.col("pos") == max_papers).head()
        if last is None:
            return df
        bound = last.paper_id
    return df.where(F.col("paper_id") <= bound)


def refuse_clashes(df: DataFrame, results: Iterable[str]) -> None:
    """Refuse input names that Spark, ignoring case, takes for a result or for each other."""
    check_names([*results, *df.columns])
