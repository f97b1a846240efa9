"""What the physical plans must show."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from corpusloom.checks import views as v
from corpusloom.checks import converge as queries
from corpusloom.functions import text
from corpusloom.operators.ask import call_model
from corpusloom.operators.layout import spread
from corpusloom.operators.scratch import settle
from corpusloom.plans import converge, relevance, translate
from corpusloom.plans.common import cap_papers
from corpusloom.sources import sinks
from tests.conftest import DATA


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_scores_need_no_shuffle(spark):
    p = settle(v.papers(spark, DATA), "papers")
    scored = relevance.score_papers(p, "t", "c", v.text_column(p), v.score_responder())
    assert "Exchange" not in plan(scored.where("passed").select("paper_id", "score"))


def test_sample_reads_ids_first_and_pushes_them_down(spark):
    p = settle(v.papers(spark, DATA), "papers")
    ids = plan(relevance.sample_ids(p, 15, 42))
    assert "TakeOrderedAndProject" in ids and "ReadSchema: struct<paper_id:bigint>" in ids
    assert "PushedFilters: [In(paper_id" in plan(relevance.draw(p, 15, 42))


def test_typical_cases_cut_before_the_shuffle(spark):
    labels, _, mapping, taxonomy = queries._flat(spark, DATA)
    shown = plan(converge.first_papers(labels, mapping, taxonomy))
    assert shown.count("WindowGroupLimit") >= 4  # partial and final, per label and per category


def test_small_mapping_is_broadcast_by_its_measured_size(spark):
    labels = settle(v.labels(spark, DATA), "labels")
    mapping = settle(v.first_letter_mapping(converge.label_counts(labels)), "mapping")
    assert "BroadcastHashJoin" in plan(converge.final_labels(labels, mapping))


def test_call_reads_only_what_it_needs(spark):
    p = settle(v.papers(spark, DATA), "papers")
    narrow = p.where("paper_id <= 10").select("paper_id", text.clean_text(F.col("title")).alias("prompt"))
    shown = plan(call_model(narrow, "prompt", lambda ps: ps, qps=0))
    assert "ReadSchema: struct<paper_id:bigint,title:string>" in shown
    assert "LessThanOrEqual(paper_id,10)" in shown


def test_dimension_choice_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "labels")
    v.labels(spark, DATA).write.partitionBy("dim").parquet(path)
    shown = plan(converge.select_dims(spark.read.parquet(path), "Lead"))
    assert "PartitionFilters: [isnotnull(dim" in shown and "= Lead" in shown


def test_bucketed_papers_stay_in_place(spark, tmp_path):
    papers = sinks.bucket_papers(v.papers(spark, DATA), "papers_in_buckets", str(tmp_path / "papers"), 4)
    answers = settle(v.papers(spark, DATA).select("paper_id", "lang"), "answers")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        shown = plan(papers.drop("lang").join(answers, "paper_id", "left"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in shown and shown.count("Exchange (") <= 2  # one exchange, named twice
    assert "SelectedBucketsCount: 4 out of 4" in shown


def test_cap_is_a_filter_on_the_scan(spark):
    p = settle(v.papers(spark, DATA), "papers")
    assert "LessThanOrEqual(paper_id,20)" in plan(cap_papers(p, 20))
    gaps = settle(p.where("paper_id % 3 = 0"), "papers")
    assert sorted(r.paper_id for r in cap_papers(gaps, 4).collect()) == [3, 6, 9, 12]
    assert cap_papers(gaps, 10_000).count() == gaps.count() and cap_papers(gaps, 0) is gaps


def test_only_scans_of_few_splits_are_spread(spark, tmp_path):
    spark.range(20_000).coalesce(1).write.parquet(str(tmp_path / "one"))
    assert "Exchange" in plan(spread(spark.read.parquet(str(tmp_path / "one"))))
    spark.range(20_000).repartition(12).write.parquet(str(tmp_path / "many"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert "Exchange" not in plan(spread(spark.read.parquet(str(tmp_path / "many"))))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_translations_of_all_columns_move_the_rows_once(spark):
    p = settle(v.papers(spark, DATA), "papers")
    said = spark.createDataFrame([("title", "k", "t")], "col string, key string, translated string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shown = plan(translate.translate_apply(p, "title,abstract,lang", said))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [part for part in shown.split("\n\n") if ") Exchange" in part and "abstract#" in part]
    assert len(moved) == 1


def test_no_text_crosses_the_grouping_by_digest(spark, tmp_path, monkeypatch):
    """What is shuffled to be grouped are digests and ids."""
    from corpusloom.plans import translate

    rows = [(i, f"text {i % 3}", None if i % 2 else "x") for i in range(20)]
    spark.createDataFrame(rows, "paper_id long, a string, b string").write.parquet(str(tmp_path / "p"))
    plans = []
    settled = translate.settle

    def seen(df, label, by=None):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return settled(df, label, by)

    monkeypatch.setattr(translate, "settle", seen)
    df = spark.read.parquet(str(tmp_path / "p"))
    found = translate.distinct_by_digest(df, "a,b,none")
    assert sorted((r.col, r.text, r.first_id, r.n) for r in found.collect()) == [
        ("a", "text 0", 0, 7), ("a", "text 1", 1, 7), ("a", "text 2", 2, 6), ("b", "x", 0, 10),
    ]
    (grouped,) = plans
    aggregates = [line for line in grouped.splitlines() if "Aggregate" in line]
    assert len(aggregates) == 2 and all("text" not in line and " a#" not in line and "[a#" not in line for line in aggregates)
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
