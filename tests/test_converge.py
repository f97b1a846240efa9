from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.plans import converge as c
from corpusloom.plans import quality

ROUNDS = "dim string, round bigint, response_ok boolean, categories array<struct<name:string,definition:string,judgment_suggestions:string,keywords:array<string>>>, mapping map<string,string>"


def folded(maps):
    """The mapping a plain dictionary ends with: follow one hop, then override."""
    state = {}
    for m in maps:
        state = {k: m.get(f, f) for k, f in state.items()} | m
    return state


def random_maps(rng, rounds):
    names = list("abcdefgh")
    return [
        {} if rng.random() < 0.15 else {k: rng.choice(names) for k in rng.sample(names, rng.randint(1, 6))}
        for _ in range(rounds)
    ]


def test_mapping_of_equals_a_fold(spark):
    rng = random.Random(5)
    cases = {f"d{i}": random_maps(rng, rng.choice([1, 2, 3, 4, 9, 17])) for i in range(60)}
    rows = [(d, r, True, [], m) for d, maps in cases.items() for r, m in enumerate(maps)]
    rows += [("failed", 0, False, [], None)]
    got = {}
    for row in c.mapping_of(spark.createDataFrame(rows, ROUNDS)).collect():
        got.setdefault(row.dim, {})[row.label] = row.final
    assert got == {d: f for d, maps in cases.items() if (f := folded(maps))}


def test_compose_mapping_equals_a_fold(spark):
    rng = random.Random(6)
    cases = {f"d{i}": random_maps(rng, 2) for i in range(40)}
    first, second = ([(d, k, f) for d, maps in cases.items() for k, f in maps[i].items()] for i in (0, 1))
    schema = "dim string, label string, final string"
    got = {}
    for row in c.compose_mapping(spark.createDataFrame(first, schema), spark.createDataFrame(second, schema)).collect():
        got.setdefault(row.dim, {})[row.label] = row.final
    assert got == {d: f for d, maps in cases.items() if (f := folded(maps))}


def labels_frame(spark, rows):
    return spark.createDataFrame([(d, p, p, cat, why) for d, p, cat, why in rows], "dim string, pos bigint, paper_id bigint, category string, reason string")


def scripted(replies):
    """A responder that answers by dimension and round from a table."""

    def answer(prompts):
        out = []
        for p in prompts:
            dim = p.split('"')[1]
            before = p.split("Categories so far:\n")[1].split("\n")[0]
            known = 0 if before == "None" else len(json.loads(before))
            out.append(replies.get((dim, known)))
        return out

    return answer


def test_converge_end_to_end_with_a_python_responder(spark):
    rows = [("App", i, f"l{i % 4}", f"r{i}") for i in range(1, 13)] + [("Tech", 1, "t", "why")]
    papers = spark.createDataFrame([(i, f" Title {i} ") for i in range(1, 9)], "paper_id bigint, title string")
    replies = {
        ("App", 0): json.dumps({"refined_categories": [{"name": "A", "keywords": "k1, k2"}, {"name": "B", "keywords": ["x"]}], "mapping": {"l1": "A", "l2": "B"}}),
        ("App", 2): json.dumps({"refined_categories": [{"name": "C"}, {"name": "B"}, {"name": "D"}], "mapping": {"A": "C", "l3": "D"}}),
        ("Tech", 0): json.dumps({"mapping": {"t": "T"}}),
    }
    taxonomy, mapping = c.converge(
        labels_frame(spark, rows), scripted(replies), limit_cats=2, papers=papers, chunk_size=2, qps=0, backoff_s=0
    )
    assert {(r.dim, r.label): r.final for r in mapping.collect()} == {
        ("App", "l1"): "C", ("App", "l2"): "B", ("App", "l3"): "D", ("App", "A"): "C", ("Tech", "t"): "T",
    }
    got = {r.name: r for r in taxonomy.collect()}
    assert set(got) == {"C", "B"}  # D is cut, Tech lost its list with the missing key
    assert (got["C"].pos, got["B"].pos) == (0, 1)
    assert got["C"].typical_cases == ["《Title 1》: r1", "《Title 5》: r5", "《ID:9》: r9"]
    final = c.final_labels(labels_frame(spark, rows), mapping)
    wide = {r.paper_id: r for r in c.label_pivot(final, ["App", "Tech"]).collect()}
    assert (wide[3].App_raw_category, wide[3].App_category, wide[3].Tech_category) == ("l3", "D", None)
    assert wide[4].App_category == "l0"  # nobody mapped it
    assert {(r.dim, r.final, r.n) for r in c.orphan_labels(final, taxonomy).collect()} == {("App", "D", 3), ("App", "l0", 3), ("Tech", "T", 1)}


def test_failed_round_keeps_the_list(spark):
    rows = [("D", i, f"l{i}", "") for i in range(1, 4)]
    replies = {("D", 0): json.dumps({"refined_categories": [{"name": "A"}], "mapping": {"l1": "A"}})}
    counts = c.label_counts(labels_frame(spark, rows))
    chunks = c.chunk_text(c.label_chunks(c.label_rank(counts), 1))
    rounds = c.converge_rounds(chunks, scripted(replies), qps=0, backoff_s=0, max_attempts=1)
    assert [(r.round, r.response_ok, [x.name for x in r.categories]) for r in rounds.orderBy("round").collect()] == [
        (0, True, ["A"]), (1, False, ["A"]), (2, False, ["A"]),
    ]
    assert [r.name for r in c.taxonomy_rows(rounds).collect()] == ["A"]


def test_rounds_that_broke_off_find_their_answers(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def answer(prompts):
        calls.add(len(prompts))
        return [json.dumps({"refined_categories": [{"name": "A"}], "mapping": {"l1": "A"}})] * len(prompts)

    rows = [("D", i, f"l{i}", "") for i in range(1, 4)] + [("E", 1, "x", "")]
    opts = {"chunk_size": 1, "qps": 0, "cache_path": str(tmp_path / "answers")}
    first = c.converge(labels_frame(spark, rows), answer, **opts)
    assert calls.value == 4
    second = c.converge(labels_frame(spark, rows), answer, **opts)
    assert calls.value == 4
    assert [sorted(map(str, t.collect())) for t in first] == [sorted(map(str, t.collect())) for t in second]


def test_nothing_to_converge(spark):
    labels = labels_frame(spark, [("D", 1, "x", "")])
    taxonomy, mapping = c.converge(labels, F.lit("{}"), dims="unknown")
    assert taxonomy.isEmpty() and mapping.isEmpty()


def test_duplicate_label_of_a_paper_the_last_wins(spark):
    df = spark.createDataFrame([("D", 1, 7, "a", "r1", "A"), ("D", 2, 7, "b", "r2", "B")], "dim string, pos bigint, paper_id bigint, category string, reason string, final string")
    row = c.label_pivot(df, ["D", "E.x"]).head()
    assert (row["D_raw_category"], row["D_category"], row["E.x_category"]) == ("b", "B", None)


def test_label_merge_keeps_old_values(spark):
    base = spark.createDataFrame([(1, "old", "t1"), (2, "old", "t2")], "paper_id bigint, D_category string, title string")
    wide = spark.createDataFrame([(2, "raw", "new", "why"), (3, "x", "y", "z")], "paper_id bigint, D_raw_category string, D_category string, D_reason string")
    got = {r.paper_id: r.asDict() for r in c.label_merge(base, wide, ["D"]).collect()}
    assert got == {
        1: {"paper_id": 1, "title": "t1", "D_raw_category": "", "D_category": "old", "D_reason": ""},
        2: {"paper_id": 2, "title": "t2", "D_raw_category": "raw", "D_category": "new", "D_reason": "why"},
    }


def test_unmapped_labels_counts_earlier_categories(spark):
    chunks = spark.createDataFrame([("D", 0, ["a", "b"]), ("D", 1, ["c"])], "dim string, round bigint, labels array<string>")
    cat = lambda n: (n, None, None, None)
    rounds = spark.createDataFrame(
        [("D", 0, True, [cat("A"), cat("B")], {"a": "A"}), ("D", 1, True, [cat("A")], {"c": "A", "A": "A"})], ROUNDS
    )
    assert {tuple(r) for r in quality.unmapped_labels(chunks, rounds).collect()} == {("D", 0, "b"), ("D", 1, "B")}


def test_dimensions_that_differ_in_case_are_refused(spark):
    df = spark.createDataFrame([("D", 1, 7, "a", "r1", "A")], "dim string, pos bigint, paper_id bigint, category string, reason string, final string")
    with pytest.raises(ValueError, match="differ in case"):
        c.label_pivot(df, ["D", "d"])
    base = spark.createDataFrame([(7, "x")], "paper_id bigint, d_category string")
    with pytest.raises(ValueError, match="differ in case"):
        c.label_merge(base, c.label_pivot(df, ["D"]), ["D"])


@pytest.mark.parametrize("stretch", [2, 500])
def test_a_rule_answers_many_rounds_in_one_job(spark, monkeypatch, stretch):
    """The same rounds as from a Column asked round by round, also where they go on in the next job."""
    monkeypatch.setattr(c, "STRETCH", stretch)
    rows = [(dim, i, f"{dim}{i}", "") for dim, n in (("D", 9), ("E", 4), (None, 3)) for i in range(n)]
    chunks = c.chunk_text(c.label_chunks(c.label_rank(c.label_counts(labels_frame(spark, rows))), 1)).localCheckpoint()

    def rule(f):
        name = F.concat(f["labels"][0], F.lit("#"), F.size(f["categories"]).cast("string"))
        known = F.transform(f["categories"], lambda x: F.struct(x["name"].alias("name"), x["extra"].alias("definition")))
        new = F.struct(name.alias("name"), F.md5(f["prompt"]).alias("definition"))
        said = F.to_json(F.struct(F.concat(known, F.array(new)).alias("refined_categories"), F.create_map(f["labels"][0], name).alias("mapping")))
        return F.when(f["round"] % 3 != 1, said)

    each = {x: F.col(x) for x in ("dim", "round", "labels", "new_labels", "categories", "prompt")}
    found = c.converge_rounds(chunks, c.Rule(rule))
    assert sorted(map(str, found.collect())) == sorted(map(str, c.converge_rounds(chunks, rule(each)).select(found.columns).collect()))
    assert found.count() == 16
    jobs = spark.sparkContext.statusTracker()
    if stretch == 500:
        spark.sparkContext.setJobGroup("rules", "rules")
        c.converge_rounds(chunks, c.Rule(rule))
        some = len(jobs.getJobIdsForGroup("rules"))
        spark.sparkContext.setJobGroup("none", "none")
        c.converge_rounds(chunks, F.lit(None).cast("string"))
        none = len(jobs.getJobIdsForGroup("none"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert 0 < some < 9 and 0 < none < 9
