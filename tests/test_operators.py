from __future__ import annotations

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.ask import ask, call_model, call_stats, semantic_map
from corpusloom.operators.lookup import hot_keys, lookup
from corpusloom.operators.numbering import assign_paper_ids, number_rows, running_sums
from corpusloom.plans import flows


def test_number_rows_within_groups(spark):
    rng = random.Random(1)
    rows = [(f"g{rng.choice([0, 0, 0, 0, 1, 2])}", i, rng.randrange(50)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(7)
    got = number_rows(df, [F.col("v").desc(), F.col("i")], within=["g"], name="rank").collect()
    expected = {}
    for g in {r[0] for r in rows}:
        for n, row in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])), 1):
            expected[row] = n
    assert {(r.g, r.i, r.v): r["rank"] for r in got} == expected


def test_assign_paper_ids_spans_partitions(spark):
    df = spark.range(5000).withColumn("k", F.md5(F.col("id").cast("string"))).repartition(9)
    got = [r.k for r in assign_paper_ids(df, ["k"]).orderBy("paper_id").collect()]
    assert got == sorted(got)
    assert assign_paper_ids(df, ["k"]).agg(F.min("paper_id"), F.max("paper_id"), F.countDistinct("paper_id")).head()[:] == (1, 5000, 5000)


def test_lookup_spreads_hot_keys_without_changing_the_result(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 50}") for i in range(3000)] + [(9999, None)]
    facts = spark.createDataFrame(rows, "i int, k string")
    table = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(40)]], "k string, v int")
    counts = facts.groupBy("k").agg(F.count("*").alias("n"))
    assert [(r.k, r["_fan"]) for r in hot_keys(counts, 500).collect()] == [("hot", 4)]
    # every key by its own size
    two = spark.createDataFrame([("a", 5000), ("b", 700), ("c", 10)], "k string, n long")
    assert {r.k: r["_fan"] for r in hot_keys(two, 500).collect()} == {"a": 10, "b": 2}
    assert hot_keys(counts, 5000) is None
    plain = sorted(map(tuple, facts.join(table, "k", "left").select("i", "k", "v").collect()))
    spread = lookup(facts, table, ["k"], counts, hot_rows=500)
    assert sorted(map(tuple, spread.select("i", "k", "v").collect())) == plain
    salts = [e for e in lookup(facts, table, ["k"], counts, hot_rows=500)._jdf.queryExecution().toString().splitlines() if "_salt" in e]
    assert salts


def responder_with(calls, bad=(), raises=()):
    def answer(prompts):
        calls.add(len(prompts))
        if any(p in raises for p in prompts):
            raise RuntimeError("service down")
        return [None if p in bad else "{broken" if p == "broken" else '{"p": "' + p + '"}' for p in prompts]

    return answer


def test_call_model_retries_and_keeps_every_row(spark):
    calls = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "b", "broken", "none", "down"])], "i int, prompt string")
    got = {
        r.prompt: r
        for r in call_model(df, "prompt", responder_with(calls, {"none"}, {"down"}), qps=0, backoff_s=0, concurrency=2).collect()
    }
    assert got["a"].response == '{"p": "a"}' and got["a"].attempts == 1 and got["a"].error is None
    assert got["broken"].response is None and got["broken"].attempts == 3 and "not JSON" in got["broken"].error
    assert got["none"].response is None and got["none"].error == "no response"
    assert got["down"].error == "RuntimeError: service down"
    assert calls.value == 2 + 3 * 3


def test_call_model_text_is_not_parsed(spark):
    df = spark.createDataFrame([("plain",)], "prompt string")
    row = call_model(df, "prompt", lambda ps: ["any text"], parse="text", qps=0).head()
    assert row.response == "any text"


def test_call_model_paces_requests(spark):
    df = spark.range(6).select(F.col("id").cast("string").alias("prompt"))
    began = time.monotonic()
    call_model(df, "prompt", lambda ps: ["{}"] * len(ps), qps=10, concurrency=1).collect()
    assert time.monotonic() - began >= 0.5


def test_semantic_map_calls_once_per_distinct_prompt_and_caches(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    df = spark.range(200).select("id", (F.col("id") % 20).cast("string").alias("prompt"))
    cache = str(tmp_path / "cache")
    opts = {"qps": 0, "backoff_s": 0, "cache_path": cache, "concurrency": 3}
    first = semantic_map(df, "prompt", responder_with(calls), commit_every=50, **opts)
    assert first.count() == 200 and first.where("response IS NULL").isEmpty()
    assert calls.value == 20
    semantic_map(df, "prompt", responder_with(calls), **opts).collect()
    assert calls.value == 20
    semantic_map(df, "prompt", responder_with(calls), tag="other model", **opts).collect()
    assert calls.value == 40


def test_semantic_map_asks_again_after_a_failure(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, prompt string")
    opts = {"qps": 0, "backoff_s": 0, "cache_path": str(tmp_path / "cache"), "max_attempts": 1}
    semantic_map(df, "prompt", responder_with(calls, bad={"b"}), **opts)
    got = semantic_map(df, "prompt", responder_with(calls), **opts)
    assert {r.id: r.response for r in got.collect()} == {1: '{"p": "a"}', 2: '{"p": "b"}'}
    assert calls.value == 3


def test_requests_keep_the_rate_over_tasks_and_commits(spark, tmp_path):
    log = str(tmp_path / "calls")

    def answer(prompts):
        with open(log, "a") as f:
            f.write("".join(f"{time.time()}\n" for _ in prompts))
        return ["{}"] * len(prompts)

    df = spark.range(24).select("id", F.col("id").cast("string").alias("prompt"))
    began = time.time()
    semantic_map(df, "prompt", answer, qps=8, concurrency=4, commit_every=10).collect()
    took = time.time() - began
    times = sorted(map(float, open(log)))
    assert len(times) == 24
    assert all(sum(t <= x < t + 1 for x in times) <= 9 for t in times)
    assert took < 20  # three seconds of calls; the rest is Spark


def test_input_of_a_call_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    df = spark.range(100).select("id", (F.col("id") % 7).cast("string").alias("prompt")).mapInPandas(count, "id long, prompt string")
    assert semantic_map(df, "prompt", responder_with(spark.sparkContext.accumulator(0)), qps=0).count() == 100
    assert seen.value == 100


def test_cache_is_read_by_tag_and_by_request(spark, tmp_path):
    cache = str(tmp_path / "cache")
    df = spark.range(5).select("id", F.col("id").cast("string").alias("prompt"))
    for tag in ("a", "b"):
        done = semantic_map(df, "prompt", responder_with(spark.sparkContext.accumulator(0)), qps=0, cache_path=cache, tag=tag)
    assert len([p for p in os.listdir(cache) if p.startswith("tag_hash=")]) == 2
    plan = done._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(tag_hash" in plan and "LeftSemi" in plan


def test_commits_hold_their_share(spark):
    sizes = []

    def sized(df, prompt, responder, *, rows, **options):
        sizes.append((rows, df.count()))
        return call_model(df, prompt, responder, rows=rows, **options)

    with pytest.MonkeyPatch.context() as m:
        m.setattr("corpusloom.operators.ask.call_model", sized)
        df = spark.range(23).select("id", F.col("id").cast("string").alias("prompt"))
        done = semantic_map(df, "prompt", responder_with(spark.sparkContext.accumulator(0)), qps=0, commit_every=5)
    assert sizes == [(5, 5)] * 4 + [(3, 3)]
    assert done.where("response IS NULL").isEmpty()


def test_names_given_twice_keep_the_last_value(spark):
    df = spark.createDataFrame([("a",)], "prompt string")
    row = call_model(df, "prompt", lambda ps: ['{"score": 4, "score": 5, "x": {"y": 1, "y": "é"}}'], qps=0).head()
    assert row.response == '{"score": 5, "x": {"y": "é"}}'


def test_a_resumed_filter_run_calls_nothing(spark, tmp_path):
    calls, worded = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def criteria(prompts):
        worded.add(1)
        return [f'{{"criteria": {{"5": "wording {time.time_ns()}"}}}}' for _ in prompts]

    def score(prompts):
        calls.add(len(prompts))
        return ['{"score": 4}' for _ in prompts]

    papers = spark.createDataFrame([(i, f"t{i}", "a", "k") for i in range(1, 4)], "paper_id long, paper_title string, paper_abstract string, paper_keywords string")
    for _ in range(2):
        flows.filter_papers(
            spark, papers, str(tmp_path / "out"), "x", score, criteria_responder=criteria, qps=0, cache_path=str(tmp_path / "cache")
        )
    assert (calls.value, worded.value) == (3, 1)


def test_running_sums(spark):
    rows = [(f"{i:05}", i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, n long").repartition(5)
    got = {r.k: r.b for r in running_sums(df, "k", "n", "b").collect()}
    total = 0
    for k, n in rows:
        assert got[k] == total
        total += n


def test_ask_accepts_a_column(spark):
    df = spark.createDataFrame([(1, "t"), (2, "u")], "paper_id int, t string")
    got = ask(df, F.concat(F.lit("say "), F.col("t")), F.to_json(F.struct("prompt")), ["paper_id"])
    assert {r.paper_id: r.response for r in got.collect()} == {1: '{"prompt":"say t"}', 2: '{"prompt":"say u"}'}
    assert call_stats(got).head()[:] == (2, 2)


def test_scratch_needs_a_named_folder():
    from corpusloom.operators.scratch import scratch_folder

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "local[4]"

        def getCheckpointDir(self):
            return None

    class Session:
        conf = Conf()
        sparkContext = Context()

    with pytest.raises(ValueError, match="checkpoint"):
        scratch_folder(Session())


def test_leaves_that_are_not_asked_for_are_not_joined(spark, monkeypatch):
    """Numbers, nulls and empty values have no key: joined, all of them would come to one task."""
    from corpusloom.plans import translate

    joined = []

    def seen(facts, *args):
        joined.extend(r["value"] for r in facts.select("value").collect())
        return lookup(facts, *args)

    monkeypatch.setattr(translate, "lookup", seen)
    rows = [(i, f'{{"a": {i}, "b": null, "c": "text {i % 2}", "d": "x", "e": [], "f": ""}}') for i in range(6)]
    docs = spark.createDataFrame([*rows, (9, None)], "doc_id long, document string")
    done = translate.translate_json(docs, ["doc_id"], F.concat(F.lit("fr:"), F.col("value")))
    got = {r.doc_id: r.document for r in done.collect()}
    assert got == {i: f'{{"a":{i},"b":null,"c":"fr:text {i % 2}","d":"x","e":[],"f":""}}' for i in range(6)} | {9: None}
    assert sorted(joined) == ["text 0"] * 3 + ["text 1"] * 3
