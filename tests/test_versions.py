"""Versions of tables: what readers see when a writer stops between any two steps."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.plans import converge, flows
from corpusloom.sources import versions


def rows(spark, path):
    return sorted(map(tuple, versions.read(spark, path).collect()))


class Lost(Exception):
    pass


STEPS = ["_parquet", "_point", "_prune"]


@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("when", ["before", "after"])
def test_a_writer_lost_at_any_step(spark, tmp_path, monkeypatch, step, when):
    path = str(tmp_path / "t")
    versions.put(spark.createDataFrame([(1, "old")], "id int, x string"), path)
    step_of = getattr(versions, step)

    def lost(*args):
        if when == "after":
            step_of(*args)
        raise Lost

    new = versions.read(spark, path).withColumn("x", F.lit("new"))
    with monkeypatch.context() as m, pytest.raises(Lost):
        m.setattr(versions, step, lost)
        versions.put(new, path, versions._parquet)
    done = (STEPS.index(step), when == "after") >= (1, True)
    assert rows(spark, path) == [(1, "new" if done else "old")]
    versions.put(versions.read(spark, path).withColumn("x", F.lit("later")), path)
    assert rows(spark, path) == [(1, "later")]
    versions.drop_unused(spark, path)
    assert rows(spark, path) == [(1, "later")] and sum(n.startswith("_v-") for n in os.listdir(path)) == versions.KEPT


def test_readers_that_have_begun(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.put(spark.range(3).toDF("id"), path)
    begun = versions.read(spark, path)
    versions.put(begun.where("id > 0"), path)
    assert begun.count() == 3 and versions.read(spark, path).count() == 2
    for _ in range(3):
        versions.put(versions.read(spark, path), path)
    assert len([n for n in os.listdir(path) if n.startswith("_current")]) == versions.KEPT


def test_no_version(spark, tmp_path):
    assert versions.read(spark, str(tmp_path / "none"), "id int").collect() == []
    with pytest.raises(FileNotFoundError):
        versions.read(spark, str(tmp_path / "none"))


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet") and "_b-" in d}


def test_only_changed_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "papers")
    papers = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "paper_id long, title string")
    versions.put_buckets(papers, path, "paper_id", 16)
    before = files(path)
    wide = spark.createDataFrame([(i, "raw", "fin", "why") for i in (3, 77, 1000)], "paper_id long, D_raw_category string, D_category string, D_reason string")
    hit = versions.update_buckets(spark, path, "paper_id", 16, wide, lambda base, new: converge.label_merge(base, new, ["D"]))
    after = files(path)
    assert 1 <= len(hit) <= 3 and {f: t for f, t in after.items() if f in before} == before
    assert len({os.path.basename(os.path.dirname(f)) for f in set(after) - set(before)}) == len(hit)
    got = {r.paper_id: (r.title, r.D_category) for r in versions.read_buckets(spark, path).collect()}
    assert len(got) == 200 and got[3] == ("t3", "fin") and got[77] == ("t77", "fin") and not got[5][1]
    assert versions.update_buckets(spark, path, "paper_id", 16, wide.where("paper_id < 0"), lambda b, n: b) == []
    versions.update_buckets(spark, path, "paper_id", 16, wide.withColumn("D_category", F.lit("x")), lambda base, new: converge.label_merge(base, new, ["D"]))
    assert versions.drop_unused(spark, path) == [] or versions.read_buckets(spark, path).count() == 200
    assert {r.D_category for r in versions.read_buckets(spark, path).where("paper_id IN (3, 77)").collect()} == {"x"}


def test_converge_in_versions(spark, tmp_path):
    labels = spark.createDataFrame([(d, 1, 1, "a", "r") for d in "DE"], "dim string, pos long, paper_id long, category string, reason string")
    papers = spark.createDataFrame([(1, "t"), (2, "u")], "paper_id long, paper_title string")
    tax, out = str(tmp_path / "tax"), str(tmp_path / "papers")
    reply = F.lit('{"refined_categories": [{"name": "A"}], "mapping": {"a": "A"}}')
    for dim in "DE":
        got = flows.converge(spark, labels, tax, reply, dims=dim, papers=papers, output_papers=out, in_versions=True)
    assert sorted((r.dim, r.name) for r in got.collect()) == [("D", "A"), ("E", "A")]
    assert sorted((r.paper_id, r.D_category, r.E_category) for r in versions.read(spark, out).collect()) == [(1, "A", "A"), (2, "", "")]
