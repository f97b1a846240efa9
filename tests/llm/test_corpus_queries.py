"""The registered corpus queries and the pipeline on the smallest tables."""

from __future__ import annotations

import importlib.util

import duckdb
import pytest

import corpus_pipeline
from corpusloom.llm import queries
from tests.conftest import DATA
from tests.llm.test_substrings import plain

PLAIN = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    result = con.execute(queries.ORACLES[name])
    kinds = {d[0]: str(d[1]) for d in result.description}
    assert {f.name: PLAIN[f.dataType.simpleString()] for f in df.schema} == kinds
    names = list(kinds)
    ours = sorted(([r[c] for c in names] for r in df.collect()), key=str)
    assert ours == sorted(([*r] for r in result.fetchall()), key=str)


def test_names():
    assert importlib.util.find_spec("corpusloom.llm")
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, tmp_path):
    """Every stage against its predecessor's rows, by brute force where SQL has no words for it."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    tables = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], DATA).write.parquet(str(tmp_path / str(i)))
        tables.append(spark.read.parquet(str(tmp_path / str(i))))
    assert all(t.dtypes == docs.dtypes for t in tables[:-1])
    good, once, cut, mixed = ([tuple(r) for r in t.collect()] for t in tables[1:5])
    all_ = {tuple(r) for r in docs.collect()}
    assert set(good) < all_
    clean = [r for r in all_ if labels.get(r[0]) == (1, 0)]
    assert sum(r in set(good) for r in clean) >= 0.98 * len(clean)

    from tests.llm.test_simhash import plain_components, plain_print

    prints = {r[0]: {plain_print(r[1])} for r in good}
    stay = {i for (i, _), c in plain_components(prints).items() if i == c}
    assert sorted(once) == sorted(r for r in good if r[0] in stay)
    wanted = plain([(r[0], r[1]) for r in once])
    expect = []
    for r in once:
        n, gone, _, kept = wanted[r[0]]
        if gone < n or not n:
            expect.append((r[0], kept, r[2], r[3], len(kept)) if gone else r)
    assert sorted(cut) == sorted(expect)
    assert set(mixed) <= set(cut) and len(mixed) == len(set(mixed)) > 0.5 * len(cut)
    pieces = tables[5].groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r.doc_id for r in pieces} == {r[0] for r in mixed}
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in pieces)


@pytest.mark.parametrize("rows", ["none"])
def test_pipeline_on_odd_tables(spark, tmp_path, rows):
    """Every stage, written and read again, on an empty table and on the odd fixture; clashing names stay."""
    from tests.llm import fixtures

    docs = fixtures.frame(spark, [] if rows == "none" else None)
    start = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(i)))
        last = i == len(corpus_pipeline.STAGES) - 1
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert last or docs.dtypes == start.dtypes
    assert (docs.count() == 0) == (rows == "none")


def test_pipeline_judges_by_words(spark, tmp_path):
    """The first stage keeps texts whose words follow each other as in trusted ones, not those with the same words in another order."""
    import random

    r = random.Random(7)
    # words that begin and end alike: whatever their order, the text has the same strings of four characters
    words = [f"ba{a}{b}ab" for a in "cdfgh" for b in "klmnp"]
    lines = [" ".join(words[i : i + 5]) for i in range(0, 25, 5)]
    good = [" ".join(r.choice(lines) for _ in range(30)) for _ in range(150)]
    mixed = [" ".join(r.sample(t.split(), len(t.split()))) for t in good[:10]]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good + mixed)]
    spark.createDataFrame([(i, 1, 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x.doc_id for x in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()}
    assert len(kept & set(range(150))) >= 140 and not kept & set(range(150, 160))
