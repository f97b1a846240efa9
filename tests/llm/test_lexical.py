"""Ball-tree search against a plain ranking of all documents."""

from __future__ import annotations

import math
import random
import re

import duckdb
import numpy as np
import pytest

from corpusloom.llm import lexical
from corpusloom.llm.lexical import BallTree
from tests.llm import fixtures

ITEMS = "item_id long, text string, doc_id long, score long, term string"


def cut(text: str | None) -> list[str]:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(lexical.TERM, lower)


def plain_rank(docs: list[tuple], items: list[tuple], top: int = lexical.TOP) -> list[tuple]:
    counted = [(i, cut(t)) for i, t in docs]
    n = sum(bool(t) for _, t in counted)
    length = sum(len(t) for _, t in counted)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(cut(t))
    out = []
    for item, terms in asked.items():
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in x for _, x in counted) + 1))) for t in terms}
        found = []
        for i, have in counted:
            if have:
                m = 50 + 50 * len(have) * n // length
                found.append((i, sum(w * (10**9 * have.count(t) // (1000 * have.count(t) + 20 * m)) for t, w in weight.items())))
        found = sorted((x for x in found if x[1] > 0), key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        out += [(item, r, *x) for r, x in enumerate(found[:top], 1)]
    return sorted(out, key=str)


def ranked(spark, docs, items, **more) -> list[tuple]:
    frame = spark.createDataFrame([(*i, 1, 2, "x") for i in items], ITEMS)
    df = lexical.rank(docs, frame, **more)
    assert df.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("top", [1, 3, 50])
def test_odd_rows(spark, top):
    rows = fixtures.documents()
    items = [(1, fixtures.prose(5, 20)), (2, None), (3, ""), (4, "One 漢字 É é A-b_c 12"), (1, "dra x"), (None, "the same line"), (6, "no such terms qqq")]
    items += [(7, " ".join(t for t in fixtures.texts() if t)), (8, "word"), (9, "line line\tLINE")]
    docs = [(r[0], r[1]) for r in rows]
    assert ranked(spark, fixtures.frame(spark).repartition(5), items, top=top) == plain_rank(docs, items, top)


def test_blocks_of_documents_and_queries(spark, monkeypatch):
    """Several trees a task and several blocks of queries give the same as one."""
    for name, value in (("BLOCK_DOCS", 7), ("QUERY_TERMS", 30)):
        monkeypatch.setattr(lexical, name, value)
    items = [(i, fixtures.prose(i, 12)) for i in range(12)]
    docs = [(r[0], r[1]) for r in fixtures.documents()]
    assert ranked(spark, fixtures.frame(spark).coalesce(2), items, top=5) == plain_rank(docs, items, 5)


def test_empty(spark):
    none, some = fixtures.frame(spark, []), [(1, "word")]
    assert ranked(spark, none, some) == ranked(spark, fixtures.frame(spark), []) == []


def test_equal_texts_rank_by_id(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(300, 0, -1)] + [(999, "other")], "doc_id long, text string")
    found = ranked(spark, docs.repartition(7), [(1, "words")])
    assert [r[2] for r in sorted(found, key=lambda r: r[1])] == list(range(1, 51))


def vectors(seed: int, docs: int, width: int):
    r = random.Random(seed)
    rows = [{a: r.randint(1, 2**34) for a in r.sample(range(width), r.randint(1, 6))} for _ in range(docs)]
    rows += rows[: docs // 4]  # copies
    sizes = np.array([len(x) for x in rows])
    return rows, np.cumsum(sizes) - sizes, np.array([a for x in rows for a in x]), np.array([v for x in rows for v in x.values()])


@pytest.mark.parametrize(("docs", "width", "leaf"), [(1, 10, 4), (90, 12, 1), (200, 40, 4), (300, 200, 8)])
def test_bounds_hold_and_prune(docs, width, leaf):
    rows, starts, axes, values = vectors(docs, docs, width)
    tree = BallTree(starts, axes, values, width, leaf)
    r = random.Random(1)
    scored = leaves = 0
    for _ in range(30):
        query = np.array(sorted(r.sample(range(width), r.randint(1, 8))))
        exact = [sum(row.get(a, 0) for a in query.tolist()) for row in rows]
        bounds = tree.bounds(query)
        for node, (low, high) in enumerate(tree.spans):
            assert bounds[node] >= max(exact[i] for i in tree.order[low:high])
        marks = np.zeros(width, np.int64)
        marks[query] = 1
        best: list = []
        scored += tree.search(query, marks, best, 5, list(range(len(rows))))
        leaves += sum(c is None for c in tree.children)
        want = sorted(((s, -i) for i, s in enumerate(exact) if s), reverse=True)[:5]
        assert sorted(best, reverse=True) == want
    assert docs < 200 or scored < 0.8 * leaves


def test_long_texts_are_cut_at_terms(monkeypatch):
    text = fixtures.prose(3, 500).encode()
    whole = lexical.term_counts(text)
    monkeypatch.setattr(lexical, "CHUNK", 50)
    assert lexical.term_counts(text) == whole and whole.total() == len(cut(text.decode()))


def test_terms_in_sql_and_tasks(spark):
    texts = [t or "" for t in fixtures.texts()] + ["İSTANBUL ſK straße á \x7f~b", "\u0080x y"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for text, found in df.select("text", lexical.terms(df.text)).collect():
        assert sorted(found) == sorted(t.decode() for t in lexical.term_counts(text.encode()).elements()) == sorted(cut(text))


def test_twin_on_odd_rows(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    rows = [(r[0], r[1]) for r in fixtures.documents() if r[1] is None or len(r[1]) < 5_000]
    items = [(i, fixtures.prose(i, 12)) for i in range(6)] + [(9, None), (9, "É 漢字 One")]
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    assert sorted(con.execute(lexical.ORACLE).fetchall(), key=str) == plain_rank(rows, items)
