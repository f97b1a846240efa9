"""Periodic runs against a scan of every period."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from corpusloom.llm import periodic, queries
from tests.conftest import DATA
from tests.llm import fixtures

BLANKS = re.compile("[^\x20\x09-\x0d]+")


def plain_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period): stretches of words equal to those p on, the smallest p of each stretch."""
    least: dict[tuple[int, int], int] = {}
    n = len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(12, 2 * p):
                least.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in least.items())


def fast(*texts: list[int]) -> list[list[tuple[int, int, int]]]:
    named = [[b"%d" % w for w in t] for t in texts]
    return [found for found, _ in periodic._batch_runs(named)]


def text(seed: int) -> list[int]:
    r = random.Random(seed)
    n = r.randint(0, 120)
    kind = seed % 6
    if kind < 2:
        return [r.randint(0, 1 + kind) for _ in range(n)]
    if kind == 2:
        part = [r.randint(0, 3) for _ in range(r.randint(1, 40))]
        out = (part * 120)[:n]
        for _ in range(r.randint(0, 2) if out else 0):
            out[r.randrange(len(out))] = 9
        return out
    if kind == 3:
        a, b = [0], [0, 1]
        for _ in range(r.randint(1, 9)):
            a, b = b, b + a
        return b
    if kind == 4:
        part = [r.randint(0, 1) for _ in range(r.randint(1, 4))] * 30
        one, two = part[: r.randint(1, 30)], part[: r.randint(1, 30)]
        return one + two + one + two + one + part[:20]
    out = []
    while len(out) < n:
        out += [r.randint(0, 50) for _ in range(r.randint(1, 25))] * r.randint(1, 4)
    return out


@pytest.mark.parametrize("seed", range(0, 600, 60))
def test_all_runs(seed):
    texts = [text(s) for s in range(seed, seed + 60)]
    assert fast(*texts) == [plain_runs(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4))
def test_any_text(texts):
    assert fast(*texts) == [plain_runs(t) for t in texts] if texts else True


def test_every_period_and_place():
    """Shortest runs of every period up to 70, at every offset to the grid."""
    for p in range(1, 71):
        texts = []
        for before in range(0, 17):
            part = list(range(1000, 1000 + p))
            run = (part * 13)[: max(12, 2 * p)]
            texts.append([*range(before), *run, 7777])
        assert fast(*texts) == [[(b, max(12, 2 * p), p)] for b in range(17)]


def test_wavelet():
    r = random.Random(4)
    values = [r.randrange(50) for _ in range(80)]
    tree = periodic.Wavelet(np.array(values), 50)
    asked = [(a, b, v) for a in range(0, 80, 7) for b in range(a, 81, 5) for v in (0, 3, 31, 32, 49, 50)]
    low, high, value = map(np.array, zip(*asked, strict=True))
    assert tree.below(low, high, value).tolist() == [sum(x < v for x in values[a:b]) for a, b, v in asked]
    asked = [(a, b, k) for a, b, _ in asked for k in range(b - a)][::9]
    low, high, k = map(np.array, zip(*asked, strict=True))
    assert tree.smallest(low, high, k).tolist() == [sorted(values[a:b])[k] for a, b, k in asked]


def test_short_runs_are_refused():
    with pytest.raises(ValueError):
        periodic.find_runs(np.array([1, 1, -1]), 5)


def plain_report(doc_id: int | None, content: str | None) -> tuple:
    words = BLANKS.findall(content or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    s, length, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    return doc_id, len(found), s, length, q, 1000 * length // q if found else None, sha(lines), sha(kept)


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in fixtures.documents() if r[1] is None or len(r[1]) < 20_000]
    rows += [(i, fixtures.prose(i, 40 + i % 90)) for i in range(1000, 1060)]  # some of them edited
    rows += [(i, "A b a b\x0ba b a b\tA B " * 9) for i in range(3000, 3020)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start long, runs string")
    found = periodic.report(periodic.runs(df, periodic.repeated_tail))
    assert sorted(map(tuple, found.collect()), key=str) == sorted((plain_report(*r) for r in rows), key=str)
    assert dict(found.dtypes) == {"doc_id": "bigint"} | dict.fromkeys(
        ("n_runs", "start", "length", "period", "exponent_milli"), "bigint"
    ) | {"runs_sha256": "string", "collapsed_sha256": "string"}


def test_spans_and_text(spark):
    df = spark.createDataFrame([(1, "a b " * 10 + "c"), (2, None)], "doc_id long, text string")
    one, two = sorted(periodic.runs(df).collect())
    assert [tuple(r) for r in one.runs] == [(0, 20, 2)] and one.collapsed == "a b c" and one.n_words == 21
    assert two.runs == [] and two.collapsed == "" and two.n_words == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.report(periodic.runs(df)).collect() == []


def test_long_periodic_texts():
    """Highly periodic long texts end in reasonable time and find the one run."""
    part = list(range(997))
    found = fast([0] * 60_000, part * 60, (part * 60)[:-1] + [5000])
    assert found == [[(0, 60_000, 1)], [(0, 997 * 60, 997)], [(0, 997 * 60 - 1, 997)]]


def test_query(spark):
    """The registered query on the smallest table."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    found = queries.QUERIES["op12_periodic_runs"](spark, DATA).collect()
    small = {r.doc_id for r in docs if len(r.text or "") < 8_000}
    want = sorted(plain_report(*r) for r in docs if r.doc_id in small)
    assert len(found) == len(docs) and sorted(tuple(r) for r in found if r.doc_id in small) == want
