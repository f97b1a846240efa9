"""Raked weights and the sample drawn by them."""

from __future__ import annotations

import pytest

from corpusloom.llm import mixing
from tests.llm import fixtures

CELLS = "source string, lang string, topic string, mass long"


def shares_of(cells: list[tuple], chances) -> dict[tuple[str, str], float]:
    """Expected share of every value of every dimension."""
    mass = {c[:3]: c[3] for c in cells}
    held = {(r.source, r.lang, r.topic): r.probability * mass[r.source, r.lang, r.topic] for r in chances.collect()}
    out: dict[tuple[str, str], float] = {}
    for c, h in held.items():
        for d, v in zip(mixing.DIMENSIONS, c, strict=True):
            out[d, v] = out.get((d, v), 0) + h / sum(held.values())
    return out


@pytest.mark.parametrize("budget", [0.05, 0.3, 1.0, None])
def test_marginals_meet_their_targets(spark, budget):
    cells = [(f"s{i}", f"l{j}", f"t{k}", 1000 + 97 * i * (j + 1) + 31 * k) for i in range(5) for j in range(3) for k in range(2)]
    targets = {"source": {f"s{i}": i + 1 for i in range(5)}, "lang": {"l0": 1, "l1": 1, "l2": 2, "other": 9}}
    chances, got, gap = mixing.fitted(spark.createDataFrame(cells, CELLS), targets, budget)
    found = shares_of(cells, chances)
    assert gap <= mixing.TOLERANCE and got <= (budget or 1)
    for i in range(5):
        assert found["source", f"s{i}"] == pytest.approx((i + 1) / 15, rel=0.011)
    for j, share in enumerate([0.25, 0.25, 0.5]):
        assert found["lang", f"l{j}"] == pytest.approx(share, rel=0.011)
    kept = sum(r.probability * m for r in chances.collect() for *c, m in cells if tuple(c) == (r.source, r.lang, r.topic))
    assert kept / sum(c[3] for c in cells) == pytest.approx(got, rel=0.01)
    assert got == pytest.approx(min(budget or 1, got)) and (budget not in (0.05, 0.3) or got == budget)


def plain_fit(cells: list[tuple], goal: float, sweeps: int) -> list[float]:
    """Bounded raking in plain Python, with the default targets."""
    weight = [float(c[3]) for c in cells]
    for _ in range(sweeps):
        for i, d in enumerate(mixing.DIMENSIONS):
            values = {c[i] for c in cells}
            w = {v: sum(c[3] for c in cells if c[i] == v) ** mixing.TEMPERATURE[d] for v in values}
            held = {v: sum(min(x, c[3]) for c, x in zip(cells, weight) if c[i] == v) for v in values}
            weight = [x * goal * w[c[i]] / sum(w.values()) / held[c[i]] for c, x in zip(cells, weight)]
    return [min(x, c[3]) / c[3] for c, x in zip(cells, weight)]


@pytest.mark.parametrize("few", [1_000_000, 1])
def test_fit_equals_plain_raking(spark, monkeypatch, few):
    """By windows, and by sums for more cells than fit them."""
    monkeypatch.setattr(mixing, "MAX_BROADCAST", few)
    monkeypatch.setattr(mixing, "SWEEPS", 2)
    cells = skewed()
    chances, budget, _ = mixing.fitted(spark.createDataFrame(cells, CELLS), budget=0.2, tolerance=1.0)
    want = plain_fit(cells, budget * sum(c[3] for c in cells), 2)
    got = {(r.source, r.lang, r.topic): r.probability for r in chances.collect()}
    assert budget == 0.2 and [got[c[:3]] for c in cells] == pytest.approx(want, abs=2e-6)


def test_registered_query_meets_its_targets(spark):
    """Expected shares of the query's own default call."""
    from corpusloom.llm import queries
    from tests.conftest import DATA

    rows = queries.QUERIES["op9_mixing"](spark, DATA).collect()
    cells: dict[tuple, int] = {}
    for r in rows:
        cells[r.source, r.lang, r.topic] = cells.get((r.source, r.lang, r.topic), 0) + r.tokens
    for i, d in enumerate(mixing.DIMENSIONS):
        w = {v: sum(m for c, m in cells.items() if c[i] == v) ** mixing.TEMPERATURE[d] for v in {c[i] for c in cells}}
        held = {v: sum(r.tokens * r.probability for r in rows if r[d] == v) for v in w}
        for v, x in w.items():
            assert held[v] / sum(held.values()) == pytest.approx(x / sum(w.values()), rel=mixing.TOLERANCE * 1.01)


def test_values_without_a_target_get_none(spark):
    docs = fixtures.frame(spark)
    found = mixing.mix(docs, {"source": {"src0": 1.0}}).collect()
    assert {r.kept for r in found if r.source != "src0"} == {False}


def test_sample(spark):
    docs = fixtures.frame(spark)
    found = mixing.mix(docs).collect()
    assert len(found) == len(fixtures.documents())
    assert all(0 <= r.probability <= 1 and not (r.kept and r.tokens == 0) for r in found)
    assert {r.lang for r in found} == {"en", "fr", mixing.NONE}
    kept = mixing.sampled(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in found if r.kept)
    twice = [(*r[:1], "some text here", *r[2:]) for r in fixtures.documents()[7:8] * 4]
    assert len({r.kept for r in mixing.mix(fixtures.frame(spark, twice)).collect()}) == 1


def test_empty(spark):
    none = fixtures.frame(spark, [])
    assert mixing.mix(none).collect() == mixing.sampled(none).collect() == []
    blank = fixtures.frame(spark, fixtures.documents()[:2])
    assert [r.kept for r in mixing.mix(blank).collect()] == [False, False]


def test_many_cells(spark, monkeypatch):
    wanted = sorted((str(r.doc_id), r.kept) for r in mixing.mix(fixtures.frame(spark)).collect())
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 1)
    assert sorted((str(r.doc_id), r.kept) for r in mixing.mix(fixtures.frame(spark)).collect()) == wanted


def skewed():
    """One source with a third of the mass, a rare language and a rare topic, and cells of very different sizes."""
    return [
        (f"s{i}", f"l{j}", f"t{k}", (9000 if i == 0 else 1000 + 70 * i) // (1 + 5 * j) // (1 + 9 * k) + (i * j * k) % 7)
        for i in range(12) for j in range(3) for k in range(2)
    ]


def test_bounded_raking_meets_its_targets(spark):
    cells = spark.createDataFrame(skewed(), CELLS)
    chances, budget, gap = mixing.fitted(cells)
    mass = {r[:3]: r[3] for r in skewed()}
    held = {(r.source, r.lang, r.topic): r.probability * mass[r.source, r.lang, r.topic] for r in chances.collect()}
    assert sum(held.values()) / sum(mass.values()) == pytest.approx(budget, rel=0.01) and 0.3 < budget < 0.9
    for i, d in enumerate(mixing.DIMENSIONS):
        wanted = {v: sum(m for c, m in mass.items() if c[i] == v) ** mixing.TEMPERATURE[d] for v in {c[i] for c in mass}}
        for v, w in wanted.items():
            share = sum(h for c, h in held.items() if c[i] == v) / sum(held.values())
            assert share == pytest.approx(w / sum(wanted.values()), rel=mixing.TOLERANCE * 1.01)
    found = mixing.gaps(cells, chances).agg({"gap": "max"}).head()[0]
    assert found == pytest.approx(gap, abs=1e-4) and gap <= mixing.TOLERANCE


def test_contradicting_targets_leave_a_gap_that_is_told(spark):
    rows = [("a", "x", "t", 100), ("b", "y", "t", 100)]
    targets = {"source": {"a": 1, "b": 1}, "lang": {"x": 1, "y": 3}}
    _, budget, gap = mixing.fitted(spark.createDataFrame(rows, CELLS), targets)
    assert gap > mixing.TOLERANCE and budget == pytest.approx(2 / 3)  # none is lost for nothing
    assert mixing.fitted(spark.createDataFrame(rows, CELLS), targets, 0.2)[1] == 0.2


def test_stage_meets_its_targets(spark, tmp_path):
    """The mix of the pipeline, on documents of equal size: drawn shares near the targets of their mass."""
    import corpus_pipeline

    rows = []
    for s, l, n in [("s0", "en", 3000), ("s0", "fr", 200), ("s1", "en", 900), ("s1", "fr", 500), ("s2", "en", 400), ("s2", "fr", 100)]:
        rows += [(len(rows) + i, "some plain words", l, s, 16, 1, "x", 2, "y", "z") for i in range(n)]
    kept = corpus_pipeline.mix(spark, fixtures.frame(spark, rows), "").groupBy("source", "lang").count().collect()
    total = sum(r["count"] for r in kept)
    for i, d in ((3, "source"), (2, "lang")):
        wanted = {v: sum(r[i] == v for r in rows) ** mixing.TEMPERATURE[d] for v in {r[i] for r in rows}}
        for v, w in wanted.items():
            share = sum(r["count"] for r in kept if r[d] == v) / total
            assert share == pytest.approx(w / sum(wanted.values()), abs=0.015)


def test_no_budget_on_empty_tables(spark):
    assert mixing.sampled(fixtures.frame(spark, []), budget=None).collect() == []
    assert [r.kept for r in mixing.mix(fixtures.frame(spark, fixtures.documents()[:2]), budget=None).collect()] == [False, False]
