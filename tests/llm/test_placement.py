"""The lookup table and what stands on it."""

from __future__ import annotations

from collections import Counter

import pytest

from corpusloom.llm import placement
from tests.llm import fixtures


def test_shares_differ_by_one():
    held = Counter(placement.fill(placement.shard_names()))
    assert sum(held.values()) == placement.SLOTS and max(held.values()) - min(held.values()) <= 1


def test_few_slots_move():
    names = placement.shard_names(20)
    all_, fewer = placement.fill(names), placement.fill(names[:-1])
    moved = sum(a != b for a, b in zip(all_, fewer) if a != 19)
    assert moved / placement.SLOTS < 0.1


@pytest.mark.parametrize("slots", [1, 10, 4098])
def test_prime_only(slots):
    with pytest.raises(ValueError):
        placement.fill(["a"], slots)


def test_one_shard():
    assert set(placement.fill(["a"], 7)) == {0}


def test_place(spark):
    docs = fixtures.frame(spark).withColumnRenamed("m", "Slot")
    placed = placement.place(docs, placement.shard_names(8), 101)
    rows = placed.collect()
    assert len(rows) == len(fixtures.documents())
    assert len({(r.doc_id, r.shard) for r in rows if r.doc_id is not None}) == len({r.doc_id for r in rows if r.doc_id is not None})
    assert all(r.shard for r in rows)
    assert [c.lower() for c in placed.columns].count("slot") == 1
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "hashpartitioning" not in plan
    assert placement.place(fixtures.frame(spark, []), ["a"]).collect() == []
