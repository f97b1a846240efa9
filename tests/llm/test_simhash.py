"""Near-duplicates against all pairs."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from corpusloom.llm import simhash
from corpusloom.llm.components import components
from tests.llm import fixtures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_print(text: str | None) -> int:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints: dict[int, set[int]]) -> dict[tuple[int, int], int]:
    """(id, print) to the smallest id reachable."""
    nodes = sorted({f for fs in prints.values() for f in fs})
    root = {f: f for f in nodes}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in combinations(nodes, 2):
        if (a ^ b).bit_count() <= 4:
            root[top(a)] = top(b)
    low: dict[int, int] = {}
    for i, fs in prints.items():
        for f in fs:
            low[top(f)] = min(low.get(top(f), i), i)
    return {(i, f): low[top(f)] for i, fs in prints.items() for f in fs}


def test_triples_hit_every_choice_of_four():
    assert all(any(set(t) <= set(q) for t in simhash.TRIPLES) for q in combinations(range(8), 4))


def test_fixture(spark):
    rows = fixtures.documents()
    found = simhash.near_duplicates(fixtures.frame(spark)).collect()
    prints: dict[int, set[int]] = {}
    for r in rows:
        if r[0] is not None:
            prints.setdefault(r[0], set()).add(plain_print(r[1]))
    classes = plain_components(prints)
    wanted = sorted((str(r[0]), f"{plain_print(r[1]):016x}", str(classes.get((r[0], plain_print(r[1]))))) for r in rows)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == wanted


def test_links_reach_all_near_pairs(spark, monkeypatch):
    """Random prints in tight groups, entries larger than a block."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    r = np.random.default_rng(3)
    prints = set()
    for _ in range(6):
        centre = int(r.integers(0, 2**63))
        for _ in range(120):
            flips = r.choice(64, int(r.integers(0, 7)), replace=False)
            prints.add(centre ^ sum(1 << int(b) for b in flips))
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    df = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, rep long")
    roots = {x.node: x.root for x in components(simhash.links(df)).collect()}
    wanted = plain_components({i: {f & (2**64 - 1)} for i, f in enumerate(signed)})
    assert {i: roots.get(i, i) for i in range(len(signed))} == {i: c for (i, _), c in wanted.items()}


def test_long_way(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1001)], "a long, b long")
    found = {r.node: r.root for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


def test_one_of_each_group_stays(spark):
    docs = fixtures.frame(spark)
    kept = simhash.distinct_documents(docs).collect()
    classes = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs).collect()}
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(ids) == len(set(ids))
    assert set(ids) == {c for c in classes.values() if c is not None}
    assert kept[0].asDict().keys() == docs.first().asDict().keys()


def test_empty(spark):
    assert simhash.near_duplicates(fixtures.frame(spark, [])).collect() == []
    assert simhash.distinct_documents(fixtures.frame(spark, [])).collect() == []


@pytest.mark.parametrize("text", ["x", "a b c d e", "Ä ä Ö"])
def test_prints(text):
    assert simhash.fingerprint(text.encode()) & (2**64 - 1) == plain_print(text)
