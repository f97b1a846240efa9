"""Repeated passages against a search over all windows."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from corpusloom.llm import substrings
from tests.llm import fixtures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows: list[tuple[int, str | None]], window: int = 20) -> dict[int, tuple]:
    """For different ids: (n_words, n_removed, digest)."""
    seen: dict[tuple, tuple] = {}
    out = {}
    for i, t in sorted(rows):
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if seen.setdefault(key, (i, s)) < (i, s):
                gone[s : s + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def test_word_hashes_tell_words_apart(monkeypatch):
    text = fixtures.prose(3, 3000) + "\n x\t y\x0bz  aa a"
    words = text.split()
    hashes = substrings.word_hashes(text.encode()).tolist()
    assert len(hashes) == len(words)
    assert len(set(hashes)) == len(set(words)) == len(set(zip(hashes, words, strict=True)))
    monkeypatch.setattr(substrings, "PIECE", 100)
    assert substrings.word_hashes(text.encode()).tolist() == hashes
    long = ("a " + "b" * 5000 + " c").encode()
    assert len(substrings.word_hashes(long)) == 3


def test_anchor_is_the_rightmost_minimum():
    r = np.random.default_rng(1)
    hashes = r.integers(0, 50, 300).astype(np.uint64)
    grams, best = substrings.anchors(hashes)
    for s, b in enumerate(best.tolist()):
        part = grams[s : s + 17]
        assert b == max(s + i for i, g in enumerate(part) if g == part.min())


def test_fixture(spark):
    rows = [r for r in fixtures.documents() if r[0] is not None][:-1]
    found = substrings.repeats(fixtures.frame(spark, [(*r,) for r in rows]), with_text=True).collect()
    wanted = plain(list({r[0]: (r[0], r[1]) for r in rows}.values()))
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_words, r.n_removed, r.kept_sha256) == wanted[r.doc_id][:3], r.doc_id
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all(s.end - s.start >= 20 for s in r.spans)
        if r.n_removed:
            assert r.kept_text == wanted[r.doc_id][3]


def test_odd_ids(spark):
    found = substrings.repeats(fixtures.frame(spark)).collect()
    assert len(found) == len(fixtures.documents())
    base = [r for r in found if r.doc_id is None and r.n_words == 300]
    assert [r.n_removed for r in base] == [300]


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    """Few words, many overlapping repeats."""
    r = random.Random(seed)
    pool = [[r.choice("abcdefgh") for _ in range(r.randint(10, 60))] for _ in range(6)]
    rows = []
    for i in range(60):
        words = [w for _ in range(r.randint(0, 4)) for w in r.choice(pool)[r.randint(0, 12) :]]
        rows.append((i, r.choice([" ", "\n"]).join(words) or None))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substrings.repeats(docs).collect()}
    assert found == {i: w[:3] for i, w in plain(rows).items()}


def test_filter(spark):
    docs = fixtures.frame(spark)
    kept = substrings.without_repeats(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    rows = kept.collect()
    assert all(r.n_chars == len(r.text) for r in rows if r.doc_id and r.doc_id > 30 and r.text)
    assert substrings.without_repeats(fixtures.frame(spark, [])).collect() == []
