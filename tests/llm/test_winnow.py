"""Fingerprints against a window-by-window choice, and the edited texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from corpusloom.llm import winnow
from tests.llm import fixtures


def plain(text: str, k: int, window: int) -> list[tuple[int, int]]:
    if not text:
        return []
    h = winnow.gram_hashes(np.array([ord(c) for c in text], np.uint32), k).tolist()
    w = min(window, len(h))
    chosen = {max(i for i in range(s, s + w) if h[i] == min(h[s : s + w])) for s in range(len(h) - w + 1)}
    return [(h[i], i) for i in sorted(chosen)]


@pytest.mark.parametrize("k,window", [(1, 1), (3, 4), (5, 7), (24, 64)])
def test_choice(k, window):
    for text in ["", "a", "ab" * 60, "aaaaaaaaaaaaaaaaaaaaaaaa" * 9, fixtures.prose(1, 120), "é漢𝄞" * 50]:
        h, p = winnow.winnow(winnow._points(text), k, window)
        assert list(zip(h.tolist(), p.tolist())) == plain(text, k, window)


def test_shared_passage_is_found():
    passage = fixtures.prose(8, 60)[: winnow.K + winnow.WINDOW - 1]
    a, b = (winnow.winnow(winnow._points(fixtures.prose(s, 40) + passage + fixtures.prose(s + 1, 40)))[0] for s in (20, 30))
    assert np.intersect1d(a, b).size


def expected(rows):
    """(id, edited digest) for different ids in the defined order; null ids last, repeated ids by text."""
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1] or ""))
    out = []
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        n = len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        out.append((str(r[0]), n, hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("rows", [fixtures.documents(), fixtures.documents()[:1], fixtures.documents()[9:11], []])
def test_edited(spark, rows):
    found = winnow.edited_fingerprints(fixtures.frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in found) == expected(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    texts = {r[0]: r[1] or "" for r in rows if r[0] != 4}
    prints: dict = {}
    for r in found:
        if r.doc_id in texts:
            prints.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
    assert all(len(v) == 1 for t, v in prints.items() if t != texts.get(None))


def test_rows(spark):
    docs = fixtures.frame(spark)
    assert winnow.fingerprints(docs).where("doc_id = 4").count() == 0 + len(
        [1 for r in fixtures.documents() if r[0] == 4 for _ in plain(r[1] or "", winnow.K, winnow.WINDOW)]
    )


def test_short_texts_stay_near_their_edited_copies(spark):
    """Two thirds of a text are unchanged: that shows from 11 characters up, where they hold K."""
    rows = [(n, fixtures.prose(300 + n, 60)[:n], "en", "s", 1, 1, "x", 2, "y", "z") for n in range(11, 200)]
    found = winnow.edited_fingerprints(fixtures.frame(spark, rows)).collect()
    assert len(found) == len(rows)
    assert [r.doc_id for r in found if r.near_edited <= r.near_next] == []


def plain_hashes(text: str, k: int) -> list[int]:
    """32-bit hashes of all runs of k code points, one by one."""
    mask = 2**64 - 1

    def mixed(x: int) -> int:
        x = (x ^ (x >> 31)) * 0xBF58476D1CE4E5B9 & mask
        return x ^ (x >> 29)

    x = [mixed(ord(c) + 0x1234567) for c in text]
    k = min(k, len(x))
    power = [1] + [pow(0x9E3779B97F4A7C15, i, 2**64) for i in range(1, k)]
    return [mixed(sum(x[s + i] * power[k - 1 - i] for i in range(k)) & mask) >> 32 for s in range(len(x) - k + 1)] if k else []


def plain_print(text: str) -> list[tuple[int, int]]:
    h = plain_hashes(text, winnow.K)
    least = len(text) - len(text) // 3
    w = 1 if least < winnow.K + winnow.WINDOW - 1 else min(winnow.WINDOW, len(h))
    chosen = {max(i for i in range(s, s + w) if h[i] == min(h[s : s + w])) for s in range(len(h) - w + 1)}
    return [(h[i], i) for i in sorted(chosen)]


def plain_likeness(a: list, b: list) -> float:
    x, y = {h for h, _ in a}, {h for h, _ in b}
    return len(x & y) / len(x | y) if x or y else 1.0


def test_prints_and_likeness(spark):
    """Every column of the query against plain Python, with the production k and window."""
    rows = [(i, t) for i, t in enumerate(t for t in fixtures.texts() if t is None or len(t) < 6_000)]
    found = winnow.edited_fingerprints(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")).collect()
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    shown = lambda p: " ".join(f"{h:08x}:{at:x}" for h, at in p)
    want = {}
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        own, other, new = plain_print(t), plain_print(after), plain_print(edited)
        want[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(own), shown(new), plain_likeness(own, new), plain_likeness(own, other))
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in found}
    assert got == want


def test_a_print_is_written_from_one_that_begins_alike():
    r = np.random.default_rng(5)
    for n in (0, 1, 5, 40, 700, 9000):
        text = "".join(map(chr, r.integers(97, 123, n)))
        one = winnow.chosen(text)
        plain = " ".join(f"{h:08x}:{p:x}" for h, p in zip(one[0].tolist(), one[1].tolist()))
        assert winnow.written(*one) == plain
        for other in (text, "", text[: n // 2], text[: n - n // 3] + "other words behind it", "x" + text):
            two = winnow.chosen(other)
            assert winnow.written_after(plain, one, two) == winnow.written(*two)
