"""Every id in one piece, little padding, and the ids of the vocabulary's own library."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import packing
from tests.llm import fixtures

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")]
ODD = ["", " ", "  ", "a  b", "a   b", " a", "a \n b", "\n\n  x", "x ", "x  ", "tab\t y", "　 z", "a\xa0 b", "<|endoftext|> c",
       "don't 12 ab3", "é è\nfoo  ", "漢字 😀😀 🇫🇷", "a  b", "'s 't"]


@pytest.mark.parametrize("path", PATHS)
def test_ids(path):
    encoder, own = packing.Encoder(path), Tokenizer.from_file(path)
    for text in [*ODD, *[t for t in fixtures.texts() if t]]:
        assert encoder(text).tolist() == [*own.encode(text, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("seed", range(6))
def test_pack(seed):
    r = random.Random(seed)
    top = [3, 300, 2048, 2049, 9000, 40][seed]
    lengths = [r.randint(1, top) for _ in range(r.randint(1, 400))]
    found = list(packing.pack(lengths))
    pieces = sorted(p for _, ps in found for p in ps)
    at = dict.fromkeys(range(len(lengths)), 0)
    for doc, start, n in pieces:
        assert n > 0 and at[doc] == start
        at[doc] += n
    assert list(at.values()) == lengths
    used = [(size, sum(n for _, _, n in ps)) for size, ps in found]
    assert sum(n != size for size, n in used) <= 1
    assert all(n <= size for size, n in used)


def test_short_tiers_fill_long_windows():
    found = list(packing.pack([1500, 400, 148, 90]))
    assert found[0] == (2048, [(0, 0, 1500), (1, 0, 400), (2, 0, 148)])


def test_fixture(spark):
    rows = fixtures.documents()
    found = packing.packed(fixtures.frame(spark), PATHS[0], with_ids=True).collect()
    own = Tokenizer.from_file(PATHS[0])
    wanted = sorted([*own.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows)
    whole: dict = {}
    for r in found:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
        whole.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
    assert sum(r.length for r in found) == sum(map(len, wanted))
    for (i, n), parts in whole.items():
        copies = sum(1 for r in rows if r[0] == i and len(own.encode(r[1] or "", add_special_tokens=False).ids) + 1 == n)
        if copies == 1:
            assert [x for _, ids in sorted(parts) for x in ids] in wanted
    by: dict = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append(r)
    for ps in by.values():
        at = 0
        for r in sorted(ps, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and len({(r.window, r.step_group) for r in ps}) == 1
    assert packing.packed(fixtures.frame(spark, []), PATHS[0]).collect() == []


@pytest.mark.parametrize("tasks", [1, 16])
def test_step_groups_are_balanced(spark, tasks):
    """All groups but the last of each size are full, however many tasks the windows come from."""
    docs = spark.createDataFrame([(i, fixtures.prose(i, 30 + 40 * (i % 40))) for i in range(400)], "doc_id long, text string")
    docs = docs.coalesce(1) if tasks == 1 else docs.repartition(tasks)
    found = packing.packed(docs, PATHS[0], step=8192).collect()
    groups: dict = {}
    for r in found:
        groups.setdefault((r.step_group, r.window), {})[r.sequence_id] = r.window
    assert len({g for g, _ in groups}) == len(groups)  # one window size a group
    sums = [sum(v.values()) for v in groups.values()]
    assert max(sums) <= 8192 and sum(s < 8192 for s in sums) <= len(packing.SIZES)


@pytest.mark.parametrize("path", PATHS)
def test_texts_without_blanks_are_not_remembered(path):
    encoder = packing.Encoder(path)
    r = random.Random(1)
    for _ in range(200):
        encoder("".join(r.choices("abcdefgh0123456789+/", k=5_000)))
    assert len(encoder.known) == 0
    for _ in range(50):
        encoder("a " + "".join(r.choices("abcdefgh+/", k=5_000)))
    assert len(encoder.known) == 0 and encoder.known.held == 0


def test_remembered_parts_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED_BYTES", 20_000)
    encoder = packing.Encoder(PATHS[0])
    for i in range(2_000):
        encoder(f"one w{i} x{i}")
        assert encoder.known.held < 22_000 and len(encoder.known) < 120
