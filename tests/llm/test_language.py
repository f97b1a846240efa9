"""Codewords, held-out accuracy and odd texts."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import language
from tests.conftest import DATA
from tests.llm import fixtures


@pytest.mark.parametrize("n", [1, 2, 4, 6, 7, 40])
def test_codewords_differ(n):
    code = language.codewords([f"l{i}" for i in range(n)])
    assert code.shape[0] == n
    for i in range(n):
        for j in range(i):
            assert (code[i] != code[j]).sum() >= max(1, code.shape[1] // 8)
    if n > 1:
        assert not (np.abs(code.sum(0)) == n).any()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)


def test_many_languages(spark):
    """More languages than have all splits as bits."""
    rows = []
    for k in range(9):
        r = random.Random(k)
        syllables = ["".join(r.choices("abcdefghijklmnop", k=2)) for _ in range(12)]
        for i in range(30):
            rows.append((1000 * k + i, " ".join("".join(r.choices(syllables, k=2)) for _ in range(25)), f"l{k}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language.identify(docs).collect()}
    held = [i for i, r in found.items() if r.held_out]
    assert sum(found[i].lang_pred == f"l{i // 1000}" for i in held) / len(held) > 0.9


def test_odd_texts(spark):
    docs = fixtures.frame(spark)
    found = language.identify(docs).collect()
    assert len(found) == len(fixtures.documents())
    und = {r.doc_id for r in found if r.lang_pred == "und"}
    wanted = {r[0] for r in fixtures.documents() if not any(c.isalpha() for c in r[1] or "")}
    assert und == wanted | ({4} if 4 in und else set())
    nothing = language.identify(docs.where("lang = 'xx'")).collect()
    assert nothing == []
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_ambiguity():
    sums = np.ones((2, language.SLOTS))
    sums[0, language.slots_of("aaaa bbbb")] += 50
    sums[1, language.slots_of("cccc dddd")] += 50
    model = language.Model(["x", "y"], sums)
    assert model.predict("aaaa bbbb")[0] == "x" and not model.predict("aaaa bbbb aaaa")[2]
    assert model.predict("cccc")[0] == "y"
    assert model.predict("aaaa cccc bbbb dddd")[2]
    assert model.predict(None) == model.predict("12") == ("und", 0.0, True)


def plain_slots(text: str) -> list[int]:
    """Slots of all n-grams of letters, one by one."""
    letters = [c if "a" <= c <= "z" or ord(c) >= 0xC0 and c not in "×÷" and not 0x2000 <= ord(c) < 0x2C00 else " " for c in text.lower()]
    x = [" "] + [c for i, c in enumerate(letters) if c != " " or i == 0 or letters[i - 1] != " "] + [" "]
    out = []
    for n in language.ORDERS:
        for i in range(len(x) - n + 1):
            h = 0
            for c in x[i : i + n]:
                h = (h + ord(c) + n) * 0x9E3779B97F4A7C15 % 2**64
                h ^= h >> 32
            out.append(h % language.SLOTS)
    return out


def plain_predictions(learn: list[tuple], texts: list[str | None]) -> list[tuple]:
    """(language, score, flag) by bit classifiers and loss-weighted decoding as they are defined."""
    langs = sorted({lang for lang, _ in learn})
    n = len(langs)
    share = {}
    for lang in langs:
        sums = [language.SMOOTH] * language.SLOTS
        for of, text in learn:
            for s in plain_slots(text) if of == lang else []:
                sums[s] += 1
        share[lang] = [x / sum(sums) for x in sums]
    # up to six languages: every split of them, the first always on the same side
    bits = [{x: 1 if i == 0 or m >> (i - 1) & 1 else -1 for i, x in enumerate(langs)} for m in range(2 ** (n - 1) - 1)]
    classifiers = []
    for bit in bits:
        mean = {s: [sum(c) / len(c) for c in zip(*[share[x] for x in langs if bit[x] == s], strict=True)] for s in (1, -1)}
        w = [math.log(a) - math.log(b) for a, b in zip(mean[1], mean[-1], strict=True)]
        at = {x: sum(p * q for p, q in zip(share[x], w, strict=True)) for x in langs}
        low, high = min(at[x] for x in langs if bit[x] == 1), max(at[x] for x in langs if bit[x] == -1)
        classifiers.append((bit, w, (low + high) / 2, max((low - high) / 2, 1e-6)))
    out = []
    for text in texts:
        if text is None or not any(c.isalpha() for c in text):
            out.append(("und", 0.0, True))
            continue
        slots = plain_slots(text)
        loss = dict.fromkeys(langs, 0.0)
        for bit, w, middle, worth in classifiers:
            margin = max(-2, min(2, sum((w[s] - middle) / worth for s in slots) / len(slots)))
            for x in langs:
                loss[x] += max(0, 1 - bit[x] * margin) ** 2 * worth / sum(c[3] for c in classifiers)
        best = min(langs, key=lambda x: loss[x])
        shares = {x: math.exp(-language.SHARPNESS / 4 * (loss[x] - loss[best])) for x in langs}
        second = max(shares[x] for x in langs if x != best)
        out.append((best, 1 / sum(shares.values()), (1 - second) / (1 + second) < language.LEAD))
    return out


def test_predictions_equal_plain_ones(spark):
    learn = [("en", "the old man went to the river and the sea"), ("fr", "le vieil homme alla vers la rivière et la mer"), ("de", "der alte Mann ging über den Fluß")]
    texts = ["the sea and the river", "la mer, été ÉTÉ", "über den Fluß 12", "x", "", None, "12 ...", "le the der", "漢字", "Mann homme man " * 40]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(learn)], "doc_id long, text string, lang string")
    model = language.train(docs)
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, language.predictions(asked, model).collect()))
    for (_, lang, score, flag), want in zip(got, plain_predictions(learn, texts), strict=True):
        assert lang == want[0] and score == pytest.approx(want[1], rel=1e-3, abs=1e-6) and flag == want[2]


def test_long_texts_are_judged_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the old man", "en"), (2, "le vieil homme", "fr")], "doc_id long, text string, lang string")
    model = language.train(docs)
    whole = model.predict("the old man and the homme " * 50)
    monkeypatch.setattr(language, "GATHERED", 7)
    assert model.predict("the old man and the homme " * 50) == pytest.approx(whole)
