"""Counts by hand on the odd texts; all the rest against DuckDB in test_corpus_queries."""

from __future__ import annotations

import re
from collections import Counter

from corpusloom.llm import rules
from tests.llm import fixtures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_fixture(spark):
    found = rules.judge(fixtures.frame(spark)).collect()
    got = sorted((str(r.doc_id), *r[1:7]) for r in found)
    assert got == sorted((str(r[0]), *plain(r[1])) for r in fixtures.documents())
    assert not any(r.kept for r in found if r.base_failed)
    assert all(r.kept == (not r.base_failed and not r.broken) for r in found)


def test_one_projection(spark):
    plan = rules.judge(fixtures.frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "ArrowEval" not in plan


def test_broken_rules_are_named(spark):
    texts = ["of the " * 3 + " ".join(f"w{i}$$" for i in range(20)), "\n".join(f"a{i} | b{i} | c{i}" for i in range(20))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.broken.split(",") for r in rules.judge(docs).collect()}
    assert "symbol_ratio" in found[0]
    assert "table_line_ratio" in found[1]


CLEAN = {
    "it": "La mattina presto il vecchio pescatore scese alla spiaggia e guardava il mare calmo mentre i gabbiani volavano bassi "
    "sopra le barche colorate legate al piccolo molo; sua figlia portava pane fresco e formaggio, perché sapeva che sarebbe tornato "
    "soltanto verso sera, quando le luci del villaggio si accendono una dopo l'altra lungo tutta la costa silenziosa.",
    "ru": "Рано утром старый рыбак вышел на берег и долго смотрел на спокойное море, пока чайки летали низко над лодками у причала; "
    "его дочь принесла свежий хлеб и сыр, потому что знала, что он вернётся только к вечеру, когда огни деревни загораются один за "
    "другим вдоль всего тихого берега, а дети бегут домой ужинать, смеясь и рассказывая друг другу длинные весёлые истории о море и ветре.",
}


def test_languages_without_a_list(spark):
    """Clean prose in them is kept, whatever its stop words; so are texts of no known language."""
    docs = spark.createDataFrame([(1, CLEAN["it"], "it"), (2, CLEAN["ru"], "ru"), (3, CLEAN["ru"], None), (4, CLEAN["ru"], "en")], "doc_id long, text string, lang string")
    found = {r.doc_id: (r.kept, r.broken) for r in rules.judge(docs).collect()}
    assert found == {1: (True, ""), 2: (True, ""), 3: (True, ""), 4: (False, "stop_word_ratio")}
    assert all(r.kept for r in rules.judge(docs.drop("lang")).collect())


def test_very_long_texts_are_kept(spark):
    text = "\n".join(f"the man {i} went to town {i} and of his {i} ways" for i in range(17_500))
    (found,) = rules.judge(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")).collect()
    assert found.n_words > 200_000 and found.kept


def test_empty(spark):
    assert rules.judge(fixtures.frame(spark, [])).collect() == []
