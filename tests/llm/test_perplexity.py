"""The model against a direct computation, and its verdicts on clean and spoilt texts."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np

from corpusloom.llm import perplexity as px
from tests.llm import fixtures

LABELS = "doc_id long, quality int, toxic int"


def plain_model(texts: list[str]) -> dict[tuple, float]:
    """Interpolated modified Kneser-Ney by its definition: probability of the last symbol of each tuple."""
    top: Counter = Counter()
    for t in texts:
        x = [0] * 3 + [int(px.FOLD[min(ord(c), px.KNOWN)]) for c in t]
        top.update(tuple(x[i : i + 4]) for i in range(len(x) - 3))
    tables = {4: dict(top)}
    for n in (3, 2, 1):
        below: dict = defaultdict(set)
        for g in tables[n + 1]:
            below[g[1:]].add(g[0])
        tables[n] = {g: len(s) for g, s in below.items()}
    discounts, contexts = {}, {}
    for n, t in tables.items():
        c = Counter(t.values())
        if c[1] and c[2]:
            y = c[1] / (c[1] + 2 * c[2])
            d = [1 - 2 * y * c[2] / c[1], 2 - 3 * y * c[3] / c[2]]
            d.append(3 - 4 * y * c[4] / c[3] if c[3] else d[1])
            discounts[n] = [min(max(v, 0.05), k) for v, k in zip(d, (1.0, 2.0, 3.0))]
        else:
            discounts[n] = [0.5, 0.75, 1.0]
        contexts[n] = defaultdict(list)
        for g, k in t.items():
            contexts[n][g[:-1]].append(k)

    def p(g: tuple) -> float:
        n = len(g)
        if n == 0:
            return 1 / px.CLASSES
        seen = contexts[n].get(g[:-1])
        if not seen:
            return p(g[1:])
        cut = lambda k: discounts[n][min(k, 3) - 1]
        k = tables[n].get(g, 0)
        own = (k - cut(k)) / sum(seen) if k else 0.0
        return own + sum(map(cut, seen)) / sum(seen) * p(g[1:])

    return p


def test_model(spark):
    texts = [fixtures.prose(i, 40) + ". Été 12!" for i in range(8)]
    logs = px.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    p = plain_model(texts)
    r = np.random.default_rng(0)
    for g in [*r.integers(0, px.CLASSES**4, 300).tolist(), *px.grams(texts[0]).tolist()]:
        symbols = tuple(g >> px.BITS * i & (px.CLASSES - 1) for i in (3, 2, 1, 0))
        assert math.isclose(math.exp(logs[g]), p(symbols), rel_tol=1e-4)
    sums = np.exp(logs.astype(np.float64)).reshape(-1, px.CLASSES).sum(1)
    assert np.allclose(sums, 1, atol=1e-4)


def documents(n: int = 240) -> tuple[list[tuple], list[tuple]]:
    rows = [(i, fixtures.prose(i, 80), "en" if i % 3 else "fr", "s", 1, 1, "x", 2, "y", "z") for i in range(n)]
    junk = [(n + i, " ".join(w + "$%#" for w in fixtures.prose(900 + i, 80).split()), "en", "s", 1, 1, "x", 2, "y", "z") for i in range(20)]
    shout = [(n + 50 + i, fixtures.prose(800 + i, 80).upper(), "fr", "s", 1, 1, "x", 2, "y", "z") for i in range(20)]
    labels = [(i, 1, 0) for i in range(0, n, 2)] + [(i, 0, 0) for i in range(n, n + 20)] + [(1, 1, 1), (3, 1, 0), (3, 0, 0), (None, 1, 0)]
    return rows + junk + shout, labels


def test_clean_texts_stay_and_spoilt_ones_go(spark):
    rows, labels = documents(600)
    docs, marks = fixtures.frame(spark, rows), spark.createDataFrame(labels, LABELS)
    kept = {r.doc_id: r.kept for r in px.classify(docs, marks).collect()}
    assert len(kept) == len(rows)
    # half of them are not trusted, and so judged by quantiles they had no part in
    assert sum(kept[i] for i in range(600)) >= 238 / 240 * 600
    assert not any(kept[i] for i in kept if i >= 600)
    good = px.good_documents(docs, marks)
    assert good.columns == docs.columns and good.dtypes == docs.dtypes
    assert {r.doc_id for r in good.collect()} == {i for i, k in kept.items() if k}


def quantiles(values: list[float]) -> list[float]:
    order = sorted(values)
    return [order[max(math.ceil(q * len(order)) - 1, 0)] for q in (px.LOW, px.HIGH)]


def plain_bounds(each: list[tuple], trusted: set) -> dict[str, tuple]:
    """Typical loss and bounds of every language, by sorting: its own and those of all, weighed by their documents."""
    good = [(of, n, loss) for i, of, n, loss in each if i in trusted]
    mean = sum(loss for *_, loss in good) / sum(n for _, n, _ in good)
    own = {of: [(n, loss) for x, n, loss in good if x == of] for of in {g[0] for g in good}}
    mix = lambda k, mine, all_, m: (k * mine + m * all_) / (k + m)
    typical = {of: mix(len(g), sum(x for _, x in g) / sum(n for n, _ in g), mean, px.SHARED_LOSS) for of, g in own.items()}
    away = lambda of, n, loss: (loss + px.PRIOR * typical[of]) / (n + px.PRIOR) - typical[of]
    overall = quantiles([away(*g) for g in good])
    out = {}
    for of, g in own.items():
        mine = quantiles([away(of, n, loss) for n, loss in g])
        out[of] = (typical[of], *[math.exp(typical[of] + mix(len(g), a, b, px.SHARED)) for a, b in zip(mine, overall)])
    return out


def test_verdicts_are_the_quantiles_of_trusted_texts(spark):
    """Bounds and verdicts against quantiles found by sorting, also for a language with few trusted texts."""
    rows, labels = documents(1200)
    rows += [(5000 + i, fixtures.prose(3000 + i, 60), "it", "s", 1, 1, "x", 2, "y", "z") for i in range(12)]
    labels += [(5000 + i, 1, 0) for i in range(8)]
    docs, marks = fixtures.frame(spark, rows), spark.createDataFrame(labels, LABELS)
    bounds = px.Bounds(docs, marks)
    trusted = {r.doc_id for r in px.trusted_ids(marks).collect()}
    each = [(r.doc_id, r.lang, r.n_points, r.loss) for r in bounds.each.collect()]
    found = {r.doc_id: r for r in px.classify(docs, marks).collect()}
    want = plain_bounds(each, trusted)
    assert set(want) == {"en", "fr", "it"}
    for i, of, n, loss in each:
        typical, low, high = want[of]
        value = math.exp((loss + px.PRIOR * typical) / (n + px.PRIOR))
        assert math.isclose(found[i].low, low, rel_tol=1e-9) and math.isclose(found[i].high, high, rel_tol=1e-9)
        if min(abs(value / b - 1) for b in (low, high)) > 1e-9:
            assert found[i].kept == (low < value < high)


def test_bounds_move_without_a_jump(spark):
    """One trusted text more changes the bounds of its language by little, at any number of them."""
    lows = []
    for n in (10, 11, 49, 51):
        rows = [(i, fixtures.prose(i, 80), "en", "s", 1, 1, "x", 2, "y", "z") for i in range(200)]
        rows += [(1000 + i, fixtures.prose(1000 + i % 10, 80, 90), "fr", "s", 1, 1, "x", 2, "y", "z") for i in range(n)]
        marks = spark.createDataFrame([(r[0], 1, 0) for r in rows], LABELS)
        table = {r.lang: r.q for r in px.Bounds(fixtures.frame(spark, rows), marks).table.collect()}
        lows.append(table["fr"][0])
    assert abs(lows[1] / lows[0] - 1) < 0.01 and max(lows[2:]) / min(lows[2:]) < 1.01


def test_other_scripts_are_told_apart(spark):
    """Letters behind the Latin ones carry information: the same words with their letters shuffled are rejected."""
    import random

    r = random.Random(3)
    words = ["море", "ветер", "рыбак", "берег", "старый", "вечером", "дочь", "хлеб", "лодка", "чайка", "деревня", "огни", "дети", "домой"]
    text = lambda: " ".join(r.choice(words) for _ in range(120))
    odd = lambda: " ".join("".join(r.choice("бвгджзклмнпрстфхцчшщъыьэюя") for _ in w) for w in text().split())
    rows = [(i, text(), "ru", "s", 1, 1, "x", 2, "y", "z") for i in range(150)]
    rows += [(500 + i, odd(), "ru", "s", 1, 1, "x", 2, "y", "z") for i in range(20)]
    rows += [(600 + i, "漢字" * 50 + "\U00020000" + text(), "zh", "s", 1, 1, "x", 2, "y", "z") for i in range(3)]
    marks = spark.createDataFrame([(i, 1, 0) for i in range(150)], LABELS)
    kept = {x.doc_id: x.kept for x in px.classify(fixtures.frame(spark, rows), marks).collect()}
    assert sum(kept[i] for i in range(150)) >= 147 and not any(kept[500 + i] for i in range(20))


def test_odd_cases(spark):
    docs, none = fixtures.frame(spark), spark.createDataFrame([], LABELS)
    found = px.classify(docs, none).collect()
    assert len(found) == len(fixtures.documents())
    assert all(r.kept == (r.n_points > 0) for r in found)
    assert px.classify(fixtures.frame(spark, []), none).collect() == []
    # long texts and null languages are scored like others
    marks = spark.createDataFrame([(r[0], 1, 0) for r in fixtures.documents() if r[0]], LABELS)
    assert all(r.perplexity > 1 for r in px.classify(docs, marks).collect() if r.n_points)


def test_trusted(spark):
    rows = [(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 1, 0), (4, 0, 0), (5, None, 0), (None, 1, 0), (6, 1, 0), (6, 1, 0)]
    assert sorted(r.doc_id for r in px.trusted_ids(spark.createDataFrame(rows, LABELS)).collect()) == [1, 6]


def plain_words(texts: list[tuple], spelled: dict[tuple, list[float]]) -> dict[tuple, float]:
    """Losses by the definition of the model: of every (text, fold), by n-grams of the given ones in the other fold.

    Discounts are made from texts that differ, of both folds.
    """
    tables: dict = {f: {px.WORDS: Counter(), "differ": Counter()} for f in (0, 1)}
    for (t, f), m in Counter(texts).items():
        x = ["<s>"] * (px.WORDS - 1) + t.split() + ["</s>"]
        for i in range(len(x) - px.WORDS + 1):
            tables[f][px.WORDS][tuple(x[i : i + px.WORDS])] += m
            tables[f]["differ"][tuple(x[i : i + px.WORDS])] += 1
    for t in tables.values():
        for n in range(px.WORDS - 1, 0, -1):
            t[n] = Counter(g[1:] for g in t[n + 1])
    cuts, totals, left = {}, defaultdict(int), defaultdict(float)
    for n in range(1, px.WORDS + 1):
        c = Counter(k for t in tables.values() for k in t["differ" if n == px.WORDS else n].values())
        y = c[1] / (c[1] + 2 * c[2])
        d = [1 - 2 * y * c[2] / c[1], 2 - 3 * y * c[3] / c[2]]
        cuts[n] = [min(max(v, 0.05), k) for v, k in zip([*d, 3 - 4 * y * c[4] / c[3] if c[3] else d[1]], (1.0, 2.0, 3.0))]
        for f, t in tables.items():
            for g, k in t[n].items():
                totals[f, g[:-1]] += k
                left[f, g[:-1]] += cuts[n][min(k, 3) - 1]

    def p(f: int, g: tuple, unknown: float) -> float:
        if not g:
            return unknown
        total, k = totals[f, g[:-1]], tables[f][len(g)][g]
        # a known word has no share in what is left for unknown ones
        lower = 0.0 if len(g) == 1 and k else p(f, g[1:], unknown)
        return (k - cuts[len(g)][min(k, 3) - 1] if k else 0) / total + left[f, g[:-1]] / total * lower if total else lower

    out = {}
    for (t, f), costs in spelled.items():
        x = ["<s>"] * (px.WORDS - 1) + t.split() + ["</s>"]
        grams = [tuple(x[i : i + px.WORDS]) for i in range(len(x) - px.WORDS + 1)]
        out[t, f] = -sum(math.log(p(1 - f, g, math.exp(c))) for g, c in zip(grams, [*costs, 0.0], strict=True))
    return out


def test_words_against_the_definition(spark):
    """The loss of every text, by the words of the other fold's trusted texts; copies count, and lose as much as one."""
    texts = [fixtures.prose(i, 40 + i % 7) + f" w{i % 5}" for i in range(60)] + [" of the  sea of\tthe", " \n", "of", "unmet xq#7 of the", "x" * 90]
    given = [*texts, None, "", texts[3], texts[55]]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(given)], "doc_id long, text string, lang string")
    trusted = docs.where("doc_id < 50 OR text = '" + texts[3] + "'").select("text")
    found = {r.doc_id: r.loss for r in px.Scorer(docs, trusted).scores(docs).collect()}
    fold = {r.text: r.f for r in docs.select("text", px._key(px.F.col("text")).bitwiseAND(px.F.lit(1)).alias("f")).collect()}
    logs, spelled = px.train(trusted), {}
    for t in texts:
        costs, inside = [], False
        for c, x in zip(t, logs[px.grams(t)].tolist()):
            if c not in " \t\n":
                costs += [] if inside else [0.0]
                inside = True
                costs[-1] += x
            elif inside:
                costs[-1] += x
                inside = False
        spelled[t, fold[t]] = costs
    want = plain_words([(t, fold[t]) for t in [*texts[:50], texts[3]]], spelled)
    assert {fold[t] for t in texts[:50]} == {0, 1} and len(found) == len(given)
    assert all(math.isclose(found[i], want[t, fold[t]], rel_tol=1e-5) for i, t in enumerate(given) if t)
    assert found[65] == found[66] == 0


def test_order_of_words_tells(spark):
    """A text whose words stand in another order costs much more, though its characters are nearly those of the same n-grams."""
    lines = ["the old fisher mends his net", "the boat lies at the bank of the river", "children bring bread to the village", "gulls follow the boat home"]
    r = np.random.default_rng(5)
    text = lambda: " ".join(lines[i] for i in r.integers(0, 4, 12))
    good = [text() for _ in range(60)]
    mixed = [" ".join(r.permutation(t.split()).tolist()) for t in good[:10]]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + mixed)], "doc_id long, text string, lang string")
    rows = {x.doc_id: x.loss / x.n_points for x in px.Scorer(docs, docs.where("doc_id < 50").select("text")).scores(docs).collect()}
    assert min(rows[60 + i] for i in range(10)) > 3 * max(rows[i] for i in range(60))


def test_slices_give_the_same_and_leave_little(spark, monkeypatch):
    """Losses do not depend on the slices in which model and texts meet; finished slices and shuffles are gone."""
    from corpusloom.operators import scratch

    texts = [fixtures.prose(i, 40 + i % 7) + f" w{i % 5}" for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    losses = []
    for slice_ in (px.SLICE, 200):
        monkeypatch.setattr(px, "SLICE", slice_)
        monkeypatch.setattr(px, "SLICES", 3)
        marks = spark.createDataFrame([(i, 1, 0) for i in range(50)], LABELS)
        store, at = scratch.file_system(spark, scratch.own_folder(spark))
        before = {f.getPath().getName() for f in store.listStatus(at)} if store.exists(at) else set()
        losses.append({r.doc_id: r.loss for r in px.Bounds(docs, marks).each.collect()})
        left = {f.getPath().getName() for f in store.listStatus(at)} - before
        assert not [n for n in left if n.startswith(("word-grams", "word-contexts", "word-probabilities", "word-continuations", "trusted-texts"))]
    assert len(losses[0]) == 60 and all(math.isclose(losses[0][i], losses[1][i], rel_tol=1e-6) for i in losses[0])


def test_hot_words_are_dealt_over_shards(spark, monkeypatch):
    """Losses do not depend on which middle words are dealt over several shards, nor on how many rows are put in order at a time."""
    texts = [fixtures.prose(i, 40 + i % 7) + f" w{i % 5}" for i in range(60)] + ["of the sea " * 30, "sea", " "]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*texts, texts[3]])], "doc_id long, text string, lang string")
    found = []
    for hot in (px.HOT, 20):
        monkeypatch.setattr(px, "HOT", hot)
        if hot == 20:
            monkeypatch.setattr(px, "SLICE", 200)
            monkeypatch.setattr(px, "SLICES", 2)
            monkeypatch.setattr(px, "PLACES", 64)
            words, fans = px.frequent_words(px._once(docs.where("doc_id < 50")), 20, 6)
            assert len(words) > 10 and min(fans) >= 2 and max(fans) == 6
        rows = px.Scorer(docs, docs.where("doc_id < 50").select("text")).scores(docs).collect()
        found.append({r.doc_id: r.loss for r in rows})
    assert len(found[0]) == 64 and found[0][3] == found[0][63]
    assert all(math.isclose(found[0][i], found[1][i], rel_tol=1e-6) for i in found[0])


def test_rows_between_tasks_are_parts_of_texts(spark):
    """N-grams go to the model, and sums come back, as a row per part of the texts and shard, not per text or n-gram."""
    docs = spark.createDataFrame([(fixtures.prose(i, 60),) for i in range(300)], "text string").coalesce(1)
    once = px._of_fold(px._once(docs), 0)
    hot = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    n, parts = once.count(), once.rdd.getNumPartitions()
    assert n > 5 * parts
    counted = px.settle(px.word_counts(once, 1, 6, hot), "counted", by="kind")
    numbers = px.Numbers([counted, counted.where("false")])
    grams = px.word_grams(once, 1, 0, 6, hot, False)
    sums = px.sums_of_grams(grams, px.word_grams(once, 1, 0, 6, hot, True), counted.where("kind = 1"), numbers, 0, 6, hot)
    assert 6 <= grams.count() <= 6 * parts and sums.count() == grams.count()
    assert px.by_text(sums, 3).count() == n


def test_pieces_hold_all_rows(monkeypatch):
    """Rows are taken in pieces of bounded size, each once and in order; no row makes no piece."""
    monkeypatch.setattr(px, "PIECE", 100)
    cells = [b"x" * n for n in (10, 0, 250, 5, 40, 60, 60, 0)]
    rows = px.pa.table({"i": list(range(8)), "x1": cells})
    pieces = list(px._pieces(rows, "x1"))
    assert len(pieces) > 2 and px.pa.concat_tables(pieces).equals(rows)
    assert max(sum(map(len, p["x1"].to_pylist()[1:])) for p in pieces) <= 100
    assert list(px._pieces(rows.slice(0, 0), "x1")) == []


def test_places_of_many_texts():
    """Texts of several parts are told apart also where they are more than 16 bits can number."""
    cells = [np.arange(40_000, dtype=np.uint16).tobytes()] * 3 + [np.array([0, 69_999], np.uint32).tobytes()]
    n = np.array([40_000] * 3 + [70_000], np.int32)
    found = px._numbered(px.pa.table({"of": cells}), "of", n, np.cumsum(np.append(0, n[:-1])))
    assert found.tolist() == [*range(120_000), 120_000, 189_999]


def test_places_are_found():
    """Hashes are found among those given, and only they: none, one, neighbours and the largest."""
    r = np.random.default_rng(2)
    top = np.uint64((1 << 64) - 1)
    for known in (r.integers(0, 1 << 63, 500, np.uint64), np.arange(9, dtype=np.uint64), top - np.arange(9, dtype=np.uint64), np.zeros(0, np.uint64)):
        known = np.unique(known)
        asked = np.concatenate((known, known + np.uint64(1), [np.uint64(0), top], r.integers(0, 1 << 63, 50, np.uint64)))
        found, place = px.Places(known).of(asked)
        assert sorted(found) == np.flatnonzero(np.isin(asked, known)).tolist() and (known[place] == asked[found]).all()


def test_word_hashes():
    """Equal words have equal hashes, whatever stands around them; others differ; begins, ends and folds are in their places."""
    texts = ["été of  the\tsea", "", " \n", "the sea of", "x", "of\u00a0the"]
    x, begins = px.word_hashes([t.encode() for t in texts], np.array([0, 1, 0, 0, 0, 0]))
    found = [x[a:b].tolist() for a, b in zip(begins, begins[1:])]
    assert [len(f) for f in found] == [7, 3, 3, 6, 4, 4]
    assert found[0][3:6] == [found[3][4], found[3][2], found[3][3]]
    assert len({h for f in found if not f[0] & 1 for h in f[2:-1]}) == 6
    assert all(h & 1 == (i == 1) for i, f in enumerate(found) for h in f)
    assert all(f[:2] == [(px.BEGIN & ~1) | (i == 1)] * 2 and f[-1] == (px.END & ~1) | (i == 1) for i, f in enumerate(found))
