"""Small tables with the odd cases: nulls, empty and long texts, ties, repeated rows, extra columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, m string, n long, _salt string, h string"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    """n words out of syllables, the frequent ones much more often."""
    r = random.Random(seed)
    syllables = ["ta", "re", "on", "il", "mu", "se", "ko", "é", "dra", "th"]
    words = ["".join(r2.choice(syllables) for _ in range(1 + i % 4)) for i, r2 in enumerate(random.Random(7 + i) for i in range(vocabulary))]
    return " ".join(words[int(vocabulary * r.random() ** 3)] for _ in range(n))


def texts() -> list[str | None]:
    passage = prose(99, 30)
    base = prose(5, 300)
    near = base.split(" ")
    near[150] = "other"
    out: list[str | None] = [None, "", " \n\t ", "One", "one ONE one", "a b c d", "A  b\nc\td"]
    out += [base, base, " ".join(near), base.upper(), base.replace(" ", "\n", 40)]
    out += [prose(i, 20 + 13 * i) for i in range(12)]
    out += [f"{prose(50 + i, 60)} {passage}\n{prose(70 + i, 40)}" for i in range(4)]
    out += [f"{passage} {passage}", passage, " ".join(passage.split(" ")[:20]), " ".join(passage.split(" ")[:19])]
    out += ["é" * 50 + " ñ 漢字 " + "x" * 3000, prose(11, 30_000), "# $ % | <>" * 20, "12 34 5.6 ..."]
    out += ["the same line\n" * 30, "word " * 200]
    return out


def documents() -> list[tuple]:
    rows = []
    for i, t in enumerate(texts()):
        rows.append((3 * i + 1, t, ["en", "fr", None][i % 3], "src0" if i % 2 else None, None if t is None else len(t)))
    rows += [rows[8], rows[8], rows[25]]  # repeated rows
    rows += [(None, prose(5, 300), "en", "src1", 5), (None, None, None, None, None)]
    rows += [(4, prose(1234, 50), "en", "src0", 5)]  # an id with two texts
    return [(*r, 1, "x", 2, "y", "z") for r in rows]


def frame(spark, rows: list[tuple] | None = None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
