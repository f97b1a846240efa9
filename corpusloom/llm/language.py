"""Language identification by error-correcting output codes.

Every language has a codeword.  For each bit a binary classifier over hashed character n-grams
tells languages with a one from those with a zero: the logarithm of the ratio between the mean
n-gram shares of both sides, which is learned by counting and so covers all labelled rows in one
pass.  A text's margins are compared with every codeword; each bit's loss counts by how well its
classifier separates, and the codeword of the least loss wins.  A small lead over the second is
flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.common import batches
from corpusloom.operators.scratch import settle

#: Slots that n-grams are hashed to, and their lengths.
SLOTS = 1 << 15
ORDERS = (1, 2, 3)
#: Up to so many languages every split of them is a bit; beyond, splits are drawn by hash.
EXHAUSTIVE = 6
SMOOTH = 0.5
#: Languages at most: bounds the model at SLOTS * bits numbers.
MAX_LANGS = 128
#: Lead in score below which a prediction is flagged.
LEAD = 0.2
#: How fast the score goes to one with the lead.
SHARPNESS = 12.0
UNKNOWN = "und"
CHUNK = 1 << 20
#: Weights gathered at a time when a text is judged, over all bits: 64 MB.
GATHERED = 1 << 24


def codewords(langs: Sequence[str]) -> np.ndarray:
    """Matrix of +1 and -1, a row per language; no bit is the same for all."""
    n = len(langs)
    if n <= 1:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        bits = [[1.0 if i == 0 or m >> (i - 1) & 1 else -1.0 for i in range(n)] for m in range(2 ** (n - 1) - 1)]
    else:
        rows = [[1.0 if md5(f"{x}/{b}".encode()).digest()[0] & 1 else -1.0 for x in langs] for b in range(15 * n.bit_length())]
        bits = [r for r in rows if abs(sum(r)) < n]
        bits += [[1.0 if i == j else -1.0 for i in range(n)] for j in range(n)]  # each language against the rest
    return np.array(bits).T


def slots_of(text: str) -> np.ndarray:
    """Hash slots of all n-grams of letters, with one blank for each run of anything else."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = (points >= 0xC0) & (points != 0xD7) & (points != 0xF7) & ~((points >= 0x2000) & (points < 0x2C00))
    letter |= (points >= 97) & (points <= 122)
    points = np.where(letter, points, 32)
    kept = np.ones(len(points), bool)
    kept[1:] = (points[1:] != 32) | (points[:-1] != 32)
    x = np.concatenate([[32], points[kept], [32]]).astype(np.uint64)
    out = []
    for n in ORDERS:
        h = np.zeros(len(x) - n + 1, np.uint64)
        for i in range(n):
            h = (h + x[i : len(x) - n + 1 + i] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        out.append(h)
    return (np.concatenate(out) % np.uint64(SLOTS)).astype(np.int64)


def has_letter(text: str) -> bool:
    return text.lower() != text.upper() or any(c.isalpha() for c in text)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 by 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def counts(docs: DataFrame) -> DataFrame:
    """(lang, slot, n) over all rows with a language: dense sums per task, added up by a shuffle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in it:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                at = slots_of(text.as_py())
                total = sums.setdefault(lang, np.zeros(SLOTS, np.int64))
                for i in range(0, len(at), CHUNK):
                    np.add.at(total, at[i : i + CHUNK], 1)
            if len(sums) > MAX_LANGS:
                raise ValueError(f"more than {MAX_LANGS} languages")
        for lang, total in sums.items():
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(total[found])], names=["lang", "slot", "n"]
            )

    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    each = rows.mapInArrow(run, "lang string, slot long, n long")
    return each.groupBy("lang", "slot").agg(F.sum("n").alias("n"))


class Model:
    """Codewords, the weights of each bit's classifier, and how much each bit's loss counts."""

    def __init__(self, langs: list[str], sums: np.ndarray):
        self.langs = langs
        self.code = codewords(langs)
        shares = (sums + SMOOTH) / (sums + SMOOTH).sum(1, keepdims=True)
        weights, worth = [], []
        for b in range(self.code.shape[1]):
            ones, zeros = self.code[:, b] > 0, self.code[:, b] < 0
            if not zeros.any():
                weights.append(np.zeros(SLOTS))
                worth.append(1.0)
                continue
            w = np.log(shares[ones].mean(0)) - np.log(shares[zeros].mean(0))
            means = shares @ w  # the margin expected for each language
            weights.append(w - (means[ones].min() + means[zeros].max()) / 2)
            worth.append(max((means[ones].min() - means[zeros].max()) / 2, 1e-6))
        self.scale = np.array(worth)
        self.weights = np.ascontiguousarray((np.array(weights) / self.scale[:, None]).T, np.float32)
        self.worth = self.scale / self.scale.sum()

    def losses(self, text: str) -> np.ndarray:
        at = slots_of(text)
        margin = np.zeros(self.code.shape[1])
        step = max(1, GATHERED // self.code.shape[1])
        for i in range(0, len(at), step):
            margin += self.weights[at[i : i + step]].sum(0, dtype=np.float64)
        margin /= len(at)
        # squared hinge: margins are 1 where a typical text of the language lies
        return ((np.maximum(0, 1 - self.code * np.clip(margin, -2, 2)) ** 2) * self.worth).sum(1)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether the second comes close; UNKNOWN without a letter."""
        if text is None or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, True
        loss = self.losses(text)
        best = int(np.argmin(loss))
        shares = np.exp(-SHARPNESS / 4 * (loss - loss[best]))
        score = float(1 / shares.sum())
        others = np.delete(shares, best)
        return self.langs[best], score, bool(len(others) and (1 - others.max()) / (1 + others.max()) < LEAD)


def train(docs: DataFrame) -> Model:
    """A model from all rows with text and language.  MAX_LANGS * SLOTS sums at most reach the driver."""
    table = settle(counts(docs), "ngrams")
    langs = sorted(r[0] for r in table.select("lang").distinct().limit(MAX_LANGS + 1).collect())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    sums = np.zeros((len(langs), SLOTS))
    found = table.toArrow()
    number = {x: i for i, x in enumerate(langs)}
    rows = np.array([number[x] for x in found["lang"].to_pylist()], np.int64)
    sums[rows, found["slot"].to_numpy()] = found["n"].to_numpy()
    return Model(langs, sums)


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) for every row of ``docs``, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = shared.value.predict

        def rows():
            for batch in it:
                for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    yield (i, *predict(text.as_py()))

        yield from batches(rows(), schema)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return narrow.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) for every row, learned from rows not held out.

    A null text or one without a letter is UNKNOWN with score 0; with no labelled row all are.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predictions(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous"
    )
