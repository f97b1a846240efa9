"""Quality rules: a table of thresholds compiled into one projection of built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.text import quoted
from corpusloom.llm.common import BLANKS, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Frequent function words of each language.
STOP_WORDS = {
    "en": "the of and to in is that for with a on as by it are was be this or an at from",
    "fr": "le la les de des du et un une en que qui pour par au dans est il elle",
    "de": "der die das dem den des und in von zu mit ein eine einen ist auf für im nicht",
    "es": "el la los las de del y que en un una por con para se su es al no lo",
}


@dataclass(frozen=True)
class Rule:
    """A row of the threshold table: the measure has to lie between low and high."""

    measure: str
    low: float | None = None
    high: float | None = None
    #: the rule holds only for texts with as many words
    from_words: int = 0
    #: the rule holds only for texts in a language that STOP_WORDS has a list for
    listed_only: bool = False


RULES = (
    Rule("n_words", 10),
    Rule("mean_word_chars", 2, 12),
    Rule("symbol_ratio", high=0.1),
    Rule("shout_ratio", high=0.3),
    Rule("dup_line_ratio", high=0.5),
    Rule("table_line_ratio", high=0.5),
    Rule("stop_word_ratio", 0.04, 0.7, from_words=50, listed_only=True),
)


def _held(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeat_words(w: Column, window: int = WINDOW) -> Column:
    """Words covered by windows of ``window`` words that are found twice or more in the array."""

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = _held(
            pairs,
            lambda s: F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])),
        )
        starts = F.array_sort(F.transform(again, lambda x: x["i"]))
        step = lambda a, i: F.struct(
            (a["n"] + F.least(F.lit(window), i - a["last"])).alias("n"), i.alias("last")
        )
        return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")), step)["n"]

    at = F.sequence(F.lit(0), F.size(w) - window)
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))
    # most texts repeat nothing: counting different hashes tells them without a sort
    return F.when(F.size(w) < window, F.lit(0)).otherwise(
        _held(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    )


def measures(text: Column) -> Column:
    """Struct of all measures of a text; a null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    stop = sorted({w for line in STOP_WORDS.values() for w in line.split()})
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")

    def of_words(w: Column) -> Column:
        plain = F.transform(w, lambda x: F.lower(F.translate(x, ".,;:!?", "")))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(plain, lambda x: x.isin(stop))).cast("long").alias("n_stop_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(x, lambda y: F.contains(y, F.lit("|")))).cast("long").alias("n_table_lines"),
        )

    return F.struct(
        _held(words(text), of_words).alias("w"),
        _held(lines, of_lines).alias("l"),
        F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(F.translate(t, "!", ""))).cast("long").alias("n_shouts"),
    )


def _measure(name: str, m: Column) -> Column:
    words_ = F.greatest(m["w"]["n_words"], F.lit(1))
    lines = F.greatest(m["l"]["n_lines"], F.lit(1))
    return {
        "n_words": m["w"]["n_words"],
        "mean_word_chars": m["word_chars"] / words_,
        "symbol_ratio": m["n_symbols"] / words_,
        "shout_ratio": m["n_shouts"] / words_,
        "dup_line_ratio": m["l"]["n_dup_lines"] / lines,
        "table_line_ratio": m["l"]["n_table_lines"] / lines,
        "stop_word_ratio": m["w"]["n_stop_words"] / words_,
    }[name]


def verdict(m: Column, rules: tuple[Rule, ...] = RULES, lang: Column | None = None) -> Column:
    """Names of the rules that a text breaks; rules for listed languages need to know its ``lang``."""
    listed = F.lit(False) if lang is None else F.coalesce(lang.isin(list(STOP_WORDS)), F.lit(False))
    broken = []
    for r in rules:
        x = _measure(r.measure, m)
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (x < r.low)
        if r.high is not None:
            bad = bad | (x > r.high)
        holds = m["w"]["n_words"] >= r.from_words
        if r.listed_only:
            holds = holds & listed
        broken.append(F.when(bad & holds, F.lit(r.measure)))
    return F.array_compact(F.array(*broken))


def judge(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """One row per row of ``docs``: the counts, base_failed, kept and the names of broken rules.

    Base: fewer than ten words, or over a fifth of them in repeated five-word windows.  Null and
    empty texts have no words and fail it.  Stop words are asked only of texts whose language has a list;
    without a column of languages, or with a null in it, of none.
    """
    lang = quoted(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    m = docs.select(quoted(id_col).alias("doc_id"), measures(quoted(text_col)).alias("m"), lang.alias("lang"))
    broken = verdict(F.col("m"), rules, F.col("lang"))
    n, repeated = F.col("m.w.n_words"), F.col("m.w.n_repeat_words")
    failed = (n < 10) | (100 * repeated > 20 * n)
    return m.select(
        "doc_id",
        n.alias("n_words"),
        F.col("m.word_chars").alias("word_chars"),
        F.col("m.n_symbols").alias("n_symbols"),
        F.col("m.l.n_dup_lines").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & (F.size(broken) == 0)).alias("kept"),
        F.array_join(broken, ",").alias("broken"),
    )


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({w for line in STOP_WORDS.values() for w in line.split()}))
    blank = r"[\x20\x09-\x0D]"
    sql = {
        "n_words": "n_words", "mean_word_chars": "word_chars / greatest(n_words, 1)", "symbol_ratio": "n_symbols / greatest(n_words, 1)",
        "shout_ratio": "n_shouts / greatest(n_words, 1)", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
        "table_line_ratio": "n_table_lines / greatest(n_lines, 1)", "stop_word_ratio": "n_stop_words / greatest(n_words, 1)",
    }
    cases = []
    for r in rules:
        bounds = [f"{sql[r.measure]} < {r.low}"] * (r.low is not None) + [f"{sql[r.measure]} > {r.high}"] * (r.high is not None)
        listed = f" AND coalesce(lang IN ({', '.join(repr(x) for x in STOP_WORDS)}), false)" * r.listed_only
        cases.append(f"CASE WHEN ({' OR '.join(bounds)}) AND n_words >= {r.from_words}{listed} THEN '{r.measure}' END")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{blank}', '', 'g') <> '') AS l FROM d),
grams AS (SELECT r, i, list_aggregate(w[i:i + {WINDOW - 1}], 'string_agg', ' ') AS g
          FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW})),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range({WINDOW}) x(k) GROUP BY r),
m AS (SELECT w.r, doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{blank}', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_shouts,
  len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  len(list_filter(l, lambda x: contains(x, '|')))::BIGINT AS n_table_lines,
  len(list_filter(w, lambda x: lower(translate(x, '.,;:!?', '')) IN ({stop})))::BIGINT AS n_stop_words,
  coalesce(covered.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN covered ON w.r = covered.r),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, concat_ws(',', {', '.join(cases)}) AS broken FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken = '' AS kept, broken FROM v
"""
