"""Mixing sources to target weights by iterative proportional fitting.

Token mass is added up per cell (source, language, topic).  Raking scales the cells until their
sums over each of the three agree with the target shares of the token budget.  A cell holds its weight,
its mass at most: the bound is part of the raking, so what it takes from full cells is raked onto the
others.  A document's probability is what its cell holds over the cell's mass.  A hash of seed and id draws
the sample, so a rerun draws the same.

No value can hold more than its mass, which bounds the budget; it is lowered further only where that narrows
the gap between shares and targets.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.text import quoted
from corpusloom.operators.scratch import settle

DIMENSIONS = ("source", "lang", "topic")
#: Targets that are not given: the share of a value is its mass to this power, made to add up to one.
TEMPERATURE = {"source": 0.7, "lang": 0.7, "topic": 0.9}
#: The share of all tokens wanted; less where the targets cannot be met with as many.
BUDGET = 0.7
#: The largest gap of a share, as part of its target, that counts as met.
TOLERANCE = 0.01
#: Sweeps between two looks at the gap, and such rounds at one budget.
SWEEPS = 8
ROUNDS = 6
#: How often the budget is lowered to LOWERED of itself, and the part of a gap that counts as no progress.
LOWERINGS = 5
LOWERED = 0.9
STUCK = 0.99
#: Cells up to which sums are taken by windows, many in one job, and their probabilities broadcast: about 100 MB.
MAX_BROADCAST = 1_000_000
SEED = 7
#: The value that stands for null in a dimension.
NONE = "(none)"
#: Bytes of text taken for one token.
BYTES = 4
DIGITS = 13

#: Topics by the first pattern found in the text.
TOPICS = (("table", r" \| "), ("license", "(?i)licen[sc]e|copyright"), ("contact", "[^ ]@[^ ]"), ("web", "https?://"))


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def tokens_of(text: Column) -> Column:
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / F.lit(BYTES)).cast("long")


def _labels(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, source, lang, topic, tokens) and more; null labels become NONE, a null text is prose."""
    return docs.select(
        F.col("doc_id"),
        F.coalesce(F.col("source"), F.lit(NONE)).alias("source"),
        F.coalesce(F.col("lang"), F.lit(NONE)).alias("lang"),
        topic_of(F.coalesce(F.col("text"), F.lit(""))).alias("topic"),
        tokens_of(F.col("text")).alias("tokens"),
        *more,
    )


def _targets(cells: DataFrame, dim: str, given: Mapping[str, float] | None) -> DataFrame:
    """(value, share); of a given table only values that occur count, made to add up to one."""
    mass = cells.groupBy(dim).agg(F.sum("mass").alias("_m"))
    if given is None:
        want = F.pow(F.col("_m"), F.lit(TEMPERATURE[dim]))
    else:
        pairs = [F.lit(x) for kv in given.items() for x in (kv[0], float(kv[1]))]
        want = F.coalesce(F.element_at(F.create_map(*pairs), F.col(dim)), F.lit(0.0))
    wanted = settle(mass.select(dim, want.alias("_w")), f"target-{dim}")
    total = wanted.agg(F.sum("_w")).head()[0]
    if not total:
        return wanted.select(dim, F.lit(0.0).alias(f"_t_{dim}"))
    return wanted.select(dim, (F.col("_w") / F.lit(float(total))).alias(f"_t_{dim}"))


def _by_value(cells: DataFrame, amount: Column) -> DataFrame:
    """(dimension, value, amount) summed per value of every dimension."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS])
    return cells.select(F.explode(pairs).alias("v"), amount.alias("amount")).groupBy("v").agg(F.sum("amount").alias("amount")).select("v.*", "amount")


def _wanted(shares: Mapping[str, DataFrame]) -> DataFrame:
    """(dimension, value, target) out of the target tables of all dimensions."""
    out = None
    for d, share in shares.items():
        one = share.select(F.lit(d).alias("dimension"), F.col(d).alias("value"), F.col(f"_t_{d}").alias("target"))
        out = one if out is None else out.unionByName(one)
    return out


def _gaps(cells: DataFrame, amount: Column, wanted: DataFrame) -> DataFrame:
    """(dimension, value, target, share, gap): the gap is a part of the target, null where none is wanted."""
    found = _by_value(cells, amount)
    total = found.where(F.col("dimension") == DIMENSIONS[0]).agg(F.sum("amount")).head()[0] or 0
    share = F.col("amount") / F.lit(float(total)) if total else F.lit(0.0)
    gap = F.when(F.col("target") > 0, F.abs(F.col("share") / F.col("target") - 1))
    return wanted.join(found, ["dimension", "value"]).select("dimension", "value", "target", share.alias("share")).withColumn("gap", gap)


def gaps(cells: DataFrame, chances: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """(dimension, value, target, share, gap) of the shares that ``chances`` lead to, per value of every dimension."""
    shares = {d: _targets(cells, d, (targets or {}).get(d)) for d in DIMENSIONS}
    both = cells.join(chances, list(DIMENSIONS))
    return _gaps(both, F.col("mass") * F.col("probability"), _wanted(shares))


def _swept(cells: DataFrame, goal: float, sweeps: int, few: bool) -> DataFrame:
    """``cells`` with their weights after ``sweeps`` over all dimensions."""
    held = F.least("weight", "mass")
    for _ in range(sweeps):
        for d in DIMENSIONS:
            wanted = F.lit(goal) * F.col(f"_t_{d}")
            if few:
                total = F.sum(held).over(Window.partitionBy(d))
                cells = cells.withColumn("weight", F.when(total > 0, F.col("weight") * (wanted / total)).otherwise(F.lit(0.0)))
            else:
                # a value may have most cells: they are added up before they meet
                sums = settle(cells.groupBy(d).agg(F.sum(held).alias("_s")), "sums")
                scaled = F.when(F.col("_s") > 0, F.col("weight") * (wanted / F.col("_s"))).otherwise(F.lit(0.0))
                cells = settle(cells.join(sums, d).withColumn("weight", scaled).select(*cells.columns), "raked")
    return cells


def fitted(
    cells: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    budget: float | None = None,
    tolerance: float = TOLERANCE,
) -> tuple[DataFrame, float, float]:
    """(source, lang, topic, probability), the budget, and the largest gap left.

    ``cells`` (source, lang, topic, mass > 0).  The budget is the given one (None: all tokens), at most what the
    scarcest value allows.  While shares miss their targets by more than ``tolerance`` it is lowered, as long as
    that narrows the gap; the try with the smallest gap is taken, the first of equals.  Targets that contradict
    each other are met by no budget: then the gap is logged.
    """
    cells = settle(cells, "cells")
    shares = {d: _targets(cells, d, (targets or {}).get(d)) for d in DIMENSIONS}
    wanted = settle(_wanted(shares), "wanted")
    count, total = cells.agg(F.count("*"), F.sum("mass")).head()
    room = _by_value(cells, F.col("mass")).join(wanted.where("target > 0"), ["dimension", "value"])
    most = float(room.agg(F.min(F.col("amount") / F.col("target"))).head()[0] or 0) / total if total else 0.0
    share = min(1.0 if budget is None else budget, most)
    if not share:
        return cells.select(*DIMENSIONS, F.lit(0.0).alias("probability")), 0.0, 0.0
    start = cells
    for d in DIMENSIONS:
        start = start.join(shares[d], d)
    start = settle(start.withColumn("weight", F.col("mass").cast("double")), "start")
    held = F.least("weight", "mass")
    best: tuple[float, float, DataFrame] | None = None
    for _ in range(LOWERINGS + 1):
        now, gap = start, float("inf")
        for _ in range(ROUNDS):
            now = settle(_swept(now, share * total, SWEEPS, count <= MAX_BROADCAST), "raked")
            before, gap = gap, _gaps(now, held, wanted).agg(F.max("gap")).head()[0] or 0.0
            if gap <= tolerance or gap > STUCK * before:
                break
        narrower = best is None or gap < STUCK * best[0]
        if narrower:
            best = (gap, share, now)
        if gap <= tolerance or not narrower:
            break
        share *= LOWERED
    gap, share, now = best
    log = logging.getLogger(__name__)
    log.log(logging.WARNING if gap > tolerance else logging.INFO, "mix: budget %.4f, largest gap to a target share %.2f %%", share, 100 * gap)
    return now.select(*DIMENSIONS, F.round(held / F.col("mass"), 6).alias("probability")), share, gap


def draw(key: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on seed and key alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long") / F.lit(float(16**DIGITS))


def mix(
    docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float | None = BUDGET, seed: int = SEED
) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, probability, kept) for every row of ``docs``.

    ``targets`` gives shares per value of a dimension; values left out get none.  Rows that repeat
    an id are drawn alike.  Empty and null texts have no mass and are not kept.  ``budget`` is the share of all
    tokens wanted, None for as many as the targets allow.
    """
    # texts are looked through once
    found = _with_chance(settle(_labels(docs), "labels"), targets, budget)
    p = F.coalesce(F.col("probability"), F.lit(0.0))
    return found.select(
        "doc_id", "source", "lang", "topic", "tokens", p.alias("probability"),
        ((F.col("tokens") > 0) & (draw(F.col("doc_id"), seed) < p)).alias("kept"),
    )


SALTS = 64


def _with_chance(each: DataFrame, targets: Mapping[str, Mapping[str, float]] | None, budget: float | None) -> DataFrame:
    """Labelled documents with the probability of their cell; beyond MAX_BROADCAST cells by salted shuffle."""
    cells = each.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("mass")).where("mass > 0")
    chances = settle(fitted(cells, targets, budget)[0], "chances")
    if chances.count() <= MAX_BROADCAST:
        return each.join(F.broadcast(chances), list(DIMENSIONS), "left")
    # a cell may hold a third of all rows
    salted = chances.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = each.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [*DIMENSIONS, "_salt"], "left").drop("_salt")


def sampled(
    docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float | None = BUDGET, seed: int = SEED
) -> DataFrame:
    """The rows of ``docs`` that the sample keeps, with all their columns."""
    own = [quoted(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    found = _with_chance(_labels(docs, *own), targets, budget)
    kept = found.where((F.col("tokens") > 0) & (draw(F.col("doc_id"), seed) < F.coalesce(F.col("probability"), F.lit(0.0))))
    return kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def oracle(budget: float = BUDGET, seed: int = SEED) -> str:
    """DuckDB twin over ``documents`` with the default targets, for tables that need no lower budget than the scarcest value's."""
    topic = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}'" for n, p in TOPICS) + " ELSE 'prose' END"
    ctes = [
        f"each AS MATERIALIZED (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, {topic} AS topic, "
        f"ceil(strlen(coalesce(text, '')) / {BYTES})::BIGINT AS tokens FROM documents)",
        "cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS mass FROM each GROUP BY ALL HAVING sum(tokens) > 0)",
    ]
    for d in DIMENSIONS:
        ctes.append(
            f"t_{d} AS MATERIALIZED (SELECT {d}, m, w / sum(w) OVER () AS t_{d} FROM (SELECT {d}, sum(mass)::DOUBLE AS m, sum(mass)::DOUBLE ** {TEMPERATURE[d]} AS w FROM cells GROUP BY {d}))"
        )
    least = ", ".join(f"(SELECT min(m / t_{d}) FROM t_{d})" for d in DIMENSIONS)
    ctes.append(f"goal AS MATERIALIZED (SELECT least({budget} * sum(mass), {least}) AS goal FROM cells)")
    joined = " ".join(f"JOIN t_{d} USING ({d})" for d in DIMENSIONS)
    ctes.append(
        f"c0 AS MATERIALIZED (SELECT source, lang, topic, mass, {', '.join(f't_{d}' for d in DIMENSIONS)}, goal, mass::DOUBLE AS weight, false AS done FROM cells {joined}, goal)"
    )
    names = f"source, lang, topic, mass, {', '.join(f't_{d}' for d in DIMENSIONS)}, goal"
    last = "c0"
    for r in range(ROUNDS):
        for i in range(SWEEPS * len(DIMENSIONS)):
            d = DIMENSIONS[i % len(DIMENSIONS)]
            step = f"weight * (goal * t_{d} / sum(least(weight, mass)) OVER (PARTITION BY {d}))"
            ctes.append(f"c{r}_{i} AS MATERIALIZED (SELECT {names}, CASE WHEN done THEN weight ELSE {step} END AS weight, done FROM {last})")
            last = f"c{r}_{i}"
        gaps = ", ".join(f"abs(sum(least(weight, mass)) OVER (PARTITION BY {d}) / sum(least(weight, mass)) OVER () / t_{d} - 1)" for d in DIMENSIONS)
        ctes.append(f"d{r} AS MATERIALIZED (SELECT {names}, weight, max(gap) OVER () <= {TOLERANCE} AS done FROM (SELECT *, greatest({gaps}) AS gap FROM {last}))")
        last = f"d{r}"
    return f"""
WITH {", ".join(ctes)},
p AS (SELECT source, lang, topic, round(least(weight, mass) / mass, 6) AS probability FROM {last})
SELECT doc_id, source, lang, topic, tokens, coalesce(probability, 0.0) AS probability,
  tokens > 0 AND ('0x' || substr(md5('{seed}/' || coalesce(doc_id::VARCHAR, '')), 1, {DIGITS}))::BIGINT / {float(16**DIGITS)} < coalesce(probability, 0.0) AS kept
FROM each LEFT JOIN p USING (source, lang, topic)
"""
