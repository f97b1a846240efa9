"""Filter flow: draw a sample, settle the criteria, score every paper, keep the relevant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions import prompts
from corpusloom.functions.responses import with_score
from corpusloom.operators.ask import Responder, ask, once, semantic_map
from corpusloom.plans.common import cap_papers, drop_results, refuse_clashes

# Fixed values of the flow.
SAMPLE_SIZE = 15
SEED = 42
MIN_SCORE = 3.0
SPOT_CHECK = 5

RESULTS = ["score", "reason", "match_keywords", "passed", "response_ok"]


def sample_ids(df: DataFrame, n: int, seed: int) -> DataFrame:
    """(paper_id, draw): ``n`` ids in a fixed pseudo-random order; reads only the ids."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("paper_id").cast("string")))
    return (
        df.select("paper_id", key.alias("_key"))
        .orderBy("_key", "paper_id")
        .limit(n)
        .select("paper_id", F.row_number().over(Window.orderBy("_key", "paper_id")).cast("long").alias("draw"))
    )


def draw(df: DataFrame, n: int, seed: int) -> DataFrame:
    """The sampled rows with ``draw``; the n ids reach the scan as a pushed-down filter."""
    ids = sample_ids(df, n, seed).collect()  # n rows
    number = F.create_map(*[F.lit(x) for r in ids for x in (r.paper_id, r.draw)]).cast("map<bigint,bigint>") if ids else None
    if number is None:
        return df.where(F.lit(False)).withColumn("draw", F.lit(0).cast("long"))
    return df.where(F.col("paper_id").isin([r.paper_id for r in ids])).withColumn("draw", number[F.col("paper_id")])


def criteria_sample(df: DataFrame, n: int = SAMPLE_SIZE, seed: int = SEED) -> DataFrame:
    return draw(df, n, seed)


def criteria_prompt(
    df: DataFrame,
    topic: str,
    text: Column,
    n: int = SAMPLE_SIZE,
    seed: int = SEED,
    template: str = prompts.CRITERIA,
    output_lang: str = "English",
) -> DataFrame:
    """One row: the number of sampled papers, their text and the prompt."""
    line = F.concat(F.lit("#"), F.col("draw").cast("string"), F.lit(" "), text)
    lines = F.sort_array(F.collect_list(F.struct("draw", line.alias("line"))))  # n rows
    return (
        draw(df, n, seed)
        .agg(
            F.count("*").alias("sample_count"),
            F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("samples_text"),
        )
        .withColumn(
            "prompt",
            prompts.render(
                template,
                sample_count=F.col("sample_count"),
                topic=topic,
                samples_text=F.col("samples_text"),
                output_lang=output_lang,
            ),
        )
    )


def criteria_text(response: Column) -> Column:
    """The criteria object of a response as JSON text, or the built-in one."""
    return F.coalesce(
        F.get_json_object(response, "$.criteria"),
        F.get_json_object(response, "$.评分标准"),
        F.lit(prompts.DEFAULT_CRITERIA),
    )


def discover_criteria(df: DataFrame, topic: str, text: Column, responder: Responder, **options: object) -> str:
    """One call over the sample; the result enters the scoring prompt as a literal.

    With a ``cache_path`` a later run finds the criteria again, and so all scores by them.
    """
    wording = {k: options.pop(k) for k in ("template", "output_lang", "n", "seed") if k in options}
    one = criteria_prompt(df, topic, text, **wording)
    if isinstance(responder, Column):
        answered = one.withColumn("response", once(responder))
    else:
        options = {k: v for k, v in options.items() if k in ("max_attempts", "backoff_s", "cache_path", "tag", "qps")}
        answered = semantic_map(one.select("prompt"), "prompt", responder, concurrency=1, **options)
    return answered.select(criteria_text(F.col("response"))).head()[0]


def score_papers(
    df: DataFrame,
    topic: str,
    criteria: str,
    text: Column,
    responder: Responder,
    min_score: float = MIN_SCORE,
    template: str = prompts.SCORE,
    output_lang: str = "English",
    **options: object,
) -> DataFrame:
    """``df`` with score, reason, match_keywords, passed and response_ok."""
    df = drop_results(df, RESULTS)
    refuse_clashes(df, RESULTS)
    prompt = prompts.render(template, topic=topic, criteria=criteria, paper_text=text, output_lang=output_lang)
    return with_score(ask(df, prompt, responder, ["paper_id"], **options), min_score)


def score_distribution(scored: DataFrame) -> DataFrame:
    """Papers per score with their share, ascending."""
    counts = scored.groupBy("score").agg(F.count("*").alias("n"))
    everything = F.sum("n").over(Window.partitionBy())  # over the distinct scores only
    return counts.withColumn("pct", F.lit(100.0) * F.col("n") / everything).orderBy("score")


def filter_stats(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"))


def spot_check(df: DataFrame, title: Column, n: int = SPOT_CHECK, seed: int = SEED) -> DataFrame:
    """A few papers to look at; only passed ones where that column exists."""
    if "passed" in df.columns:
        df = df.where("passed")
    shown = ["paper_id", *(["score"] if "score" in df.columns else [])]
    rows = df.select(*shown, F.substring(title, 1, 80).alias("title"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("paper_id").cast("string")))
    return rows.orderBy(key, "paper_id").limit(n)


def data_peek(df: DataFrame, title: Column, abstract: Column, keywords: Column, n: int = SPOT_CHECK) -> DataFrame:
    """The first papers, shortened, to see whether the columns were read right."""
    return cap_papers(df, n).select(
        "paper_id",
        F.substring(title, 1, 80).alias("title"),
        F.substring(abstract, 1, 100).alias("abstract"),
        keywords.alias("keywords"),
    )
