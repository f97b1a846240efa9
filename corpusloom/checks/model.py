"""Calls of a Python responder on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.checks import views as v
from corpusloom.functions import prompts
from corpusloom.operators.ask import semantic_map
from corpusloom.operators.scratch import new_path, settle
from corpusloom.plans import classify, explore, relevance, translate

FAST = {"qps": 0, "backoff_s": 0.0, "batch": 64, "concurrency": 4}


def counting_responder(fail_every: int = 0) -> Callable[[list[str]], list[str | None]]:
    """Answers with the length of the prompt; prompts of some lengths get no JSON."""

    def answer(asked: list[str]) -> list[str | None]:
        import json

        return [
            "no JSON here" if fail_every and len(p) % fail_every == 0
            else json.dumps({"score": 1 + len(p) % 5, "reason": f"{len(p)} chars", "keywords": ["length"]})
            for p in asked
        ]

    return answer


def semantic_calls(spark: SparkSession, d: str) -> DataFrame:
    """Every paper's text sent once per distinct text, failures kept as null."""
    p = v.papers(spark, d).select("paper_id", F.col("abstract").alias("prompt"))
    done = semantic_map(p, "prompt", counting_responder(7), **FAST)
    return done.select(
        "paper_id", F.get_json_object("response", "$.reason").alias("reason"), F.col("attempts").cast("long").alias("attempts"),
        F.col("error").isNotNull().alias("failed"),
    )


def semantic_calls_spread(spark: SparkSession, d: str) -> DataFrame:
    """The same in several commits, with every text met twice treated as hot."""
    p = v.papers(spark, d).select("paper_id", F.col("abstract").alias("prompt"))
    done = semantic_map(p, "prompt", counting_responder(7), commit_every=400, hot_rows=2, **FAST)
    return done.select(
        "paper_id", F.get_json_object("response", "$.reason").alias("reason"), F.col("attempts").cast("long").alias("attempts"),
        F.col("error").isNotNull().alias("failed"),
    )


def response_cache(spark: SparkSession, d: str) -> DataFrame:
    """Two runs over a cache: requests kept after each, and how many of them are answers."""
    path = new_path(spark, "cache")
    p = v.papers(spark, d).select("paper_id", F.col("abstract").alias("prompt"))
    semantic_map(p, "prompt", counting_responder(7), cache_path=path, **FAST)
    first = settle(spark.read.parquet(path), "first_run")
    semantic_map(p, "prompt", counting_responder(), cache_path=path, **FAST)
    both = spark.read.parquet(path)
    return (
        first.withColumn("run", F.lit(1))
        .unionByName(both.withColumn("run", F.lit(2)))
        .groupBy("run")
        .agg(F.count("*").alias("calls"), F.count("response").alias("answers"), F.countDistinct("request_hash").alias("requests"))
        .withColumn("run", F.col("run").cast("long"))
    )


def score_calls(spark: SparkSession, d: str) -> DataFrame:
    """The scoring flow with a Python responder, answers joined back to the papers."""
    p = v.papers(spark, d)
    scored = relevance.score_papers(p, v.TOPIC, "{}", v.text_column(p), counting_responder(7), **FAST)
    return scored.select("paper_id", "lang", "score", "reason", "match_keywords", "passed", "response_ok")


def field_responder(make: Callable[[str, str], object]) -> Callable[[list[str]], list[str | None]]:
    """Answers made from title and keywords, read back out of the prompt; a title ending in "e." fails."""

    def answer(asked: list[str]) -> list[str | None]:
        import json

        said = []
        for prompt in asked:
            title = prompt.split("Title: ", 1)[1].split("\nAbstract: ", 1)[0]
            keywords = prompt.rsplit("\nKeywords: ", 1)[1].split("\n", 1)[0]
            said.append(None if title.endswith("e.") else json.dumps(make(title, keywords), ensure_ascii=False))
        return said

    return answer


def explore_calls(spark: SparkSession, d: str) -> DataFrame:
    """Labels named by a Python responder."""
    p = v.papers(spark, d)
    named = field_responder(lambda t, k: {"Keyword": {"category": k, "reason": t}, "Initial": {"category": t[:1]}, "Note": k})
    return explore.explore_labels(p, v.text_column(p), named, dims="Keyword,Initial", **FAST)


def classify_calls(spark: SparkSession, d: str) -> DataFrame:
    """Classes named by a Python responder, as a list."""
    p = v.papers(spark, d)
    given = p.select(F.col("source").alias("name")).distinct().select(
        F.lit(0).cast("long").alias("pos"), "name", F.lit(None).cast("string").alias("definition")
    )
    named = field_responder(lambda t, k: {"category": [k, t[:1]], "reason": t, "keywords": k})
    done = classify.classify(p, given, v.text_column(p), named, "multi", **FAST)
    return done.select("paper_id", "source", "classify_category", "classify_reason", "classify_keywords", "response_ok")


def translate_calls(spark: SparkSession, d: str) -> DataFrame:
    """Long texts asked for one by one, short ones in lists, by a Python responder."""

    def answer(asked: list[str]) -> list[str | None]:
        import json

        bodies = [p.split("\n\n", 1)[1] for p in asked]
        return [
            json.dumps({t: "[en] " + t for t in json.loads(b)}) if b.startswith('["') else None if len(b) % 7 == 0 else "[en] " + b
            for b in bodies
        ]

    done = translate.translate_columns(v.papers(spark, d), "abstract,lang,source", answer, **FAST)
    return done.select("paper_id", F.md5("abstract").alias("abstract"), "lang", "source")


QUERIES = {
    "explore_calls": explore_calls,
    "classify_calls": classify_calls,
    "translate_calls": translate_calls,
    "semantic_map": semantic_calls,
    "semantic_map_spread": semantic_calls_spread,
    "response_cache": response_cache,
    "score_calls": score_calls,
}

_CALLS = f"""WITH {v.PAPERS} SELECT paper_id, CASE WHEN length(abstract) % 7 <> 0 THEN length(abstract) || ' chars' END AS reason,
  CASE WHEN length(abstract) % 7 <> 0 THEN 1 ELSE 3 END::BIGINT AS attempts, length(abstract) % 7 = 0 AS failed FROM papers"""

_SHORT = prompts.SCORE.replace("{{topic}}", v.TOPIC).replace("{{criteria}}", "{}").replace("{{output_lang}}", "English")

_FIELDS = f"""WITH {v.PAPERS}, f AS (SELECT paper_id, source, trim(title, {v.BLANKS}) AS t,
    coalesce(keywords, author_keywords) AS k FROM papers)"""

ORACLES = {
    "explore_calls": f"""{_FIELDS}
      SELECT 'Keyword' AS dim, paper_id AS pos, paper_id, k AS category, t AS reason FROM f WHERE NOT ends_with(t, 'e.')
      UNION ALL SELECT 'Initial', paper_id, paper_id, substr(t, 1, 1), '' FROM f WHERE NOT ends_with(t, 'e.')""",
    "classify_calls": f"""{_FIELDS}, o AS (SELECT *, NOT ends_with(t, 'e.') AS response_ok FROM f)
      SELECT paper_id, source, CASE WHEN response_ok THEN k || '; ' || substr(t, 1, 1) ELSE '' END AS classify_category,
        CASE WHEN response_ok THEN t ELSE '' END AS classify_reason, CASE WHEN response_ok THEN k ELSE '' END AS classify_keywords,
        response_ok FROM o""",
    "translate_calls": f"""WITH {v.PAPERS} SELECT paper_id,
      md5(CASE WHEN length(abstract) % 7 = 0 THEN abstract ELSE '[en] ' || abstract END) AS abstract,
      '[en] ' || lang AS lang, '[en] ' || source AS source FROM papers""",
    "semantic_map": _CALLS,
    "semantic_map_spread": _CALLS,
    "response_cache": f"""WITH t AS (SELECT DISTINCT text FROM documents),
      c AS (SELECT count(*) AS requests, count(*) FILTER (length(text) % 7 = 0) AS failed FROM t)
      SELECT 1::BIGINT AS run, requests AS calls, requests - failed AS answers, requests FROM c
      UNION ALL SELECT 2, requests + failed, requests, requests FROM c""",
    "score_calls": f"""WITH {v.PAPERS}, p AS (SELECT paper_id, lang,
        length(replace({v.sql_text(_SHORT)}, '{{{{paper_text}}}}', {v.TEXT})) AS chars FROM papers)
      SELECT paper_id, lang, CASE WHEN chars % 7 = 0 THEN 1 ELSE 1 + chars % 5 END::DOUBLE AS score,
        CASE WHEN chars % 7 = 0 THEN '' ELSE chars || ' chars' END AS reason,
        CASE WHEN chars % 7 = 0 THEN '' ELSE 'length' END AS match_keywords,
        CASE WHEN chars % 7 = 0 THEN FALSE ELSE 1 + chars % 5 >= 3 END AS passed, chars % 7 <> 0 AS response_ok FROM p""",
}
