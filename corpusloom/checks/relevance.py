"""Scoring queries and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.checks import views as v
from corpusloom.functions import prompts, text
from corpusloom.operators.numbering import assign_paper_ids
from corpusloom.operators.scratch import new_path
from corpusloom.plans import quality, relevance
from corpusloom.sources import sinks

CRITERIA = '{"5":"yes","1":"no"}'


def _scored(spark: SparkSession, d: str) -> DataFrame:
    p = v.papers(spark, d)
    return relevance.score_papers(p, v.TOPIC, CRITERIA, v.text_column(p), v.score_responder())


def assign_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = v.table(spark, d, "documents").select("doc_id", "source", "lang")
    return assign_paper_ids(docs, ["doc_id"])


PAD_LEFT, PAD_RIGHT = "\t 　", " \r\n  "


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    padded = F.concat(F.lit(PAD_LEFT), F.col("text"), F.lit(PAD_RIGHT))
    c = text.clean_text(padded)
    return v.table(spark, d, "documents").select(
        "doc_id", F.length(c).cast("long").alias("chars"), F.md5(c).alias("digest")
    )


def longest_of(spark: SparkSession, d: str) -> DataFrame:
    p = v.papers(spark, d)
    return p.select("paper_id", text.longest_of([F.col("keywords"), F.col("lang"), F.col("source"), F.col("title")]).alias("value"))


def paper_text(spark: SparkSession, d: str) -> DataFrame:
    p = v.papers(spark, d)
    t = v.text_column(p)
    return p.select("paper_id", F.length(t).cast("long").alias("chars"), F.md5(t).alias("digest"))


def keyword_fallback(spark: SparkSession, d: str) -> DataFrame:
    p = v.papers(spark, d)
    return p.select("paper_id", text.keyword_fallback(F.col("keywords"), p.columns).alias("keywords"))


def render_prompt(spark: SparkSession, d: str) -> DataFrame:
    p = v.papers(spark, d)
    # the paper's text holds a later placeholder, which gets expanded as well
    holding = F.concat(v.text_column(p), F.lit(" in {{output_lang}} {{nobody}}"))
    prompt = prompts.render(prompts.SCORE, topic=v.TOPIC, criteria=CRITERIA, paper_text=holding, output_lang=F.col("lang"))
    return p.select("paper_id", F.length(prompt).cast("long").alias("chars"), F.md5(prompt).alias("digest"))


RENDERED = "replace(replace({}, '{{{{paper_text}}}}', {} || ' in {{{{output_lang}}}} {{{{nobody}}}}'), '{{{{output_lang}}}}', lang)".format(
    v.sql_text(prompts.SCORE.replace("{{topic}}", v.TOPIC).replace("{{criteria}}", CRITERIA)), v.TEXT
)


def split_list(spark: SparkSession, d: str) -> DataFrame:
    listed = F.concat(F.lit(" "), F.col("source"), F.lit(" ,, "), F.col("lang"), F.lit(","), F.col("text"))
    items = text.split_list(listed)
    return v.table(spark, d, "documents").select(
        "doc_id", F.size(items).cast("long").alias("items"), F.md5(F.array_join(items, "|")).alias("digest")
    )


def score_defaults(spark: SparkSession, d: str) -> DataFrame:
    p = v.papers(spark, d)
    scored = relevance.score_papers(p, v.TOPIC, CRITERIA, v.text_column(p), v.odd_score_responder())
    return scored.select("paper_id", "score", "reason", "match_keywords", "passed", "response_ok")


SCORE_PROMPT = "replace({}, '{{{{paper_text}}}}', {})".format(
    v.sql_text(
        prompts.SCORE.replace("{{topic}}", v.TOPIC).replace("{{criteria}}", CRITERIA).replace("{{output_lang}}", "English")
    ),
    v.TEXT,
)

ODD = f"""odd AS (
  SELECT *, CASE
    WHEN paper_id % 17 = 0 OR paper_id % 19 = 0 OR paper_id % 23 = 0 OR paper_id % 29 = 0 THEN 1
    WHEN paper_id % 31 = 0 THEN paper_id % 5 WHEN paper_id % 37 = 0 THEN 4.5 WHEN paper_id % 41 = 0 THEN 7
    WHEN paper_id % 43 = 0 THEN 1 ELSE {v.SCORE} END::DOUBLE AS score,
  CASE WHEN paper_id % 17 = 0 THEN 'null' WHEN paper_id % 19 = 0 THEN 'junk' WHEN paper_id % 23 = 0 THEN 'empty'
    WHEN paper_id % 29 = 0 THEN 'nullscore' WHEN paper_id % 31 = 0 THEN 'string' WHEN paper_id % 37 = 0 THEN 'half'
    WHEN paper_id % 41 = 0 THEN 'high' WHEN paper_id % 43 = 0 THEN 'list' ELSE 'usual' END AS kind FROM papers)"""


def filter_passed(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("passed").select("paper_id", "title", "score", "match_keywords")


def score_distribution(spark: SparkSession, d: str) -> DataFrame:
    return relevance.score_distribution(_scored(spark, d))


def filter_stats(spark: SparkSession, d: str) -> DataFrame:
    return relevance.filter_stats(_scored(spark, d))


def criteria_sample(spark: SparkSession, d: str) -> DataFrame:
    return relevance.criteria_sample(v.papers(spark, d)).select("draw", "paper_id", "title")


def criteria_prompt(spark: SparkSession, d: str) -> DataFrame:
    p = v.papers(spark, d)
    return relevance.criteria_prompt(p, v.TOPIC, v.text_column(p)).select(
        "sample_count", F.length("prompt").cast("long").alias("chars"), F.md5("prompt").alias("digest")
    )


def criteria_default(spark: SparkSession, d: str) -> DataFrame:
    """Criteria read from answers, one per paper: given, missing, or no answer at all."""
    i = F.col("paper_id")
    said = (
        F.when(i % 3 == 0, F.to_json(F.struct(F.struct(F.col("lang").alias("5"), F.col("source").alias("1")).alias("criteria"))))
        .when(i % 3 == 1, F.lit('{"analysis": "only"}'))
    )
    return v.papers(spark, d).select("paper_id", relevance.criteria_text(said).alias("criteria"))


def spot_check(spark: SparkSession, d: str) -> DataFrame:
    return relevance.spot_check(_scored(spark, d), F.col("title"), seed=7)


def data_peek(spark: SparkSession, d: str) -> DataFrame:
    p = v.papers(spark, d)
    c = text.clean_text
    return relevance.data_peek(p, c(F.col("title")), c(F.col("abstract")), c(F.col("keywords")))


def contract_score(spark: SparkSession, d: str) -> DataFrame:
    p = v.papers(spark, d)
    scored = relevance.score_papers(p, v.TOPIC, CRITERIA, v.text_column(p), v.odd_score_responder())
    return quality.bad_scores(scored).select("paper_id", "score")


def scored_sinks(spark: SparkSession, d: str) -> DataFrame:
    """Write passed and all papers as CSV, read both folders back and compare their sizes."""
    path = new_path(spark, "filtered")
    rows = _scored(spark, d).select("paper_id", "title", "score", "passed")
    sinks.write_scored(rows, path, as_csv=True)

    def read(folder: str, name: str) -> DataFrame:
        schema = "paper_id bigint, title string, score double, passed boolean"
        back = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(folder)
        return back.groupBy("score").agg(F.count("*").alias("n"), F.sum("paper_id").alias("ids")).withColumn("sink", F.lit(name))

    return read(path, "passed").unionByName(read(path + "_all", "all"))


_S = f"WITH {v.PAPERS}, scored AS (SELECT *, ({v.SCORE})::DOUBLE AS score FROM papers)"
_DRAW = f"""WITH {v.PAPERS}, drawn AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || paper_id), paper_id) AS draw
  FROM papers), picked AS (SELECT * FROM drawn WHERE draw <= 15)"""

QUERIES = {
    f.__name__: f
    for f in (
        assign_ids, clean_text, longest_of, paper_text, keyword_fallback, render_prompt, split_list,
        score_defaults, filter_passed, score_distribution, filter_stats, criteria_sample, criteria_prompt,
        criteria_default, spot_check, data_peek, contract_score, scored_sinks,
    )
}

ORACLES = {
    "assign_ids": "SELECT doc_id, source, lang, doc_id + 1 AS paper_id FROM documents",
    "clean_text": f"""WITH c AS (SELECT doc_id, trim({v.sql_text(PAD_LEFT)} || text || {v.sql_text(PAD_RIGHT)},
        {v.sql_text(text.WHITESPACE)}) AS t FROM documents)
      SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM c""",
    "longest_of": f"""WITH {v.PAPERS}, c AS (SELECT paper_id, unnest([1, 2, 3, 4]) AS i,
        unnest([coalesce(keywords, ''), lang, source, trim(title, {v.BLANKS})]) AS x FROM papers)
      SELECT paper_id, arg_max(x, length(x) * 10 - i) AS value FROM c GROUP BY paper_id""",
    "paper_text": f"WITH {v.PAPERS} SELECT paper_id, length({v.TEXT}) AS chars, md5({v.TEXT}) AS digest FROM papers",
    "keyword_fallback": f"WITH {v.PAPERS} SELECT paper_id, coalesce(keywords, author_keywords) AS keywords FROM papers",
    "render_prompt": f"WITH {v.PAPERS} SELECT paper_id, length({RENDERED}) AS chars, md5({RENDERED}) AS digest FROM papers",
    "split_list": f"""WITH s AS (SELECT doc_id, list_filter(list_transform(
        string_split(' ' || source || ' ,, ' || lang || ',' || text, ','), lambda x: trim(x, {v.sql_text(text.WHITESPACE)})),
        lambda x: x <> '') AS l FROM documents)
      SELECT doc_id, len(l) AS items, md5(array_to_string(l, '|')) AS digest FROM s""",
    "score_defaults": f"""WITH {v.PAPERS}, {ODD}
      SELECT paper_id, score,
        CASE kind WHEN 'usual' THEN 'prompt ' || md5({SCORE_PROMPT}) WHEN 'nullscore' THEN 'unsure' ELSE '' END AS reason,
        CASE kind WHEN 'usual' THEN array_to_string({v.MET}, '; ') WHEN 'string' THEN 'one; two'
          WHEN 'half' THEN 'a; b' ELSE '' END AS match_keywords,
        score >= 3 AS passed, kind NOT IN ('null', 'junk', 'empty', 'list') AS response_ok FROM odd""",
    "filter_passed": f"""{_S} SELECT paper_id, title, score, array_to_string({v.MET}, '; ') AS match_keywords
      FROM scored WHERE score >= 3""",
    "score_distribution": f"""{_S} SELECT score, count(*) AS n,
      100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS pct FROM scored GROUP BY score ORDER BY score""",
    "filter_stats": f"{_S} SELECT count(*) FILTER (score >= 3) AS passed, count(*) AS total FROM scored",
    "criteria_sample": f"{_DRAW} SELECT draw, paper_id, title FROM picked",
    "criteria_prompt": """{} , s AS (SELECT count(*) AS sample_count,
        string_agg('#' || draw || ' ' || {}, chr(10) ORDER BY draw) AS samples_text FROM picked),
      r AS (SELECT sample_count, replace(replace(replace({}, '{{{{sample_count}}}}', sample_count::VARCHAR),
        '{{{{samples_text}}}}', samples_text), '{{{{output_lang}}}}', 'English') AS prompt FROM s)
      SELECT sample_count, length(prompt) AS chars, md5(prompt) AS digest FROM r""".format(
        _DRAW, v.TEXT, v.sql_text(prompts.CRITERIA.replace("{{topic}}", v.TOPIC))
    ),
    "criteria_default": f"""WITH {v.PAPERS} SELECT paper_id, CASE WHEN paper_id % 3 = 0
        THEN '{{"5":"' || lang || '","1":"' || source || '"}}' ELSE {v.sql_text(prompts.DEFAULT_CRITERIA)} END AS criteria
      FROM papers""",
    "spot_check": f"""{_S} SELECT paper_id, score, substr(title, 1, 80) AS title FROM scored
      WHERE score >= 3 ORDER BY md5('7:' || paper_id), paper_id LIMIT 5""",
    "data_peek": f"""WITH {v.PAPERS} SELECT paper_id, substr(trim(title, {v.BLANKS}), 1, 80) AS title,
      substr(trim(abstract, {v.BLANKS}), 1, 100) AS abstract, coalesce(keywords, '') AS keywords
      FROM papers WHERE paper_id <= 5""",
    "contract_score": f"""WITH {v.PAPERS}, {ODD} SELECT paper_id, score FROM odd
      WHERE score NOT BETWEEN 1 AND 5 OR score <> floor(score)""",
    "scored_sinks": f"""{_S} SELECT 'passed' AS sink, score, count(*) AS n, sum(paper_id)::BIGINT AS ids FROM scored
        WHERE score >= 3 GROUP BY score
      UNION ALL SELECT 'all', score, count(*), sum(paper_id)::BIGINT FROM scored GROUP BY score""",
}
