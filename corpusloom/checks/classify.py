"""Classification queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusloom.checks import views as v
from corpusloom.functions import prompts
from corpusloom.operators.ask import call_stats
from corpusloom.operators.scratch import new_path
from corpusloom.plans import classify as c
from corpusloom.sources import documents, exports, sinks


def _categories(spark: SparkSession, d: str, without: str = "src3") -> DataFrame:
    """The sources met in the documents, as the user's categories; one may be left out."""
    names = v.table(spark, d, "documents").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n"))
    pos = F.row_number().over(Window.orderBy("name")).cast("long") - 1
    return names.where(F.col("name") != without).select(pos.alias("pos"), "name", F.lit(None).cast("string").alias("definition"))


CATEGORIES = """categories AS (SELECT row_number() OVER (ORDER BY source) - 1 AS pos, source AS name
  FROM (SELECT DISTINCT source FROM documents WHERE source <> 'src3'))"""


def _classified(spark: SparkSession, d: str, mode: str) -> DataFrame:
    p = v.papers(spark, d)
    return c.classify(p, _categories(spark, d), v.text_column(p), v.class_responder(mode), mode)


def schema_inline(spark: SparkSession, d: str) -> DataFrame:
    lists = v.papers(spark, d).select("paper_id", F.concat_ws(", ", "source", F.lit(" "), "lang", "title").alias("listed"))
    return documents.categories_inline(lists, "listed")


def schema_text(spark: SparkSession, d: str) -> DataFrame:
    return documents.schema_text(_categories(spark, d, without=""))


def schema_defined(spark: SparkSession, d: str) -> DataFrame:
    """Categories with a definition are shown as a JSON object."""
    sizes = v.table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    named = sizes.select(
        F.row_number().over(Window.orderBy("lang")).cast("long").alias("pos"),
        F.col("lang").alias("name"),
        F.concat(F.col("n").cast("string"), F.lit(" papers")).alias("definition"),
    )
    return documents.schema_text(named)


def classify_single(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d, "single").select("paper_id", "classify_category", "classify_reason", "shape_ok")


def classify_multi(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d, "multi").select("paper_id", "classify_category", "shape_ok")


def classify_keywords(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d, "multi").select("paper_id", "classify_keywords")


def classify_failures(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d, "single").where(~F.col("response_ok")).select(
        "paper_id", "classify_category", "classify_reason", "classify_keywords"
    )


def classify_valid(spark: SparkSession, d: str) -> DataFrame:
    return c.flag_categories(_classified(spark, d, "multi"), _categories(spark, d))


def category_distribution(spark: SparkSession, d: str) -> DataFrame:
    return c.category_distribution(_classified(spark, d, "multi"))


def classified_csv(spark: SparkSession, d: str) -> DataFrame:
    """Classified papers written as CSV and read back; empty cells read as missing."""
    path = new_path(spark, "classified")
    done = _classified(spark, d, "multi")
    sinks.write_csv(done.select("paper_id", "title", "classify_category", "classify_reason", "classify_keywords"), path)
    back = exports.load_papers(spark, path)
    return back.select("paper_id", "classify_category", "classify_reason", "classify_keywords", F.md5("paper_title").alias("title"))


def call_statistics(spark: SparkSession, d: str) -> DataFrame:
    p = v.papers(spark, d)
    return call_stats(p.withColumn("prompt", v.text_column(p)).select("paper_id", v.class_responder("single").alias("response")))


QUERIES = {
    "schema_inline": schema_inline,
    "schema_text": schema_text,
    "schema_defined": schema_defined,
    "classify_single": classify_single,
    "classify_multi": classify_multi,
    "classify_keywords": classify_keywords,
    "classify_failures": classify_failures,
    "classify_valid": classify_valid,
    "category_distribution": category_distribution,
    "classified_csv": classified_csv,
    "call_stats": call_statistics,
}

_KIND = """CASE WHEN paper_id % 17 = 0 OR paper_id % 19 = 0 THEN 'failed' WHEN paper_id % 23 = 0 THEN 'empty'
  WHEN paper_id % 5 = 0 THEN 'unusual' ELSE 'usual' END"""


def _answers(mode: str) -> str:
    usual, unusual = ("source", "source || '; ' || lang")
    if mode == "multi":
        usual, unusual = unusual, usual
    prompt = (
        prompts.CLASSIFY.replace("{{classify_mode}}", mode)
        .replace("{{researcher_guide}}", prompts.NO_GUIDE)
        .replace("{{output_lang}}", "English")
    )
    return f"""WITH {v.PAPERS}, {CATEGORIES},
      shown AS (SELECT string_agg('- ' || name, chr(10) ORDER BY pos) AS schema_text FROM categories),
      kinds AS (SELECT *, {_KIND} AS kind FROM papers),
      answers AS (SELECT kinds.*,
        CASE kind WHEN 'usual' THEN {usual} WHEN 'unusual' THEN {unusual} ELSE '' END AS classify_category,
        CASE WHEN kind IN ('usual', 'unusual') THEN md5(replace(replace({v.sql_text(prompt)},
          '{{{{schema_text}}}}', schema_text), '{{{{paper_text}}}}', {v.TEXT})) ELSE '' END AS classify_reason,
        CASE kind WHEN 'failed' THEN '' WHEN 'empty' THEN 'plain' ELSE lang || '; ' || n_chars END AS classify_keywords,
        kind <> 'failed' AS response_ok,
        {"kind = 'usual' OR kind = 'failed'" if mode == "single" else "kind IN ('usual', 'empty')"} AS shape_ok
      FROM kinds, shown)"""


_SPLIT = "parts AS (SELECT paper_id, unnest(string_split(classify_category, '; ')) AS category FROM answers)"

ORACLES = {
    "schema_inline": f"""WITH l AS (SELECT paper_id, list_filter(list_transform(
        string_split(source || ',' || lang || ',' || title, ','), lambda x: trim(x, {v.BLANKS})), lambda x: x <> '') AS items
        FROM (SELECT doc_id + 1 AS paper_id, source, lang, split_part(text, chr(10), 1) AS title FROM documents))
      SELECT paper_id, unnest(range(len(items))) AS pos, unnest(items) AS name FROM l""",
    "schema_text": f"""WITH categories AS (SELECT row_number() OVER (ORDER BY source) - 1 AS pos, source AS name
      FROM (SELECT DISTINCT source FROM documents)) SELECT string_agg('- ' || name, chr(10) ORDER BY pos) AS schema_text FROM categories""",
    "schema_defined": """WITH s AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
      SELECT '{' || chr(10) || string_agg('  "' || lang || '" : "' || n || ' papers"', ',' || chr(10) ORDER BY lang)
        || chr(10) || '}' AS schema_text FROM s""",
    "classify_single": f"{_answers('single')} SELECT paper_id, classify_category, classify_reason, shape_ok FROM answers",
    "classify_multi": f"{_answers('multi')} SELECT paper_id, classify_category, shape_ok FROM answers",
    "classify_keywords": f"{_answers('multi')} SELECT paper_id, classify_keywords FROM answers",
    "classify_failures": f"""{_answers('single')}
      SELECT paper_id, classify_category, classify_reason, classify_keywords FROM answers WHERE NOT response_ok""",
    "classify_valid": f"""{_answers('multi')}, {_SPLIT}
      SELECT paper_id, category, category IN (SELECT name FROM categories) AS in_schema FROM parts WHERE category <> ''""",
    "category_distribution": f"""{_answers('multi')}, {_SPLIT}
      SELECT category, count(*) AS n FROM parts WHERE category <> '' GROUP BY category ORDER BY n DESC, category""",
    "classified_csv": f"""{_answers('multi')} SELECT paper_id, nullif(classify_category, '') AS classify_category,
      nullif(classify_reason, '') AS classify_reason, nullif(classify_keywords, '') AS classify_keywords, md5(title) AS title FROM answers""",
    "call_stats": f"{_answers('single')} SELECT count(*) FILTER (response_ok) AS succeeded, count(*) AS total FROM answers",
}
