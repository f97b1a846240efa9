"""Papers and draft labels seen in the given tables, and stand-ins for a model.

The responders here are plain SQL expressions. They exercise prompts, parsing and
everything after; they say nothing about the quality a model would reach.
Each SQL text is the DuckDB twin of the function beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions.text import keyword_fallback, paper_text
from corpusloom.operators.layout import spread

TOPIC = "history of the printed book"
# terms that make up the lexical stand-in score
TERMS = ["the", "edition", "of", "ther", "and"]
DIMS = ["Language", "Source", "Lead"]


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---- papers ----------------------------------------------------------------


def papers(spark: SparkSession, folder: str) -> DataFrame:
    return as_papers(spread(table(spark, folder, "documents")))


def as_papers(documents: DataFrame) -> DataFrame:
    return documents.select(
        (F.col("doc_id") + 1).alias("paper_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("abstract"),
        F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("keywords"),
        F.col("lang").alias("Author Keywords"),
        "lang",
        "source",
        "n_chars",
    )


PAPERS = """papers AS (
  SELECT doc_id + 1 AS paper_id, split_part(text, chr(10), 1) AS title, text AS abstract,
         CASE WHEN doc_id % 7 <> 0 THEN source END AS keywords, lang AS author_keywords,
         lang, source, n_chars FROM documents)"""

BLANKS = "' ' || chr(9) || chr(10) || chr(13)"


def text_column(df: DataFrame) -> Column:
    return paper_text(F.col("title"), F.col("abstract"), keyword_fallback(F.col("keywords"), df.columns))


TEXT = f"""('Title: ' || trim(title, {BLANKS}) || chr(10) || 'Abstract: ' || trim(abstract, {BLANKS})
 || chr(10) || 'Keywords: ' || coalesce(nullif(trim(keywords, {BLANKS}), ''), author_keywords))"""


# ---- scoring stand-in --------------------------------------------------------


def met_terms() -> Column:
    """Terms met as whole lower-case words, in alphabetical order."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("abstract"), F.lit("[a-z]+"), F.lit(0)))
    return F.array_sort(F.array_intersect(words, F.array(*[F.lit(t) for t in TERMS])))


MET = "list_sort(list_intersect(list_distinct(regexp_extract_all(lower(abstract), '[a-z]+')), [{}]))".format(
    ", ".join(sql_text(t) for t in TERMS)
)


def score_responder() -> Column:
    """Terms of the topic met in the abstract; the reason holds the prompt's hash."""

    def answer(met: Column) -> Column:
        return F.to_json(
            F.struct(
                F.least(F.lit(5), F.size(met) + 1).alias("score"),
                F.concat(F.lit("prompt "), F.md5("prompt")).alias("reason"),
                met.alias("keywords"),
            )
        )

    # a list of one binds the terms to a name, so that they are looked for once
    return F.get(F.transform(F.array(met_terms()), answer), F.lit(0))


SCORE = f"least(5, 1 + len({MET}))"


def odd_score_responder() -> Column:
    """Failures and unusual values, picked by the paper id."""
    i = F.col("paper_id")
    return (
        F.when(i % 17 == 0, F.lit(None).cast("string"))
        .when(i % 19 == 0, F.lit("no score today"))
        .when(i % 23 == 0, F.lit("{}"))
        .when(i % 29 == 0, F.lit('{"score": null, "reason": "unsure"}'))
        .when(i % 31 == 0, F.concat(F.lit('{"score": "'), (i % 5).cast("string"), F.lit('", "keywords": "one; two"}')))
        .when(i % 37 == 0, F.lit('{"score": 4.5, "keywords": ["a", "b"]}'))
        .when(i % 41 == 0, F.lit('{"score": 7}'))
        .when(i % 43 == 0, F.lit('[{"score": 5}]'))
        .otherwise(score_responder())
    )


# ---- labels ------------------------------------------------------------------


def lead(text: str) -> Column:
    return F.lower(F.regexp_extract(text, "^\\S+", 0))


def explore_responder() -> Column:
    """One label per dimension with missing, null and non-object values among them."""
    i = F.col("paper_id")
    odd = F.when(i % 13 != 0, F.col("source"))
    answer = F.to_json(
        F.struct(
            F.struct(F.col("lang").alias("category"), F.col("title").alias("reason")).alias("Language"),
            # a missing category every 13th paper
            F.struct(odd.alias("category"), F.md5("prompt").alias("reason")).alias("Source"),
            F.struct(lead("abstract").alias("category"), F.lit("first word").alias("reason")).alias("Lead"),
            F.lit("not a label").alias("Note"),
        )
    )
    return (
        F.when(i % 17 == 0, F.lit(None).cast("string"))
        .when(i % 19 == 0, F.lit("{broken"))
        .when(i % 23 == 0, F.lit('{"Language": {"category": null, "reason": "none"}, "Lead": "text"}'))
        .otherwise(answer)
    )


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """Draft labels of all papers along three dimensions."""
    values = F.array(
        F.struct(F.lit("Language").alias("dim"), F.col("lang").alias("category")),
        F.struct(F.lit("Source").alias("dim"), F.col("source").alias("category")),
        F.struct(F.lit("Lead").alias("dim"), lead("text").alias("category")),
    )
    return (
        table(spark, folder, "documents")
        .select((F.col("doc_id") + 1).alias("paper_id"), F.col("n_chars"), F.explode(values).alias("v"))
        .select(
            "v.dim",
            F.col("paper_id").alias("pos"),
            "paper_id",
            "v.category",
            F.concat(F.lit("length "), F.col("n_chars").cast("string")).alias("reason"),
        )
    )


LABELS = """labelled AS (
  SELECT dim, doc_id + 1 AS pos, doc_id + 1 AS paper_id, category, 'length ' || n_chars AS reason FROM (
    SELECT doc_id, n_chars, 'Language' AS dim, lang AS category FROM documents UNION ALL
    SELECT doc_id, n_chars, 'Source', source FROM documents UNION ALL
    SELECT doc_id, n_chars, 'Lead', lower(regexp_extract(text, '^\\S+')) FROM documents))"""

COUNTS = """counts AS (SELECT dim, category, count(*) AS n, min(pos) AS first_pos FROM labelled GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY n DESC, first_pos, category) AS rank FROM counts),
chunked AS (SELECT *, (rank - 1) // 30 AS round FROM ranked)"""


def first_letter_mapping(counts: DataFrame) -> DataFrame:
    """A one-step mapping: labels go to their first letter; one-letter labels stay unmapped."""
    return counts.where(F.length("category") > 1).select(
        "dim",
        F.col("category").alias("label"),
        F.concat(F.substring("category", 1, 1), F.lit("*")).alias("final"),
    )


MAPPING = """mapping AS (SELECT dim, category AS label, substr(category, 1, 1) || '*' AS final
  FROM counts WHERE length(category) > 1)"""


def letter_taxonomy(mapping: DataFrame) -> DataFrame:
    """Categories of first_letter_mapping in alphabetical order, numbered per dimension."""
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("dim").orderBy("name")).cast("long") - 1
    return (
        mapping.groupBy("dim", F.col("final").alias("name"))
        .agg(F.count("*").alias("size"))
        .select(
            "dim",
            F.lit("Default").alias("grp"),
            pos.alias("pos"),
            "name",
            F.concat(F.col("size").cast("string"), F.lit(" labels")).alias("definition"),
            F.lit("same first letter").alias("judgment_suggestions"),
            F.array(F.col("name"), F.lit("initial")).alias("keywords"),
            F.lit(None).cast("array<string>").alias("typical_cases"),
        )
    )


TAXONOMY = """taxonomy AS (SELECT dim, 'Default' AS grp, row_number() OVER (PARTITION BY dim ORDER BY name) - 1 AS pos,
  name, size || ' labels' AS definition, 'same first letter' AS judgment_suggestions
  FROM (SELECT dim, final AS name, count(*) AS size FROM mapping GROUP BY 1, 2))"""

FLAT = f"{LABELS}, {COUNTS}, {MAPPING}, {TAXONOMY}"


def merge_responder(chunk: dict[str, Column]) -> Column:
    """Round r files labels and earlier categories under their first letter, marked with r.

    Every fourth round from the third on fails.
    """
    r = chunk["round"].cast("string")

    def renamed(name: Column) -> Column:
        return F.concat(F.substring(name, 1, 1), F.lit("#"), r)

    asked = F.array_distinct(F.concat(chunk["labels"], F.transform(chunk["categories"], lambda c: c["name"])))
    categories = F.transform(
        F.array_sort(F.array_distinct(F.transform(asked, renamed))),
        lambda name: F.struct(
            name.alias("name"), F.concat(F.lit("round "), r).alias("definition"), F.array(name).alias("keywords")
        ),
    )
    mapping = F.map_from_entries(F.transform(asked, lambda x: F.struct(x, renamed(x))))
    answer = F.to_json(F.struct(categories.alias("refined_categories"), mapping.alias("mapping")))
    return F.when(chunk["round"] % 4 != 2, answer)


# ---- classification stand-in -------------------------------------------------


def class_responder(mode: str) -> Column:
    """The source, or source and language; wrong shapes and failures by paper id."""
    i = F.col("paper_id")
    one, many = F.col("source"), F.array("source", "lang")
    keywords = F.array("lang", F.col("n_chars").cast("string"))

    def said(category: Column) -> Column:
        return F.to_json(F.struct(category.alias("category"), F.md5("prompt").alias("reason"), keywords.alias("keywords")))

    usual, unusual = (said(one), said(many)) if mode == "single" else (said(many), said(one))
    return (
        F.when(i % 17 == 0, F.lit(None).cast("string"))
        .when(i % 19 == 0, F.lit("not json"))
        .when(i % 23 == 0, F.lit('{"category": [], "reason": null, "keywords": "plain"}'))
        .when(i % 5 == 0, unusual)
        .otherwise(usual)
    )
