"""Translation queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.checks import views as v
from corpusloom.functions import prompts
from corpusloom.operators.scratch import new_path, settle
from corpusloom.plans import flows, translate as t
from corpusloom.sources import documents, exports, sinks
from corpusloom.sources.leaves import json_from_leaves, json_leaves

COLUMNS = "title, abstract, lang, missing"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return t.distinct_texts(v.papers(spark, d), COLUMNS)


def _digest(name: str) -> Column:
    return F.md5(name).alias("digest")


def distinct_texts(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("col", _digest("text"), "first_id", "n")


def distinct_by_digest(spark: SparkSession, d: str) -> DataFrame:
    return t.distinct_by_digest(v.papers(spark, d), COLUMNS).select("col", _digest("text"), "first_id", "n")


def batch_size(spark: SparkSession, d: str) -> DataFrame:
    return t.batch_size(_texts(spark, d))


def batch_size_tables(spark: SparkSession, d: str) -> DataFrame:
    """Batch sizes for the other text tables: turns of conversations, pages, benchmark items."""
    turns = v.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("paper_id"), "role", F.col("text").alias("turn_text"))
    pages = v.table(spark, d, "pages").select(F.col("page_id").alias("paper_id"), "url", "html")
    items = v.table(spark, d, "benchmark").select(F.col("item_id").alias("paper_id"), F.col("text").alias("item_text"))
    found = [t.distinct_texts(df, c) for df, c in ((turns, "role,turn_text"), (pages, "url,html"), (items, "item_text"))]
    return t.batch_size(found[0].unionByName(found[1]).unionByName(found[2]))


def translate_batches(spark: SparkSession, d: str) -> DataFrame:
    texts = settle(_texts(spark, d), "texts", by="col")
    return t.translate_batches(texts, t.batch_size(texts)).select(
        "col", "batch", "batch_size", F.size("texts").cast("long").alias("texts"), F.md5(F.array_join("texts", "|")).alias("digest")
    )


def _responder() -> Column:
    """A mark before the text; the third batch of a column fails, lists lose their first text."""

    def said(x: Column) -> Column:
        return F.concat(F.lit("[en] "), x)

    listed = F.map_from_entries(F.transform(F.slice("texts", F.lit(2), F.size("texts")), lambda x: F.struct(x, said(x))))
    return F.when(
        F.col("batch") != 2,
        F.when(F.col("batch_size") == 1, said(F.get("texts", F.lit(0)))).otherwise(F.to_json(listed)),
    )


def translate_map(spark: SparkSession, d: str) -> DataFrame:
    texts = settle(_texts(spark, d), "texts", by="col")
    batches = t.translate_batches(texts, t.batch_size(texts))
    return t.translate_map(batches, _responder()).select("col", "key", _digest("translated"))


def translate_prompts(spark: SparkSession, d: str) -> DataFrame:
    texts = settle(t.distinct_texts(v.papers(spark, d), "abstract,source"), "texts", by="col")
    batches = t.translate_batches(texts, t.batch_size(texts))
    prompt = t.batch_prompt("French")
    return batches.select("col", "batch", F.length(prompt).cast("long").alias("chars"), F.md5(prompt).alias("digest"))


def translate_apply(spark: SparkSession, d: str) -> DataFrame:
    done = t.translate_columns(v.papers(spark, d), COLUMNS, _responder())
    return done.select("paper_id", "title", F.md5("abstract").alias("abstract"), "lang", "source")


def translate_apply_spread(spark: SparkSession, d: str) -> DataFrame:
    """The same with every text met 20 times or more spread over several tasks."""
    p = v.papers(spark, d)
    texts = settle(_texts(spark, d), "texts", by="col")
    said = settle(t.translate_map(t.translate_batches(texts, t.batch_size(texts)), _responder()), "translations")
    done = t.translate_apply(p, COLUMNS, said, texts, hot_rows=20)
    return done.select("paper_id", "title", F.md5("abstract").alias("abstract"), "lang", "source")


def translated_csv(spark: SparkSession, d: str) -> DataFrame:
    """Translated conversations written as CSV and read back."""
    turns = v.table(spark, d, "conversations").withColumn("paper_id", F.col("conv_id") * 1000 + F.col("turn"))
    said = F.when(
        F.col("batch_size") == 1, F.concat(F.lit("[en] "), F.get("texts", F.lit(0)))
    ).otherwise(F.to_json(F.map_from_entries(F.transform("texts", lambda x: F.struct(x, F.concat(F.lit("[en] "), x))))))
    path = new_path(spark, "translated")
    sinks.write_csv(t.translate_columns(turns, "role,text", said).drop("paper_id"), path)
    return exports.read_table(spark, f"{path}/*.csv").select("conv_id", "turn", "role", F.md5("text").alias("digest"))


def _leaf_responder() -> Column:
    return F.when(~F.col("value").startswith("h"), F.concat(F.lit("fr:"), "value"))


def translate_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    taxonomy = v.letter_taxonomy(v.first_letter_mapping(_counts(spark, d)))
    done = t.translate_taxonomy(taxonomy, _leaf_responder())
    return done.select("dim", "grp", "pos", "name", "definition", "judgment_suggestions", F.array_join("keywords", "; ").alias("keywords"))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.plans.converge import label_counts

    return settle(label_counts(v.labels(spark, d)), "label_counts")


def translate_draft(spark: SparkSession, d: str) -> DataFrame:
    return t.translate_draft(v.labels(spark, d), _leaf_responder()).select("dim", "paper_id", "category", "reason")


def translate_draft_file(spark: SparkSession, d: str) -> DataFrame:
    """A draft file through the translate flow, which tells it from a taxonomy by its shape."""
    path = new_path(spark, "draft")
    documents.write_draft(v.labels(spark, d), f"{path}/draft.json")
    flows.translate_file(spark, f"{path}/draft.json", f"{path}/out", _leaf_responder())
    return documents.read_draft(spark, f"{path}/out").select("dim", "paper_id", "category", "reason")


# ---- JSON of any shape ---------------------------------------------------------


def _json(spark: SparkSession, d: str) -> DataFrame:
    """A nested JSON document for every given document: texts, numbers, truth values, nulls, empty lists and objects."""
    nothing = F.lit(None).cast("string")
    body = F.struct(
        F.col("text"),
        F.array("lang", "source", nothing).alias("tags"),
        F.array(F.struct(F.col("n_chars").alias("size"), F.array().cast("array<string>").alias("none"))).alias("parts"),
        F.create_map().cast("map<string,string>").alias("free"),
    )
    whole = F.struct("doc_id", (F.col("n_chars") > 1000).alias("long"), body.alias("body"), nothing.alias("alpha"))
    return v.table(spark, d, "documents").select("doc_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("document"))


def _leaves(documents_: DataFrame) -> DataFrame:
    found = json_leaves(documents_, ["doc_id"])
    return found.select("doc_id", "at", "path", "kind", F.when(F.col("kind") == "text", F.md5("value")).otherwise(F.col("value")).alias("value"))


def json_table(spark: SparkSession, d: str) -> DataFrame:
    """The leaves of JSON documents, which are rebuilt from the table and taken apart again."""
    table = settle(json_leaves(_json(spark, d), ["doc_id"]), "leaves")
    return _leaves(json_from_leaves(table, ["doc_id"]))


def translate_json(spark: SparkSession, d: str) -> DataFrame:
    """All texts of nested documents translated; everything else stays as it is."""
    return _leaves(t.translate_json(_json(spark, d), ["doc_id"], _leaf_responder()))


QUERIES = {
    f.__name__: f
    for f in (
        distinct_texts, distinct_by_digest, batch_size, batch_size_tables, translate_batches, translate_prompts, translate_map,
        translate_apply, translate_apply_spread, translated_csv, translate_taxonomy, translate_draft, translate_draft_file,
        json_table, translate_json,
    )
}

TEXTS = f"""{v.PAPERS}, cells AS (
  SELECT 'title' AS col, title AS text, paper_id FROM papers WHERE title IS NOT NULL
  UNION ALL SELECT 'abstract', abstract, paper_id FROM papers UNION ALL SELECT 'lang', lang, paper_id FROM papers),
texts AS (SELECT col, text, min(paper_id) AS first_id, count(*) AS n FROM cells GROUP BY 1, 2)"""

SIZES = """placed AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY first_id, text) AS pos FROM texts),
means AS (SELECT col, sum(length(text))::DOUBLE / 10 AS mean_length FROM placed WHERE pos <= 10 GROUP BY col),
sizes AS (SELECT col, mean_length, CASE WHEN mean_length > 500 THEN 1 WHEN mean_length > 100 THEN 5 ELSE 20 END::BIGINT AS batch_size
  FROM means)"""

BATCHES = f"""WITH {TEXTS}, {SIZES}, packed AS (
  SELECT col, text, pos, batch_size, CASE batch_size WHEN 1 THEN first_id ELSE (pos - 1) // batch_size END AS batch,
    (pos - 1) % batch_size AS slot FROM placed JOIN sizes USING (col))"""

SAID = f"""{BATCHES}, said AS (SELECT col, text, '[en] ' || text AS translated FROM packed
  WHERE batch <> 2 AND (batch_size = 1 OR slot > 0))"""

APPLIED = f"""{SAID} SELECT p.paper_id, coalesce(a.translated, p.title) AS title, md5(coalesce(b.translated, p.abstract)) AS abstract,
  coalesce(c.translated, p.lang) AS lang, p.source FROM papers p
  LEFT JOIN said a ON a.col = 'title' AND a.text = p.title LEFT JOIN said b ON b.col = 'abstract' AND b.text = p.abstract
  LEFT JOIN said c ON c.col = 'lang' AND c.text = p.lang"""

_LEAF = "CASE WHEN length({0}) > 1 AND {0} NOT LIKE 'h%' THEN 'fr:' || {0} ELSE {0} END"

_P = f"WITH {v.PAPERS}, cells AS (SELECT 'abstract' AS col, abstract AS text, paper_id FROM papers UNION ALL SELECT 'source', source, paper_id FROM papers), texts AS (SELECT col, text, min(paper_id) AS first_id FROM cells GROUP BY 1, 2), {SIZES}"



def _json_leaves(text: str) -> str:
    """DuckDB's own walk over the same documents, ``text`` being what a text has become."""
    return f"""WITH j AS (SELECT doc_id, to_json({{'doc_id': doc_id, 'long': n_chars > 1000, 'body': {{'text': {text.format('text')},
        'tags': [{text.format('lang')}, {text.format('source')}, NULL], 'parts': [{{'size': n_chars, 'none': []}}], 'free': MAP {{}}}}, 'alpha': NULL}}) AS j
      FROM documents),
    w AS (SELECT doc_id, t.fullkey, t.type, t.value, t.id FROM j, json_tree(j.j) t
      WHERE t.type NOT IN ('OBJECT', 'ARRAY') OR t.value::VARCHAR IN ('{{}}', '[]'))
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY id) - 1)::INTEGER AS at, fullkey AS path,
      CASE type WHEN 'VARCHAR' THEN 'text' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'BOOLEAN' THEN 'boolean'
        WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind,
      CASE WHEN type = 'VARCHAR' THEN md5(value->>'$') WHEN type IN ('OBJECT', 'ARRAY') THEN '' ELSE value::VARCHAR END AS value FROM w"""


ORACLES = {
    "json_table": _json_leaves("{0}"),
    "translate_json": _json_leaves("(" + _LEAF + ")"),
    "distinct_texts": f"WITH {TEXTS} SELECT col, md5(text) AS digest, first_id, n FROM texts",
    "distinct_by_digest": f"WITH {TEXTS} SELECT col, md5(text) AS digest, first_id, n FROM texts",
    "batch_size": f"WITH {TEXTS}, {SIZES} SELECT * FROM sizes",
    "batch_size_tables": f"""WITH cells AS (
        SELECT 'role' AS col, role AS text, conv_id * 1000 + turn AS id FROM conversations
        UNION ALL SELECT 'turn_text', text, conv_id * 1000 + turn FROM conversations
        UNION ALL SELECT 'url', url, page_id FROM pages UNION ALL SELECT 'html', html, page_id FROM pages
        UNION ALL SELECT 'item_text', text, item_id FROM benchmark),
      texts AS (SELECT col, text, min(id) AS first_id FROM cells GROUP BY 1, 2), {SIZES} SELECT * FROM sizes""",
    "translate_batches": f"""{BATCHES} SELECT col, batch, batch_size, count(*) AS texts,
      md5(string_agg(text, '|' ORDER BY pos)) AS digest FROM packed GROUP BY 1, 2, 3""",
    "translate_prompts": f"""{_P}, packed AS (SELECT col, text, pos, batch_size,
          CASE batch_size WHEN 1 THEN first_id ELSE (pos - 1) // batch_size END AS batch FROM placed JOIN sizes USING (col)),
      listed AS (SELECT col, batch, batch_size, min(text) AS one, '["' || string_agg(text, '","' ORDER BY pos) || '"]' AS many
        FROM packed GROUP BY 1, 2, 3),
      asked AS (SELECT col, batch, CASE batch_size WHEN 1
        THEN replace({v.sql_text(prompts.TRANSLATE_TEXT.replace("{{target_lang}}", "French"))}, '{{{{text}}}}', one)
        ELSE replace({v.sql_text(prompts.TRANSLATE_LIST.replace("{{target_lang}}", "French"))}, '{{{{texts}}}}', many) END AS prompt FROM listed)
      SELECT col, batch, length(prompt) AS chars, md5(prompt) AS digest FROM asked""",
    "translate_map": f"{SAID} SELECT col, sha256(text) AS key, md5(translated) AS digest FROM said",
    "translate_apply": APPLIED,
    "translate_apply_spread": APPLIED,
    "translated_csv": """SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, '[en] ' || role AS role,
      md5('[en] ' || text) AS digest FROM conversations""",
    "translate_taxonomy": f"""WITH {v.FLAT} SELECT dim, grp, pos, {_LEAF.format('name')} AS name, {_LEAF.format('definition')} AS definition,
      'fr:same first letter' AS judgment_suggestions, {_LEAF.format('name')} || '; fr:initial' AS keywords FROM taxonomy""",
    "translate_draft_file": f"WITH {v.LABELS} SELECT dim, paper_id, {_LEAF.format('category')} AS category, {_LEAF.format('reason')} AS reason FROM labelled",
    "translate_draft": f"WITH {v.LABELS} SELECT dim, paper_id, {_LEAF.format('category')} AS category, {_LEAF.format('reason')} AS reason FROM labelled",
}
