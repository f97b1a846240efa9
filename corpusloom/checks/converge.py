"""Explore and converge queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.checks import views as v
from corpusloom.functions import prompts
from corpusloom.operators import ranges
from corpusloom.operators.scratch import new_path, settle
from corpusloom.plans import converge as c
from corpusloom.plans import explore as x
from corpusloom.plans import flows, quality
from corpusloom.sources import documents, exports, sinks, versions
from corpusloom.streaming import drafts

# ---- explore ---------------------------------------------------------------


def _responses(spark: SparkSession, d: str, max_papers: int | None = None) -> DataFrame:
    p = v.papers(spark, d)
    return x.ask_labels(p, v.text_column(p), v.explore_responder(), dims="Language,Source,Lead", max_papers=max_papers)


def _explored(spark: SparkSession, d: str) -> DataFrame:
    return x.labels_of(_responses(spark, d))


EXPLORE_PROMPT = "replace({}, '{{{{paper_text}}}}', {})".format(
    v.sql_text(
        prompts.EXPLORE.replace("{{dimensions_desc}}", prompts.dimensions_text(v.DIMS))
        .replace("{{researcher_guide}}", prompts.NO_GUIDE)
        .replace("{{output_lang}}", "English")
    ),
    v.TEXT,
)

EXPLORED = f"""{v.PAPERS}, answered AS (
  SELECT *, paper_id % 23 = 0 AS partial FROM papers WHERE paper_id % 17 <> 0 AND paper_id % 19 <> 0),
explored AS (
  SELECT 'Language' AS dim, paper_id AS pos, paper_id, CASE WHEN partial THEN '' ELSE lang END AS category,
    CASE WHEN partial THEN 'none' ELSE title END AS reason FROM answered
  UNION ALL SELECT 'Source', paper_id, paper_id, CASE WHEN paper_id % 13 <> 0 THEN source ELSE '' END,
    md5({EXPLORE_PROMPT}) FROM answered WHERE NOT partial
  UNION ALL SELECT 'Lead', paper_id, paper_id, lower(regexp_extract(abstract, '^\\S+')), 'first word'
    FROM answered WHERE NOT partial)"""


def explore_labels(spark: SparkSession, d: str) -> DataFrame:
    return _explored(spark, d)


def explore_dims(spark: SparkSession, d: str) -> DataFrame:
    return x.dims_of(_responses(spark, d))


def max_papers(spark: SparkSession, d: str) -> DataFrame:
    return x.labels_of(_responses(spark, d, max_papers=150))


def draft_export(spark: SparkSession, d: str) -> DataFrame:
    docs = documents.draft_documents(v.labels(spark, d), block=100)
    return docs.select("dim", "block", F.length("document").cast("long").alias("chars"), F.md5("document").alias("digest"))


def draft_scan(spark: SparkSession, d: str) -> DataFrame:
    """Draft written as JSON lines and read back: the same labels."""
    path = new_path(spark, "draft")
    documents.write_draft(_explored(spark, d), path)
    return documents.read_draft(spark, path).select("dim", "pos", "paper_id", "category", "reason")


def explore_stream(spark: SparkSession, d: str) -> DataFrame:
    """Documents that arrive in two parts: the second run continues the ids and the draft of the first."""
    path = new_path(spark, "stream")
    docs = v.table(spark, d, "documents")
    half = docs.agg(F.expr("(min(doc_id) + max(doc_id)) div 2")).head()[0]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)

    def label(papers: DataFrame) -> DataFrame:
        p = v.as_papers(papers.withColumn("doc_id", F.col("paper_id") - 1))
        return x.labels_of(x.ask_labels(p, v.text_column(p), v.explore_responder(), dims="Language,Source,Lead"))

    for part in (docs.where(F.col("doc_id") <= half), docs.where(F.col("doc_id") > half)):
        part.write.mode("append").parquet(f"{path}/in")
        found = drafts.explore_stream(spark, f"{path}/in", schema, f"{path}/out", label, ["doc_id"])
    return found.select("dim", "pos", "paper_id", "category", "reason")


# ---- converge, without rounds -------------------------------------------------


def _flat(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """labels, their counts (written), mapping and taxonomy."""
    labels = v.labels(spark, d)
    counts = settle(c.label_counts(labels), "label_counts")
    mapping = v.first_letter_mapping(counts)
    return labels, counts, mapping, v.letter_taxonomy(mapping)


#: Buckets of the papers in ``label_merge_buckets``.
PAPER_BUCKETS = 16
#: Positions of a dimension that one file of ``draft_file`` holds.
FILE_BLOCK = 1000


def draft_file(spark: SparkSession, d: str) -> DataFrame:
    """Draft as one indented JSON object per file, a file for each dimension and block, read back."""
    path = new_path(spark, "draft")
    whole = documents.draft_documents(_explored(spark, d), FILE_BLOCK, indented=True)
    whole.select("dim", "block", F.col("document").alias("value")).write.partitionBy("dim", "block").text(path)
    return documents.read_draft(spark, path).select("dim", "pos", "paper_id", "category", "reason")


#: Bytes of a split in ``draft_splits``, far below the size of its files.
SPLIT = 32 << 10


def draft_splits(spark: SparkSession, d: str) -> DataFrame:
    """Draft files that hold all dimensions, on one line or indented, read in splits of SPLIT bytes.

    Every label has a further field with brackets, quotes and objects in it.
    """
    path = new_path(spark, "draft")
    more = F.struct(F.concat(F.lit('}]"'), F.col("reason")).alias("}"), F.array(F.struct(F.col("category").alias("x"))).alias("list"))
    item = F.struct("paper_id", more.alias("more"), "category", "reason")
    block = F.call_function("div", F.col("pos"), F.lit(FILE_BLOCK))
    listed = _explored(spark, d).groupBy(block.alias("block"), "dim").agg(F.sort_array(F.collect_list(item)).alias("items"))
    whole = listed.groupBy("block").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("dim", "items")))).alias("m"))
    text = F.when(F.col("block") % 2 == 0, F.to_json("m")).otherwise(F.to_json("m", {"pretty": "true"}))
    whole.select("block", text.alias("value")).write.partitionBy("block").text(path)
    with ranges.splits_of(spark, SPLIT):
        items = documents.draft_ranges(spark, path)
    return documents.item_labels(items).select("dim", "pos", "paper_id", "category", "reason")


def converge_flow(spark: SparkSession, d: str) -> DataFrame:
    """From a draft that labels every paper twice to labelled papers, in two runs over one export.

    The model fails throughout, so the last raw label of a paper is its final one.
    """
    path = new_path(spark, "flow")
    early = F.struct("paper_id", F.concat(F.lit("zz "), "category").alias("category"), F.lit("first").alias("reason"))
    late = F.struct("paper_id", "category", "reason")
    lines = v.labels(spark, d).select(F.to_json(F.create_map("dim", F.array(early, late))).alias("value"))
    lines.write.text(f"{path}/draft")
    papers = v.papers(spark, d).select("paper_id", F.col("title").alias("paper_title"))
    nothing = F.lit(None).cast("string")
    for dims in ("Source", "Lead"):
        flows.converge(
            spark, f"{path}/draft", f"{path}/taxonomy.json", nothing, dims=dims, papers=papers, output_papers=f"{path}/labelled.csv"
        )
    out = flows.labelled_export(spark, f"{path}/labelled.csv")
    return out.select("paper_id", *[n for dim in ("Source", "Lead") for n in c.label_columns(dim)])


def select_dims(spark: SparkSession, d: str) -> DataFrame:
    chosen = c.select_dims(v.labels(spark, d), "Lead, Unknown ,Source")
    return chosen.groupBy("dim").agg(F.count("*").alias("n"))


def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return c.label_counts(v.labels(spark, d))


def label_rank(spark: SparkSession, d: str) -> DataFrame:
    return c.label_rank(c.label_counts(v.labels(spark, d)))


def label_chunks(spark: SparkSession, d: str) -> DataFrame:
    return c.label_chunks(label_rank(spark, d)).select("dim", "category", "rank", "round")


def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    return c.chunk_text(c.label_chunks(label_rank(spark, d))).select(
        "dim", "round", F.size("labels").cast("long").alias("labels"), "new_labels"
    )


def cap_categories(spark: SparkSession, d: str) -> DataFrame:
    return c.cap_categories(_flat(spark, d)[3], 5).select("dim", "pos", "name")


def title_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Titles of the labelled papers; a draft may name papers that are not there."""
    labels = v.labels(spark, d).withColumn("paper_id", F.col("paper_id") + 100)
    return c.title_backfill(labels, v.papers(spark, d), F.col("title")).select("dim", "paper_id", "title")


def category_members(spark: SparkSession, d: str) -> DataFrame:
    _, counts, mapping, taxonomy = _flat(spark, d)
    return c.category_members(counts, mapping, taxonomy)


def typical_cases(spark: SparkSession, d: str) -> DataFrame:
    labels, _, mapping, taxonomy = _flat(spark, d)
    return c.typical_cases(labels, mapping, taxonomy, v.papers(spark, d), F.col("title"))


def taxonomy_with_cases(spark: SparkSession, d: str) -> DataFrame:
    labels, _, mapping, taxonomy = _flat(spark, d)
    cases = c.typical_cases(labels, mapping, taxonomy, v.papers(spark, d), F.col("title"), k=3)
    return c.with_cases(taxonomy, cases).select(
        "dim", "grp", "pos", "name", F.array_join("keywords", "; ").alias("keywords"), F.array_join("typical_cases", "\n").alias("cases")
    )


def final_labels(spark: SparkSession, d: str) -> DataFrame:
    labels, counts, mapping, _ = _flat(spark, d)
    return c.final_labels(labels, mapping, counts).select("dim", "paper_id", "category", "final", "reason")


def final_labels_spread(spark: SparkSession, d: str) -> DataFrame:
    """The same with every label of 100 papers or more spread over several tasks."""
    labels, counts, mapping, _ = _flat(spark, d)
    return c.final_labels(labels, mapping, counts, hot_rows=100).select("dim", "paper_id", "category", "final", "reason")


def orphan_labels(spark: SparkSession, d: str) -> DataFrame:
    labels, _, mapping, taxonomy = _flat(spark, d)
    return c.orphan_labels(c.final_labels(labels, mapping), c.cap_categories(taxonomy, 3))


def label_pivot(spark: SparkSession, d: str) -> DataFrame:
    labels, _, mapping, _ = _flat(spark, d)
    return c.label_pivot(c.final_labels(labels, mapping), v.DIMS)


def label_papers(spark: SparkSession, d: str) -> DataFrame:
    _, _, mapping, _ = _flat(spark, d)
    wide = c.label_pivot(c.final_labels(_explored(spark, d), mapping), ["Source"])
    return c.label_papers(v.papers(spark, d).select("paper_id", "title"), wide)


def label_papers_bucketed(spark: SparkSession, d: str) -> DataFrame:
    """The same against papers kept in buckets by id: only the labels are shuffled."""
    _, _, mapping, _ = _flat(spark, d)
    wide = c.label_pivot(c.final_labels(_explored(spark, d), mapping), ["Source"])
    path = new_path(spark, "bucketed")
    rows = v.papers(spark, d).select("paper_id", "title")
    name = "papers_" + path[-32:]
    papers = sinks.bucket_papers(rows, name, path, buckets=8)
    labelled = settle(c.label_papers(papers, wide), "labelled")
    spark.sql(f"DROP TABLE {name}")
    return labelled


def label_merge(spark: SparkSession, d: str) -> DataFrame:
    """Papers of an earlier run (the graded documents) get new labels; failed papers keep theirs."""
    base, wide = _graded(spark, d)
    return c.label_merge(base, wide, ["Source", "Lead"])


def _graded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Papers of an earlier run (the graded documents), and new labels of two dimensions."""
    _, _, mapping, _ = _flat(spark, d)
    wide = c.label_pivot(c.final_labels(_explored(spark, d), mapping), ["Source", "Lead"])
    graded = v.table(spark, d, "labels").select(
        (F.col("doc_id") + 1).alias("paper_id"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("Source_category")
    )
    return v.papers(spark, d).select("paper_id").join(graded, "paper_id", "left"), wide


def label_merge_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The same merge into papers kept in buckets, in two steps that each write the buckets they change."""
    base, wide = _graded(spark, d)
    path = new_path(spark, "papers")
    versions.put_buckets(base, path, "paper_id", PAPER_BUCKETS)
    low = versions.bucket_of(F.col("paper_id"), PAPER_BUCKETS) < PAPER_BUCKETS // 2
    for part in (wide.where(low), wide.where(~low)):
        versions.update_buckets(
            spark, path, "paper_id", PAPER_BUCKETS, part, lambda rows, new: c.label_merge(rows, new, ["Source", "Lead"])
        )
    names = [n for dim in ("Source", "Lead") for n in c.label_columns(dim)]
    return versions.read_buckets(spark, path).select("paper_id", *names)


def snapshot_swap(spark: SparkSession, d: str) -> DataFrame:
    """A taxonomy kept in versions: two runs replace dimensions, the second reading what the first left."""
    path = new_path(spark, "taxonomy")
    old = settle(_flat(spark, d)[3], "taxonomy")
    versions.put(old, path)
    for dim in ("Lead", "Source"):
        new = old.where(F.col("dim") == dim).withColumn("definition", F.lit("new"))
        versions.put(c.taxonomy_upsert(versions.read(spark, path), new), path)
    return versions.read(spark, path).select("dim", "pos", "name", "definition")


def labelled_csv(spark: SparkSession, d: str) -> DataFrame:
    """Labelled papers written as CSV, read back as the base of a second run with another dimension."""
    _, _, mapping, _ = _flat(spark, d)
    final = c.final_labels(_explored(spark, d), mapping)
    path = new_path(spark, "labelled")
    first = c.label_papers(v.papers(spark, d).select("paper_id"), c.label_pivot(final, ["Source"]))
    sinks.write_csv(first, path)
    base = exports.read_table(spark, f"{path}/*.csv").withColumn("paper_id", F.col("paper_id").cast("long"))
    return c.label_merge(base, c.label_pivot(final, ["Lead"]), ["Lead"])


def taxonomy_upsert(spark: SparkSession, d: str) -> DataFrame:
    """New categories for two dimensions, one of them without any; the third stays."""
    _, counts, mapping, old = _flat(spark, d)
    new = old.where("dim = 'Lead'").withColumn("definition", F.lit("new"))
    dims = counts.where("dim <> 'Language'").select("dim").distinct()
    return c.taxonomy_upsert(old, new, dims).select("dim", "pos", "name", "definition")


def taxonomy_partitions(spark: SparkSession, d: str) -> DataFrame:
    """The same kept as a table partitioned by dimension: other partitions are not touched."""
    path = new_path(spark, "taxonomy")
    old = settle(_flat(spark, d)[3], "taxonomy")
    sinks.replace_dims(old, path)
    sinks.replace_dims(old.where("dim <> 'Lead'").withColumn("definition", F.lit("new")), path)
    return spark.read.schema(old.schema).parquet(path).select("dim", "pos", "name", "definition")


def taxonomy_scan(spark: SparkSession, d: str) -> DataFrame:
    """Taxonomy as JSON documents, read back."""
    docs = _flat(spark, d)[3].drop("typical_cases").withColumn("typical_cases", F.array("name"))
    back = documents.parse_taxonomies(documents.taxonomy_documents(docs))
    return back.select(
        "dim", "grp", "pos", "name", "definition", F.array_join("keywords", "; ").alias("keywords"), F.array_join("typical_cases", "; ").alias("cases")
    )


def mapping_cascade(spark: SparkSession, d: str) -> DataFrame:
    """One composition: labels that went to their first letter, then letters and some labels move on."""
    _, counts, old, taxonomy = _flat(spark, d)
    moved = taxonomy.where("pos % 2 = 0").select("dim", F.col("name").alias("label"), F.concat("name", F.lit("*")).alias("final"))
    direct = counts.where("n = 1").select("dim", F.col("category").alias("label"), F.lit("rare").alias("final"))
    return c.compose_mapping(old, moved.unionByName(direct))


# ---- converge, round after round ---------------------------------------------


def _rounds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    chunks = settle(c.chunk_text(c.label_chunks(label_rank(spark, d))), "chunks")
    return chunks, c.converge_rounds(chunks, c.Rule(v.merge_responder))


ROUNDS = f"""{v.LABELS}, {v.COUNTS},
good AS (SELECT dim, max(round) AS last FROM chunked WHERE round % 4 <> 2 GROUP BY dim)"""


def converge_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Final label of every raw label after all rounds."""
    return c.mapping_of(_rounds(spark, d)[1]).join(
        label_counts(spark, d).select("dim", F.col("category").alias("label")), ["dim", "label"], "left_semi"
    )


def taxonomy_rows(spark: SparkSession, d: str) -> DataFrame:
    return c.taxonomy_rows(_rounds(spark, d)[1], limit_cats=8).select(
        "dim", "grp", "pos", "name", "definition", F.array_join("keywords", "; ").alias("keywords")
    )


def contract_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Answers that leave the most frequent label of each chunk unmapped."""
    chunks, rounds = _rounds(spark, d)
    first = chunks.select("dim", "round", F.col("labels")[0].alias("first"))
    careless = rounds.join(first, ["dim", "round"]).withColumn("mapping", F.map_filter("mapping", lambda k, _: k != F.col("first")))
    return quality.unmapped_labels(chunks, careless)


def contract_cap(spark: SparkSession, d: str) -> DataFrame:
    return quality.too_many_categories(_flat(spark, d)[3], 10)


def _renamed(taxonomy: DataFrame) -> DataFrame:
    vague = F.when(F.col("pos") % 5 == 0, "Other").when(F.col("pos") % 7 == 0, "综合")
    return taxonomy.withColumn("name", F.coalesce(vague, "name"))


def contract_names(spark: SparkSession, d: str) -> DataFrame:
    return quality.vague_names(_renamed(_flat(spark, d)[3])).select("dim", "pos", "name")


def contract_unique(spark: SparkSession, d: str) -> DataFrame:
    return quality.repeated_names(_renamed(_flat(spark, d)[3]))


QUERIES = {
    f.__name__: f
    for f in (
        explore_labels, explore_dims, explore_stream, max_papers, draft_export, draft_scan, draft_file, draft_splits, converge_flow, select_dims, label_counts, label_rank,
        label_chunks, chunk_text, cap_categories, title_backfill, category_members, typical_cases,
        taxonomy_with_cases, final_labels, final_labels_spread, orphan_labels, label_pivot, label_papers, label_papers_bucketed,
        label_merge, label_merge_buckets, snapshot_swap, labelled_csv, taxonomy_upsert, taxonomy_partitions, taxonomy_scan, mapping_cascade, converge_rounds,
        taxonomy_rows, contract_mapping, contract_cap, contract_names, contract_unique,
    )
}

_FINAL = """finals AS (SELECT l.dim, l.pos, l.paper_id, l.category, l.reason, coalesce(m.final, l.category) AS final
  FROM {} l LEFT JOIN mapping m ON m.dim = l.dim AND m.label = l.category)"""
FINALS = f"WITH {v.FLAT}, {_FINAL.format('labelled')}"
EXPLORED_FINALS = f"WITH {v.FLAT}, {EXPLORED}, {_FINAL.format('explored')}"

CASES = f"""WITH {v.FLAT}, {v.PAPERS}, hits AS (
  SELECT t.dim, t.pos, t.name, l.paper_id, l.reason,
    row_number() OVER (PARTITION BY t.dim, t.pos ORDER BY l.pos) AS rank
  FROM labelled l JOIN mapping m ON m.dim = l.dim AND m.label = l.category
    JOIN taxonomy t ON t.dim = m.dim AND t.name = m.final),
cases AS (SELECT dim, pos, name, rank, '《' || trim(title, {v.BLANKS}) || '》: ' || reason AS "case"
  FROM hits JOIN papers USING (paper_id))"""

RENAMED = f"""WITH {v.FLAT}, renamed AS (SELECT dim, pos, CASE WHEN pos % 5 = 0 THEN 'Other'
  WHEN pos % 7 = 0 THEN '综合' ELSE name END AS name FROM taxonomy)"""


def _pivot(dims: list[str]) -> str:
    parts = []
    for dim in dims:
        for suffix, col in (("raw_category", "category"), ("category", "final"), ("reason", "reason")):
            parts.append(f"max({col}) FILTER (dim = '{dim}') AS {dim}_{suffix}")
    return f"SELECT paper_id, {', '.join(parts)} FROM finals GROUP BY paper_id"


def _merged(dim: str) -> str:
    old = "'quality ' || quality" if dim == "Source" else "NULL"
    return (
        f"coalesce({dim}_raw_category, '') AS {dim}_raw_category, coalesce({dim}_category, {old}, '') AS {dim}_category, "
        f"coalesce({dim}_reason, '') AS {dim}_reason"
    )


ORACLES = {
    "explore_labels": f"WITH {EXPLORED} SELECT * FROM explored",
    "explore_stream": f"WITH {EXPLORED} SELECT * FROM explored",
    "explore_dims": f"""WITH {EXPLORED}, n AS (SELECT dim, count(*) AS n_labels FROM explored GROUP BY dim)
      SELECT * FROM n UNION ALL SELECT 'Note', 0""",
    "max_papers": f"WITH {EXPLORED} SELECT * FROM explored WHERE paper_id <= 150",
    "draft_export": f"""WITH {v.LABELS}, items AS (SELECT dim, pos // 100 AS block,
        string_agg('{{"paper_id":' || paper_id || ',"category":' || to_json(category)::VARCHAR || ',"reason":"' || reason || '"}}',
          ',' ORDER BY pos) AS body FROM labelled GROUP BY 1, 2),
      docs AS (SELECT dim, block, '{{"' || dim || '":[' || body || ']}}' AS document FROM items)
      SELECT dim, block, length(document) AS chars, md5(document) AS digest FROM docs""",
    "draft_scan": f"WITH {EXPLORED} SELECT * FROM explored",
    "draft_file": f"WITH {EXPLORED} SELECT * FROM explored",
    "draft_splits": f"WITH {EXPLORED} SELECT * FROM explored",
    "converge_flow": f"""WITH {v.LABELS}, finals AS (SELECT *, category AS final FROM labelled),
      wide AS ({_pivot(['Source', 'Lead'])})
      SELECT paper_id, nullif(Source_raw_category, '') AS Source_raw_category, nullif(Source_category, '') AS Source_category,
        nullif(Source_reason, '') AS Source_reason, nullif(Lead_raw_category, '') AS Lead_raw_category,
        nullif(Lead_category, '') AS Lead_category, nullif(Lead_reason, '') AS Lead_reason FROM wide""",
    "select_dims": f"WITH {v.LABELS} SELECT dim, count(*) AS n FROM labelled WHERE dim IN ('Lead', 'Source') GROUP BY dim",
    "label_counts": f"WITH {v.LABELS}, {v.COUNTS} SELECT * FROM counts",
    "label_rank": f"WITH {v.LABELS}, {v.COUNTS} SELECT * FROM ranked",
    "label_chunks": f"WITH {v.LABELS}, {v.COUNTS} SELECT dim, category, rank, round FROM chunked",
    "chunk_text": f"""WITH {v.LABELS}, {v.COUNTS} SELECT dim, round, count(*) AS labels,
      string_agg('- ' || category || ' (' || n || ')', chr(10) ORDER BY rank) AS new_labels FROM chunked GROUP BY dim, round""",
    "cap_categories": f"WITH {v.FLAT} SELECT dim, pos, name FROM taxonomy WHERE pos < 5",
    "title_backfill": f"""WITH {v.LABELS}, {v.PAPERS} SELECT dim, l.paper_id + 100 AS paper_id,
      coalesce(trim(title, {v.BLANKS}), 'ID:' || (l.paper_id + 100)) AS title
      FROM labelled l LEFT JOIN papers p ON p.paper_id = l.paper_id + 100""",
    "category_members": f"""WITH {v.FLAT} SELECT t.dim, t.pos, t.name, m.label, c.n, c.first_pos FROM taxonomy t
      JOIN mapping m ON m.dim = t.dim AND m.final = t.name JOIN counts c ON c.dim = m.dim AND c.category = m.label""",
    "typical_cases": f"{CASES} SELECT * FROM cases WHERE rank <= 5",
    "taxonomy_with_cases": f"""{CASES} SELECT t.dim, t.grp, t.pos, t.name, t.name || '; initial' AS keywords,
        string_agg("case", chr(10) ORDER BY rank) AS cases
      FROM taxonomy t JOIN cases c ON c.dim = t.dim AND c.pos = t.pos AND rank <= 3 GROUP BY 1, 2, 3, 4""",
    "final_labels": f"{FINALS} SELECT dim, paper_id, category, final, reason FROM finals",
    "final_labels_spread": f"{FINALS} SELECT dim, paper_id, category, final, reason FROM finals",
    "orphan_labels": f"""{FINALS} SELECT dim, final, count(*) AS n FROM finals
      WHERE (dim, final) NOT IN (SELECT (dim, name) FROM taxonomy WHERE pos < 3) GROUP BY dim, final""",
    "label_pivot": f"{FINALS} {_pivot(v.DIMS)}",
    "label_papers": f"""{EXPLORED_FINALS}, wide AS ({_pivot(['Source'])})
      SELECT paper_id, title, Source_raw_category, Source_category, Source_reason FROM papers LEFT JOIN wide USING (paper_id)""",
    "label_papers_bucketed": f"""{EXPLORED_FINALS}, wide AS ({_pivot(['Source'])})
      SELECT paper_id, title, Source_raw_category, Source_category, Source_reason FROM papers LEFT JOIN wide USING (paper_id)""",
    "label_merge": f"""{EXPLORED_FINALS}, wide AS ({_pivot(['Source', 'Lead'])})
      SELECT p.paper_id, {_merged('Source')}, {_merged('Lead')} FROM papers p
      LEFT JOIN wide USING (paper_id) LEFT JOIN labels g ON g.doc_id + 1 = p.paper_id""",
    "snapshot_swap": f"""WITH {v.FLAT} SELECT dim, pos, name, CASE WHEN dim IN ('Lead', 'Source') THEN 'new' ELSE definition END AS definition
      FROM taxonomy""",
    # an empty cell reads as missing
    "labelled_csv": f"""{EXPLORED_FINALS}, wide AS ({_pivot(['Source', 'Lead'])})
      SELECT p.paper_id, nullif(Source_raw_category, '') AS Source_raw_category, nullif(Source_category, '') AS Source_category,
        Source_reason, {_merged('Lead')} FROM papers p LEFT JOIN wide USING (paper_id)""",
    "taxonomy_upsert": f"""WITH {v.FLAT} SELECT dim, pos, name, CASE dim WHEN 'Lead' THEN 'new' ELSE definition END AS definition
      FROM taxonomy WHERE dim <> 'Source'""",
    "taxonomy_partitions": f"""WITH {v.FLAT} SELECT dim, pos, name, CASE dim WHEN 'Lead' THEN definition ELSE 'new' END AS definition
      FROM taxonomy""",
    "taxonomy_scan": f"""WITH {v.FLAT} SELECT dim, grp, pos, name, definition, name || '; initial' AS keywords, name AS cases
      FROM taxonomy""",
    "mapping_cascade": f"""WITH {v.FLAT}, moved AS (SELECT dim, name AS label, name || '*' AS final FROM taxonomy WHERE pos % 2 = 0
        UNION ALL SELECT dim, category, 'rare' FROM counts WHERE n = 1),
      hopped AS (SELECT o.dim, o.label, coalesce(m.final, o.final) AS final FROM mapping o
        LEFT JOIN moved m ON m.dim = o.dim AND m.label = o.final)
      SELECT dim, label, coalesce(m.final, h.final) AS final FROM hopped h FULL JOIN moved m USING (dim, label)""",
    "converge_rounds": f"""WITH {ROUNDS} SELECT dim, category AS label, substr(category, 1, 1) || '#' || last AS final
      FROM chunked JOIN good USING (dim) WHERE round % 4 <> 2""",
    "taxonomy_rows": f"""WITH {ROUNDS}, names AS (SELECT DISTINCT dim, last, substr(category, 1, 1) || '#' || last AS name
        FROM chunked JOIN good USING (dim) WHERE round % 4 <> 2),
      placed AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY name) - 1 AS pos FROM names)
      SELECT dim, 'Default' AS grp, pos, name, 'round ' || last AS definition, name AS keywords FROM placed WHERE pos < 8""",
    "contract_mapping": f"""WITH {ROUNDS} SELECT dim, round, category AS label FROM chunked
      WHERE round % 4 <> 2 AND rank = round * 30 + 1""",
    "contract_cap": f"WITH {v.FLAT} SELECT dim, count(*) AS n FROM taxonomy GROUP BY dim HAVING count(*) > 10",
    "contract_names": f"{RENAMED} SELECT dim, pos, name FROM renamed WHERE name IN ('Other', '综合')",
    "contract_unique": f"{RENAMED} SELECT dim, name, count(*) AS n FROM renamed GROUP BY dim, name HAVING count(*) > 1",
}
ORACLES["label_merge_buckets"] = ORACLES["label_merge"]
