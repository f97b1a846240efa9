"""Reading exports: the documents are written as files of many layouts, then loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.checks import views as v
from corpusloom.functions.text import paper_text, keyword_fallback
from corpusloom.operators.ranges import splits_of
from corpusloom.operators.scratch import new_path
from corpusloom.sources import exports, sinks

# Header layouts; every document is filed as an export with one of them.
LAYOUTS = [
    ["TI", "AB", "DE", "ID", "PY"],
    ["Article Title", "Abstract", "Author Keywords", "Keywords Plus"],
    ["Title", "Abstract", "Author Keywords", "Index Keywords"],
    ["Title", "Abstract", "Author Keywords"],
    ["题目", "摘要", "关键词"],
    ["Publication", "Summary", "note"],
    ["a1", "b2"],
    ["Title", "Abstract", "Keywords"],
    ["Title", "Abstract", "Title", "Keywords", "Title"],
]


def _headers(spark: SparkSession, d: str) -> DataFrame:
    """(file, names): a header per document, with the document's source as an extra column."""
    layouts = F.array(*[F.array(*[F.lit(n) for n in names]) for names in LAYOUTS])
    picked = F.get(layouts, (F.col("doc_id") % len(LAYOUTS)).cast("int"))
    return v.table(spark, d, "documents").select(
        F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file"),
        F.concat(picked, F.array("source")).alias("names"),
    )


def detect_source(spark: SparkSession, d: str) -> DataFrame:
    return _headers(spark, d).select("file", exports.detect_source(F.col("names")).alias("dialect"))


def map_columns(spark: SparkSession, d: str) -> DataFrame:
    return exports.map_columns(_headers(spark, d).withColumn("names", exports.dedup_names(F.col("names"))))


def map_columns_named(spark: SparkSession, d: str) -> DataFrame:
    """The same with the dialect given by the caller."""
    return exports.map_columns(_headers(spark, d), "standard").select("file", "role", "column")


def dedup_columns(spark: SparkSession, d: str) -> DataFrame:
    return _headers(spark, d).select("file", F.array_join(exports.dedup_names(F.col("names")), "|").alias("names"))


def _write(df: DataFrame, path: str, sep: str = ",", suffix: str = "csv") -> None:
    (
        df.write.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
        .option("extension", suffix).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def _export(spark: SparkSession, d: str, path: str) -> None:
    """Documents by language in four layouts, in files of ascending ids."""
    p = v.papers(spark, d)
    missing = F.when(F.col("paper_id") % 9 == 0, "NA").when(F.col("paper_id") % 9 == 1, "n/a")
    keywords = F.coalesce(missing, F.col("keywords"))
    layouts = {
        "en": ("csv", ",", ["TI", "AB", "DE", "PY"]),
        "fr": ("csv", ",", ["Title", "Abstract", "Author Keywords", "Index Keywords"]),
        "de": ("tsv", "\t", ["题目", "摘要", "关键词", "note"]),
        "rest": ("csv", ",", ["Publication", "Summary", "note", "year"]),
    }
    for lang, (suffix, sep, names) in layouts.items():
        rows = p.where(F.col("lang") == lang) if lang != "rest" else p.where(~F.col("lang").isin([k for k in layouts if k != "rest"]))
        cells = [F.col("title"), F.col("abstract"), keywords, F.col("paper_id").cast("string")]
        # a file per range of ids, in path order
        ranged = rows.repartitionByRange("paper_id").sortWithinPartitions("paper_id")
        ordered = ranged.select(*[c.alias(n) for c, n in zip(cells, names, strict=True)])
        _write(ordered, f"{path}/{lang}", sep, suffix)


def load_papers(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "exports")
    _export(spark, d, path)
    loaded = exports.load_papers(spark, path)
    return loaded.select(
        "paper_id",
        F.element_at(F.split("source_file", "/"), -2).alias("folder"),
        "paper_title",
        F.md5("paper_abstract").alias("abstract"),
        "paper_keywords",
        F.coalesce("PY", "`Index Keywords`", F.when(F.col("题目").isNotNull(), F.col("note")), "year").cast("long").alias("written_id"),
    )


def load_text(spark: SparkSession, d: str) -> DataFrame:
    """Paper text of loaded exports, with the keyword fallback over their own columns."""
    path = new_path(spark, "exports")
    _export(spark, d, path)
    loaded = exports.load_papers(spark, path)
    text = paper_text(F.col("paper_title"), F.col("paper_abstract"), keyword_fallback(F.col("paper_keywords"), loaded.columns))
    return loaded.select("paper_id", F.md5(text).alias("digest"))


def _round_trip(spark: SparkSession, d: str, sep: str, suffix: str, table: str, columns: list[str]) -> DataFrame:
    path = new_path(spark, "scan")
    rows = v.table(spark, d, table).select(*[F.col(c).cast("string") for c in columns])
    _write(rows, path, sep, suffix)
    files = [r.file for r in exports.list_files(spark, f"{path}/*.{suffix}").collect()]
    return exports.scan_delimited(spark, files, columns, sep).select(*columns)


def scan_csv(spark: SparkSession, d: str) -> DataFrame:
    """Pages through CSV and back: markup, quotes and line ends survive."""
    back = _round_trip(spark, d, ",", "csv", "pages", ["page_id", "url", "html"])
    return back.select("page_id", "url", F.md5("html").alias("digest"))


#: Bytes of a split in ``scan_csv_splits``, far below the size of its files.
SPLIT = 32 << 10


def scan_csv_splits(spark: SparkSession, d: str) -> DataFrame:
    """Pages through CSV and back, the files read in splits of SPLIT bytes: quoted cells of many lines span them."""
    path = new_path(spark, "scan")
    rows = v.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    lines = F.concat(F.col("html"), F.lit('\n"quoted", \n\n'), F.col("url"))
    _write(rows.withColumn("html", lines), path)
    with splits_of(spark, SPLIT):
        back = exports.read_table(spark, path)
    return back.select("page_id", "url", F.md5("html").alias("digest"))


def scan_tsv(spark: SparkSession, d: str) -> DataFrame:
    back = _round_trip(spark, d, "\t", "tsv", "conversations", ["conv_id", "turn", "role", "text"])
    return back.select("conv_id", "turn", "role", F.md5("text").alias("digest"))


def csv_sink(spark: SparkSession, d: str) -> DataFrame:
    """Documents through the CSV sink (with BOM) and back through the header reader."""
    path = new_path(spark, "sink")
    rows = v.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")
    sinks.write_csv(rows, path)
    return exports.read_table(spark, f"{path}/*.csv").select("doc_id", F.md5("text").alias("digest"), "lang")


QUERIES = {
    f.__name__: f
    for f in (
        detect_source, map_columns, map_columns_named, dedup_columns, load_papers, load_text, scan_csv, scan_csv_splits, scan_tsv,
        csv_sink,
    )
}


def _list(names: list[str]) -> str:
    return "[" + ", ".join(v.sql_text(n) for n in names) + "]"


_CANDIDATES = " UNION ALL ".join(
    f"SELECT '{dialect}' AS dialect, {d} AS dpos, '{role}' AS role, unnest({_list(names)}) AS name, unnest(range({len(names)})) AS cpos"
    for d, (dialect, roles) in enumerate(exports.CANDIDATES.items())
    for role, names in roles.items()
)

HEADERS = f"""headers AS (SELECT 'f' || doc_id AS file, unnest(layout || [source]) AS name,
    unnest(range(len(layout) + 1)) AS pos
  FROM (SELECT doc_id, source, [{", ".join(_list(n) for n in LAYOUTS)}][doc_id % {len(LAYOUTS)} + 1] AS layout FROM documents)),
candidates AS ({_CANDIDATES}),
hits AS (SELECT f.file, c.dialect, c.dpos, count(DISTINCT h.name) AS n
  FROM (SELECT DISTINCT file FROM headers) f CROSS JOIN candidates c
  LEFT JOIN headers h ON h.file = f.file AND h.name = c.name GROUP BY 1, 2, 3),
detected AS (SELECT file, arg_max(dialect, n * 10 - dpos) AS dialect FROM hits GROUP BY file)"""


def _mapped(dialects: str) -> str:
    return f"""exact AS (SELECT t.file, c.role, arg_min(c.name, c.cpos) AS name FROM {dialects} t
    JOIN candidates c ON c.dialect = t.dialect JOIN headers h ON h.file = t.file AND h.name = c.name GROUP BY 1, 2),
  hinted AS (SELECT file, 'title' AS role, arg_min(name, pos) AS name FROM headers WHERE lower(name) LIKE '%ti%' GROUP BY file
    UNION ALL SELECT file, 'abstract', arg_min(name, pos) FROM headers
      WHERE lower(name) LIKE '%ab%' OR lower(name) LIKE '%summary%' GROUP BY file),
  mapped AS (SELECT t.file, t.dialect, r.role, coalesce(e.name, x.name) AS "column",
      CASE WHEN e.name IS NOT NULL THEN 'name' WHEN x.name IS NOT NULL THEN 'fallback' END AS matched_by
    FROM {dialects} t CROSS JOIN (SELECT unnest(['title', 'abstract', 'keywords']) AS role) r
    LEFT JOIN exact e ON e.file = t.file AND e.role = r.role LEFT JOIN hinted x ON x.file = t.file AND x.role = r.role)"""


_FILES = f"""{v.PAPERS}, filed AS (SELECT *, CASE WHEN lang IN ('en', 'fr', 'de') THEN lang ELSE 'rest' END AS folder,
    CASE WHEN paper_id % 9 NOT IN (0, 1) THEN keywords END AS kept FROM papers)"""

ORACLES = {
    "detect_source": f"WITH {HEADERS} SELECT * FROM detected",
    "map_columns": f"WITH {HEADERS}, {_mapped('detected')} SELECT * FROM mapped",
    "map_columns_named": f"""WITH {HEADERS}, named AS (SELECT file, 'standard' AS dialect FROM detected), {_mapped('named')}
      SELECT file, role, "column" FROM mapped""",
    "dedup_columns": f"""WITH {HEADERS}, seen AS (SELECT *, row_number() OVER (PARTITION BY file, name ORDER BY pos) - 1 AS k FROM headers)
      SELECT file, string_agg(CASE k WHEN 0 THEN name ELSE name || '.' || k END, '|' ORDER BY pos) AS names FROM seen GROUP BY file""",
    "load_papers": f"""WITH {_FILES} SELECT row_number() OVER (ORDER BY folder, paper_id) AS paper_id, folder,
        title AS paper_title, md5(abstract) AS abstract, CASE WHEN folder <> 'rest' THEN kept END AS paper_keywords,
        paper_id AS written_id FROM filed""",
    "load_text": f"""WITH {_FILES} SELECT row_number() OVER (ORDER BY folder, paper_id) AS paper_id,
        md5('Title: ' || trim(title, {v.BLANKS}) || chr(10) || 'Abstract: ' || trim(abstract, {v.BLANKS}) || chr(10) || 'Keywords: ' ||
        CASE WHEN folder <> 'rest' THEN coalesce(kept, '') ELSE '' END) AS digest FROM filed""",
    "scan_csv": "SELECT page_id::VARCHAR AS page_id, url, md5(html) AS digest FROM pages",
    "scan_csv_splits": """SELECT page_id::VARCHAR AS page_id, url,
      md5(html || chr(10) || '"quoted", ' || chr(10) || chr(10) || url) AS digest FROM pages""",
    "scan_tsv": "SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, role, md5(text) AS digest FROM conversations",
    "csv_sink": "SELECT doc_id::VARCHAR AS doc_id, md5(text) AS digest, lang FROM documents",
}
