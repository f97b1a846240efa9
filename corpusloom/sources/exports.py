"""Bibliographic exports: delimited files of differing column layouts.

The layout work (which dialect, which column holds the title) is done on header
rows only, one array of names per file, with array expressions and no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions.text import check_names, quoted
from corpusloom.operators.layout import spread
from corpusloom.operators.lookup import lookup
from corpusloom.operators.numbering import running_sums
from corpusloom.operators.ranges import Unit, read_pieces, scan_splits, split_settings, split_states, stitched
from corpusloom.operators.scratch import settle

# Per dialect and role the column names looked for, in order.
CANDIDATES = {
    "wos": {
        "title": ["TI", "Article Title", "Title"],
        "abstract": ["AB", "Abstract"],
        "keywords": ["DE", "Author Keywords", "ID", "Keywords Plus", "Keywords"],
    },
    "scopus": {
        "title": ["Title"],
        "abstract": ["Abstract"],
        "keywords": ["Author Keywords", "Index Keywords"],
    },
    "standard": {
        "title": ["Title", "题目", "标题"],
        "abstract": ["Abstract", "摘要"],
        "keywords": ["Keywords", "Author Keywords", "关键词"],
    },
}
# Parts of a lower-cased name that reveal a role when no candidate is there.
NAME_HINTS = {"title": ["title", "ti"], "abstract": ["abstract", "ab", "summary"], "keywords": []}
# Cell texts that mean "missing".
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Separator by file suffix.
SEPARATORS = {".csv": ",", ".txt": "\t", ".tsv": "\t"}

ROLES = ["title", "abstract", "keywords"]
HEADERS = "file string, names array<string>, line_end string"
HEADER_BYTES = 64 * 1024
#: Names of columns in headers, up to which these are broadcast: some 10 MB.
MAX_BROADCAST = 200_000
ARROW_STORES = {"file", "s3", "s3a", "s3n", "gs", "hdfs", "abfs", "abfss"}


# ---- layouts ---------------------------------------------------------------


def dedup_names(names: Column) -> Column:
    """Header names made unique: the first keeps its name, later ones get the first free of .1, .2, …"""
    numbers = F.sequence(F.lit(1), F.greatest(F.size(names), F.lit(1)))

    def renamed(done: Column, name: Column) -> Column:
        tried = F.transform(numbers, lambda n: F.concat(name, F.lit("."), n.cast("string")))
        free = F.filter(tried, lambda t: ~F.array_contains(done, t) & ~F.array_contains(names, t))
        return F.array_append(done, F.when(F.array_contains(done, name), F.get(free, F.lit(0))).otherwise(name))

    return F.aggregate(names, F.array().cast("array<string>"), renamed)


def detect_source(names: Column, source_type: str = "auto") -> Column:
    """Dialect whose candidate names occur most in a header; ties go to the earlier one."""
    if source_type in CANDIDATES:
        return F.lit(source_type)
    hits = {
        dialect: F.size(F.array_intersect(names, F.array(*[F.lit(c) for r in roles.values() for c in r])))
        for dialect, roles in CANDIDATES.items()
    }
    best = F.greatest(*hits.values())
    return F.coalesce(*[F.when(n == best, F.lit(dialect)) for dialect, n in hits.items()])


def map_column(names: Column, dialect: Column, role: str) -> Column:
    """Struct(column, matched_by) for one role; both null when the role is unmapped."""
    exact = F.coalesce(
        *[
            F.when(
                dialect == name,
                F.get(F.filter(F.array(*[F.lit(c) for c in roles[role]]), lambda c: F.array_contains(names, c)), F.lit(0)),
            )
            for name, roles in CANDIDATES.items()
        ]
    )
    hints = NAME_HINTS[role]
    hinted = F.lit(None).cast("string")
    if hints:
        hinted = F.get(
            F.filter(names, lambda n: reduce(lambda a, b: a | b, [F.lower(n).contains(h) for h in hints])),
            F.lit(0),
        )
    how = F.when(exact.isNotNull(), F.lit("name")).when(hinted.isNotNull(), F.lit("fallback"))
    return F.struct(F.coalesce(exact, hinted).alias("column"), how.alias("matched_by"))


def map_columns(headers: DataFrame, source_type: str = "auto") -> DataFrame:
    """(file, dialect, role, column, matched_by): three rows for every (file, names) row."""
    names = F.col("names")
    return (
        headers.withColumn("dialect", detect_source(names, source_type))
        .withColumn(
            "m",
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(role).alias("role"), map_column(names, F.col("dialect"), role).alias("at"))
                        for role in ROLES
                    ]
                )
            ),
        )
        .select("file", "dialect", "m.role", "m.at.column", "m.at.matched_by")
    )


# ---- reading ---------------------------------------------------------------


def _separator(path: str) -> str:
    name = path.rsplit("/", 1)[-1].lower()
    suffix = "." + name.rsplit(".", 1)[-1] if "." in name else ""
    if suffix not in SEPARATORS:
        raise ValueError(f"unsupported file type {suffix or '(none)'}: {path}")
    return SEPARATORS[suffix]


def list_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Paths of the files to read; no content is touched (the column is pruned)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select(F.col("path").alias("file"))


def read_headers(files: DataFrame, through: str = "auto") -> DataFrame:
    """(file, names, line_end): the header record of each file; only its first blocks are read.

    ``through="arrow"`` opens the files on the executors with Arrow's file systems,
    ``"spark"`` lets Spark read one record per file, for stores or credentials only
    Spark knows.  ``"auto"`` takes Arrow wherever it knows the store.
    """
    if through == "auto":
        schemes = [r[0] for r in files.select(F.substring_index("file", ":", 1)).distinct().collect()]
        through = "arrow" if set(schemes) <= ARROW_STORES else "spark"
    return headers_by_arrow(files) if through == "arrow" else headers_by_spark(files)


def headers_by_spark(files: DataFrame) -> DataFrame:
    """One tiny job per file, several at a time; header names come to the driver."""
    spark = files.sparkSession

    def header(file: str) -> tuple[str, list[str], str]:
        reader = spark.read.options(header=False, multiLine=True, quote='"', escape='"', lineSep="\n", sep=_separator(file))
        row = reader.csv(file).head()
        names = [c or "" for c in row] if row else []
        if names and names[-1].endswith("\r"):
            return file, [*names[:-1], names[-1][:-1]], "\r\n"
        return file, names, "\n"

    with ThreadPoolExecutor(16) as pool:
        rows = list(pool.map(header, [r.file for r in files.collect()]))
    return spark.createDataFrame(rows, HEADERS)


def headers_by_arrow(files: DataFrame) -> DataFrame:
    def first_records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import io
        import re

        from pyarrow import fs

        # a record ends at the first line end outside quotes
        whole = re.compile(rb'((?:[^"\r\n]|"[^"]*")*)(\r\n|\n|\r(?=.))', re.DOTALL)
        for frame in frames:
            names, ends = [], []
            for file in frame["file"]:
                store, path = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", file))
                text, record = b"", None
                with store.open_input_stream(path) as stream:
                    size = HEADER_BYTES
                    while record is None and (block := stream.read(size)):
                        text += block
                        record = whole.match(text)
                        size = len(text)  # doubled, so that a long record is not matched over and over
                # no such end: the file is its header, or a lone quote keeps it open
                head, end = record.groups() if record else (text.split(b"\n", 1)[0].rstrip(b"\r"), b"\n")
                sep = "," if file.lower().endswith(".csv") else "\t"
                names.append(next(csv.reader(io.StringIO(head.decode("utf-8-sig"), newline=""), delimiter=sep), []))
                ends.append(end.decode())
            yield pd.DataFrame({"file": frame["file"], "names": names, "line_end": ends})

    return files.mapInPandas(first_records, HEADERS)


def scan_delimited(
    spark: SparkSession,
    files: list[str],
    names: list[str],
    sep: str,
    line_end: str | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Files of one layout as text columns, missing markers as null, plus file and row order.

    ``line_end`` is the one after the header; left to itself Spark takes the first
    line end it meets, which may stand inside a quoted cell.  ``multi_line=False`` lets large
    files be split, where no quoted cell holds a line end.  Short rows are filled with nulls;
    a row with more cells than the header is refused, naming its file.
    """
    check_names(names)
    over = "_over" + "_" * max(map(len, names), default=0)  # no name is as long
    schema = ", ".join("`" + n.replace("`", "``") + "` string" for n in [*names, over])
    reader = spark.read.option("lineSep", line_end) if line_end else spark.read
    raw = (
        reader.schema(schema)
        .option("header", True)
        .option("multiLine", multi_line)  # quoted fields hold line ends; one task per file
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .csv(files)
    )
    cells = [F.when(~quoted(n).isin(MISSING), quoted(n)).alias(n) for n in names if n != "source_file"]
    file = F.col("_metadata.file_path")
    refused = F.raise_error(F.concat(F.lit("more cells than the header has: "), file))
    return raw.select(
        *cells,
        F.when(F.col(over).isNull(), file).otherwise(refused.cast("string")).alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


# ---- reading in splits ---------------------------------------------------------


def file_separator(file: str) -> str:
    """The separator by the file's suffix."""
    return SEPARATORS.get("." + file.lower().rsplit(".", 1)[-1], "\t")


def _inside_after(line: str, inside: bool, sep: str) -> bool:
    """Whether a quoted cell is open behind a line that begins inside one, or at the start of a cell."""
    if '"' not in line:
        return inside
    at, opening = 0, sep + '"'
    if not inside and line[0] == '"':
        inside, at = True, 1
    while True:
        if not inside:
            at = line.find(opening, at)
            if at < 0:
                return False
            inside, at = True, at + len(opening)
        quote = line.find('"', at)
        if quote < 0:
            return True
        if line.startswith('"', quote + 1):
            at = quote + 2
        else:
            inside, at = False, quote + 1


def _summarise(lines: Iterable[str], file: str) -> tuple[int, int, int, int]:
    """What the lines of a split do to quotes, whether it begins outside a cell or inside one."""
    sep, first, second = file_separator(file), False, True
    for line in lines:
        if '"' in line:
            first, second = _inside_after(line, first, sep), _inside_after(line, second, sep)
    return int(first), int(second), 0, 0


def _record_units(end: str, lines: Iterable[str], state: int, count: int, file: str, start: int) -> Iterator[Unit]:
    """The records of a split, ``header`` the first of a file; blank lines between them are none."""
    sep, inside, opens, held = file_separator(file), bool(state), not state, []
    kind = "record" if start else "header"
    for line in lines:
        if not held and not inside and line in ("", "\r"):
            continue
        held.append(line)
        inside = _inside_after(line, inside, sep)
        if not inside:
            yield kind, 0, opens, True, end.join(held)
            kind, opens, held = "record", True, []
    if held:
        yield kind, 0, opens, False, end.join(held) + end


def read_records(
    spark: SparkSession, paths: str | list[str], headers: DataFrame, line_ends: Iterable[str], multi_line: bool = True
) -> DataFrame:
    """(file, start, n, text): the records of delimited files behind their headers, read in splits of any file.

    ``headers`` (file, line_end) names the files to read, ``line_ends`` those that occur.  ``multi_line=False``
    saves a pass where no quoted cell holds a line end; a pass is also saved where all files are too small to be split.
    """
    ends = {"\r" if e == "\r" else "\n" for e in line_ends}
    with split_settings(spark):
        split = multi_line and _may_split(spark, paths)
    units = None
    for end in sorted(ends):
        with split_settings(spark):
            pieces = read_pieces(spark, paths, end)
            if len(ends) > 1:
                mine = (F.col("line_end") == "\r") if end == "\r" else (F.col("line_end") != "\r")
                pieces = pieces.join(headers.where(mine).select("file"), "file", "left_semi")
            states = split_states(pieces, _summarise) if split else None
            found = scan_splits(pieces, states, partial(_record_units, end))
            found = settle(found, "records") if split else found
        if split:
            found = stitched(found)
        units = found if units is None else units.unionByName(found, allowMissingColumns=True)
    return units.where("kind = 'record'").select("file", "start", "n", "text")


def _may_split(spark: SparkSession, paths: str | list[str]) -> bool:
    """Whether some file is large enough for Spark to read it in splits."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    conf = spark._jsparkSession.sessionState().conf()
    return (files.agg(F.max("length")).head()[0] or 0) > min(conf.filesOpenCostInBytes(), conf.filesMaxPartitionBytes())


def scan_records(spark: SparkSession, paths: str | list[str], headers: DataFrame, multi_line: bool = True) -> DataFrame:
    """(source_file, _block, _row, cells) and further columns of ``headers``: the records of files of any layout, by one scan.

    ``headers`` (file, names, line_end, …) holds every file's header.  ``cells`` are in the order of ``names``, missing
    markers and cells that a short row lacks as null.  A row with more cells than the header is refused, naming its file.
    """
    files, widest, line_ends = headers.agg(F.count("*"), F.max(F.size("names")), F.collect_set("line_end")).head()
    widest = widest or 0
    records = read_records(spark, paths, headers, line_ends, multi_line).withColumnRenamed("n", "_row")
    schema = ", ".join(f"c{i} string" for i in range(widest + 1))
    if files * (widest + 1) <= MAX_BROADCAST:
        placed = records.join(F.broadcast(headers), "file")
    else:
        placed = lookup(records, headers, ["file"], records.groupBy("file").agg(F.count("*").alias("n")))
    # the line end behind a record goes with it
    text = F.when(F.col("line_end") == "\r\n", F.regexp_replace("text", "\r$", "")).otherwise(F.col("text"))

    def parsed(sep: str) -> Column:
        return F.from_csv(text, schema, {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true"})

    commas = F.lower(F.substring_index("file", ".", -1)) == "csv"
    # inside a lambda a record is parsed once, not once per cell
    record = F.array(F.when(commas, parsed(",")).otherwise(parsed("\t")))
    split = placed.withColumn("_cells", F.transform(record, lambda r: F.array(*[r[f"c{i}"] for i in range(widest + 1)]))[0])
    known = F.slice("_cells", F.lit(1), F.size("names"))
    over = F.exists(F.slice("_cells", F.size("names") + 1, F.lit(widest + 1)), lambda c: c.isNotNull())
    refused = F.raise_error(F.concat(F.lit("more cells than the header has: "), F.col("file")))
    return split.select(
        F.when(over, refused.cast("string")).otherwise(F.col("file")).alias("source_file"),
        F.col("start").alias("_block"),
        "_row",
        *[c for c in headers.columns if c not in ("file", "line_end")],
        F.transform(known, lambda c: F.when(~c.isin(MISSING), c)).alias("cells"),
    )


def _placed(headers: DataFrame, names: list[str]) -> DataFrame:
    """``headers`` with ``_at``: the position in a file of each of ``names``, null where it has none."""
    check_names(names)
    place = F.transform(F.array(*[F.lit(n) for n in names]).cast("array<string>"), lambda n: F.nullif(F.array_position("names", n), F.lit(0)) - 1)
    return headers.withColumn("_at", place.cast("array<int>"))


def _columns(names: list[str]) -> dict[str, Column]:
    """The column of each name in what scan_records gives for _placed headers."""
    return {n: F.get("cells", F.col("_at")[i]).alias(n) for i, n in enumerate(names)}


def _names(headers: DataFrame) -> list[str]:
    """All column names of all layouts, in the order of the first file that has each; as many as columns come out."""
    each = headers.select("file", F.posexplode("names").alias("pos", "name"))
    firsts = each.groupBy("name").agg(F.min(F.struct("file", "pos")).alias("first")).collect()
    return [r.name for r in sorted(firsts, key=lambda r: tuple(r["first"]))]


def _headers_of(spark: SparkSession, paths: str | list[str], through: str = "auto") -> DataFrame:
    headers = read_headers(list_files(spark, paths), through).withColumn("names", dedup_names(F.col("names")))
    suffix = F.lower(F.concat(F.lit("."), F.substring_index("file", ".", -1)))
    refused = F.raise_error(F.concat(F.lit("unsupported file type "), suffix, F.lit(": "), F.col("file")))
    return settle(headers.withColumn("file", F.when(suffix.isin(list(SEPARATORS)), F.col("file")).otherwise(refused.cast("string"))), "headers")


def load_papers(
    spark: SparkSession,
    paths: str | list[str],
    source_type: str = "auto",
    headers_through: str = "auto",
    multi_line: bool = True,
) -> DataFrame:
    """One paper table from exports of differing layout, by one scan whatever the number of layouts.

    Keeps every original column and adds ``paper_title``, ``paper_abstract``,
    ``paper_keywords`` (null when unmapped), ``source_file`` and ``paper_id``:
    files in path order, rows in file order, counted from 1.  Exports of an earlier
    result keep the ``paper_id`` they hold.  Large files are read in splits; ``multi_line=False``
    saves a pass over them where no quoted cell holds a line end.
    """
    headers = _headers_of(spark, paths, headers_through)
    names = _names(headers)
    roles = F.map_from_entries(F.collect_list(F.struct("role", "column")))
    found = map_columns(headers, source_type).where("column IS NOT NULL").groupBy("file").agg(roles.alias("roles"))
    mapped = settle(_placed(headers, names).join(found, "file", "left"), "layouts")
    place = {r: (F.array_position("names", F.col("roles")[r]) - 1).cast("int") for r in ROLES}
    rows = scan_records(spark, paths, mapped.withColumns({f"_{r}": at for r, at in place.items()}), multi_line)
    # a role's column is one of the file's own
    added = {f"paper_{r}": F.get("cells", F.col(f"_{r}")).alias(f"paper_{r}") for r in ROLES}
    columns = _columns(names)
    own = [c for n, c in columns.items() if n not in added and n not in ("source_file", "paper_id")]
    kept = "paper_id" in names and headers.where(~F.array_contains("names", "paper_id")).isEmpty()
    given = [columns["paper_id"].cast("long").alias("paper_id")] if kept else []
    papers = spread(rows.select(*own, "source_file", *given, *added.values(), "_block", "_row"))
    if kept:
        return settle(papers.drop("_row", "_block"), "papers")
    return number_by_file(settle(papers, "papers"))


def number_by_file(df: DataFrame) -> DataFrame:
    """``paper_id`` from (source_file, _block, _row) without moving the papers.

    Rows of a split are numbered in the scan; only the row counts, one per split,
    are brought into file order.
    """
    place = ["source_file", "_block"]
    counts = df.groupBy(*place).agg(F.count("*").alias("n"), F.min("_row").alias("_first"))
    firsts = settle(running_sums(counts.withColumn("_place", F.struct(*place)), "_place", "n", "_before"), "firsts")
    return (
        lookup(df, firsts.drop("n", "_place"), place, firsts.select(*place, "n"))
        .withColumn("paper_id", F.col("_before") + F.col("_row") - F.col("_first") + 1)
        .drop("_row", "_block", "_first", "_before")
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Already labelled exports as text columns."""
    headers = _headers_of(spark, path)
    names = _names(headers)
    rows = scan_records(spark, path, settle(_placed(headers, names), "layouts"))
    return rows.select(*[c for n, c in _columns(names).items() if n != "source_file"])
