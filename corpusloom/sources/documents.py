"""JSON drafts and taxonomies, category schemas."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusloom.functions.responses import json_text, list_at, other_members, text_at, with_members
from corpusloom.functions.text import clean_text, split_list
from corpusloom.operators.ranges import Unit, read_pieces, scan_splits, split_settings, split_states, stitched
from corpusloom.operators.scratch import settle

LABELS = "dim string, pos bigint, paper_id bigint, category string, reason string"
TAXONOMY = (
    "dim string, grp string, pos bigint, name string, definition string, "
    "judgment_suggestions string, keywords array<string>, typical_cases array<string>, extra string"
)
TAXONOMY_FIELDS = ["name", "definition", "judgment_suggestions", "keywords", "typical_cases"]
DRAFT_JSON = "map<string,array<struct<paper_id:bigint,category:string,reason:string>>>"
BLOCK = 1000


# ---- drafts: {dim: [{paper_id, category, reason}]} ---------------------------


def draft_documents(labels: DataFrame, block: int = BLOCK, indented: bool = False) -> DataFrame:
    """Draft JSON in documents of bounded size, one JSON object per row.

    A dimension may hold a label for every paper, so it is cut by position into
    blocks; every row is a whole draft document of its own, over several lines if ``indented``.
    """
    place = ["seq"] if "seq" in labels.columns else []
    items = F.sort_array(F.collect_list(F.struct("pos", *place, "paper_id", "category", "reason")))
    plain = F.transform(
        items, lambda i: F.struct(i["paper_id"].alias("paper_id"), i["category"].alias("category"), i["reason"].alias("reason"))
    )
    return (
        labels.groupBy("dim", F.call_function("div", F.col("pos"), F.lit(block)).alias("block"))
        .agg(plain.alias("items"))
        .select("dim", "block", F.to_json(F.create_map("dim", "items"), {"pretty": str(indented).lower()}).alias("document"))
    )


#: Pieces of JSON files end here, so that the objects of a draft are pieces of their own also on one line.
END = "}"
TOKEN = re.compile(r'"[^"]*"|"[^"]*\Z|[{}\[\]]|[^\s",:{}\[\]]+')
NO_TOKEN = re.compile(r"[\s\ufeff]*")


def _hidden(text: str) -> str:
    """The text with escaped characters, which no JSON text holds plainly, in their place."""
    return text.replace("\\\\", "\x01\x01").replace('\\"', "\x02\x02") if "\\" in text else text


def _deeper(parts: list[str]) -> int:
    signs = "".join(parts)
    return signs.count("{") + signs.count("[") - signs.count("}") - signs.count("]")


def _summarise(texts: Iterable[str], file: str) -> tuple[int, int, int, int]:
    """What the pieces do to quotes and depth, whether they begin outside a string or inside one."""
    inside, depth = [0, 1], [0, 0]
    for text in texts:
        parts = _hidden(text).split('"')
        deeper = _deeper(parts[0::2]), _deeper(parts[1::2])
        for h in (0, 1):
            depth[h] += deeper[inside[h]]
            inside[h] ^= (len(parts) - 1) & 1
            depth[h] -= 1 - inside[h]  # the sign that ended the piece
    return inside[0], inside[1], depth[0], depth[1]


def _draft_units(texts: Iterable[str], state: int, depth: int, file: str, begin: int) -> Iterator[Unit]:
    """The units of a split of a draft: ``head``, a key with the sign that opens its value; ``item``, an object
    of a list; ``odd``, what no draft holds; ``end``, the depth behind the split.

    ``group`` counts the heads of the split up to the unit.
    """
    inside, heads = bool(state), 0
    unit = "item" if depth > 2 else "head" if inside and depth == 1 else None
    opens, held = False, []
    for text in texts:
        whole = _hidden(text)
        if depth == 0 and not inside and NO_TOKEN.fullmatch(whole):
            continue  # behind the last sign
        whole, text = whole + END, text + END
        pos = start = 0  # start of the unit that is open, in this piece
        while pos < len(whole):
            if inside:
                quote = whole.find('"', pos)
                if quote < 0:
                    break
                inside, pos = False, quote + 1
                continue
            found = TOKEN.search(whole, pos)
            if not found:
                break
            sign, pos = found[0][0], found.end()
            inside = sign == '"' and (len(found[0]) == 1 or found[0][-1] != '"')
            if unit is None and depth == 2 and sign == "{":
                unit, opens, start, held = "item", True, found.start(), []
            elif unit is None and depth == 1 and sign == '"':
                unit, opens, start, held = "head", True, found.start(), []
                continue
            elif unit is None and sign not in "]}\ufeff" and (depth or sign != "{") or unit == "head" and sign in "]}":
                yield "odd", heads, True, True, found[0]
                unit = None
            depth += (sign in "{[") - (sign in "}]")
            if unit == "head":
                heads += 1
                yield unit, heads, opens, True, "".join(held) + text[start:pos]
                unit = None
            elif unit == "item" and depth == 2:
                yield unit, heads, opens, True, "".join(held) + text[start:pos]
                unit = None
            if depth < 0:
                yield "odd", heads, True, True, sign
                depth = 0
        if unit:
            held.append(text[start:])
    if unit:
        yield unit, heads, opens, False, "".join(held)
    yield "end", heads, True, True, str(depth + inside)


def _units(spark: SparkSession, path: str) -> DataFrame:
    """The units of all files of a path, read from written tables."""
    with split_settings(spark):
        pieces = read_pieces(spark, path, END)
        found = settle(scan_splits(pieces, split_states(pieces, _summarise), _draft_units), "units")
    return stitched(found)


def _heads(units: DataFrame) -> DataFrame:
    """(file, closed_in, grp, dim, opener) of the keys of the draft's objects; the opener is the first sign of the value."""
    key = F.regexp_extract("text", r'(?s)^("(?:[^"\\]|\\.)*")\s*:', 1)
    return units.where("kind = 'head'").select(
        "file", "closed_in", "grp", F.from_json(F.concat(F.lit("["), key, F.lit("]")), "array<string>")[0].alias("dim"),
        F.right("text", F.lit(1)).alias("opener"),
    )


def _faults(units: DataFrame) -> DataFrame:
    """(file, fault): what keeps a file from being a draft or taxonomy of JSON objects."""
    odd = units.where("kind = 'odd' OR (kind = 'head' AND right(text, 1) NOT IN ('[', '{') AND text NOT RLIKE ':\\\\s*null$') OR NOT closes")
    ends = units.where("kind = 'end'").groupBy("file").agg(F.max_by("text", "start").alias("depth")).where("depth <> '0'")
    return odd.select("file", F.left("text", F.lit(80)).alias("fault")).unionByName(ends.select("file", F.lit("it ends inside a value").alias("fault")))


def document_kind(spark: SparkSession, path: str) -> str | None:
    """``taxonomy`` or ``draft`` by the values of the objects in the files; None when they are empty, ``other`` for all else."""
    units = _units(spark, path)
    openers = {r.opener for r in _heads(units).select("opener").where("opener IN ('[', '{')").distinct().collect()}
    if openers == {"{"}:
        return "taxonomy"
    if not _faults(units).isEmpty() or len(openers) > 1:
        return "other"
    return "draft" if openers else None


#: What tells the key of an item's list.
PLACE = ["file", "closed_in", "grp"]


def _keyed_items(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, start, n, closed_in, grp, item) of draft files, and (file, closed_in, grp, dim); what is no draft is refused."""
    units = _units(spark, path)
    heads = settle(_heads(units), "heads")
    wrong = _faults(units).unionByName(heads.where("opener = '{'").select("file", F.lit("values that are no lists").alias("fault"))).head()
    if wrong:
        raise ValueError(f"no draft: {wrong.file}: {wrong.fault}")
    # the key that was open before a split is the last of the splits before it; one row per split and key
    splits = units.where("kind = 'end'").select("file", F.col("start").alias("closed_in"), F.lit(0).cast("long").alias("grp"))
    before = Window.partitionBy("file").orderBy("closed_in", "grp").rowsBetween(Window.unboundedPreceding, 0)
    keys = heads.select(*PLACE, "dim").unionByName(splits.withColumn("dim", F.lit(None).cast("string")))
    keys = keys.withColumn("dim", F.last("dim", ignorenulls=True).over(before))
    return units.where("kind = 'item'").select("file", "start", "n", "closed_in", "grp", F.col("text").alias("item")), keys


def draft_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, n, dim, item): the label objects of draft files, each as JSON text.

    Files of any size, on one line or many, are read in splits; an object of a list is a row.  ``start`` and
    ``n`` are its place in the file.  What is no draft is refused, naming the file.
    """
    items, keys = _keyed_items(spark, path)
    return items.join(keys, PLACE).select("file", "start", "n", "dim", "item")


def _parsed_items(items: DataFrame) -> DataFrame:
    """Items with the fields of each as ``_i``; texts that are no JSON are refused."""
    parsed = F.from_json("item", "paper_id bigint, category string, reason string")
    refused = F.raise_error(F.concat(F.lit("no draft: "), F.col("file"), F.lit(" "), F.left("item", F.lit(80))))
    whole = F.when(F.try_parse_json("item").isNotNull(), parsed).otherwise(refused.cast("struct<paper_id:bigint,category:string,reason:string>"))
    return items.withColumn("_i", whole)


def _labels_of(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        "dim",
        F.col("_i.paper_id").alias("pos"),
        F.col("_i.paper_id").alias("paper_id"),
        F.coalesce("_i.category", F.lit("")).alias("category"),
        F.coalesce("_i.reason", F.lit("")).alias("reason"),
        F.struct("file", F.col("start").alias("line"), F.col("n").alias("at")).alias("seq"),
    )


def item_labels(items: DataFrame) -> DataFrame:
    """Labels of draft items in paper order, the order every later step uses; ``seq`` is the
    place in the draft, which tells the last of several labels of a paper.  Texts that are no JSON are refused."""
    return _labels_of(_parsed_items(items))


def item_documents(items: DataFrame, block: int = BLOCK) -> DataFrame:
    """(dim, document): draft JSON with the items as they are, in documents of bounded size."""
    listed = F.sort_array(F.collect_list(F.struct("n", "item")))
    body = F.array_join(F.transform(listed, lambda x: x["item"]), ",")
    return (
        items.groupBy("dim", "file", "start", F.call_function("div", F.col("n"), F.lit(block)).alias("block"))
        .agg(body.alias("body"))
        .select("dim", F.concat(F.lit("{"), json_text(F.col("dim")), F.lit(":["), F.col("body"), F.lit("]}")).alias("document"))
    )


def read_draft(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a draft: files of one JSON object each, or of JSON lines, of any size.

    Items are parsed where they were found, by all tasks, and their fields are joined with the keys.
    """
    items, keys = _keyed_items(spark, path)
    # the value once: a projection above the join would parse in its few tasks
    parsed = _parsed_items(items).select("file", "start", "n", "closed_in", "grp", "_i").join(keys, PLACE)
    return _labels_of(parsed)


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, document): JSON objects or lists, one a line or one a file, of a path that must exist.

    A file whose first line is no document by itself, as in indented files, is read whole.
    What is no JSON either way is refused, naming the file.
    """
    placed = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
        F.trim("value").alias("document"),
    )
    placed = placed.where("document <> ''")
    lines = placed.drop("start")
    is_document = F.coalesce(F.schema_of_variant(F.try_parse_json("document")).rlike("^(OBJECT|ARRAY)"), F.lit(False))
    starts = lines.withColumn("ok", is_document).groupBy("file").agg(F.min_by("ok", "line").alias("first"), F.bool_and("ok").alias("all"))
    # (file, first): files of one document each, and broken ones; a table, as a folder may hold any number
    odd = settle(starts.where("NOT all").select("file", "first"), "whole-files")
    broken = odd.where("first").head()
    if broken:
        raise ValueError(f"neither a JSON object nor one in every line: {broken.file}")
    if odd.isEmpty():
        return lines
    # a file is put together from its lines, so its path never has to be known to the driver
    at = F.sort_array(F.collect_list(F.struct("start", "line", "document")))
    whole = placed.join(odd, "file", "left_semi").groupBy("file").agg(F.array_join(at["document"], "\n").alias("document"))
    whole = whole.select("file", F.lit(0).cast("long").alias("line"), F.trim("document", F.lit("\r\n\t ")).alias("document"))
    refused = F.raise_error(F.concat(F.lit("neither a JSON object nor one in every line: "), F.col("file")))
    closed = F.col("document").endswith("}") | F.col("document").endswith("]")
    checked = F.when(is_document & closed, F.col("document")).otherwise(refused.cast("string"))
    return lines.join(odd, "file", "left_anti").unionByName(whole.withColumn("document", checked))


def write_draft(labels: DataFrame, path: str, block: int = BLOCK) -> None:
    """Draft as JSON lines, one folder per dimension."""
    draft_documents(labels, block).select("dim", F.col("document").alias("value")).write.partitionBy("dim").mode(
        "overwrite"
    ).text(path)


# ---- taxonomies: {dim: {"Default": [category]}} -----------------------------


def taxonomy_documents(taxonomy: DataFrame) -> DataFrame:
    """One JSON object per dimension; a dimension holds at most ``limit_cats`` categories."""
    extra = F.col("extra") if "extra" in taxonomy.columns else F.lit(None).cast("string")
    category = with_members(F.to_json(F.struct(*TAXONOMY_FIELDS)), extra)
    ordered = F.sort_array(F.collect_list(F.struct("pos", category.alias("category"))))
    listed = F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["category"]), ","), F.lit("]"))
    groups = F.sort_array(F.collect_list(F.concat(json_text(F.col("grp")), F.lit(":"), F.col("categories"))))
    return (
        taxonomy.groupBy("dim", "grp")
        .agg(listed.alias("categories"))
        .groupBy("dim")
        .agg(F.array_join(groups, ",").alias("groups"))
        .select("dim", F.concat(F.lit("{"), json_text(F.col("dim")), F.lit(":{"), F.col("groups"), F.lit("}}")).alias("document"))
    )


def parse_taxonomies(documents: DataFrame, column: str = "document") -> DataFrame:
    """Taxonomy rows of JSON documents; ``keywords`` may be a list or a text, fields of other names go to ``extra``."""
    texts = "map<string,string>"
    dims = documents.select(F.explode(F.from_json(column, texts)).alias("dim", "_groups"))
    groups = dims.select("dim", F.explode(F.from_json("_groups", texts)).alias("grp", "_items"))
    c = F.col("c")
    listed = groups.select("dim", "grp", F.posexplode(F.from_json("_items", "array<string>")).alias("pos", "item"))
    return listed.withColumn("c", F.try_parse_json("item")).select(
        "dim",
        "grp",
        F.col("pos").cast("long").alias("pos"),
        F.coalesce(F.try_variant_get(c, "$.name", "string"), F.lit("")).alias("name"),
        text_at(c, "$.definition").alias("definition"),
        text_at(c, "$.judgment_suggestions").alias("judgment_suggestions"),
        list_at(c, "$.keywords").alias("keywords"),
        list_at(c, "$.typical_cases").alias("typical_cases"),
        other_members(F.col("item"), TAXONOMY_FIELDS).alias("extra"),
    )


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _absent(error: AnalysisException) -> bool:
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_taxonomy_json(spark: SparkSession, path: str) -> DataFrame:
    """Taxonomy files of one JSON object, or of one per line; no file gives an empty taxonomy."""
    try:
        return parse_taxonomies(json_documents(spark, path))
    except AnalysisException as e:
        if _absent(e):
            return empty(spark, TAXONOMY)
        raise


def read_table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet table, or an empty one while it has not been written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if _absent(e):
            return empty(spark, schema)
        raise


# ---- category schemas --------------------------------------------------------


def categories_inline(df: DataFrame, column: str) -> DataFrame:
    """(pos, name) rows for each comma list in ``column``; other columns are kept."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.posexplode(split_list(F.col(column))).alias("pos", "name")).withColumn(
        "pos", F.col("pos").cast("long")
    )


def read_categories(spark: SparkSession, schema: str) -> DataFrame | str:
    """categories(pos, name, definition) from a file or an inline comma list.

    A file may hold a JSON list, a JSON object of name to definition, or one
    name per line; blank names are dropped.  A JSON text is free wording for the
    prompt and is returned as it is.
    """
    try:
        document = spark.read.text(schema, wholetext=True).select("value") if schema else None
    except AnalysisException as e:
        if not _absent(e):
            raise
        document = None
    if document is None:
        inline = spark.range(1).select(F.lit(schema).alias("value"))
        return categories_inline(inline, "value").withColumn("definition", F.lit(None).cast("string"))
    text = document.head().value  # a user's own category list
    one = spark.range(1).select(F.lit(text).alias("value"))
    v = F.try_parse_json(F.col("value"))
    kind = one.select(F.schema_of_variant(v)).head()[0] or ""
    if kind == "STRING":
        return one.select(F.try_variant_get(v, "$", "string")).head()[0]
    if kind.startswith("ARRAY<"):
        rows = F.posexplode(F.transform(F.try_variant_get(v, "$", "array<string>"), clean_text)).alias("pos", "name")
        named = one.select(rows).withColumn("definition", F.lit(None).cast("string"))
    elif kind.startswith("OBJECT<"):
        entries = F.map_entries(F.from_json("value", "map<string,string>"))
        named = one.select(F.posexplode(entries).alias("pos", "e")).select("pos", F.col("e.key").alias("name"), F.col("e.value").alias("definition"))
    else:
        lines = F.filter(F.transform(F.split("value", "\n"), clean_text), lambda x: x != "")
        named = one.select(F.posexplode(lines).alias("pos", "name")).withColumn("definition", F.lit(None).cast("string"))
    return named.where("name <> ''").withColumn("pos", F.col("pos").cast("long"))


def schema_text(categories: DataFrame) -> DataFrame:
    """One row: the categories as the prompt shows them.

    Plain names give bullet lines, names with definitions a JSON object, both in order.
    """
    ordered = F.sort_array(F.collect_list(F.struct("pos", "name", "definition")))
    return categories.agg(ordered.alias("c")).select(
        F.when(
            F.exists("c", lambda c: c["definition"].isNotNull()),
            F.to_json(F.map_from_arrays(F.transform("c", lambda c: c["name"]), F.transform("c", lambda c: c["definition"])), {"pretty": "true"}),
        )
        .otherwise(F.array_join(F.transform("c", lambda c: F.concat(F.lit("- "), c["name"])), "\n"))
        .alias("schema_text")
    )
