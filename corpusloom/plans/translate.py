"""Translate flow: every distinct text once, in batches, then back into place."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions import prompts
from corpusloom.functions.text import quoted, split_argument
from corpusloom.operators.ask import Responder, once, semantic_map
from corpusloom.operators.lookup import HOT_ROWS, lookup
from corpusloom.operators.numbering import number_rows
from corpusloom.operators.scratch import settle
from corpusloom.sources.leaves import json_from_leaves, json_leaves

# Fixed values of the flow: texts looked at, and batch size by their mean length.
PROBE = 10
LONG, MEDIUM = 500, 100
SIZES = {"long": 1, "medium": 5, "short": 20}


def text_key(text: Column) -> Column:
    return F.sha2(text, 256)


def distinct_texts(df: DataFrame, columns: str | Iterable[str], row_id: str = "paper_id") -> DataFrame:
    """texts(col, text, first_id, n): distinct non-null texts of the columns that exist.

    One pass for all columns; copies are combined on the map side.  ``row_id`` is
    unique, so ``first_id`` orders the texts of a column as they are first seen.
    """
    present = [c for c in split_argument(columns) if c in df.columns]
    cells = F.array(
        *[F.struct(F.lit(c).alias("col"), quoted(c).cast("string").alias("text")) for c in present]
    )
    if not present:
        cells = F.from_json(F.lit("[]"), "array<struct<col:string,text:string>>")
    return (
        df.select(F.col(row_id).alias("_id"), F.explode(cells).alias("cell"))
        .select("_id", "cell.col", "cell.text")
        .where(F.col("text").isNotNull())
        .groupBy("col", "text")
        .agg(F.min("_id").alias("first_id"), F.count("*").alias("n"))
    )


def distinct_by_digest(df: DataFrame, columns: str | Iterable[str], row_id: str = "paper_id") -> DataFrame:
    """What distinct_texts gives, without moving texts to be grouped.

    Equal texts are told by a digest of 128 bits, and only digests are shuffled.  Then the rows that have a
    text first are read again: where their ids are few enough to be broadcast, by measured size, no text moves
    at all, otherwise each row once, and not even that in a table bucketed by ``row_id``.
    """
    present = [c for c in split_argument(columns) if c in df.columns]
    if not present:
        return distinct_texts(df, [], row_id)
    keys = [F.struct(F.lit(c).alias("col"), F.unhex(F.md5(quoted(c).cast("string"))).alias("key")) for c in present]
    firsts = (
        df.select(F.col(row_id).alias("_id"), F.explode(F.array(*keys)).alias("c"))
        .where(F.col("c.key").isNotNull())
        .groupBy("c.col", "c.key")
        .agg(F.min("_id").alias("first_id"), F.count("*").alias("n"))
    )
    # one narrow row per row that has some text first
    held = F.collect_list(F.struct("col", "n"))
    rows = settle(firsts.groupBy("first_id").agg(held.alias("_of")), "firsts")
    cells = F.array(*[F.struct(F.lit(c).alias("col"), quoted(c).cast("string").alias("text")) for c in present])
    found = df.select(F.col(row_id).alias("first_id"), cells.alias("_cells")).join(rows, "first_id")
    each = found.select("first_id", "_cells", F.explode("_of").alias("_o"))
    text = F.filter("_cells", lambda c: c["col"] == F.col("_o.col"))[0]["text"]
    return each.select("_o.col", text.alias("text"), "first_id", "_o.n")


def batch_size(texts: DataFrame) -> DataFrame:
    """(col, mean_length, batch_size) from the first ten distinct texts of a column.

    The sum of lengths is always divided by ten, also for fewer texts.  Lengths,
    not texts, are sorted, and each task passes on ten rows per column.
    """
    first = Window.partitionBy("col").orderBy("first_id")
    probe = (
        texts.select("col", "first_id", F.length("text").alias("chars"))
        .withColumn("_r", F.row_number().over(first))
        .where(F.col("_r") <= PROBE)
    )
    mean = F.sum("chars").cast("double") / PROBE
    size = (
        F.when(F.col("mean_length") > LONG, SIZES["long"])
        .when(F.col("mean_length") > MEDIUM, SIZES["medium"])
        .otherwise(SIZES["short"])
    )
    return probe.groupBy("col").agg(mean.alias("mean_length")).withColumn("batch_size", size.cast("long"))


def translate_batches(texts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(col, batch, batch_size, texts): texts packed in first-seen order, at most 20 each.

    ``batch`` counts the batches of a column.  Long texts, one to a batch, are not
    moved at all: their ``batch`` is the id of the row that has them first.
    """
    size_of = {r.col: r.batch_size for r in sizes.select("col", "batch_size").collect()}  # one row per column
    long = [c for c, size in size_of.items() if size == 1]
    short = [c for c, size in size_of.items() if size > 1]
    shape = ["col", "batch", "batch_size", "texts"]
    batches = texts.where(F.col("col").isin(long)).select(
        "col",
        F.col("first_id").cast("long").alias("batch"),
        F.lit(1).cast("long").alias("batch_size"),
        F.array("text").alias("texts"),
    )
    if not short:
        return batches
    size = F.coalesce(*[F.when(F.col("col") == c, F.lit(size_of[c]).cast("long")) for c in short])
    numbered = number_rows(
        texts.where(F.col("col").isin(short)).select("col", "first_id", "text"), [F.col("first_id")], within=["col"]
    )
    packed = (
        numbered.withColumn("batch_size", size)
        .withColumn("batch", F.call_function("div", F.col("pos") - 1, F.col("batch_size")))
        .groupBy("col", "batch", "batch_size")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("o"))
        .withColumn("texts", F.transform("o", lambda x: x["text"]))
        .select(*shape)
    )
    return batches.unionByName(packed) if long else packed


def batch_prompt(
    target_lang: str, one: str = prompts.TRANSLATE_TEXT, many: str = prompts.TRANSLATE_LIST
) -> Column:
    single = prompts.render(one, target_lang=target_lang, text=F.get("texts", F.lit(0)))
    listed = prompts.render(many, target_lang=target_lang, texts=F.to_json("texts"))
    return F.when(F.col("batch_size") == 1, single).otherwise(listed)


def translate_map(
    batches: DataFrame, responder: Responder, target_lang: str = "English", **options: object
) -> DataFrame:
    """translations(col, key, translated); ``key`` is the hash of the original text.

    Long texts are asked for one by one and answered as text, short ones in lists
    answered as a JSON object.  A text answered twice takes the later batch; a
    batch that failed is simply missing.  A Column responder may use col, batch,
    batch_size, texts and prompt.
    """
    asked = batches.withColumn("prompt", batch_prompt(target_lang))
    single, listed = asked.where("batch_size = 1"), asked.where("batch_size > 1")
    narrow = ["col", "batch", "prompt"]
    if isinstance(responder, Column):
        said_one = single.withColumn("response", once(responder))
        said_many = listed.withColumn("response", once(responder))
    else:
        # the lone text itself is needed beside its answer; only its key is carried
        said_one = semantic_map(
            single.select(*narrow, text_key(F.get("texts", F.lit(0))).alias("key")), "prompt", responder, parse="text", **options
        )
        said_many = semantic_map(listed.select(*narrow), "prompt", responder, parse="json", **options)
    key = F.col("key") if "key" in said_one.columns else text_key(F.get("texts", F.lit(0)))
    ones = said_one.where("response <> ''").select("col", key.alias("key"), "batch", F.col("response").alias("translated"))
    pairs = said_many.select("col", "batch", F.explode(F.from_json("response", "map<string,string>")).alias("text", "translated"))
    manys = pairs.where(F.col("translated").isNotNull()).select("col", text_key(F.col("text")).alias("key"), "batch", "translated")
    return (
        ones.unionByName(manys)
        .groupBy("col", "key")
        .agg(F.max(F.struct("batch", "translated")).alias("last"))
        .select("col", "key", "last.translated")
    )


def translate_apply(
    df: DataFrame,
    columns: str | Iterable[str],
    translations: DataFrame,
    counts: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    row_id: str = "paper_id",
) -> DataFrame:
    """Replace texts by their translation; texts without one stay.

    Keys of all columns are joined with the translations at once and brought back to one
    narrow row per ``row_id``, which is unique, so full rows are moved once at most.
    ``counts`` (texts with n, written) lets very frequent texts be spread.
    """
    present = [c for c in split_argument(columns) if c in df.columns]
    if not present:
        return df
    cells = F.array(*[F.struct(F.lit(c).alias("col"), text_key(quoted(c).cast("string")).alias("key")) for c in present])
    keyed = (
        df.select(F.col(row_id).alias("_id"), F.explode(cells).alias("c"))
        .select("_id", "c.col", "c.key")
        .where(F.col("key").isNotNull())
    )
    per_key = counts.select("col", text_key(F.col("text")).alias("key"), "n") if counts is not None else None
    found = lookup(keyed, translations.select("col", "key", "translated"), ["col", "key"], per_key, hot_rows)
    by_row = (
        found.where(F.col("translated").isNotNull())
        .groupBy("_id")
        .agg(*[F.max(F.when(F.col("col") == c, F.col("translated"))).alias(f"_t{i}") for i, c in enumerate(present)])
    )
    new = {c: F.coalesce(f"_t{i}", quoted(c).cast("string")).alias(c) for i, c in enumerate(present)}
    joined = df.join(by_row, df[row_id] == by_row["_id"], "left")
    return joined.select(*[new.get(c, df[f"`{c.replace('`', '``')}`"]) for c in df.columns])


def translate_columns(
    df: DataFrame,
    columns: str | Iterable[str],
    responder: Responder,
    target_lang: str = "English",
    row_id: str = "paper_id",
    **options: object,
) -> DataFrame:
    """``df`` with the given columns translated; missing columns are skipped."""
    if not [c for c in split_argument(columns) if c in df.columns]:
        return df
    texts = settle(distinct_by_digest(df, columns, row_id), "texts", by="col")
    # made of written tables, and written again as requests
    batches = translate_batches(texts, batch_size(texts))
    translations = settle(translate_map(batches, responder, target_lang, **options), "translations", by="col")
    return translate_apply(df, columns, translations, texts, row_id=row_id)


# ---- leaves of JSON documents ------------------------------------------------


def text_leaves(df: DataFrame, keys: list[str], texts: list[str], lists: list[str]) -> DataFrame:
    """(keys…, field, at, value): every text of the given columns, list items with their place."""
    singles = [
        F.struct(F.lit(c).alias("field"), F.lit(-1).alias("at"), quoted(c).alias("value")) for c in texts
    ]
    none = F.from_json(F.lit("[]"), "array<struct<field:string,at:int,value:string>>")

    def items_of(name: str) -> Column:
        def leaf(x: Column, i: Column) -> Column:
            return F.struct(F.lit(name).alias("field"), i.cast("int").alias("at"), x.alias("value"))

        return F.coalesce(F.transform(quoted(name), leaf), none)

    items = [items_of(c) for c in lists]
    leaves = F.concat(F.array(*singles), *items)
    return df.select(*keys, F.explode(leaves).alias("leaf")).select(*keys, "leaf.field", "leaf.at", "leaf.value")


def translate_values(
    leaves: DataFrame,
    responder: Responder,
    target_lang: str = "English",
    template: str = prompts.TRANSLATE_TEXT,
    hot_rows: int = HOT_ROWS,
    **options: object,
) -> DataFrame:
    """``leaves``, written, with (_key, value): every text longer than one character translated.

    Equal texts are asked for once.  A failed text stays as it is, and so does one whose key is null.
    A Column responder may use value and prompt.
    """
    worth = leaves.where(F.col("_key").isNotNull() & (F.length("value") > 1)).groupBy("_key", "value").agg(F.count("*").alias("n"))
    counts = settle(worth, "leaf_texts")
    asked = counts.select("_key", "value", prompts.render(template, target_lang=target_lang, text=F.col("value")).alias("prompt"))
    if isinstance(responder, Column):
        said = asked.withColumn("response", once(responder))
    else:
        said = semantic_map(asked.select("_key", "prompt"), "prompt", responder, parse="text", **options)
    table = settle(said.where("response <> ''").select("_key", F.col("response").alias("translated")), "leaf_answers")
    # values that were not asked for, most of them without a key, stay where they are: a join would bring them to one task
    was_asked = F.coalesce(F.col("_key").isNotNull() & (F.length("value") > 1), F.lit(False))
    found = lookup(leaves.where(was_asked), table, ["_key"], counts.select("_key", "n"), hot_rows)
    found = found.withColumn("value", F.coalesce("translated", "value")).drop("translated", "_key")
    return found.unionByName(leaves.where(~was_asked).drop("_key"))


def translate_leaves(
    df: DataFrame, keys: list[str], texts: list[str], lists: list[str], responder: Responder, **options: object
) -> DataFrame:
    """Translate all texts longer than one character inside the rows of ``df``, as translate_values does."""
    leaves = settle(text_leaves(df, keys, texts, lists).withColumn("_key", text_key(F.col("value"))), "leaves")
    done = translate_values(leaves, responder, **options)
    # back to one row per document row: its own few leaves
    picked = [
        F.max(F.when(F.col("field") == c, F.col("value"))).alias(f"_t{i}") for i, c in enumerate(texts)
    ] + [
        F.sort_array(F.collect_list(F.when(F.col("field") == c, F.struct("at", "value")))).alias(f"_l{i}")
        for i, c in enumerate(lists)
    ]
    rebuilt = done.groupBy(*keys).agg(*picked)
    values = {c: F.col(f"_t{i}") for i, c in enumerate(texts)}
    for i, c in enumerate(lists):
        values[c] = F.when(quoted(c).isNotNull(), F.transform(f"_l{i}", lambda x: x["value"]))
    joined = df.join(rebuilt, keys, "left")
    return joined.select(*[values[c].alias(c) if c in values else quoted(c) for c in df.columns])


def translate_json(
    documents: DataFrame, keys: list[str], responder: Responder, column: str = "document", **options: object
) -> DataFrame:
    """``documents`` with all texts of the JSON in ``column`` translated, whatever its shape.

    Keys, their order and values that are no texts stay; ``keys`` tell the documents apart.
    """
    leaves = json_leaves(documents, keys, column)
    leaves = settle(leaves.withColumn("_key", F.when(F.col("kind") == "text", text_key(F.col("value")))), "leaves")
    done = json_from_leaves(translate_values(leaves, responder, **options), keys, "_done")
    joined = documents.join(done, keys, "left")
    return joined.select(*[F.col("_done").alias(c) if c == column else quoted(c) for c in documents.columns])


def translate_taxonomy(taxonomy: DataFrame, responder: Responder, **options: object) -> DataFrame:
    """The texts of a taxonomy, also those of further fields; dimension and group names are keys and stay."""
    place = ["dim", "grp", "pos"]
    if "extra" in taxonomy.columns:
        whole = settle(taxonomy.withColumn("extra", F.concat(F.lit("{"), F.col("extra"), F.lit("}"))), "taxonomy")
        said = translate_json(whole, place, responder, "extra", **options)
        taxonomy = settle(said.withColumn("extra", F.expr("substring(extra, 2, length(extra) - 2)")), "taxonomy")
    return translate_leaves(
        taxonomy,
        ["dim", "grp", "pos"],
        ["name", "definition", "judgment_suggestions"],
        ["keywords", "typical_cases"],
        responder,
        **options,
    )


def translate_draft(labels: DataFrame, responder: Responder, **options: object) -> DataFrame:
    """The categories and reasons of a draft; several labels of a paper are told apart by ``seq``."""
    keys = ["dim", "pos", "paper_id", *(["seq"] if "seq" in labels.columns else [])]
    return translate_leaves(labels, keys, ["category", "reason"], [], responder, **options)
