"""Converge flow: merge the long tail of labels into a small taxonomy, label the papers.

Tables: labels(dim, pos, paper_id, category, reason); chunks(dim, round, labels,
new_labels); taxonomy(dim, grp, pos, name, ...); mapping(dim, label, final).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusloom.functions import prompts
from corpusloom.functions.responses import CATEGORY_TYPE, category_json, is_answer, label_mapping, parsed, refined_categories
from corpusloom.functions.text import check_names, clean_text, quoted, split_argument
from corpusloom.operators.ask import Responder, call_model, once, semantic_map
from corpusloom.operators.lookup import HOT_ROWS, lookup
from corpusloom.operators.numbering import number_rows
from corpusloom.operators.scratch import new_path, settle

# Fixed values of the flow.
CHUNK = 30
LIMIT_CATS = 10
CASES = 5
GROUP = "Default"
# dimensions that one task of a round takes
DIMS_PER_TASK = 1000
# rounds of a dimension that one job takes where a Rule answers: so many chunks and answers are in one row
STRETCH = 500


# ---- popularity ------------------------------------------------------------


def select_dims(labels: DataFrame, dims: str | Iterable[str] | None = None) -> DataFrame:
    """Labels of the requested dimensions (none given: all); unknown names are ignored.

    A literal filter, so tables partitioned by ``dim`` are pruned.
    """
    wanted = split_argument(dims)
    return labels.where(F.col("dim").isin(wanted)) if wanted else labels


def label_counts(labels: DataFrame) -> DataFrame:
    """(dim, category, n, first_pos): combined on the map side, so hot labels are cheap."""
    return labels.groupBy("dim", "category").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def label_rank(counts: DataFrame) -> DataFrame:
    """Add ``rank`` within the dimension: most papers first, ties by first position."""
    order = [F.col("n").desc(), F.col("first_pos"), F.col("category")]
    return number_rows(counts, order, within=["dim"], name="rank")


def label_chunks(ranked: DataFrame, size: int = CHUNK) -> DataFrame:
    """Add ``round``: chunks of ``size`` labels in order of popularity."""
    return ranked.withColumn("round", F.call_function("div", F.col("rank") - 1, F.lit(size)))


def chunk_text(chunked: DataFrame) -> DataFrame:
    """(dim, round, labels, new_labels): one row per chunk, at most ``size`` labels each."""
    line = F.concat(F.lit("- "), F.col("category"), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    ordered = F.sort_array(F.collect_list(F.struct("rank", "category", line.alias("line"))))
    return (
        chunked.groupBy("dim", "round")
        .agg(ordered.alias("o"))
        .select(
            "dim",
            "round",
            F.transform("o", lambda x: x["category"]).alias("labels"),
            F.array_join(F.transform("o", lambda x: x["line"]), "\n").alias("new_labels"),
        )
    )


# ---- rounds ----------------------------------------------------------------


def categories_json(categories: Column) -> Column:
    """A list of categories as the prompt shows it, with every field the model gave them."""
    return F.concat(F.lit("["), F.array_join(F.transform(categories, category_json), ","), F.lit("]"))


class Rule:
    """A responder made of Spark expressions: ``make`` gives the response of a chunk.

    It gets the Columns dim, round, labels, new_labels, categories and prompt by name, so that it can be
    asked again and again inside one expression.
    """

    def __init__(self, make: Callable[[dict[str, Column]], Column]):
        self.make = make


def _as_rule(spark: SparkSession, responder: Responder | Rule) -> Rule | None:
    """The rule of a responder that is one, or a Column that looks at no field."""
    if isinstance(responder, Rule) or not isinstance(responder, Column):
        return responder if isinstance(responder, Rule) else None
    try:
        spark.range(0).select(F.lit(None).alias("_none")).select(responder)
    except AnalysisException:
        return None
    return Rule(lambda _: responder)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is met."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _answer_of(response: Column, categories: Column, round_: Column) -> Column:
    """The row of ROUND_TYPE that a response makes: a failed call keeps the list; an answer replaces it, even by an empty one."""

    def row(said: Column, v: Column, ok: Column) -> Column:
        return F.struct(
            ok.alias("response_ok"),
            F.when(ok, refined_categories(said)).otherwise(categories).alias("categories"),
            F.when(ok, label_mapping(v)).alias("mapping"),
            round_.alias("round"),
        )

    return _bound(response, lambda said: _bound(parsed(said), lambda v: _bound(is_answer(v), lambda ok: row(said, v, ok))))


ROUND_TYPE = f"struct<response_ok:boolean,categories:array<{CATEGORY_TYPE}>,mapping:map<string,string>,round:bigint>"


def _rounds_by_rule(chunks: DataFrame, rule: Rule, prompt: Callable[..., Column]) -> DataFrame:
    """converge_rounds where a rule answers: a job per STRETCH rounds, in which each dimension runs through its chunks."""
    spark = chunks.sparkSession
    path = new_path(spark, "rounds")
    queue = settle(chunks.withColumn("stretch", F.call_function("div", F.col("round"), F.lit(STRETCH))), "chunks", by="stretch")
    last = queue.agg(F.max("stretch")).head()[0]
    schema = "dim string, response_ok boolean, categories array<{}>, mapping map<string,string>, round bigint".format(CATEGORY_TYPE)
    if last is None:
        return spark.createDataFrame([], schema)
    none = F.from_json(F.lit("[]"), f"array<{CATEGORY_TYPE}>")
    step = F.when(F.col("round").isNotNull(), F.struct("round", "labels", "new_labels"))

    def ask(state: Column, chunk: Column) -> Column:
        fields = {"dim": F.col("dim"), "categories": state["categories"], **{c: chunk[c] for c in ("round", "labels", "new_labels")}}
        said = rule.make({**fields, "prompt": prompt(fields)})
        return _bound(
            _answer_of(said, state["categories"], chunk["round"]),
            lambda r: F.struct(r["categories"].alias("categories"), F.concat(state["rounds"], F.array(r)).alias("rounds")),
        )

    for s in range(last + 1):
        now = queue.where(F.col("stretch") == s).drop("stretch").withColumn("categories", F.lit(None).cast(f"array<{CATEGORY_TYPE}>"))
        if s:
            # a dimension's list as the last round of the stretch before left it
            before = spark.read.schema(schema).parquet(f"{path}/r={s - 1}").where(F.col("round") == s * STRETCH - 1)
            now = now.unionByName(before.select("dim", "categories"), allowMissingColumns=True)
        each = now.groupBy("dim").agg(
            F.sort_array(F.collect_list(step)).alias("steps"), F.first("categories", ignorenulls=True).alias("categories")
        )
        start = F.struct(F.coalesce("categories", none).alias("categories"), F.array().cast(f"array<{ROUND_TYPE}>").alias("rounds"))
        found = each.select("dim", F.explode(F.aggregate("steps", start, ask)["rounds"]).alias("r"))
        found.select("dim", "r.*").write.parquet(f"{path}/r={s}")
    return spark.read.schema(schema).parquet(path).drop("r")


def converge_rounds(
    chunks: DataFrame,
    responder: Responder | Rule,
    limit_cats: int = LIMIT_CATS,
    guide: str | None = None,
    template: str = prompts.CONVERGE,
    output_lang: str = "English",
    **options: object,
) -> DataFrame:
    """rounds(dim, response_ok, categories, mapping, round), one row per chunk.

    Round r sends chunk r of every dimension at once; chunks of one dimension
    follow each other, as each prompt holds the categories of the one before.
    A round is one small job over one row per dimension, without a shuffle up to
    DIMS_PER_TASK of them, written before the next one reads it, so every request is sent once; with a ``cache_path`` a run that
    broke off finds its answers again.  A Column responder may use dim, round,
    labels, new_labels, categories and prompt.  With a Rule, or a Column that uses none of them, a job takes
    STRETCH rounds.
    """
    spark = chunks.sparkSession

    def prompt_of(fields: dict[str, Column]) -> Column:
        known = fields["categories"]
        return prompts.render(
            template,
            dim_name=fields["dim"],
            new_labels=fields["new_labels"],
            existing_taxonomy=F.when(F.size(known) > 0, categories_json(known)).otherwise(F.lit("None")),
            limit_cats=limit_cats,
            researcher_guide=guide or prompts.NO_GUIDE,
            output_lang=output_lang,
        )

    rule = _as_rule(spark, responder)
    if rule is not None:
        return _rounds_by_rule(chunks, rule, prompt_of)
    path = new_path(spark, "rounds")
    queue = new_path(spark, "chunks")
    # a folder per round: which one is read stands in no expression, so that the generated
    # code of the first rounds serves all others
    chunks.withColumn("folder", F.col("round")).repartition("folder").write.partitionBy("folder").parquet(queue)
    queued = StructType([*chunks.schema.fields, StructField("folder", LongType())])
    last, dims = spark.read.schema(queued).parquet(queue).agg(F.max("round"), F.countDistinct("dim")).head()
    schema = (
        f"dim string, response_ok boolean, categories array<{CATEGORY_TYPE}>, mapping map<string,string>, round bigint"
    )
    if last is None:
        return spark.createDataFrame([], schema)
    none = F.from_json(F.lit("[]"), f"array<{CATEGORY_TYPE}>")
    prompt = prompt_of({c: F.col(c) for c in ("dim", "new_labels", "categories")})
    v = F.col("_answer")
    ok = F.col("response_ok")
    result = [
        F.col("dim"),
        ok,
        # a failed call keeps the list; an answer replaces it, even by an empty one
        F.when(ok, refined_categories(F.col("_response"))).otherwise(F.col("categories")).alias("categories"),
        F.when(ok, label_mapping(v)).alias("mapping"),
        F.col("round"),
    ]
    response = once(responder) if isinstance(responder, Column) else F.col("response")
    for r in range(last + 1):
        now = spark.read.schema(chunks.schema).parquet(f"{queue}/folder={r}")
        if r:
            before = spark.read.schema(schema).parquet(f"{path}/r={r - 1}").select("dim", "categories")
            # chunk and state of a dimension meet in one task: one row of each
            both = now.unionByName(before, allowMissingColumns=True).coalesce(1 + dims // DIMS_PER_TASK)
            held = [F.first(c, ignorenulls=True).alias(c) for c in [*chunks.columns, "categories"] if c != "dim"]
            now = both.groupBy("dim").agg(*held).where(F.col("round").isNotNull())
        else:
            now = now.withColumn("categories", none)
        asked = now.withColumn("prompt", prompt)
        if not isinstance(responder, Column):
            narrow = asked.select("dim", "prompt")
            if "cache_path" in options:
                replies = semantic_map(narrow, "prompt", responder, **options)
            else:
                replies = call_model(narrow, "prompt", responder, rows=dims, **options)
            asked = replies.join(now.select("dim", "round", "categories"), "dim")
        read = asked.withColumn("_response", response).withColumn("_answer", parsed(F.col("_response"))).withColumn("response_ok", is_answer(v))
        read.select(*result).write.parquet(f"{path}/r={r}")
    return spark.read.schema(schema).parquet(path).drop("r")


def taxonomy_rows(rounds: DataFrame, limit_cats: int = LIMIT_CATS) -> DataFrame:
    """taxonomy rows of each dimension's last round, cut to ``limit_cats`` by position."""
    final = rounds.groupBy("dim").agg(F.max_by("categories", "round").alias("categories"))
    return cap_categories(
        final.select("dim", F.lit(GROUP).alias("grp"), F.posexplode("categories").alias("pos", "c")).select(
            "dim",
            "grp",
            F.col("pos").cast("long").alias("pos"),
            "c.name",
            "c.definition",
            "c.judgment_suggestions",
            "c.keywords",
            F.lit(None).cast("array<string>").alias("typical_cases"),
            "c.extra",
        ),
        limit_cats,
    )


def cap_categories(taxonomy: DataFrame, limit_cats: int = LIMIT_CATS) -> DataFrame:
    return taxonomy.where(F.col("pos") < limit_cats)


# ---- mapping ---------------------------------------------------------------


def compose_mapping(old: DataFrame, new: DataFrame) -> DataFrame:
    """One round: follow ``new`` one hop from ``old``, then let ``new`` override.

    Both are mapping(dim, label, final) with (dim, label) unique.
    """
    hop = new.select("dim", F.col("label").alias("final"), F.col("final").alias("hopped"))
    moved = old.join(hop, ["dim", "final"], "left").select(
        "dim", "label", F.coalesce("hopped", "final").alias("moved")
    )
    return moved.join(new, ["dim", "label"], "full").select(
        "dim", "label", F.coalesce("final", "moved").alias("final")
    )


def mapping_of(rounds: DataFrame) -> DataFrame:
    """mapping(dim, label, final) after all rounds, in log2(rounds) joins.

    The same result as composing round after round, which would rewrite the whole
    mapping each time.  A label starts from the last round that maps it; a value f
    given in round r then moves on with the first later round that maps f.  These
    moves form chains; following the chain of a chain doubles the reach each time.
    """
    edges = settle(
        rounds.select("dim", "round", F.explode("mapping").alias("label", "final")), "edges"
    )
    if edges.isEmpty():
        return edges.select("dim", "label", "final")
    # nodes: value f as it stands after round r (r rows per value and dimension at most)
    values = edges.select("dim", "round", F.col("final").alias("value")).distinct()
    keys = edges.select("dim", "round", F.col("label").alias("value"), F.lit(True).alias("is_key"))
    later = (
        Window.partitionBy("dim", "value").orderBy(F.desc("round")).rangeBetween(Window.unboundedPreceding, -1)
    )
    seen = values.withColumn("is_key", F.lit(False)).unionByName(keys)
    moves = (
        seen.withColumn("next", F.min(F.when(F.col("is_key"), F.col("round"))).over(later))
        .where(~F.col("is_key") & F.col("next").isNotNull())
        .select("dim", "round", "value", "next")
        .join(
            edges.select("dim", F.col("round").alias("next"), F.col("label").alias("value"), F.col("final").alias("to")),
            ["dim", "next", "value"],
        )
        .select("dim", "round", "value", F.col("next").alias("to_round"), F.col("to"))
    )
    chains = settle(moves, "moves")
    while True:
        onward = chains.select(
            "dim",
            F.col("round").alias("to_round"),
            F.col("value").alias("to"),
            F.col("to_round").alias("far_round"),
            F.col("to").alias("far"),
        )
        longer = chains.join(onward, ["dim", "to_round", "to"], "left")
        stepped = settle(
            longer.select(
                "dim",
                "round",
                "value",
                F.coalesce("far_round", "to_round").alias("to_round"),
                F.coalesce("far", "to").alias("to"),
                F.col("far").isNotNull().alias("moved"),
            ),
            "moves",
        )
        chains = stepped.drop("moved")
        if stepped.where("moved").isEmpty():
            break
    start = edges.groupBy("dim", "label").agg(F.max(F.struct("round", "final")).alias("s")).select(
        "dim", "label", F.col("s.round").alias("round"), F.col("s.final").alias("value")
    )
    return start.join(chains.select("dim", "round", "value", "to"), ["dim", "round", "value"], "left").select(
        "dim", "label", F.coalesce("to", "value").alias("final")
    )


# ---- labels onto papers ----------------------------------------------------


def final_labels(
    labels: DataFrame, mapping: DataFrame, counts: DataFrame | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """labels with ``final``; a label nobody mapped stays as it is.

    ``counts`` (from label_counts, written) lets very frequent labels be spread.
    """
    table = mapping.select("dim", F.col("label").alias("category"), "final")
    per_key = counts.select("dim", "category", "n") if counts is not None else None
    return lookup(labels, table, ["dim", "category"], per_key, hot_rows).withColumn(
        "final", F.coalesce("final", "category")
    )


def orphan_labels(final: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Final labels in use that the capped taxonomy does not list, with their papers."""
    used = final.groupBy("dim", "final").agg(F.count("*").alias("n"))
    named = taxonomy.select("dim", F.col("name").alias("final"))
    return used.join(named, ["dim", "final"], "left_anti")


def category_members(counts: DataFrame, mapping: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(dim, pos, name, label, n, first_pos): the raw labels filed under each category."""
    raw = counts.withColumnRenamed("category", "label")
    named = taxonomy.select("dim", "pos", F.col("name").alias("final"))
    return (
        raw.join(mapping, ["dim", "label"])
        .join(named, ["dim", "final"])
        .select("dim", "pos", F.col("final").alias("name"), "label", "n", "first_pos")
    )


def title_backfill(labels: DataFrame, papers: DataFrame, title: Column) -> DataFrame:
    """labels with ``title``; papers that are missing show as ID:n."""
    titles = papers.select("paper_id", clean_text(title).alias("title"))
    known = labels.join(titles, "paper_id", "left")
    return known.withColumn("title", F.coalesce("title", F.concat(F.lit("ID:"), F.col("paper_id").cast("string"))))


def first_papers(labels: DataFrame, mapping: DataFrame, taxonomy: DataFrame, k: int = CASES) -> DataFrame:
    """(dim, category_pos, name, rank, paper_id, reason): the first ``k`` papers of each category.

    First the k earliest papers of each raw label, then of each category: what
    is shuffled and joined is a handful of rows per label.
    """
    per_label = Window.partitionBy("dim", "category").orderBy("pos", "paper_id")
    early = labels.withColumn("_r", F.row_number().over(per_label)).where(F.col("_r") <= k).drop("_r")
    table = mapping.select("dim", F.col("label").alias("category"), F.col("final").alias("name"))
    named = taxonomy.select("dim", F.col("pos").alias("category_pos"), "name")
    # by position: two categories may share a name
    per_category = Window.partitionBy("dim", "category_pos").orderBy("pos", "paper_id")
    return (
        early.join(table, ["dim", "category"])
        .join(named, ["dim", "name"])
        .withColumn("rank", F.row_number().over(per_category).cast("long"))
        .where(F.col("rank") <= k)
        .select("dim", "category_pos", "name", "rank", "paper_id", "reason")
    )


def typical_cases(
    labels: DataFrame, mapping: DataFrame, taxonomy: DataFrame, papers: DataFrame, title: Column, k: int = CASES
) -> DataFrame:
    """(dim, pos, name, rank, case); only the papers chosen are looked up for their title."""
    first = settle(first_papers(labels, mapping, taxonomy, k), "cases")
    cited = papers.join(first.select("paper_id").distinct(), "paper_id", "left_semi")
    case = F.concat(F.lit("《"), F.col("title"), F.lit("》: "), F.col("reason"))
    return title_backfill(first, cited, title).select(
        "dim", F.col("category_pos").alias("pos"), "name", "rank", case.alias("case")
    )


def with_cases(taxonomy: DataFrame, cases: DataFrame) -> DataFrame:
    """taxonomy with its typical cases as a list (at most k per category)."""
    lists = (
        cases.groupBy("dim", "pos")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "case"))).alias("o"))
        .select("dim", "pos", F.transform("o", lambda x: x["case"]).alias("cases"))
    )
    none = F.array().cast("array<string>")
    return (
        taxonomy.join(lists, ["dim", "pos"], "left")
        .withColumn("typical_cases", F.coalesce("cases", none))
        .select(*taxonomy.columns)
    )


def label_columns(dim: str) -> list[str]:
    return [f"{dim}_raw_category", f"{dim}_category", f"{dim}_reason"]


def label_pivot(final: DataFrame, dims: list[str]) -> DataFrame:
    """One row per paper: raw label, final label and reason of each dimension.

    One aggregation by paper; when a paper has a dimension twice the last wins: by ``pos``,
    and where labels were read from a draft by ``seq``, their place in it.
    """
    check_names(c for d in dims for c in label_columns(d))
    place = ["seq"] if "seq" in final.columns else []
    per_dim = [
        F.max(F.when(F.col("dim") == d, F.struct("pos", *place, "category", "final", "reason"))).alias(f"_d{i}")
        for i, d in enumerate(dims)
    ]
    columns = []
    for i, d in enumerate(dims):
        raw, fin, why = label_columns(d)
        columns += [
            F.col(f"_d{i}.category").alias(raw),
            F.col(f"_d{i}.final").alias(fin),
            F.col(f"_d{i}.reason").alias(why),
        ]
    return final.where(F.col("dim").isin(dims)).groupBy("paper_id").agg(*per_dim).select("paper_id", *columns)


def label_papers(papers: DataFrame, wide: DataFrame) -> DataFrame:
    """Papers with their labels; labels of papers that do not exist are left out."""
    return papers.join(wide, "paper_id", "left")


def label_merge(base: DataFrame, wide: DataFrame, dims: list[str]) -> DataFrame:
    """Update the label columns of ``dims``: new values win, old ones stay, new columns start empty."""
    targets = [c for d in dims for c in label_columns(d)]
    check_names([*base.columns, *targets])
    fresh = wide.select("paper_id", *[quoted(c).alias(f"_new{i}") for i, c in enumerate(targets)])
    joined = base.join(fresh, "paper_id", "left")
    kept = [quoted(c) for c in base.columns if c not in targets]
    merged = [
        F.coalesce(F.col(f"_new{i}"), *([quoted(c)] if c in base.columns else []), F.lit("")).alias(c)
        for i, c in enumerate(targets)
    ]
    return joined.select(*kept, *merged)


def taxonomy_upsert(old: DataFrame, new: DataFrame, dims: DataFrame | None = None) -> DataFrame:
    """``new`` replaces the dimensions it was made for, the others stay.

    ``dims`` names them when some may have ended without any category.
    """
    replaced = (dims if dims is not None else new).select("dim").distinct()
    return old.join(replaced, "dim", "left_anti").unionByName(new, allowMissingColumns=True)


def converge(
    labels: DataFrame,
    responder: Responder | Rule,
    limit_cats: int = LIMIT_CATS,
    dims: str | Iterable[str] | None = None,
    papers: DataFrame | None = None,
    title: Column | None = None,
    chunk_size: int = CHUNK,
    counts: DataFrame | None = None,
    **options: object,
) -> tuple[DataFrame, DataFrame]:
    """(taxonomy, mapping) of the chosen dimensions; typical cases when papers are given.

    ``counts``, from label_counts of the chosen dimensions and written, spares counting them again.
    """
    chosen = select_dims(labels, dims)
    if counts is None:
        counts = settle(label_counts(chosen), "label_counts")
    chunks = chunk_text(label_chunks(label_rank(counts), chunk_size))
    rounds = converge_rounds(chunks, responder, limit_cats, **options)
    mapping = settle(mapping_of(rounds), "mapping")
    taxonomy = settle(taxonomy_rows(rounds, limit_cats), "taxonomy")
    if papers is not None and not taxonomy.isEmpty():
        cases = typical_cases(chosen, mapping, taxonomy, papers, title if title is not None else F.col("title"))
        taxonomy = settle(with_cases(taxonomy, cases), "taxonomy")
    return taxonomy, mapping
