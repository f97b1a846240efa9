"""The five flows from files to files.

Papers are given as exports (.csv, .tsv, .txt), folders of them, or a DataFrame as
``load_papers`` returns it.  Output is parquet, or CSV where ``as_csv`` is set.
``prompt_dir`` holds templates of the user's own, named as in TEMPLATES.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions import prompts
from corpusloom.functions.text import keyword_fallback, paper_text, split_argument
from corpusloom.operators.ask import Responder
from corpusloom.operators.scratch import file_system, settle, swap
from corpusloom.plans import classify as classes
from corpusloom.plans import converge as conv
from corpusloom.plans import explore as expl
from corpusloom.plans import relevance, translate
from corpusloom.sources import documents, sinks, versions
from corpusloom.sources.exports import load_papers, read_table

Papers = str | list[str] | DataFrame

TEMPLATES = {
    "filter_criteria": prompts.CRITERIA,
    "filter_score": prompts.SCORE,
    "explore": prompts.EXPLORE,
    "converge": prompts.CONVERGE,
    "classify": prompts.CLASSIFY,
}


def _template(spark: SparkSession, name: str, prompt_dir: str | None) -> str:
    return prompts.read_template(spark, f"{prompt_dir.rstrip('/')}/{name}.md") if prompt_dir else TEMPLATES[name]


def _papers(spark: SparkSession, papers: Papers, source_type: str) -> DataFrame:
    return papers if isinstance(papers, DataFrame) else load_papers(spark, papers, source_type)


def _write(df: DataFrame, path: str, as_csv: bool) -> None:
    if as_csv:
        sinks.write_csv(df, path)
    else:
        df.write.mode("overwrite").parquet(path)


def text_of(papers: DataFrame) -> Column:
    """Text of papers loaded by load_papers, with the keyword fallback."""
    keywords = keyword_fallback(F.col("paper_keywords"), papers.columns)
    return paper_text(F.col("paper_title"), F.col("paper_abstract"), keywords)


def filter_papers(
    spark: SparkSession,
    papers: Papers,
    output: str | None,
    topic: str,
    responder: Responder,
    criteria_responder: Responder | None = None,
    min_score: float = relevance.MIN_SCORE,
    source_type: str = "auto",
    output_lang: str = "English",
    prompt_dir: str | None = None,
    as_csv: bool = False,
    **options: object,
) -> DataFrame:
    """All papers with their scores; ``output`` gets those that passed, ``output``_all every one."""
    papers = _papers(spark, papers, source_type)
    text = text_of(papers)
    criteria = relevance.discover_criteria(
        papers,
        topic,
        text,
        responder if criteria_responder is None else criteria_responder,
        template=_template(spark, "filter_criteria", prompt_dir),
        output_lang=output_lang,
        **options,
    )
    scored = relevance.score_papers(
        papers,
        topic,
        criteria,
        text,
        responder,
        min_score,
        template=_template(spark, "filter_score", prompt_dir),
        output_lang=output_lang,
        **options,
    )
    return sinks.write_scored(scored, output, as_csv) if output else settle(scored, "scored")


def explore(
    spark: SparkSession,
    papers: Papers,
    output: str,
    responder: Responder,
    dims: str | Iterable[str] | None = None,
    guide: str | None = None,
    max_papers: int | None = None,
    source_type: str = "auto",
    output_lang: str = "English",
    prompt_dir: str | None = None,
    **options: object,
) -> DataFrame:
    """Draft labels, also written as JSON lines per dimension."""
    papers = _papers(spark, papers, source_type)
    labels = expl.explore_labels(
        papers,
        text_of(papers),
        responder,
        dims=dims,
        guide=guide,
        max_papers=max_papers,
        template=_template(spark, "explore", prompt_dir),
        output_lang=output_lang,
        **options,
    )
    labels = settle(labels, "labels")
    documents.write_draft(labels, output)
    return labels


def converge(
    spark: SparkSession,
    draft: str | DataFrame,
    output_taxonomy: str,
    responder: Responder,
    limit_cats: int = conv.LIMIT_CATS,
    dims: str | Iterable[str] | None = None,
    guide: str | None = None,
    papers: Papers | None = None,
    output_papers: str | None = None,
    source_type: str = "auto",
    output_lang: str = "English",
    prompt_dir: str | None = None,
    in_versions: bool = False,
    **options: object,
) -> DataFrame:
    """The updated taxonomy; other dimensions of ``output_taxonomy`` stay as they are.

    ``draft`` is a path of JSON lines or of whole JSON files.  ``output_taxonomy`` is a parquet
    table, or JSON, an object a line, where its name ends so.  ``output_papers``, a parquet table
    or (``.csv``) an export, has a ``paper_id``: when it exists its label columns are updated,
    otherwise it starts from ``papers``.  Without either of them no papers are written.  With ``in_versions``
    the parquet tables are kept as ``sources.versions`` does, to be read by it: then a run that is lost at any
    step leaves the old rows or the new ones.
    """
    labels = documents.read_draft(spark, draft) if isinstance(draft, str) else draft
    # parsed once; each dimension is a folder, so that unwanted ones are not read
    labels = settle(labels, "labels", by="dim")
    present = [r.dim for r in labels.select("dim").distinct().collect()]  # names of dimensions
    wanted = split_argument(dims)
    processed = [d for d in wanted if d in present] if wanted else sorted(present)
    if not processed:
        return documents.empty(spark, documents.TAXONOMY)
    if papers is not None:
        papers = _papers(spark, papers, source_type)
    chosen = conv.select_dims(labels, processed)
    counts = settle(conv.label_counts(chosen), "label_counts")
    taxonomy, mapping = conv.converge(
        labels,
        responder,
        limit_cats,
        processed,
        papers,
        F.col("paper_title"),
        counts=counts,
        guide=guide,
        template=_template(spark, "converge", prompt_dir),
        output_lang=output_lang,
        **options,
    )
    done = spark.createDataFrame([(d,) for d in processed], "dim string")
    if output_taxonomy.lower().endswith(".json"):
        old = documents.read_taxonomy_json(spark, output_taxonomy)
        updated = settle(conv.taxonomy_upsert(old, taxonomy, done), "taxonomy")
        lines = documents.taxonomy_documents(updated).select("document")
        swap(lines, output_taxonomy, lambda d, path: d.write.text(path))
    elif in_versions:
        versions.put(conv.taxonomy_upsert(versions.read(spark, output_taxonomy, documents.TAXONOMY), taxonomy, done), output_taxonomy)
        updated = versions.read(spark, output_taxonomy, documents.TAXONOMY)
    else:
        old = documents.read_table_or_empty(spark, output_taxonomy, documents.TAXONOMY)
        updated = sinks.replace_table(conv.taxonomy_upsert(old, taxonomy, done), output_taxonomy)
    if output_papers:
        as_csv = output_papers.lower().endswith(".csv")
        base = papers
        in_versions = in_versions and not as_csv
        store, at = file_system(spark, output_papers)
        if in_versions and versions.current(spark, output_papers):
            base = versions.read(spark, output_papers)
        elif not in_versions and store.exists(at):
            base = labelled_export(spark, output_papers) if as_csv else spark.read.parquet(output_papers)
        if base is not None:
            wide = conv.label_pivot(conv.final_labels(chosen, mapping, counts), processed)
            merged = conv.label_merge(base, wide, processed)
            if in_versions:
                versions.put(merged, output_papers)
            elif as_csv:
                swap(merged, output_papers, sinks.write_csv)
            else:
                swap(merged, output_papers)
    return updated


def labelled_export(spark: SparkSession, path: str) -> DataFrame:
    """Papers of an earlier converge run: a CSV file or a folder of them, with their ids."""
    store, at = file_system(spark, path)
    table = read_table(spark, f"{path.rstrip('/')}/*.csv" if store.getFileStatus(at).isDirectory() else path)
    if "paper_id" not in table.columns:
        raise ValueError(f"no paper_id in {path}")
    return table.withColumn("paper_id", F.col("paper_id").cast("long"))


def translate_file(
    spark: SparkSession,
    papers: Papers,
    output: str,
    responder: Responder,
    columns: str | Iterable[str] | None = None,
    target_lang: str = "English",
    as_csv: bool = True,
    **options: object,
) -> DataFrame:
    """Translated columns of an export, or all texts of a JSON document of any shape (.json).

    A draft may be a file of any size and gives its labels, a taxonomy its rows; other documents
    give (file, line, document).  Keys, their order and values that are no texts stay.  Any other file
    type, what is no JSON and a path that does not exist are refused.
    """
    if isinstance(papers, str) and papers.lower().rstrip("/").endswith(".json"):
        kind = documents.document_kind(spark, papers)
        options = {"target_lang": target_lang, **options}
        if kind == "draft":
            items = settle(documents.draft_ranges(spark, papers), "items")
            done = settle(translate.translate_json(items, ["file", "start", "n"], responder, "item", **options), "translated")
            lines = documents.item_documents(done).select("dim", F.col("document").alias("value"))
            lines.write.partitionBy("dim").mode("overwrite").text(output)
            return documents.item_labels(done)
        given = settle(documents.json_documents(spark, papers), "documents")
        done = settle(translate.translate_json(given, ["file", "line"], responder, **options), "translated")
        done.select("document").write.mode("overwrite").text(output)
        return documents.parse_taxonomies(done) if kind in (None, "taxonomy") else done
    if not split_argument(columns):
        raise ValueError("name the columns to translate")
    loaded = _papers(spark, papers, "auto")
    done = settle(translate.translate_columns(loaded, columns, responder, target_lang, **options), "translated")
    _write(done, output, as_csv)
    return done


def classify(
    spark: SparkSession,
    papers: Papers,
    output: str,
    schema: str,
    responder: Responder,
    mode: str = "single",
    guide: str | None = None,
    source_type: str = "auto",
    output_lang: str = "English",
    prompt_dir: str | None = None,
    as_csv: bool = False,
    **options: object,
) -> DataFrame:
    """Papers with the categories of ``schema``: a file (JSON or one per line) or a comma list."""
    papers = _papers(spark, papers, source_type)
    done = classes.classify(
        papers,
        documents.read_categories(spark, schema),
        text_of(papers),
        responder,
        mode,
        guide,
        template=_template(spark, "classify", prompt_dir),
        output_lang=output_lang,
        **options,
    )
    if as_csv:
        done = settle(done, "classified")
        sinks.write_csv(done, output)
        return done
    done.write.mode("overwrite").parquet(output)
    return spark.read.schema(done.schema).parquet(output)
