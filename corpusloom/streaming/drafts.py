"""Drafts that grow with a folder of papers.

Every run takes the files that have arrived since the last one (``availableNow``) in batches, gives their papers
the next ids and appends their labels.  A batch has a folder of its own for its papers and for its draft and
replaces both when it is run again, so a driver lost half-way leaves nothing twice; with a ``cache_path`` in the
labelling its answers are found again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.functions.text import quoted
from corpusloom.operators.numbering import number_rows
from corpusloom.operators.scratch import file_system, settle
from corpusloom.sources import documents


def _batch_folders(spark: SparkSession, path: str, before: int) -> list[str]:
    """Folders of the batches before a number."""
    store, at = file_system(spark, path)
    names = [s.getPath().getName() for s in store.listStatus(at)] if store.exists(at) else []
    return [f"{path}/{n}" for n in names if n.startswith("batch=") and int(n[6:]) < before]


def explore_stream(
    spark: SparkSession,
    source: str,
    schema: str,
    output: str,
    label: Callable[[DataFrame], DataFrame],
    order: Sequence[str],
    max_files: int = 1000,
) -> DataFrame:
    """Labels of all papers so far; ``label`` gives the labels of papers, as ``explore.explore_labels`` does.

    ``source`` is a folder of parquet files that is only added to.  Papers of a batch are numbered by ``order``, unique
    in it, behind those of all batches before.  ``output`` holds papers, draft and the stream's checkpoint.
    """
    papers_path, draft_path = f"{output}/papers", f"{output}/draft"

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        earlier = _batch_folders(session, papers_path, number)
        taken = session.read.parquet(*earlier).count() if earlier else 0
        rows = settle(batch, "batch")
        # only the order columns are sorted
        numbers = number_rows(rows.select(*map(quoted, order)), [quoted(c) for c in order], name="paper_id", start=taken + 1)
        papers = rows.join(numbers, list(order))
        papers.write.mode("overwrite").parquet(f"{papers_path}/batch={number}")
        labels = settle(label(session.read.schema(papers.schema).parquet(f"{papers_path}/batch={number}")), "labels")
        documents.write_draft(labels, f"{draft_path}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    query = (
        stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{output}/_checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if not _batch_folders(spark, draft_path, 2**62):
        return documents.empty(spark, documents.LABELS).withColumn("seq", F.lit(None).cast("string"))
    return documents.read_draft(spark, draft_path)
