"""Intermediate tables in the shared checkpoint folder.

A table written here is computed once, survives the loss of executors, cuts the
lineage, and gives Catalyst its true size, so that a later join is broadcast
only when the written files are below ``spark.sql.autoBroadcastJoinThreshold``.
Every application has a folder of its own, which ``clear`` removes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir`` or by the context's checkpoint folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return folder


def own_folder(spark: SparkSession) -> str:
    return f"{scratch_folder(spark).rstrip('/')}/corpusloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once and go on from the written table.

    ``by`` names a column of few values to make folders of, for partition pruning.
    """
    path = new_path(df.sparkSession, label)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system for ``path`` and the path as it takes it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def clear(spark: SparkSession) -> None:
    """Remove all scratch tables of this application; results still read from them are gone."""
    store, folder = file_system(spark, own_folder(spark))
    store.delete(folder, True)


def discard(*tables: DataFrame, part: str = "") -> None:
    """Remove the files of settled tables that nothing reads any more, or those in their folder ``part``."""
    for table in tables:
        spark = table.sparkSession
        folder = own_folder(spark)
        mark = f"/{folder.rsplit('/', 1)[1]}/"
        names = {f.split(mark, 1)[1].split("/", 1)[0] for f in table.inputFiles() if mark in f}
        for name in names:
            store, at = file_system(spark, f"{folder}/{name}/{part}".rstrip("/"))
            store.delete(at, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries run within leave no shuffle files behind, which else stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Run flows that write their results, and remove what they left behind."""
    try:
        yield
    finally:
        clear(spark)


def swap(df: DataFrame, path: str, write=None) -> None:
    """Put ``df`` in the place of ``path``, which it may have been read from, by one write.

    The new files are written beside it and renamed.  Between the two renames the path does not exist, and a
    store that copies on rename takes as long as a write: ``sources.versions`` has neither, but readers of its own.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    new, old = f"{path.rstrip('/')}.new-{mark}", f"{path.rstrip('/')}.old-{mark}"
    (write or (lambda d, p: d.write.parquet(p)))(df, new)
    store, at = file_system(spark, path.rstrip("/"))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    if store.exists(at) and not store.rename(at, hadoop(old)):
        raise OSError(f"cannot move {path}")
    if not store.rename(hadoop(new), at):
        raise OSError(f"cannot move {new} to {path}")
    store.delete(hadoop(old), True)
