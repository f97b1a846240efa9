"""Tables in versions: readers meet the old or the new rows, whatever step a writer was lost at.

A version is a folder of its own beside the others.  It becomes the current one by a single empty file, whose
name holds its number and its folder; the file with the highest number counts.  Nothing is renamed or
overwritten, so stores that copy on rename lose no time, and a path never ceases to exist.  Versions that are no
longer current stay for readers that have begun, and go when KEPT newer ones have been written.

A table in buckets is a version that lists one folder per bucket, so that an update writes the buckets that
it changes and names the folders of the others again.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions.text import quoted
from corpusloom.operators.scratch import file_system, settle

#: Versions that are kept, the current one included.
KEPT = 2
POINTER = re.compile(r"_current-(\d{12})-(.+)")
BUCKETS = "bucket int, folder string"


def _pointers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of all versions, the current one last."""
    store, at = file_system(spark, path)
    if not store.exists(at):
        return []
    names = [POINTER.fullmatch(s.getPath().getName()) for s in store.listStatus(at)]
    return sorted((int(m[1]), m[2]) for m in names if m)


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the current version; None while there is none."""
    found = _pointers(spark, path)
    return f"{path.rstrip('/')}/{found[-1][1]}" if found else None


def _point(spark: SparkSession, path: str, folder: str) -> None:
    """Make ``folder`` the current version: the one step that readers see."""
    number = max([n for n, _ in _pointers(spark, path)], default=0) + 1
    store, at = file_system(spark, f"{path.rstrip('/')}/_current-{number:012d}-{folder}")
    if not store.createNewFile(at):
        raise OSError(f"cannot make {folder} the current version of {path}")


def _prune(spark: SparkSession, path: str, keep: int = KEPT) -> None:
    """Remove what no kept version names."""
    found = _pointers(spark, path)
    store, _ = file_system(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for number, folder in found[:-keep]:
        store.delete(hadoop(f"{path.rstrip('/')}/_current-{number:012d}-{folder}"), False)
        store.delete(hadoop(f"{path.rstrip('/')}/{folder}"), True)


def _parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def put(df: DataFrame, path: str, write: Callable[[DataFrame, str], None] = _parquet) -> None:
    """Make ``df``, which may have been read from ``path``, the current version of the table there, by one write."""
    spark = df.sparkSession
    folder = f"_v-{uuid.uuid4().hex}"
    write(df, f"{path.rstrip('/')}/{folder}")
    _point(spark, path, folder)
    _prune(spark, path)


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The current version of a parquet table; with a ``schema``, an empty one while there is none."""
    folder = current(spark, path)
    if folder is None:
        if schema is None:
            raise FileNotFoundError(f"no version of a table in {path}")
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema) if schema else spark.read).parquet(folder)


# ---- buckets -----------------------------------------------------------------


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write_buckets(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """(bucket, folder) of the rows of ``df``, written to a folder per bucket below a new one."""
    spark = df.sparkSession
    group = f"_b-{uuid.uuid4().hex}"
    placed = df.withColumn("_bucket", bucket_of(quoted(key), buckets))
    settled = placed.repartition(buckets, "_bucket").write.partitionBy("_bucket")
    settled.parquet(f"{path.rstrip('/')}/{group}")
    store, at = file_system(spark, f"{path.rstrip('/')}/{group}")
    found = [s.getPath().getName() for s in store.listStatus(at)]
    rows = [(int(n.split("=")[1]), f"{group}/{n}") for n in found if n.startswith("_bucket=")]
    return spark.createDataFrame(rows, BUCKETS)


def _folders(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(bucket, folder) of the current version: as many rows as there are buckets."""
    return sorted(tuple(r) for r in read(spark, path, BUCKETS).collect())


def put_buckets(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Make ``df`` the current version of a table in ``buckets`` folders by a hash of ``key``."""
    written = _write_buckets(df, path, key, buckets)
    put(written.coalesce(1), path)


def read_buckets(spark: SparkSession, path: str, only: set[int] | None = None) -> DataFrame:
    """The rows of the current version, or of some of its buckets; columns that a bucket lacks are null."""
    folders = [f"{path.rstrip('/')}/{f}" for b, f in _folders(spark, path) if only is None or b in only]
    if not folders:
        raise FileNotFoundError(f"no such buckets in {path}")
    return spark.read.option("mergeSchema", "true").parquet(*folders)


def update_buckets(
    spark: SparkSession, path: str, key: str, buckets: int, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]
) -> list[int]:
    """Replace the rows of the buckets that ``changes`` has keys in by ``merge(rows, changes)``; other files stay.

    The numbers of the buckets written are returned: at most ``buckets``.
    """
    changes = settle(changes, "changes")
    hit = {r[0] for r in changes.select(bucket_of(quoted(key), buckets)).distinct().collect()}
    old = _folders(spark, path)
    hit &= {b for b, _ in old}
    if not hit:
        return []
    new = _write_buckets(merge(read_buckets(spark, path, hit), changes), path, key, buckets)
    kept = spark.createDataFrame([x for x in old if x[0] not in hit], BUCKETS)
    put(kept.unionByName(new).coalesce(1), path)
    return sorted(hit)


def drop_unused(spark: SparkSession, path: str) -> list[str]:
    """Remove folders that neither a kept version nor its list of buckets names, as lost writers leave them."""
    kept = {f for _, f in _pointers(spark, path)}
    for _, folder in _pointers(spark, path):
        listed = spark.read.parquet(f"{path.rstrip('/')}/{folder}")
        if listed.columns == ["bucket", "folder"]:
            kept |= {r.folder.split("/")[0] for r in listed.collect()}
    store, at = file_system(spark, path)
    names = [s.getPath().getName() for s in store.listStatus(at) if s.isDirectory()]
    gone = [n for n in names if n.startswith(("_v-", "_b-")) and n not in kept]
    for n in gone:
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{n}"), True)
    return gone
