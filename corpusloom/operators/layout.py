"""Physical layout of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out over all cores when the scan has fewer splits than cores.

    An unsplittable file (quoted CSV) or one small row group is one task, and so is
    everything after it.  Scans of many splits are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
