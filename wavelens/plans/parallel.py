"""Spreading CPU-heavy row work over the cluster.

A scan of a few large files (or a broadcast join on top of one) can leave a
whole stage in a handful of partitions. Before expensive per-row work (edit
distances, header decoding), ``spread`` hash-partitions the rows over at
least the cluster's default parallelism, and does nothing when the input
already has that many partitions, as a large scan does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def spread(df: DataFrame, keys: Sequence[str] = (), min_partitions: int | None = None) -> DataFrame:
    """Use on scan outputs: their partition count is known from planning
    alone (no job runs to find it)."""
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, *keys) if keys else df.repartition(target)
