"""Intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from wavelens.session import scratch_path


def fresh_path(spark: SparkSession, name: str) -> str:
    """A folder of its own for each call, under ``spark.checkpoint.dir``."""
    return scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex}")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: computed once, lineage cut, and no
    expression of it is evaluated again by what follows."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Within it, jobs hand texts to Python in batches of ``rows`` rows; the session's own
    setting comes back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
