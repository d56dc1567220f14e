"""Loaders for the parquet tables.

Reads always go through ``spark.read.parquet`` so that Catalyst can prune
columns and push filters into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> list[str]:
    """Register each table as a temp view under its own name."""
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)
    return list(names)
