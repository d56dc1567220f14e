"""Catalogue and scan helpers.

The reference listed the tables of each DuckDB file, read the first one and
printed its columns; here that is Spark's catalogue. Splits are one table
with a ``split`` column (or ``split=`` folders, so filters prune files).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Reference column names (left) and the names used here (right): the dots in
# two of them collide with struct field access.
REFERENCE_COLUMNS = {
    "audio": "audio",
    "Unnamed: 0": "row_num",
    "transcription": "transcription",
    "audio.duration": "audio_duration",
    "transcription.length": "transcription_length",
    "__hf_index_id": "utt_id",
}


# The utterance table as stored here (reference columns renamed, plus the
# split partition column): read with this schema, no inference.
UTTERANCE_SCHEMA = T.StructType([
    T.StructField("audio", T.StructType([T.StructField("bytes", T.BinaryType()),
                                         T.StructField("path", T.StringType())])),
    T.StructField("row_num", T.LongType()),
    T.StructField("transcription", T.StringType()),
    T.StructField("audio_duration", T.DoubleType()),
    T.StructField("transcription_length", T.LongType()),
    T.StructField("utt_id", T.LongType()),
    T.StructField("split", T.StringType()),
])


def rename_reference_columns(df: DataFrame) -> DataFrame:
    """Rename the reference's columns on ingest (backticks guard the dots)."""
    return df.select(*[F.col(f"`{c}`").alias(REFERENCE_COLUMNS.get(c, c)) for c in df.columns])


def list_tables(spark: SparkSession, db: str | None = None) -> DataFrame:
    """A3: the catalogue as a DataFrame ``(name, is_temporary)``, by name."""
    rows = [(t.name, bool(t.isTemporary)) for t in spark.catalog.listTables(db)]
    return spark.createDataFrame(sorted(rows), "name string, is_temporary boolean")


def first_table(spark: SparkSession, db: str | None = None, empty_schema=None) -> DataFrame | None:
    """A2: the first table by name (deterministic, unlike "whatever is
    listed first"). With an empty catalogue: an empty frame of
    ``empty_schema`` when given, else ``None`` (the reference printed a
    message and returned)."""
    names = sorted(t.name for t in spark.catalog.listTables(db) if db is None or not t.isTemporary)
    if names:
        return spark.table(names[0])
    return spark.createDataFrame([], empty_schema) if empty_schema is not None else None


def describe(df: DataFrame) -> DataFrame:
    """A4: columns as rows ``(position, name, type, nullable)``."""
    spark = df.sparkSession
    rows = [(i, f.name, f.dataType.simpleString(), bool(f.nullable)) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "position int, name string, type string, nullable boolean")


def combine_splits(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Per-split frames into one, tagged with ``split``."""
    out = None
    for name, df in frames.items():
        tagged = df.withColumn("split", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def write_splits(df: DataFrame, path: str) -> None:
    """Store a table partitioned by ``split`` (one folder per split)."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_splits(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A1 for stored splits: partition discovery gives the ``split`` column,
    and a filter on it reads only that folder."""
    r = spark.read.schema(schema) if schema is not None else spark.read
    return r.parquet(path)


def ordered_limit(df: DataFrame, n: int, order_cols=("utt_id",)) -> DataFrame:
    """``LIMIT n`` with an order added so the result repeats
    (Spark plans it as a top-k, not a full sort)."""
    return df.orderBy(*order_cols).limit(n)
