"""Readers for the reference's text outputs.

Both are ``spark.read.text`` (or any frame of lines) plus ``regexp_extract``
and ``from_json``: no Python per line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The line formats written by the reference's scripts.
QUALITY_RE = r"Warning: Audio file at index (\d+) in (\w+) data is too short \(([0-9.]+) seconds\)"
ERROR_RE = r"Error processing audio at index (\d+) in (\w+) data: (.*)"
RESULTS_RE = r"Evaluation Results: (\{.*\})"


def parse_quality_log(lines: DataFrame, col: str = "value") -> DataFrame:
    """Short-clip warnings back to ``(utt_id, split_label, seconds)``;
    other lines are dropped."""
    m = F.regexp_extract(F.col(col), QUALITY_RE, 1)
    return (lines.filter(F.col(col).rlike(QUALITY_RE)).select(
        m.cast("long").alias("utt_id"),
        F.regexp_extract(F.col(col), QUALITY_RE, 2).alias("split_label"),
        F.regexp_extract(F.col(col), QUALITY_RE, 3).cast("double").alias("seconds")))


def parse_quality_errors(lines: DataFrame, col: str = "value") -> DataFrame:
    """Lines about unreadable clips back to ``(utt_id, split_label, error)``."""
    return lines.filter(F.col(col).rlike(ERROR_RE)).select(
        F.regexp_extract(F.col(col), ERROR_RE, 1).cast("long").alias("utt_id"),
        F.regexp_extract(F.col(col), ERROR_RE, 2).alias("split_label"),
        F.regexp_extract(F.col(col), ERROR_RE, 3).alias("error"))


def read_quality_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_quality_log(spark.read.text(path))


def parse_results(lines: DataFrame, col: str = "value", source_col: str | None = None) -> DataFrame:
    """``Evaluation Results: {...}`` lines (a Python dict repr) to a
    ``map<string,double>`` column ``metrics``; other lines are dropped."""
    body = F.regexp_extract(F.col(col), RESULTS_RE, 1)
    parsed = F.from_json(body, "map<string,double>", {"allowSingleQuotes": "true"})
    keep = [F.col(source_col)] if source_col else []
    return lines.filter(F.col(col).rlike(RESULTS_RE)).select(*keep, parsed.alias("metrics"))


def read_results(spark: SparkSession, glob: str) -> DataFrame:
    """A11 + J5: every results file under a glob; the model name is the
    folder above ``logs``."""
    lines = spark.read.text(glob, wholetext=True).withColumn("_file", F.input_file_name())
    parsed = parse_results(lines, source_col="_file")
    return parsed.select(F.regexp_extract("_file", r"([^/]+)/logs/[^/]+$", 1).alias("model"), "metrics")


def results_long(parsed: DataFrame, id_cols=("model",)) -> DataFrame:
    """Metric map to long rows ``(id..., metric, value)``."""
    return parsed.select(*id_cols, F.explode("metrics").alias("metric", "value"))
