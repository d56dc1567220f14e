"""End-to-end jobs: the reference's scripts as Spark jobs with sinks.

Each job reads an utterance table in the reference schema (``audio`` struct,
``row_num``, ``transcription``, ``audio_duration``, ``transcription_length``,
``utt_id``, ``split``), runs the operators, and writes its outputs with
Spark writers (overwrite or append), so nothing passes through the driver.

    python -m wavelens.plans.jobs ingest   --duckdb a.duckdb,b.duckdb --splits train,test --out DIR
    python -m wavelens.plans.jobs quality  --utterances DIR --out LOG_DIR
    python -m wavelens.plans.jobs duration --utterances DIR --out REPORT_DIR
    python -m wavelens.plans.jobs profile  --utterances DIR --out DIR
    python -m wavelens.plans.jobs prepare  --utterances DIR --out DIR
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelens.operators import labels as lb
from wavelens.operators import profile as pf
from wavelens.operators import quality as qc
from wavelens.sources import catalog as cat
from wavelens.sources.materialize import input_signature, materialize

FINDINGS_COLUMNS = ["check", "split", "utt_id", "column", "value", "message"]


def ingest_duckdb(spark: SparkSession, files: dict[str, str], out: str, id_column: str = "__hf_index_id") -> DataFrame:
    """A5 + A6: DuckDB split files (one per split) into one Parquet table
    partitioned by ``split``, reference columns renamed on the way."""
    from wavelens.sources.duckdb_source import DuckDBDataSource
    spark.dataSource.register(DuckDBDataSource)
    frames = {name: cat.rename_reference_columns(
        spark.read.format("duckdb_file").option("paths", path).option("id_column", id_column).load())
        for name, path in files.items()}
    cat.write_splits(cat.combine_splits(frames), out)
    return cat.read_splits(spark, out)


def quality_findings_table(utts: DataFrame) -> DataFrame:
    """All checks of the cleaning script as rows ``(check, split, utt_id,
    column, value, message)``: missing values per column (D1), short and
    unreadable clips (B6, B9), duplicate counts (D6)."""
    missing = qc.missing_values(utts, ["split"]).select(
        F.lit("missing_values").alias("check"), "split", F.lit(None).cast("long").alias("utt_id"),
        "column", F.col("n_missing").cast("double").alias("value"),
        F.format_string("Missing values in %s: %s = %d", "split", "column", "n_missing").alias("message"))
    clips = qc.short_clip_messages(qc.with_clip_info(utts)).select(
        "check", "split", "utt_id", F.lit(None).cast("string").alias("column"),
        F.col("seconds").alias("value"), "message")
    dups = qc.duplicate_counts(utts).select(
        F.lit("duplicate_rows").alias("check"), "split", F.lit(None).cast("long").alias("utt_id"),
        F.lit(None).cast("string").alias("column"), F.col("n_duplicates").cast("double").alias("value"),
        F.format_string("Duplicate rows in %s dataset: %d", "split", "n_duplicates").alias("message"))
    return missing.unionByName(clips).unionByName(dups).select(*FINDINGS_COLUMNS)


def quality_job(utts: DataFrame, log_path: str, run_id: str | None = None, duplicates_path: str | None = None) -> None:
    """A10: add the findings of a run to the log table, a folder ``run_id=...`` for each run.
    A run that is done again (a retry after a failure) replaces its own folder and no
    other, so each finding of a run stands in the log once. ``run_id`` defaults to a digest of the
    input's files. With ``duplicates_path`` the duplicated rows themselves (D7) are
    listed there, in the same way."""
    run = F.lit(run_id or input_signature(utts)).alias("run_id")

    def put(df: DataFrame, path: str) -> None:
        (df.select("*", run).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("run_id").parquet(path))

    put(quality_findings_table(utts), log_path)       # never empty: every column has a row of missing values
    if duplicates_path:
        put(qc.duplicate_rows(utts.drop("audio"), subset=["transcription"]), duplicates_path)


def duration_job(utts: DataFrame, report_path: str, on_error: str = "record") -> None:
    """The three-line duration report, overwritten as text (three rows:
    one small file). ``on_error='fail'`` stops at the first clip that cannot be
    read, as the reference's report does; ``'record'`` leaves it out of the hours."""
    clips = qc.with_clip_info(utts)
    if on_error == "fail":
        clips = qc.clip_errors(clips, on_error="fail")
    lines = qc.duration_report_lines(qc.duration_totals(clips))
    lines.orderBy("line_no").select("value").coalesce(1).write.mode("overwrite").text(report_path)


def profile_job(utts: DataFrame, out: str) -> None:
    """D8-D18 for both numeric columns, one Parquet table each."""
    p = pf.profile_frame(utts)
    cat_df = pf.cut_categories(p, "audio_duration", ["split"])
    tables = {
        "correlation": pf.correlation(p, ["audio_duration", "transcription_length", "n_words"], ["split"]),
        "scatter": pf.scatter_points(p, "audio_duration", "transcription_length"),
        "category_counts": pf.category_counts(cat_df),
        "box_by_category": pf.box_stats(cat_df, "transcription_length", ["split", "category"]),
        "violin": pf.kde(cat_df, "transcription_length", ["split", "category"], grid=pf.VIOLIN_GRID,
                         cut=pf.VIOLIN_CUT, bins=None),
        "ecdf_audio_duration": pf.ecdf(p, "audio_duration", ["split"]),
        "pair_points": pf.pair_points(p, ["audio_duration", "transcription_length", "n_words"]),
    }
    for col in ("audio_duration", "transcription_length"):
        tables[f"histogram_{col}"] = pf.histogram(p, col, ["split"])
        tables[f"kde_{col}"] = pf.kde(p, col, ["split"])
        tables[f"box_{col}"] = pf.box_stats(p, col, ["split"])
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out.rstrip('/')}/{name}")


def prepare_job(utts: DataFrame, out: str, max_length: int = lb.MAX_LABEL_LENGTH) -> DataFrame:
    """F18 + A7: dictionary from the training split, prepared rows of every
    split, stored under a parameter fingerprint and reused when present."""
    train = utts.filter(F.col("split") == "train").select("transcription")
    key = {"out": out, "max_length": max_length, "input": input_signature(utts)}
    dictionary = lb.build_dictionary(train, store_key={**key, "part": "dictionary"})
    prepared = lb.prepare_split(utts, dictionary, max_length)
    return materialize(prepared, "prepared", {**key, "part": "rows"}, base=out, partition_by=("split",))


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="wavelens.plans.jobs")
    ap.add_argument("job", choices=["ingest", "quality", "duration", "profile", "prepare"])
    ap.add_argument("--utterances")
    ap.add_argument("--duckdb", help="comma-separated DuckDB files (ingest)")
    ap.add_argument("--splits", help="comma-separated split names, same order as --duckdb")
    ap.add_argument("--out", required=True)
    a = ap.parse_args(argv)
    from wavelens.session import get_session
    spark = get_session()
    if a.job == "ingest":
        ingest_duckdb(spark, dict(zip(a.splits.split(","), a.duckdb.split(","))), a.out)
        return
    utts = cat.read_splits(spark, a.utterances, cat.UTTERANCE_SCHEMA)
    {"quality": quality_job, "duration": duration_job, "profile": profile_job, "prepare": prepare_job}[a.job](
        utts, a.out)


if __name__ == "__main__":
    main()
