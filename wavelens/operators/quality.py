"""Data-quality checks on utterance splits.

Clip durations come from the WAV header bytes (F6); duplicate detection
shuffles on its key, the other checks only aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelens.functions import text as tx
from wavelens.functions.wav import add_clip_info

SHORT_CLIP_SECONDS = 1.0   # fixed value: clips strictly under one second are flagged
SPLIT_LABELS = {"train": "training", "validation": "validation", "test": "test"}


def with_clip_info(utts: DataFrame) -> DataFrame:
    """Add ``clip`` (F6/B9 struct) read from ``audio.bytes``; the bytes are
    dropped right after so they never reach a shuffle."""
    df = add_clip_info(utts.withColumn("audio_bytes", F.col("audio.bytes")), "audio_bytes", "clip")
    return df.drop("audio_bytes")


def missing_values(df: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Per group and column, rows that are NULL (or NaN for floating
    columns), in long form ``(group..., column, n_missing)``. One aggregate,
    then an unpivot of the one-row-per-group result."""
    cols = [f for f in df.schema.fields if f.name not in group_cols]
    aggs = []
    for f in cols:
        miss = F.col(f.name).isNull()
        if isinstance(f.dataType, T.StructType) and "path" in f.dataType.names:
            # whether the clip is there, put so that its path is asked for: then Spark reads only
            # that field of it, not its bytes
            there = F.concat(F.lit("x"), F.coalesce(F.col(f.name)["path"], F.lit("")))
            miss = F.when(miss, F.lit("")).otherwise(there) == ""
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            miss = miss | F.isnan(F.col(f.name))
        aggs.append(F.count_if(miss).cast("long").alias(f.name))
    wide = df.groupBy(*group_cols).agg(*aggs) if group_cols else df.agg(*aggs)
    return wide.unpivot(list(group_cols), [f.name for f in cols], "column", "n_missing")


def short_clips(clips: DataFrame, threshold: float = SHORT_CLIP_SECONDS) -> DataFrame:
    """Clips with duration strictly under ``threshold`` seconds."""
    return clips.filter(F.col("clip.duration") < F.lit(threshold))


def clip_errors(clips: DataFrame, on_error: str = "record") -> DataFrame:
    """Rows whose clip could not be read. ``on_error='fail'`` raises in
    the task (like a reader without capture); ``'record'`` keeps them."""
    bad = clips.filter(F.col("clip.error").isNotNull())
    if on_error == "fail":
        return clips.withColumn("clip", F.when(F.col("clip.error").isNull(), F.col("clip"))
                                .otherwise(F.raise_error(F.concat(F.lit("unreadable clip: "),
                                                                  F.col("clip.error")))))
    return bad


def duration_totals(clips: DataFrame, group_cols: Sequence[str] = ("split",)) -> DataFrame:
    """D2 + D3: total audio per split. Frames are summed as integers per
    sample rate first, then divided once per rate, so the total does not
    depend on row order. Clips that could not be read add no seconds and are
    counted beside the total."""
    per_rate = (clips.groupBy(*group_cols, F.col("clip.sample_rate").alias("rate"))
                .agg(F.sum("clip.frames").alias("frames"), F.count(F.lit(1)).alias("n"),
                     F.count("clip.error").alias("bad")))
    seconds = F.sum(F.col("frames").cast("double") / F.col("rate"))
    return (per_rate.groupBy(*group_cols).agg(
        (F.sum("n") - F.sum("bad")).alias("n_clips"), F.sum("bad").alias("n_unreadable"),
        F.coalesce(seconds, F.lit(0.0)).alias("total_seconds"))
        .withColumn("hours", F.round(F.col("total_seconds") / 3600.0, 2)))


def duration_report_lines(totals: DataFrame) -> DataFrame:
    """A9 text: the three report lines, in the order train, test, validation."""
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "test", 1).otherwise(2)
    return totals.select(
        order.alias("line_no"),
        F.format_string("Total duration of %s dataset: %s hours ", F.col("split"),
                        tx.two_decimals(F.col("total_seconds") / 3600.0)).alias("value"))


def short_clip_messages(clips: DataFrame, threshold: float = SHORT_CLIP_SECONDS) -> DataFrame:
    """A10 rows: ``(check, split, utt_id, seconds, message)`` per short clip
    and per unreadable clip, in one pass over the clips. ``utt_id`` is
    reported, not the row position. Seconds are formatted as Python does
    (F9)."""
    label = F.coalesce(F.create_map(*[x for k, v in SPLIT_LABELS.items() for x in (F.lit(k), F.lit(v))])
                       [F.col("split")], F.col("split"))
    err = F.col("clip.error")
    dur = F.col("clip.duration")
    found = clips.filter(err.isNotNull() | (dur < F.lit(threshold)))
    return found.select(
        F.when(err.isNull(), F.lit("short_clip")).otherwise(F.lit("unreadable")).alias("check"),
        "split", "utt_id", dur.alias("seconds"),
        F.when(err.isNull(), F.format_string(
            "Warning: Audio file at index %d in %s data is too short (%s seconds)",
            F.col("utt_id"), label, tx.two_decimals(dur)))
        .otherwise(F.format_string("Error processing audio at index %d in %s data: %s",
                                   F.col("utt_id"), label, err)).alias("message"))


def _key_cols(df: DataFrame, subset: Sequence[str] | None, exclude: Sequence[str]) -> list[str]:
    if subset:
        return list(subset)
    return [c for c in df.columns if c not in exclude]


def _duplicate_candidates(df: DataFrame, within: list[str], keys: list[str]):
    """Phase 1 of duplicate detection: a 96-bit fingerprint of the key
    columns (NULL-stable) is counted per split, shuffling fingerprints only.
    Rows whose fingerprint occurs once cannot be duplicates; the rest (the
    candidates) go to the exact phase 2 on the full key values, so a
    fingerprint collision costs work, never a wrong answer.
    Returns the fingerprinted rows, the per-fingerprint counts and the
    candidate rows."""
    hashed = df.withColumns({"_h1": F.xxhash64(*keys), "_h2": F.hash(*keys)})
    counts = hashed.groupBy(*within, "_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"))
    cand = counts.filter(F.col("_n") > 1).select(*[F.col(c).alias(f"_c_{c}") for c in within],
                                                F.col("_h1").alias("_c_h1"), F.col("_h2").alias("_c_h2"))
    cond = ([hashed[c].eqNullSafe(F.col(f"_c_{c}")) for c in within]
            + [hashed["_h1"] == F.col("_c_h1"), hashed["_h2"] == F.col("_c_h2")])
    rows = hashed.join(cand, cond, "left_semi").drop("_h1", "_h2")
    return hashed, counts, rows


def duplicate_rows(df: DataFrame, subset: Sequence[str] | None = None, within: Sequence[str] = ("split",),
                   order_col: str = "utt_id", exclude: Sequence[str] = ("audio",)) -> DataFrame:
    """Rows equal to an earlier row (keep-first) on the key columns
    (default: every column but ``audio``), within each split. NULL equals
    NULL. Only fingerprint candidates (see :func:`_duplicate_candidates`)
    reach the exact step: the first row of each key comes from a partial
    aggregate (skew safe), and rows are matched back with a join AQE can
    split when a key is hot."""
    within = list(within)
    keys = [c for c in _key_cols(df, subset, list(exclude) + within) if c not in within]
    allk = within + keys
    _, _, cand = _duplicate_candidates(df, within, keys)
    firsts = cand.groupBy(*allk).agg(F.min(order_col).alias("_first"), F.count(F.lit(1)).alias("_n"))
    firsts = firsts.filter(F.col("_n") > 1).drop("_n")
    f = firsts.select(*[F.col(c).alias(f"_k_{c}") for c in allk], "_first")
    cond = [cand[c].eqNullSafe(f[f"_k_{c}"]) for c in allk]
    j = cand.join(f, cond, "inner").filter(F.col(order_col) != F.col("_first"))
    return j.drop(*[f"_k_{c}" for c in allk]).withColumnRenamed("_first", "first_" + order_col)


def duplicate_counts(df: DataFrame, subset: Sequence[str] | None = None, within: Sequence[str] = ("split",),
                     exclude: Sequence[str] = ("audio",)) -> DataFrame:
    """Per split, rows and duplicate rows (rows minus distinct keys).
    Row totals come from the fingerprint counts; the exact count of
    distinct keys is taken over the candidate rows only."""
    within = list(within)
    keys = [c for c in _key_cols(df, subset, list(exclude) + within) if c not in within]
    _, counts, cand = _duplicate_candidates(df, within, keys)
    totals = counts.groupBy(*within).agg(F.sum("_n").alias("n_rows"))
    per_key = cand.groupBy(*within, *keys).agg(F.count(F.lit(1)).alias("_n"))
    dups = per_key.groupBy(*within).agg(F.sum(F.col("_n") - 1).alias("_d"))
    return (totals.join(dups, within, "left")
            .select(*within, "n_rows", F.coalesce(F.col("_d"), F.lit(0)).cast("long").alias("n_duplicates")))


def id_filter(df: DataFrame, ids: Sequence[int] | DataFrame, col: str = "utt_id") -> DataFrame:
    """Rows whose id is in a list. A short Python list becomes an
    IN predicate pushed to the scan; a key DataFrame becomes a left-semi
    join (AQE broadcasts it when its runtime size is small)."""
    if isinstance(ids, DataFrame):
        k = ids.select(F.col(ids.columns[0]).alias("_key")).distinct()
        return df.join(k, df[col] == k["_key"], "left_semi")
    return df.filter(F.col(col).isin(list(ids)))


def quality_findings(utts: DataFrame) -> DataFrame:
    """The whole check of the reference's cleaning script as one table of
    findings ``(check, split, utt_id, seconds, message)``."""
    return short_clip_messages(with_clip_info(utts))
