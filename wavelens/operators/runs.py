"""Run-log analysis.

A run log is a long table ``(run, step, metric, value)``. Per-run sequences
are ordered scans; they use the running aggregates of :mod:`wavelens.plans.scan` over
stored ranges of (run, metric, step), so one long run is spread over many tasks and the
log is read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavelens.plans.scan import running
from wavelens.sources.materialize import staged

# Fixed values of the reference's training settings.
PATIENCE = 15
MIN_GAIN = 0.0005
LOGGING_STEPS = 50
EVAL_STEPS = 1000
KEEP_CHECKPOINTS = 5
EVAL_BATCH = 8
KEYS = ("run", "metric")


def metric_log(events: DataFrame) -> DataFrame:
    """The ``events`` table as a run log: run = user, step = event id,
    metric = event type."""
    return events.select(F.col("user_id").alias("run"), F.col("event_id").alias("step"),
                         F.col("event_type").alias("metric"), "value", "ts")


def wide_to_long(logs: DataFrame, id_cols: Sequence[str] = ("run", "step"), map_col: str = "logs") -> DataFrame:
    """A logged dict per step (``map<string,double>``) to long rows;
    keys that are absent simply produce no row."""
    return logs.select(*id_cols, F.explode(map_col).alias("metric", "value"))


def metric_series(log: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """The (step, value) series of each metric, ordered by step (a
    range-partitioned sort, not a window). Every metric is its own series;
    plain and normalised WER are not merged into one list."""
    df = log.filter(F.col("metric").isin(list(metrics))) if metrics else log
    return df.select("run", "metric", "step", "value").orderBy("run", "metric", "step")


def running_best(log: DataFrame, lower_is_better: bool = True) -> DataFrame:
    """Best value so far at each step."""
    op = "min" if lower_is_better else "max"
    return running(log.select("run", "metric", "step", "value"), KEYS, ["step"], {"best_so_far": (op, "value")})


def early_stopping(log: DataFrame, patience: int = PATIENCE, min_gain: float = MIN_GAIN,
                   lower_is_better: bool = True) -> DataFrame:
    """Where an early-stopping rule would stop each (run, metric).

    A value counts as an improvement when there is no earlier value, or it
    beats the best earlier value by more than ``min_gain``. The counter is
    the number of values since the last improvement; training stops at the
    first step where it reaches ``patience``. The best earlier value moves
    on any gain, even one below ``min_gain``.
    Output: ``run, metric, n_evals, best_value, stop_step`` (NULL: never).
    """
    op = "min_excl" if lower_is_better else "max_excl"
    a = running(log.select("run", "metric", "step", "value"), KEYS, ["step"],
                {"prior_best": (op, "value"), "idx": ("index", None)}, keep_chunk=True)
    better = (F.col("value") < F.col("prior_best")) if lower_is_better else (F.col("value") > F.col("prior_best"))
    improved = F.col("prior_best").isNull() | (better & (F.abs(F.col("value") - F.col("prior_best")) > min_gain))
    # the second scan runs over the chunks of the first
    b = staged(a.withColumn("_imp_idx", F.when(improved, F.col("idx"))), "improvements")
    c = running(b, KEYS, ["step"], {"last_improved": ("max", "_imp_idx")})
    c = c.withColumn("counter", F.col("idx") - F.col("last_improved"))
    best = F.min("value") if lower_is_better else F.max("value")
    return c.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_evals"), best.alias("best_value"),
        F.min(F.when(F.col("counter") >= patience, F.col("step"))).alias("stop_step"))


def irregular_steps(log: DataFrame, cadence: int = LOGGING_STEPS) -> DataFrame:
    """W5 rows: ``(run, metric, step, prev_step, gap)`` where the gap to the
    previous record differs from the cadence."""
    a = running(log.select("run", "metric", "step"), KEYS, ["step"], {"prev_step": ("lag", "step")})
    gap = F.col("step") - F.col("prev_step")
    return a.filter(F.col("prev_step").isNotNull() & (gap != cadence)).withColumn("gap", gap)


def cadence_gaps(log: DataFrame, cadence: int = LOGGING_STEPS) -> DataFrame:
    """Per (run, metric), the rows whose step gap to the previous row
    differs from the expected cadence, summarised."""
    a = running(log.select("run", "metric", "step"), KEYS, ["step"], {"prev_step": ("lag", "step")})
    gap = F.col("step") - F.col("prev_step")
    return a.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("prev_step").isNotNull() & (gap != cadence)).alias("n_irregular"),
        F.max(gap).alias("max_gap"))


def best_checkpoint(log: DataFrame, lower_is_better: bool = True) -> DataFrame:
    """The best value per (run, metric); ties go to the lowest step.
    A partial aggregate (``min`` of a struct), no sort of the group."""
    key = F.struct((F.col("value") if lower_is_better else -F.col("value")).alias("v"), F.col("step").alias("step"))
    b = log.filter(F.col("value").isNotNull()).groupBy(*KEYS).agg(F.min(key).alias("_b"))
    v = F.col("_b").getField("v")
    return b.select(*KEYS, (v if lower_is_better else -v).alias("best_value"),
                    F.col("_b").getField("step").alias("best_step"))


def kept_checkpoints(log: DataFrame, keep: int = KEEP_CHECKPOINTS, lower_is_better: bool = True) -> DataFrame:
    """C4: checkpoints left by a rotation that keeps ``keep`` in all: the
    best one plus the newest ``keep - 1`` others. Steps are unique in a series."""
    best = best_checkpoint(log, lower_is_better).select(*KEYS, F.col("best_step").alias("_best_step"))
    tagged = (log.select(*KEYS, "step").join(best, list(KEYS), "left")
              .withColumn("is_best", F.coalesce(F.col("step") == F.col("_best_step"), F.lit(False)))
              .withColumn("_slots", F.when(F.col("_best_step").isNull(), keep).otherwise(keep - 1))
              .drop("_best_step"))
    # row_number with a fixed bound: Spark keeps ``keep`` rows of a group in
    # each task before the shuffle (WindowGroupLimit), so a long run is no hot key
    newest = Window.partitionBy(*KEYS).orderBy(F.col("step").desc())
    ranked = (tagged.filter(~F.col("is_best")).withColumn("newer", F.row_number().over(newest))
              .filter(F.col("newer") <= keep))
    kept_others = ranked.filter(F.col("newer") <= F.col("_slots")).select(*KEYS, "step", "is_best")
    return kept_others.unionByName(tagged.filter(F.col("is_best")).select(*KEYS, "step", "is_best"))


def eval_speed(log: DataFrame, batch_size: int = EVAL_BATCH) -> DataFrame:
    """Per run: runtime (first to last record, seconds, 4 decimals), samples
    per second and steps per second (3 decimals), as a trainer reports."""
    ts = F.col("ts").cast("timestamp")  # NTZ or not: only the difference is used
    secs = (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))).cast("double") / 1e6
    g = log.groupBy("run").agg(F.round(secs, 4).alias("eval_runtime"), F.count(F.lit(1)).alias("n"),
                               F.avg("value").alias("eval_loss"))
    return (g.withColumn("eval_samples_per_second", F.round(F.try_divide(F.col("n"), F.col("eval_runtime")), 3))
            .withColumn("eval_steps_per_second",
                        F.round(F.try_divide(F.ceil(F.col("n") / batch_size), F.col("eval_runtime")), 3)))


def results_lines(metrics: DataFrame, id_col: str, value_cols: Sequence[str]) -> DataFrame:
    """Format one ``Evaluation Results: {...}`` line per row, as the
    reference's scripts print them (a Python dict of floats)."""
    entries = [F.concat(F.lit(f"'{c}': "), F.col(c).cast("double").cast("string")) for c in value_cols]
    body = F.concat(F.lit("{"), F.concat_ws(", ", *entries), F.lit("}"))
    return metrics.select(F.col(id_col), F.concat(F.lit("Evaluation Results: "), body).alias("value"))


def throughput(results: DataFrame, id_col: str = "model") -> DataFrame:
    """Rows and batches implied by a results record:
    runtime x samples/s and runtime x steps/s."""
    m = F.col("metrics")
    return results.select(
        id_col,
        m["eval_runtime"].alias("eval_runtime"),
        F.round(m["eval_runtime"] * m["eval_samples_per_second"], 0).alias("implied_rows"),
        F.round(m["eval_runtime"] * m["eval_steps_per_second"], 0).alias("implied_batches"))
