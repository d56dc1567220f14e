"""Metric records as a stream (S1): latest and best value per (run, metric).

``readStream`` of log files -> long rows -> ``groupBy(run, metric)``. The
state holds one row per (run, metric), whatever the number of records, so
no watermark is needed. Two sinks:

* ``update`` (default): each trigger appends only the groups that changed,
  tagged with the batch id, under ``<table>/batch_id=N``; readers take the
  newest row per key (:func:`read_latest`). Append-only writes survive task
  retries (a rewritten batch folder replaces itself).
* ``complete``: each trigger rewrites the whole (small) state table.

Early stopping on the stream (:func:`start_early_stop_monitor`) keeps for every
(run, metric) what the rule needs to go on, never the history. The series are dealt to a
fixed number of groups by hash; a group's series are one state of
``transformWithStateInPandas``, read and written once a trigger, so the calls to the state
store follow the number of groups and not that of the series.

Stream checkpoints go under ``spark.checkpoint.dir`` (a shared folder).
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wavelens.operators.runs import MIN_GAIN, PATIENCE, metric_log

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def metric_state(log: DataFrame) -> DataFrame:
    """Aggregates kept per (run, metric): count, best (lowest) value, the
    latest value (at the highest step) and that step."""
    return log.groupBy("run", "metric").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.min("value").alias("best_value"),
        F.max_by("value", "step").alias("latest_value"),
        F.max("step").alias("latest_step"))


def event_stream(spark: SparkSession, path_glob: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path_glob)


def start_metric_state(spark: SparkSession, path_glob: str, table_path: str, checkpoint: str,
                       mode: str = "update", available_now: bool = True, state_partitions: int | None = None,
                       max_files_per_trigger: int | None = None):
    """Start the stream; returns the ``StreamingQuery``. ``state_partitions``
    (default: the cluster's parallelism) fixes the number of state-store
    partitions for the life of the checkpoint; the state has one row per
    (run, metric)."""
    state = metric_state(metric_log(event_stream(spark, path_glob, max_files_per_trigger)))

    def write_update(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").parquet(f"{table_path}/batch_id={batch_id}"))

    def write_complete(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(table_path)

    w = (state.writeStream.outputMode("update" if mode == "update" else "complete")
         .option("checkpointLocation", checkpoint)
         .foreachBatch(write_update if mode == "update" else write_complete))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    with _settings(spark, {"spark.sql.shuffle.partitions": str(state_partitions or spark.sparkContext.defaultParallelism)}):
        return w.start()     # the query keeps the partition count it starts with


@contextlib.contextmanager
def _settings(spark: SparkSession, conf: dict[str, str]):
    """Settings that a query started inside keeps; the session gets its own back."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_latest(spark: SparkSession, table_path: str) -> DataFrame:
    """The current state from an ``update``-mode table: per key, the row of
    the newest batch (a partial aggregate on the key, no window)."""
    t = spark.read.parquet(table_path)
    cols = [c for c in t.columns if c not in ("run", "metric", "batch_id")]
    newest = t.groupBy("run", "metric").agg(F.max_by(F.struct(*cols), "batch_id").alias("s"))
    return newest.select("run", "metric", "s.*")


SERIES_GROUPS = 1024        # states of a stream
_SERIES = pa.schema([("run", pa.int64()), ("metric", pa.string()), ("n", pa.int64()), ("best", pa.float64()),
                     ("improved", pa.int64()), ("stop", pa.int64()), ("last", pa.int64()), ("late", pa.int64())])
_PACKED = T.StructType([T.StructField("series", T.BinaryType())])
DECISION_DDL = "run long, metric string, n_evals long, best_value double, stop_step long, n_late long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def follow(series: tuple, steps: np.ndarray, values: np.ndarray, patience: int, min_gain: float,
           lower_is_better: bool) -> tuple:
    """A series' state after more records, which are put in step order. The state: number of
    records, best value, number of the last improvement, step of the stop, last step, and
    how many records came late (a step at or below one of an earlier trigger)."""
    n, best, improved, stop, last, late = series
    if last is not None:
        late += int((steps <= last).sum())
    order = np.argsort(steps, kind="stable")
    for step, value in zip(steps[order].tolist(), values[order].tolist()):
        # NaN stands above every number, as in Spark's comparisons
        x = None if value is None else math.inf if math.isnan(value) else value
        was = None if best is None else math.inf if math.isnan(best) else best
        if was is None:
            gain = True
        else:
            gain = x is not None and (x < was if lower_is_better else x > was) and abs(x - was) > min_gain
        if gain:
            improved = n
        if x is not None and (was is None or (x < was if lower_is_better else x > was)):
            best = value
        if stop is None and n - improved >= patience:
            stop = step
        n += 1
    last = max([*([] if last is None else [last]), *steps.tolist()], default=None)
    return n, best, improved, stop, last, late


def pack(series: dict[tuple, tuple]) -> bytes:
    """Series (run, metric) with their states as one Arrow stream."""
    columns = zip(*((*key, *state) for key, state in series.items()))
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SERIES)], schema=_SERIES)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _SERIES) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(packed: bytes) -> dict[tuple, tuple]:
    columns = pa.ipc.open_stream(pa.py_buffer(packed)).read_all().columns
    return {row[:2]: row[2:] for row in zip(*(c.to_pylist() for c in columns))}


def early_stop_processor(patience: int = PATIENCE, min_gain: float = MIN_GAIN, lower_is_better: bool = True) -> StatefulProcessor:
    """One state per group of series; every (run, metric) with new records gives one decision
    row a trigger."""
    class EarlyStop(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.group = handle.getValueState("series", _PACKED)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            new = pd.concat(list(rows), ignore_index=True)
            run, named, steps = (new[c].to_numpy() for c in ("run", "named", "step"))
            values = new["value"].astype(object).where(new["present"], None).to_numpy()
            metric, metrics = pd.factorize(new["metric"])        # -1: null
            order = np.lexsort((run, named, metric))             # stable
            ids = np.stack([run, named, metric])[:, order]
            starts = np.flatnonzero(np.r_[True, (ids[:, 1:] != ids[:, :-1]).any(0)])
            series = unpack(self.group.get()[0]) if self.group.exists() else {}
            out = []
            for at in np.split(order, starts[1:]):
                i = at[0]
                k = (int(run[i]) if named[i] else None, metrics[metric[i]] if metric[i] >= 0 else None)
                series[k] = state = follow(series.get(k, (0, None, 0, None, None, 0)), steps[at], values[at],
                                           patience, min_gain, lower_is_better)
                out.append((*k, state[0], state[1], state[3], state[5]))
            self.group.update((pack(series),))
            runs, names, n, best, stop, late = zip(*out)
            yield pd.DataFrame({"run": pd.array(runs, "Int64"), "metric": pd.Series(names, dtype=object), "n_evals": n,
                                "best_value": pd.Series(best, dtype=object), "stop_step": pd.array(stop, "Int64"), "n_late": late})

        def close(self) -> None:
            pass

    return EarlyStop()


def start_early_stop_monitor(spark: SparkSession, path_glob: str, decisions_path: str, checkpoint: str,
                             available_now: bool = True, max_files_per_trigger: int | None = None,
                             state_partitions: int | None = None, groups: int = SERIES_GROUPS, **rule):
    """W2 on a stream: each trigger moves the states of the (run, metric) keys it touches
    and appends their decisions under ``decisions_path/batch_id=N`` (read with
    :func:`read_latest`). The rule is that of :func:`wavelens.operators.runs.early_stopping`
    (``patience``, ``min_gain``, ``lower_is_better``) over records in step order.

    No history is stored or read again. A trigger that is run again after a failure starts from
    the states of the trigger before it and overwrites its own folder, so it gives the same
    decisions. A log is appended in step order: records within a trigger may come
    in any order; those that come in a later trigger than a higher step count as evaluations at
    the place they came and are reported in ``n_late``. Series are dealt to ``groups`` states (fixed
    for the life of the checkpoint); the states and a trigger's records of one group are held
    together. A record without a step has no place in the order and is left out."""
    records = metric_log(event_stream(spark, path_glob, max_files_per_trigger)).filter(F.col("step").isNotNull()).select(
        F.pmod(F.xxhash64("run", "metric"), F.lit(groups)).alias("group"), F.coalesce("run", F.lit(0)).alias("run"),
        F.col("run").isNotNull().alias("named"), "metric", "step",
        F.coalesce("value", F.lit(0.0)).alias("value"), F.col("value").isNotNull().alias("present"))
    decisions = records.groupBy("group").transformWithStateInPandas(
        statefulProcessor=early_stop_processor(**rule), outputStructType=DECISION_DDL, outputMode="Update", timeMode="None")

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").parquet(f"{decisions_path}/batch_id={batch_id}"))

    w = decisions.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(on_batch)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    with _settings(spark, {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.shuffle.partitions":
                           str(state_partitions or spark.sparkContext.defaultParallelism)}):
        return w.start()
