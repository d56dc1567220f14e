import numpy as np
import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from wavelens.operators.runs import early_stopping, metric_log
from wavelens.streaming import metrics as sm

SF = "/root/testdata/sf0.01"


def test_stream_equals_batch(spark, tmp_path):
    for mode in ("update", "complete"):
        table, ckpt = str(tmp_path / mode / "t"), str(tmp_path / mode / "c")
        q = sm.start_metric_state(spark, f"{SF}/events*.parquet", table, ckpt, mode=mode)
        q.awaitTermination()
        got = sm.read_latest(spark, table) if mode == "update" else spark.read.parquet(table)
        batch = sm.metric_state(metric_log(spark.read.parquet(f"{SF}/events.parquet")))
        cols = ["run", "metric", "n_records", "best_value", "latest_value", "latest_step"]
        assert got.select(*cols).exceptAll(batch.select(*cols)).count() == 0
        assert got.count() == batch.count() == 750


COLS = ["run", "metric", "n_evals", "best_value", "stop_step"]


def _parts(ev, n):
    """The events in step order, dealt to ``n`` parts."""
    cuts = [float("-inf"), *ev.approxQuantile("event_id", [i / n for i in range(1, n)], 0.0), float("inf")]
    return [ev.filter((F.col("event_id") > a) & (F.col("event_id") <= b)) for a, b in zip(cuts, cuts[1:])]


def test_early_stop_monitor_over_several_triggers(spark, tmp_path):
    """Four triggers, the query started anew for each: its state goes on from the checkpoint."""
    src, dec = str(tmp_path / "events"), str(tmp_path / "dec")
    ev = spark.read.parquet(f"{SF}/events.parquet")
    for part in _parts(ev, 4):
        part.repartition(2).write.mode("append").parquet(src)
        sm.start_early_stop_monitor(spark, f"{src}/*.parquet", dec, str(tmp_path / "ckpt"), state_partitions=4).awaitTermination()
    got = sm.read_latest(spark, dec)
    assert spark.read.parquet(dec).select("batch_id").distinct().count() == 4
    exp = early_stopping(metric_log(ev))
    assert sorted(map(tuple, got.select(*COLS).collect())) == sorted(map(tuple, exp.select(*COLS).collect()))
    assert got.agg({"n_late": "max"}).first()[0] == 0 and got.filter("stop_step IS NOT NULL").count() > 0


def test_failed_trigger_runs_again(spark, tmp_path):
    """A trigger that fails after its states were computed, run again, gives the same decisions."""
    src, dec = str(tmp_path / "events"), str(tmp_path / "dec")
    ev = spark.read.parquet(f"{SF}/events.parquet")
    first, second = _parts(ev, 2)
    first.write.parquet(src)
    sm.start_early_stop_monitor(spark, f"{src}/*.parquet", dec, str(tmp_path / "ckpt"), state_partitions=2).awaitTermination()
    second.write.mode("append").parquet(src)
    (tmp_path / "dec" / "batch_id=1").write_text("in the way of the trigger's folder")
    blocked = sm.start_early_stop_monitor(spark, f"{src}/*.parquet", str(tmp_path / "dec" / "batch_id=1"), str(tmp_path / "ckpt"),
                                          state_partitions=2)
    with pytest.raises(StreamingQueryException):
        blocked.awaitTermination()
    (tmp_path / "dec" / "batch_id=1").unlink()
    sm.start_early_stop_monitor(spark, f"{src}/*.parquet", dec, str(tmp_path / "ckpt"), state_partitions=2).awaitTermination()
    got = sm.read_latest(spark, dec)
    assert got.agg({"n_evals": "sum"}).first()[0] == ev.count()
    exp = early_stopping(metric_log(ev))
    assert sorted(map(tuple, got.select(*COLS).collect())) == sorted(map(tuple, exp.select(*COLS).collect()))


def test_follow_is_the_batch_rule(spark):
    """States moved record by record, and in one go, against the batch rule; nulls, NaN, late steps."""
    rng = np.random.default_rng(4)
    for lower in (True, False):
        for case in range(6):
            values = np.round(rng.random(60) / (1 + np.arange(60) / 10), 3).astype(object)
            values[rng.random(60) < 0.1] = None
            if case % 2:
                values[rng.random(60) < 0.1] = float("nan")
            steps = np.arange(60) * 10
            log = spark.createDataFrame([(1, "m", int(s), v) for s, v in zip(steps, values)],
                                        "run long, metric string, step long, value double")
            want = early_stopping(log, patience=5, min_gain=0.01, lower_is_better=lower).first()
            whole = one = (0, None, 0, None, None, 0)
            mixed = rng.permutation(60)
            whole = sm.follow(whole, steps[mixed], values[mixed], 5, 0.01, lower)
            for i in range(60):
                one = sm.follow(one, steps[i:i + 1], values[i:i + 1], 5, 0.01, lower)
            assert repr(whole) == repr(one) and whole[0] == want.n_evals and whole[3] == want.stop_step
            assert repr(whole[1]) == repr(want.best_value)
    assert sm.follow((5, 0.5, 0, None, 40, 0), np.array([30, 50]), np.array([0.9, 0.9], object), 9, 0.01, True)[4:] == (50, 1)


class _State:
    """A value state that counts its calls."""
    value, calls = None, 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


def test_series_of_a_group_share_one_state(spark):
    """Many series, null runs and metrics among them, over three triggers in several frames:
    the batch rule's decisions, with one read and one write of the state a trigger."""
    rng = np.random.default_rng(9)
    rows = [(None if i % 7 == 0 else i % 5, None if i % 11 == 0 else "ab"[i % 2], i,
             None if rng.random() < 0.1 else round(float(rng.random()), 3)) for i in range(900)]
    state, got = _State(), {}
    processor = sm.early_stop_processor(patience=5, min_gain=0.01)
    processor.init(state)
    for trigger in range(3):
        part = [rows[i] for i in rng.permutation(range(trigger * 300, trigger * 300 + 300))]
        frame = pd.DataFrame({"run": [r or 0 for r, *_ in part], "named": [r is not None for r, *_ in part],
                              "metric": pd.Series([m for _, m, *_ in part], dtype=object), "step": [p[2] for p in part],
                              "value": [p[3] or 0.0 for p in part], "present": [p[3] is not None for p in part]})
        told = pd.concat(processor.handleInputRows((0,), iter([frame[:100], frame[100:]]), None))
        none = told.astype(object).where(told.notna(), None)
        assert len(none) == len(set(zip(none["run"], none["metric"])))
        got.update({(r.run, r.metric): (r.n_evals, r.best_value, r.stop_step, r.n_late) for r in none.itertuples()})
    assert state.calls == 5          # the first trigger has nothing to read
    log = spark.createDataFrame(rows, "run long, metric string, step long, value double")
    want = {(r.run, r.metric): (r.n_evals, r.best_value, r.stop_step, 0)
            for r in early_stopping(log, patience=5, min_gain=0.01).collect()}
    assert got == want and len(want) == 18 and any(w[2] for w in want.values())
