from pyspark.sql import functions as F

from wavelens.operators import runs as rn
from wavelens.sources import logs as lg

# The four recorded evaluation lines (golden fixture).
RESULTS = {
    "tiny": "Evaluation Results: {'eval_loss': 0.06537050753831863, 'eval_wer': 0.464858825919155, "
            "'eval_ground_truths_wer': 0.39829389661825937, 'eval_runtime': 201.4118, "
            "'eval_samples_per_second': 5.923, 'eval_steps_per_second': 0.745, 'epoch': 3.571428571428571}",
    "base": "Evaluation Results: {'eval_loss': 0.05212818458676338, 'eval_wer': 0.351868779199675, "
            "'eval_ground_truths_wer': 0.29481060221387223, 'eval_runtime': 233.8911, "
            "'eval_samples_per_second': 5.101, 'eval_steps_per_second': 0.641, 'epoch': 3.571428571428571}",
    "small": "Evaluation Results: {'eval_loss': 0.039028141647577286, 'eval_model_preparation_time': 0.0059, "
             "'eval_wer': 0.24664838513101767, 'eval_ground_truths_wer': 0.19604955824108866, "
             "'eval_runtime': 348.3536, 'eval_samples_per_second': 3.425, 'eval_steps_per_second': 0.431}",
    "medium": "Evaluation Results: {'eval_loss': 0.03392885997891426, 'eval_wer': 0.1653463335364615, "
              "'eval_ground_truths_wer': 0.12420026403980908, 'eval_runtime': 641.1126, "
              "'eval_samples_per_second': 1.861, 'eval_steps_per_second': 0.234, 'epoch': 3.571428571428571}",
}


def early_stop_loop(values, patience=15, gain=0.0005):
    best, counter = None, 0
    for i, v in enumerate(values):
        if best is None or (v < best and abs(v - best) > gain):
            counter = 0
        else:
            counter += 1
        if best is None or v < best:
            best = v
        if counter >= patience:
            return i
    return None


def test_results_golden_files(spark, tmp_path):
    for model, line in RESULTS.items():
        d = tmp_path / model / "logs"
        d.mkdir(parents=True)
        (d / "results.txt").write_text(line)
    parsed = lg.read_results(spark, str(tmp_path / "*" / "logs" / "results.txt"))
    m = {r.model: r.metrics for r in parsed.collect()}
    assert m["medium"]["eval_wer"] == 0.1653463335364615
    assert "epoch" not in m["small"] and m["small"]["eval_model_preparation_time"] == 0.0059
    from wavelens.operators import wer
    w = spark.createDataFrame([(k, v["eval_wer"], v["eval_ground_truths_wer"]) for k, v in m.items()],
                              "model string, wer double, gt_wer double")
    ranked = {r.model: r for r in wer.rank_models(wer.formatting_share(w)).collect()}
    assert [k for k, _ in sorted(ranked.items(), key=lambda kv: kv[1].rank)] == ["medium", "small", "base", "tiny"]
    assert abs(ranked["tiny"].format_share - 0.1432) < 1e-3
    t = {r.model: r for r in rn.throughput(parsed).collect()}
    assert t["tiny"].implied_rows == 1193.0 and t["medium"].implied_rows == 1193.0


def test_early_stopping_matches_loop(spark):
    # gains below the threshold still move the best value
    vals = [1.0, 0.9, 0.8996, 0.8993, 0.899] + [0.95] * 20
    log = spark.createDataFrame([("r", "m", i * 1000, v) for i, v in enumerate(vals)],
                                "run string, metric string, step long, value double")
    r = rn.early_stopping(log).first()
    assert r.stop_step == early_stop_loop(vals) * 1000


def test_kept_checkpoints_rotation(spark):
    vals = [0.5, 0.2, 0.4, 0.45, 0.46, 0.47, 0.48, 0.49]
    log = spark.createDataFrame([("r", "wer", (i + 1) * 1000, v) for i, v in enumerate(vals)],
                                "run string, metric string, step long, value double")
    kept = sorted(r.step for r in rn.kept_checkpoints(log, keep=5).collect())
    assert kept == [2000, 5000, 6000, 7000, 8000]
    best = rn.best_checkpoint(log).first()
    assert (best.best_value, best.best_step) == (0.2, 2000)


def test_wide_to_long_skips_absent_keys(spark):
    df = spark.createDataFrame([("r", 50, {"loss": 1.2}), ("r", 1000, {"eval_loss": 0.9, "eval_wer": 0.4})],
                               "run string, step long, logs map<string,double>")
    assert rn.wide_to_long(df).count() == 3
    assert F is not None


def test_quality_log_golden_lines(spark):
    # Recorded warning lines (training and validation).
    lines = ["Warning: Audio file at index 445 in training data is too short (0.77 seconds)",
             "Warning: Audio file at index 7158 in training data is too short (0.08 seconds)",
             "Warning: Audio file at index 78 in validation data is too short (0.92 seconds)",
             "Duplicate rows in training dataset: 0"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {(r.utt_id, r.split_label, r.seconds) for r in lg.parse_quality_log(df).collect()}
    assert got == {(445, "training", 0.77), (7158, "training", 0.08), (78, "validation", 0.92)}


def test_duration_report_format(spark):
    from wavelens.operators import quality as qc
    totals = spark.createDataFrame([("train", 39.38 * 3600), ("test", 0.41 * 3600), ("validation", 2.11 * 3600)],
                                   "split string, total_seconds double")
    lines = sorted((r.line_no, r.value) for r in qc.duration_report_lines(totals).collect())
    assert [v for _, v in lines] == ["Total duration of train dataset: 39.38 hours ",
                                     "Total duration of test dataset: 0.41 hours ",
                                     "Total duration of validation dataset: 2.11 hours "]


def test_irregular_steps_rows(spark):
    log = spark.createDataFrame([("r", "loss", s, 1.0) for s in (50, 100, 150, 300, 350)],
                                "run string, metric string, step long, value double")
    rows = [(r.step, r.gap) for r in rn.irregular_steps(log, 50).collect()]
    assert rows == [(300, 150)]
