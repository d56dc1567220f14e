"""Benchmark: run the headline queries at $BENCH_SF_DIR and print one JSON line.

Each query is executed in full with the ``noop`` sink (every row computed,
nothing collected to the driver). Environment:
  BENCH_SF_DIR  default /root/testdata/sf0.1
  BENCH_CPUS    default 8
  BENCH_QUERIES optional comma-separated subset
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wavelens.plans.registry import QUERIES  # noqa: E402
from wavelens.session import get_session  # noqa: E402

HEADLINE = [
    "e4_wer_by_model",            # flagship: plain + normalised corpus WER
    "e1_pair_edits",
    "f5_normalize_documents",
    "f6_clip_duration",
    "d2_d3_duration_totals",
    "a10_quality_log",
    "d6_duplicate_counts",
    "d7_w1_duplicate_rows_transcription",
    "d1_missing_lineitem",
    "d9_histogram_audio_duration",
    "d10_kde_transcription_length",
    "d11_box_transcription_length",
    "d16_ecdf_audio_duration",
    "f10_j3_tokenize",
    "u2_collate_all_splits",
    "w2_early_stopping",
    "c4_kept_checkpoints",
    "s1_stream_metric_state",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = get_session(f"local[{cpus}]", app="wavelens-bench", shuffle_partitions=max(8, cpus * 2),
                        extra_conf={"spark.driver.memory": "16g"})
    # not timed: JIT and Python-worker warm-up (each query once on the
    # smallest data set), and the stored tables of the input (utterances with
    # bytes, word dictionary: data at rest, built once per input and reused)
    from wavelens.sources.fixtures import utterances
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        for name in names:
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    began = time.perf_counter()
    utterances(spark, sf_dir).select("utt_id").write.format("noop").mode("overwrite").save()
    from wavelens.plans.registry import _dictionary
    _dictionary(spark, sf_dir).write.format("noop").mode("overwrite").save()
    build = time.perf_counter() - began
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus,
           "build_sec": round(build, 3)}
    if "e4_wer_by_model" in times:
        # scored (reference, hypothesis) pairs per second, comparable in kind
        # to the samples/s the reference records for its evaluation runs
        pairs = QUERIES["e4_wer_by_model"](spark, sf_dir).agg({"n_pairs": "sum"}).first()[0]
        out["wer_pairs_per_sec"] = round(pairs / times["e4_wer_by_model"], 1)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
