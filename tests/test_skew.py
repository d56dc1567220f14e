"""Hot keys: one key holding a large share of rows gives the same results
with AQE's skew handling forced on (tiny skew thresholds)."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavelens.operators import quality as qc
from wavelens.operators import runs as rn


def _forced_skew(spark):
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    return old


def _restore(spark, old):
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_duplicates_with_a_hot_key(spark):
    df = (spark.range(0, 30000)
          .withColumn("split", F.lit("train"))
          .withColumn("transcription", F.when(F.col("id") % 3 == 0, F.lit("hot text"))
                      .otherwise(F.concat(F.lit("t"), (F.col("id") % 5000).cast("string"))))
          .withColumnRenamed("id", "utt_id"))
    old = _forced_skew(spark)
    try:
        got = {(r.utt_id, r.first_utt_id) for r in
               qc.duplicate_rows(df, subset=["transcription"]).select("utt_id", "first_utt_id").collect()}
        counts = {r.split: r.n_duplicates for r in qc.duplicate_counts(df, subset=["transcription"]).collect()}
    finally:
        _restore(spark, old)
    w = W.partitionBy("split", "transcription")
    exp = (df.withColumn("f", F.min("utt_id").over(w)).filter(F.col("utt_id") != F.col("f"))
           .select("utt_id", "f").collect())
    assert got == {(r.utt_id, r.f) for r in exp}
    assert counts["train"] == len(exp)


def test_kept_checkpoints_with_a_hot_run(spark):
    log = (spark.range(0, 20000).select(
        F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("run"),
        F.lit("wer").alias("metric"), F.col("id").alias("step"),
        ((F.col("id") * 7919) % 1000 / 1000.0).alias("value")))
    old = _forced_skew(spark)
    try:
        got = {(r.run, r.step) for r in rn.kept_checkpoints(log, keep=5).collect()}
    finally:
        _restore(spark, old)
    best = log.groupBy("run", "metric").agg(F.min(F.struct("value", "step")).alias("b"))
    t = log.join(best, ["run", "metric"]).withColumn("is_best", F.col("step") == F.col("b.step"))
    r = t.withColumn("rn", F.row_number().over(
        W.partitionBy("run", "metric").orderBy(F.col("is_best").desc(), F.col("step").desc())))
    exp = {(x.run, x.step) for x in r.filter(F.col("rn") <= 5).collect()}
    assert got == exp


def test_null_keys_are_equal(spark):
    df = spark.createDataFrame([(1, "train", None), (2, "train", None), (3, "train", "a"), (4, "test", None)],
                               "utt_id long, split string, transcription string")
    c = {r.split: (r.n_rows, r.n_duplicates) for r in qc.duplicate_counts(df, subset=["transcription"]).collect()}
    assert c == {"train": (3, 1), "test": (1, 0)}
    rows = [(r.utt_id, r.first_utt_id) for r in qc.duplicate_rows(df, subset=["transcription"]).collect()]
    assert rows == [(2, 1)]
