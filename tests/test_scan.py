from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavelens.plans.scan import dense_index, running


def test_running_matches_windows_with_a_hot_group(spark):
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    ev = ev.withColumn("run", F.when(F.col("user_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")))
    r = running(ev, ["run"], ["event_id"], {
        "cs": ("sum", "value"), "cm": ("min", "value"), "cx": ("max_excl", "value"),
        "n": ("count", None), "i": ("index", None), "prev": ("lag", "event_id")}, n_partitions=16)
    w = W.partitionBy("run").orderBy("event_id")
    inc, exc = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    ref = ev.select("event_id", F.sum("value").over(inc).alias("cs_r"), F.min("value").over(inc).alias("cm_r"),
                    F.max("value").over(exc).alias("cx_r"), F.count("*").over(inc).alias("n_r"),
                    F.lag("event_id").over(w).alias("prev_r"))
    j = r.join(ref, "event_id")
    bad = j.filter((F.abs(F.col("cs") - F.col("cs_r")) > 1e-6) | (F.col("cm") != F.col("cm_r"))
                   | ~F.col("cx").eqNullSafe(F.col("cx_r")) | (F.col("n") != F.col("n_r"))
                   | (F.col("i") != F.col("n_r") - 1) | ~F.col("prev").eqNullSafe(F.col("prev_r")))
    assert r.count() == 10000 and bad.count() == 0


def test_dense_index_global(spark):
    df = spark.range(0, 5000).withColumn("k", (F.col("id") * 7919) % 5000)
    out = dense_index(df, [], ["k"], n_partitions=7)
    assert out.filter(F.col("idx") != F.col("k")).count() == 0


def test_running_on_shuffled_input_many_chunks(spark):
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet").repartition(8)
    ev = ev.withColumn("run", F.when(F.col("user_id") % 2 == 0, F.lit(0)).otherwise(F.col("user_id")))
    r = running(ev, ["run", "event_type"], ["event_id"], {"cs": ("sum", "value"), "i": ("index", None)},
                n_partitions=40)
    w = W.partitionBy("run", "event_type").orderBy("event_id")
    ref = ev.select("event_id", F.sum("value").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("cs_r"),
                    (F.row_number().over(w) - 1).alias("i_r"))
    bad = r.join(ref, "event_id").filter((F.abs(F.col("cs") - F.col("cs_r")) > 1e-6) | (F.col("i") != F.col("i_r")))
    assert bad.count() == 0
