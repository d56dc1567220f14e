"""Plan shape checks: the scale properties the design relies on."""

from wavelens.operators import labels as lb
from wavelens.plans.registry import QUERIES, _dictionary
from wavelens.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_id_filter_is_pushed_to_the_scan(spark):
    p = _plan(QUERIES["b5_id_in_list"](spark, SF))
    assert "PushedFilters: [In(utt_id" in p or "In(utt_id" in p


def test_profile_scan_reads_two_columns(spark):
    p = _plan(QUERIES["d9_histogram_audio_duration"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in p or "ReadSchema: struct<n_chars:bigint" in p


def test_tokenize_is_one_plan(spark):
    """The dictionary joins by key, whatever its size (AQE broadcasts a small one),
    and no job runs while the query is built."""
    u = fx.utterances(spark, SF, with_bytes=False)
    t = lb.tokenize(u, ["utt_id"], _dictionary(spark, SF))
    assert "CartesianProduct" not in _plan(t) and "NestedLoop" not in _plan(t)


def test_no_clip_bytes_in_a_shuffle(spark):
    for name in ("j2_key_lookup_short_clips", "d1_missing_utterances"):
        p = _plan(QUERIES[name](spark, SF))
        for line in p.splitlines():
            if "Exchange" in line or "SortMergeJoin" in line:
                assert "bytes" not in line
        if name.startswith("d1"):
            assert "bytes:binary" not in p


def test_no_unpartitioned_window_in_running_queries(spark):
    for name in ("w4_running_best", "d16_ecdf_audio_duration", "w6_batch_ids"):
        p = _plan(QUERIES[name](spark, SF))
        # windows only over the small carry table, always partitioned
        for line in p.splitlines():
            if "Window [" in line:
                assert "windowspecdefinition(" in line


def test_running_spreads_a_large_input(spark):
    """An ordered hot group: no chunk holds over twice the mean."""
    from pyspark.sql import functions as F

    from wavelens.plans import scan
    df = spark.range(0, 2_000_000).withColumn("g", F.lit(1))
    chunks = scan.chunked(df, ["g", "id"], 64)
    sizes = [r["count"] for r in chunks.groupBy(scan.CHUNK).count().collect()]
    assert len(sizes) == 64 and max(sizes) <= 2 * 2_000_000 / 64
    out = scan.running(df, ["g"], ["id"], {"i": ("index", None)}, n_partitions=64)
    assert out.filter(F.col("i") != F.col("id")).count() == 0
    # chunk numbers come from the stored table: no key in the plan, one shuffle for the rows
    # and the carries, nothing broadcast, no join
    p = _plan(out)
    assert "CASE WHEN" not in p and "Join" not in p and "Broadcast" not in p and p.count("FileScan") == 2


def test_chunk_count_follows_the_rows(spark, monkeypatch):
    from wavelens.plans import scan
    monkeypatch.setattr(scan, "CHUNK_ROWS", 1000)
    assert [scan.chunked(spark.range(n), ["id"]).select(scan.CHUNK).distinct().count() for n in (10, 5000, 50_000)] == [1, 5, 50]


def test_early_stopping_reads_the_log_once(spark, monkeypatch):
    """A hot run over many chunks; the log itself is computed a single time."""
    from pyspark.sql import functions as F

    from wavelens.operators import runs as rn
    from wavelens.plans import scan
    log = spark.range(0, 60_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("run"),
                                        F.lit("wer").alias("metric"), F.col("id").alias("step"),
                                        (F.abs(F.sin("id")) / (1 + F.col("id") / 1000)).alias("value"))
    want = sorted(map(tuple, rn.early_stopping(log).collect()))
    monkeypatch.setattr(scan, "CHUNK_ROWS", 1500)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    got = rn.early_stopping(log.mapInPandas(count, log.schema))
    assert sorted(map(tuple, got.collect())) == want and seen.value == 60_000
