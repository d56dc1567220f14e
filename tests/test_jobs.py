import duckdb
from pyspark.sql import functions as F

from wavelens.plans import jobs
from wavelens.sources import catalog as cat
from wavelens.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def _stored(spark, tmp_path):
    path = str(tmp_path / "utts")
    cat.write_splits(fx.utterances(spark, SF), path)
    return cat.read_splits(spark, path)


def test_quality_and_duration_jobs(spark, tmp_path):
    u = _stored(spark, tmp_path)
    log = str(tmp_path / "log")
    dups = str(tmp_path / "duplicates")
    jobs.quality_job(u, log, "monday", dups)
    jobs.quality_job(u, log, "monday", dups)      # done again after a failure: the same findings once
    jobs.quality_job(u, log, "tuesday")           # another run is added
    f = spark.read.parquet(log)
    short = u.filter(F.col("audio_duration") < 1.0).count()
    assert {r.run_id: r["count"] for r in f.filter(F.col("check") == "short_clip").groupBy("run_id").count().collect()} == {
        "monday": short, "tuesday": short}
    assert spark.read.parquet(dups).filter("run_id = 'monday'").count() == u.count() - u.select("split", "transcription").distinct().count()
    assert f.filter((F.col("check") == "missing_values") & (F.col("value") > 0)).count() == 0
    rep = str(tmp_path / "report")
    jobs.duration_job(u, rep)
    lines = [r.value for r in spark.read.text(rep).collect()]
    assert [x.split(" dataset")[0] for x in lines] == ["Total duration of train", "Total duration of test",
                                                        "Total duration of validation"]


def test_profile_and_prepare_jobs(spark, tmp_path):
    u = _stored(spark, tmp_path)
    out = str(tmp_path / "profile")
    jobs.profile_job(u, out)
    h = spark.read.parquet(f"{out}/histogram_audio_duration")
    assert h.groupBy("split").agg(F.sum("count").alias("n")).orderBy("split").collect() == \
        u.groupBy("split").agg(F.count(F.lit(1)).alias("n")).orderBy("split").collect()
    prep = jobs.prepare_job(u, str(tmp_path / "prep"))
    assert prep.count() == u.count()
    assert prep.select(F.max(F.size("labels"))).first()[0] == 367


def test_ingest_duckdb_splits(spark, tmp_path):
    files = {}
    for split in ("train", "test"):
        path = str(tmp_path / f"{split}.duckdb")
        con = duckdb.connect(path)
        con.execute(f"""CREATE TABLE data AS SELECT {{'bytes': CAST('RIFF' AS BLOB), 'path': 'x.wav'}} AS audio,
                        doc_id AS "Unnamed: 0", text AS transcription, n_chars / 1000.0 AS "audio.duration",
                        n_chars AS "transcription.length", doc_id AS __hf_index_id
                        FROM read_parquet('{SF}/documents.parquet') WHERE (doc_id % 2 = 0) = ('{split}' = 'train')""")
        con.close()
        files[split] = path
    t = jobs.ingest_duckdb(spark, files, str(tmp_path / "ingested"))
    assert t.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert set(t.columns) >= {"utt_id", "audio_duration", "split"}


def test_cli_duration(spark, tmp_path):
    _stored(spark, tmp_path)
    out = str(tmp_path / "cli_report")
    jobs.main(["duration", "--utterances", str(tmp_path / "utts"), "--out", out])
    assert spark.read.text(out).count() == 3
