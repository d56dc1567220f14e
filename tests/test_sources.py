import os

import pytest

import duckdb
from pyspark.sql import functions as F

from wavelens.sources import catalog as cat
from wavelens.sources import fixtures as fx
from wavelens.sources.clips import export_clips, read_manifest
from wavelens.sources.duckdb_source import DuckDBDataSource

SF = "/root/testdata/sf0.001"


def test_duckdb_file_source(spark, tmp_path):
    path = str(tmp_path / "train.duckdb")
    con = duckdb.connect(path)
    con.execute(f"""CREATE TABLE data AS SELECT {{'bytes': CAST('RIFF' AS BLOB), 'path': 'x.wav'}} AS audio,
                    doc_id AS "Unnamed: 0", text AS transcription, n_chars / 1000.0 AS "audio.duration",
                    n_chars AS "transcription.length", doc_id AS __hf_index_id
                    FROM read_parquet('{SF}/documents.parquet')""")
    con.close()
    spark.dataSource.register(DuckDBDataSource)
    df = (spark.read.format("duckdb_file").option("paths", path).option("id_column", "__hf_index_id")
          .option("rows_per_partition", "50").load())
    assert df.rdd.getNumPartitions() >= 4
    df = cat.rename_reference_columns(df)
    assert df.columns == ["audio", "row_num", "transcription", "audio_duration", "transcription_length", "utt_id"]
    assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert df.filter(F.col("audio.path") == "x.wav").count() == df.count()


def test_clip_export(spark, tmp_path):
    u = fx.utterances(spark, SF).filter(F.col("utt_id") < 5)
    m = export_clips(u, str(tmp_path / "clips")).collect()
    assert len(m) == 5
    for r in m:
        assert os.path.getsize(r.path) == r.n_bytes
        assert os.path.basename(r.path) == f"{r.utt_id}_{r.utt_id}.wav"


def _files(folder):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc"))


def test_clip_export_is_an_action_of_its_own(spark, tmp_path):
    """The export runs once, whatever is done with the manifest; two exports stand side by side."""
    out = str(tmp_path / "clips")
    u = fx.utterances(spark, SF).repartition(3)
    m = export_clips(u.filter(F.col("utt_id") < 9), out)
    before = {f: os.stat(f).st_mtime_ns for f in _files(out)}
    assert m.count() == m.count() == 9 and {f: os.stat(f).st_mtime_ns for f in _files(out)} == before
    assert len([f for f in before if f.endswith(".wav")]) == 9 and not any("_attempts" in f for f in before)
    again = export_clips(u.filter(F.col("utt_id").between(9, 11)), out)
    assert again.count() == read_manifest(spark, out).count() == 12
    assert set(before) < set(_files(out))
    nothing = export_clips(u.filter(F.col("utt_id") < 0), str(tmp_path / "none"))
    assert nothing.count() == 0 and _files(tmp_path / "none") == []


def test_failed_clip_export_leaves_nothing(spark, tmp_path):
    """One of four tasks fails after the others wrote their clips."""
    out = str(tmp_path / "clips")
    u = fx.utterances(spark, SF).filter(F.col("utt_id") < 40).repartitionByRange(4, "utt_id")
    late = F.when(F.col("utt_id") == 39, F.raise_error(F.lit("stop here"))).otherwise(F.col("audio.bytes"))
    bad = u.withColumn("audio", F.struct(late.alias("bytes"), F.col("audio.path").alias("path")))
    with pytest.raises(Exception, match="stop here"):
        export_clips(bad, out)
    assert _files(out) == []
    assert export_clips(u, out).count() == 40


def test_catalog_helpers(spark):
    from wavelens.sources.tables import register_views
    register_views(spark, SF, ["region", "nation"])
    names = [r.name for r in cat.list_tables(spark).collect()]
    assert "nation" in names and "region" in names
    assert cat.first_table(spark).columns == spark.table(f"`{sorted(names)[0]}`").columns
    d = cat.describe(spark.read.parquet(f"{SF}/region.parquet")).collect()
    assert [r.name for r in d] == ["r_regionkey", "r_name"]


def test_splits_round_trip(spark, tmp_path):
    u = fx.utterances(spark, SF, with_bytes=False).drop("audio")
    cat.write_splits(u, str(tmp_path / "s"))
    back = cat.read_splits(spark, str(tmp_path / "s"))
    assert back.filter(F.col("split") == "test").count() == u.filter(F.col("split") == "test").count()


def test_first_table_on_empty_catalog(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS empty_db_for_test")
    assert cat.first_table(spark, "empty_db_for_test") is None
    e = cat.first_table(spark, "empty_db_for_test", empty_schema="a long")
    assert e.count() == 0 and e.columns == ["a"]


def test_utterance_schema_reads_stored_splits(spark, tmp_path):
    u = fx.utterances(spark, SF)
    cat.write_splits(u, str(tmp_path / "u"))
    back = cat.read_splits(spark, str(tmp_path / "u"), cat.UTTERANCE_SCHEMA)
    assert back.count() == u.count()
    assert back.filter(F.col("split") == "validation").select(F.max("utt_id")).first()[0] is not None


def test_materialize_writes_once_and_reuses(spark, tmp_path):
    from wavelens.sources.materialize import materialize
    calls = []

    def build():
        calls.append(1)
        return spark.range(0, 10)

    a = materialize(build, "t", {"k": 1}, base=str(tmp_path), spark=spark)
    b = materialize(build, "t", {"k": 1}, base=str(tmp_path), spark=spark)
    assert a.count() == b.count() == 10 and len(calls) == 1
    c = materialize(build, "t", {"k": 2}, base=str(tmp_path), spark=spark)
    assert c.count() == 10 and len(calls) == 2


def test_duckdb_rows_without_an_id(spark, tmp_path):
    spark.dataSource.register(DuckDBDataSource)
    for name, ids in (("some", "CASE WHEN i % 10 = 0 THEN NULL ELSE i END"), ("all", "NULL::BIGINT")):
        path = str(tmp_path / f"{name}.duckdb")
        con = duckdb.connect(path)
        con.execute(f"CREATE TABLE data AS SELECT {ids} AS id, i AS v FROM range(100) t(i)")
        con.close()
        df = spark.read.format("duckdb_file").option("paths", path).option("id_column", "id").load()
        assert sorted(r.v for r in df.collect()) == list(range(100))


def test_quality_log_errors(spark):
    from wavelens.sources import logs
    lines = spark.createDataFrame([("Error processing audio at index 7 in training data: not_riff",), ("other",),
                                   ("Warning: Audio file at index 3 in test data is too short (0.50 seconds)",)], "value string")
    assert [tuple(r) for r in logs.parse_quality_errors(lines).collect()] == [(7, "training", "not_riff")]
    assert [tuple(r) for r in logs.parse_quality_log(lines).collect()] == [(3, "test", 0.5)]


def test_signature_sees_files_below_a_folder(spark, tmp_path):
    from wavelens.sources.materialize import file_signature, input_signature
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    one, two = file_signature(spark, path), input_signature(spark.read.parquet(path))
    assert (file_signature(spark, path), input_signature(spark.read.parquet(path))) == (one, two)
    spark.range(20).write.mode("append").parquet(path)
    assert file_signature(spark, path) != one and input_signature(spark.read.parquet(path)) != two
    below = str(tmp_path / "p")                    # a file rewritten in a folder of a partitioned table
    spark.range(10).selectExpr("id", "id % 3 AS k").write.partitionBy("k").parquet(below)
    one, two = file_signature(spark, below), input_signature(spark.read.parquet(below))
    part = next(f for f in _files(below) if "k=1" in f)
    os.utime(part, (1, 1))
    assert file_signature(spark, below) != one and input_signature(spark.read.parquet(below)) != two
