"""Clip export (A8) as a Spark data source writer with commit and abort.

``df.write.format("clips")`` runs as one action. Every task writes its clips, and a
Parquet file with a manifest row for each, to a folder of its own attempt below
``<target>/_attempts/<job>``. When all tasks are done the driver moves each successful
attempt's folder to ``<target>/clips/<job>-<partition>`` and its manifest file to
``<target>/manifest`` (two renames for a task, however many clips it wrote), and removes
the job's attempts; a job that fails removes them as well and leaves nothing. So a retried or
speculative task's files are never seen, and reading the manifest writes nothing.

Files go through ``pyarrow.fs`` (a local folder, HDFS or an object store URI). Bytes are
written unchanged (the reference re-encoded them, dropping non-audio chunks). File names are
``<utt_id>_<base name>``, so clips with equal base names do not overwrite
each other. A clip without bytes is left out. Manifest: ``(utt_id, path, n_bytes)``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from wavelens.functions.text import basename

MANIFEST = T.StructType([
    T.StructField("utt_id", T.LongType()), T.StructField("path", T.StringType()),
    T.StructField("n_bytes", T.LongType()),
])


def _filesystem(root: str):
    """(file system, folder) of a path or URI."""
    from pyarrow import fs
    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root[5:].lstrip("/")
    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


@dataclass
class Written(WriterCommitMessage):
    """A task's attempt: its partition, folder name and number of clips."""
    partition: int
    attempt: str
    clips: int


class ClipWriter(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root, self.job = root, uuid.uuid4().hex

    def _attempts(self, base: str) -> str:
        return f"{base}/_attempts/{self.job}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark import TaskContext
        context = TaskContext.get()
        files, base = _filesystem(self.root)
        part, attempt = context.partitionId(), f"{context.partitionId()}-{uuid.uuid4().hex}"
        folder = f"{self._attempts(base)}/{attempt}"
        schema = pa.schema([("utt_id", pa.int64()), ("path", pa.string()), ("n_bytes", pa.int64())])
        done, manifest = 0, None
        try:
            for batch in iterator:
                rows = []
                for uid, name, data in zip(*(batch.column(c) for c in ("utt_id", "name", "bytes"))):
                    if not data.is_valid:
                        continue
                    if manifest is None:
                        files.create_dir(f"{folder}/clips", recursive=True)
                        manifest = pq.ParquetWriter(f"{folder}/manifest.parquet", schema, filesystem=files)
                    with files.open_output_stream(f"{folder}/clips/{name.as_py()}") as out:
                        out.write(data.as_buffer())
                    rows.append((uid.as_py(), f"{base}/clips/{self.job}-{part}/{name.as_py()}", len(data.as_buffer())))
                if rows:
                    manifest.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema))
                    done += len(rows)
        finally:
            if manifest is not None:
                manifest.close()
        return Written(part, attempt, done)

    def commit(self, messages: list) -> None:
        files, base = _filesystem(self.root)
        for folder in ("clips", "manifest"):
            files.create_dir(f"{base}/{folder}", recursive=True)
        for m in messages:
            if m is not None and m.clips:
                here = f"{self._attempts(base)}/{m.attempt}"
                files.move(f"{here}/clips", f"{base}/clips/{self.job}-{m.partition}")
                files.move(f"{here}/manifest.parquet", f"{base}/manifest/{self.job}-{m.partition}.parquet")
        self._remove(files, base)

    def abort(self, messages: list) -> None:
        self._remove(*_filesystem(self.root))

    def _remove(self, files, base: str) -> None:
        from pyarrow import fs
        if files.get_file_info(self._attempts(base)).type != fs.FileType.NotFound:
            files.delete_dir(self._attempts(base))
        if not files.get_file_info(fs.FileSelector(f"{base}/_attempts", allow_not_found=True)):
            if files.get_file_info(f"{base}/_attempts").type != fs.FileType.NotFound:
                files.delete_dir(f"{base}/_attempts")


class ClipSink(DataSource):
    """Write-only source ``clips`` for rows (utt_id, name, bytes); option ``path``."""

    @classmethod
    def name(cls):
        return "clips"

    def writer(self, schema, overwrite):
        return ClipWriter(self.options["path"].rstrip("/"))


def export_clips(df: DataFrame, target: str, id_col: str = "utt_id") -> DataFrame:
    """Write the clips of ``df`` below ``target`` and return the stored manifest."""
    spark = df.sparkSession
    # a path without a scheme means the cluster's default file system, as for
    # Spark's own writers, not each executor's disk
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    root = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    spark.dataSource.register(ClipSink)
    (df.select(F.col(id_col).cast("long").alias("utt_id"),
               F.concat_ws("_", F.col(id_col).cast("string"), basename(F.col("audio.path"))).alias("name"),
               F.col("audio.bytes").alias("bytes"))
     .write.format("clips").option("path", root).mode("append").save())
    return read_manifest(spark, root)


def read_manifest(spark: SparkSession, target: str) -> DataFrame:
    """The manifest of every export to ``target``."""
    return spark.read.schema(MANIFEST).parquet(f"{target.rstrip('/')}/manifest")
