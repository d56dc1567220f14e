"""Materialise-or-reuse of prepared tables.

The reference reused ``./preprocessed_*`` whenever the folders existed, so
every model size shared one preparation. Here the folder name carries a
fingerprint of the parameters, and a table is reused only if Spark's
``_SUCCESS`` marker is present. Written tables also cut lineage: later jobs
read the files, not the plan that made them.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelens.session import scratch_path


def run_tag(*parts: str) -> str:
    """A short stable folder name for scratch outputs keyed by ``parts``."""
    return hashlib.sha1("|".join(parts).encode()).hexdigest()[:12]


def fingerprint(params: dict) -> str:
    return hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def _listing_signature(spark: SparkSession, paths: list[str]) -> str:
    """Digest of the files at or below ``paths`` (name, length, modification time), whatever
    their order. Spark lists the paths (in a job of its own where they are many) and
    adds the digests up; no file is opened and no listing comes to the driver."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
             .select(F.sha2(F.concat_ws(":", "path", F.col("length").cast("string"),
                                        F.unix_micros("modificationTime").cast("string")), 256).alias("d")))
    # four 60-bit pieces of each digest, summed exactly
    part = [F.sum(F.conv(F.substring("d", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")) for k in range(4)]
    got = files.agg(F.count(F.lit(1)), *part).first()
    return hashlib.sha256(repr(tuple(str(x) for x in got)).encode()).hexdigest()[:16]


def file_signature(spark: SparkSession, path: str) -> str:
    """Digest of the files at or below ``path``, to key
    derived tables: a file rewritten, added or removed below a folder changes it."""
    return _listing_signature(spark, [path])


def input_signature(df: DataFrame) -> str:
    """Digest of the files below the folders a DataFrame reads, and of its plan where it reads none
    (rows made in memory)."""
    files = df.inputFiles()
    if not files:
        return f"plan:{df.semanticHash()}"
    return _listing_signature(df.sparkSession, sorted({unquote(f.rsplit("/", 1)[0]) for f in files}))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a folder of its own under the shared checkpoint folder and
    read it back: computed once, lineage cut, survives lost executors."""
    path = scratch_path(df.sparkSession, f"staged/{name}-{uuid.uuid4().hex}")
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def materialize(df, name: str, params: dict, base: str | None = None,
                partition_by: tuple[str, ...] = (), spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` as Parquet under ``base/name/fp=<fingerprint>`` unless a
    complete copy for the same parameters exists; return the stored table.
    ``df`` may be a function returning the DataFrame (then give ``spark``):
    it is only called when the table has to be built, so a stored table
    costs no planning or sampling of its inputs. ``base`` defaults to a
    folder under ``spark.checkpoint.dir``."""
    spark = spark or df.sparkSession
    root = (base or scratch_path(spark, "prepared")).rstrip("/")
    target = f"{root}/{name}/fp={fingerprint(params)}"
    if not _exists(spark, f"{target}/_SUCCESS"):
        if callable(df):
            df = df()
        # write aside, then rename into place: a reader never sees a half
        # table, and of two jobs building the same table one copy wins
        staging = f"{root}/{name}/.staging-{uuid.uuid4().hex}"
        w = df.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(staging)
        if not _rename(spark, staging, target) and not _exists(spark, f"{target}/_SUCCESS"):
            raise RuntimeError(f"could not move {staging} to {target}")
    return spark.read.parquet(target)


def _rename(spark: SparkSession, src: str, dst: str) -> bool:
    jvm = spark.sparkContext._jvm
    s, d = jvm.org.apache.hadoop.fs.Path(src), jvm.org.apache.hadoop.fs.Path(dst)
    fs = s.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(d):
        return False
    return bool(fs.rename(s, d))
