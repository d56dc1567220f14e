"""Views over the given tables that have the shapes of the reference's data.

* ``utterances``: one row per clip in the reference's ``data`` schema
  (audio struct of WAV bytes and path, transcription, lengths, id, split),
  built from ``documents``: a mono 16-bit clip at 1000 Hz with ``n_chars``
  frames, so its duration is ``n_chars / 1000`` seconds.
* ``references`` / ``hypotheses``: WER inputs from ``conversations``; each
  hypothesis "model" is a rule whose edit count is known exactly.

All of it is column expressions over the scans: the work grows with the
tables and no row goes through the driver. The small test files give one
scan partition; ``spread`` fans them out before the heavy row work (a no-op
for a large scan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelens.functions import text as tx
from wavelens.functions.wav import wav_bytes
from wavelens.plans.parallel import spread
from wavelens.sources.tables import read_table

# Fixed values of the fixture rules.
SAMPLE_RATE = 1000
SPLIT_MODULUS = 20          # doc_id % 20: 0 -> test, 1 -> validation, else train
FILLER = "zzzz"             # never occurs in the tables
SUBSTITUTE_EVERY = 5        # word index i with i % 5 == 4 is replaced
DELETE_EVERY = 7            # word index i with i % 7 == 6 is dropped
FORMAT_EVERY = 3            # word index i with i % 3 == 0 is written with other case and signs
FORMAT_SIGNS = "!?!?"       # ends no word of the tables
ORACLE_MODELS = ("substitute", "delete", "insert", "empty", "format_only")


def split_of(doc_id) -> F.Column:
    m = doc_id % SPLIT_MODULUS
    return (F.when(m == 0, F.lit("test")).when(m == 1, F.lit("validation"))
            .otherwise(F.lit("train")))


FIXTURE_VERSION = 1


def utterances(spark: SparkSession, sf_dir: str, with_bytes: bool = True) -> DataFrame:
    """The reference's ``data`` table, all splits in one frame.

    Columns: audio struct<bytes, path>, row_num, transcription,
    audio_duration, transcription_length, utt_id, split.

    With bytes, the table is built once per input file and stored as
    Parquet under the shared checkpoint folder (then reused), so queries
    read a real binary column, as they would on a cluster, instead of
    re-deriving the bytes inside every plan.
    """
    if not with_bytes:
        return build_utterances(spark, sf_dir, with_bytes=False)
    from wavelens.sources.materialize import file_signature, materialize
    params = {"sf_dir": sf_dir, "version": FIXTURE_VERSION,
              "documents": file_signature(spark, f"{sf_dir.rstrip('/')}/documents.parquet")}
    return materialize(lambda: build_utterances(spark, sf_dir), "utterances", params, spark=spark)


def build_utterances(spark: SparkSession, sf_dir: str, with_bytes: bool = True) -> DataFrame:
    d = spread(read_table(spark, sf_dir, "documents"), ["doc_id"]) if with_bytes else read_table(spark, sf_dir, "documents")
    path = F.concat(F.lit("clips/"), d.doc_id.cast("string"), F.lit(".wav"))
    if with_bytes:
        payload = F.unhex(F.repeat(F.lit("0100"), d.n_chars.cast("int")))
        audio = F.struct(wav_bytes(F.lit(SAMPLE_RATE), F.lit(1), F.lit(16), payload,
                                   size=d.n_chars * 2).alias("bytes"),
                         path.alias("path"))
    else:
        audio = F.struct(F.lit(None).cast("binary").alias("bytes"), path.alias("path"))
    return d.select(
        audio.alias("audio"),
        d.doc_id.alias("row_num"),
        d.text.alias("transcription"),
        (d.n_chars / F.lit(float(SAMPLE_RATE))).alias("audio_duration"),
        d.n_chars.alias("transcription_length"),
        d.doc_id.alias("utt_id"),
        split_of(d.doc_id).alias("split"),
    )


ODD_LISTS = 20              # extra chunks before the data chunk of an odd clip


def odd_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of every kind (:func:`build_odd_utterances`), stored like ``utterances``."""
    from wavelens.sources.materialize import file_signature, materialize
    params = {"sf_dir": sf_dir, "version": FIXTURE_VERSION,
              "documents": file_signature(spark, f"{sf_dir.rstrip('/')}/documents.parquet")}
    return materialize(lambda: build_odd_utterances(spark, sf_dir), "odd_utterances", params, spark=spark)


def build_odd_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of every kind a header check must tell apart, by ``doc_id % 10``:
    0 no bytes, 1 cut header, 2 junk, 3 zero rate, 4 a data chunk behind 20 others,
    5 stereo, 6 eight bits, else plain. There are as many samples as in ``utterances``; their
    values go 1, -2, 5 in turn."""
    d = spread(read_table(spark, sf_dir, "documents"), ["doc_id"]).filter(F.col("n_chars").isNotNull())
    kind = d.doc_id % 10
    n = d.n_chars.cast("int")
    payload = F.unhex(F.substring(F.repeat(F.lit("0100FEFF0500"), F.floor(n / 3).cast("int") + 1), F.lit(1), 4 * n))
    rate = F.when(kind == 3, F.lit(0)).otherwise(F.lit(SAMPLE_RATE))
    plain = wav_bytes(rate, F.when(kind == 5, F.lit(2)).otherwise(F.lit(1)),
                      F.when(kind == 6, F.lit(8)).otherwise(F.lit(16)), payload, size=d.n_chars * 2)
    extra = F.unhex(F.lit("4C49535404000000494E464F" * ODD_LISTS))     # LIST chunks of four bytes
    b = F.col("b")
    audio = (F.when(kind == 0, F.lit(None).cast("binary")).when(kind == 1, F.substring(b, 1, 30))
             .when(kind == 2, F.encode(F.repeat(F.lit("junk"), 20), "utf-8"))
             .when(kind == 4, F.concat(F.substring(b, 1, 36), extra, b.substr(F.lit(37), F.length(b))))
             .otherwise(b))
    return (d.select("doc_id", plain.alias("b"), split_of(d.doc_id).alias("split"))
            .select(F.struct(audio.alias("bytes"), F.concat(F.lit("clips/"), F.col("doc_id").cast("string"),
                                                            F.lit(".wav")).alias("path")).alias("audio"),
                    F.col("doc_id").alias("utt_id"), "split"))


def references(spark: SparkSession, sf_dir: str, table: str = "conversations") -> DataFrame:
    """Reference transcripts keyed by (conv_id, turn)."""
    c = spread(read_table(spark, sf_dir, table), ["conv_id", "turn"])
    return c.select("conv_id", "turn", "role", F.col("text").alias("reference"))


def _hypothesis(model: str, w: F.Column) -> F.Column:
    """Hypothesis text of ``model`` from the reference's words ``w``."""
    if model == "substitute":
        return F.array_join(F.transform(
            w, lambda x, i: F.when(i % SUBSTITUTE_EVERY == SUBSTITUTE_EVERY - 1, F.lit(FILLER))
            .otherwise(x)), " ")
    if model == "delete":
        return F.array_join(F.filter(w, lambda x, i: i % DELETE_EVERY != DELETE_EVERY - 1), " ")
    if model == "insert":
        return F.concat_ws(" ", F.array_join(w, " "), F.lit(FILLER))
    if model == "empty":
        return F.lit("")
    if model == "format_only":
        # upper case (of words whose lower case comes back) and signs, doubled spaces: no edit
        # once normalised, one for each such word before
        def loud(x):
            return F.concat(F.when(x.rlike(r"^[\x00-\x7F]*$"), F.upper(x)).otherwise(x), F.lit(FORMAT_SIGNS))
        return F.array_join(F.transform(w, lambda x, i: F.when(i % FORMAT_EVERY == 0, loud(x)).otherwise(x)), "  ")
    raise ValueError(model)


def hypotheses(spark: SparkSession, sf_dir: str, models=ORACLE_MODELS,
               table: str = "conversations") -> DataFrame:
    """One hypothesis per reference row and model: (conv_id, turn, model,
    hypothesis). One scan; the models are a fixed-size explode, no union."""
    r = references(spark, sf_dir, table).withColumn("_w", tx.wer_words(F.col("reference")))
    cases = F.array(*[F.struct(F.lit(m).alias("model"), _hypothesis(m, F.col("_w")).alias("hypothesis"))
                      for m in models])
    return (r.select("conv_id", "turn", F.explode(cases).alias("h"))
            .select("conv_id", "turn", "h.model", "h.hypothesis"))
