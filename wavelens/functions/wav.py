"""WAV header reading (F6), clip errors (B9) and peak normalisation.

Headers are read with column expressions: little-endian integers are
assembled from per-byte hex, and the RIFF chunk list is walked to the end
of the bytes, all in one pass.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Chunk tags of the RIFF/WAVE format, as hex.
RIFF_HEX = "52494646"   # "RIFF"
WAVE_HEX = "57415645"   # "WAVE"
FMT_HEX = "666D7420"    # "fmt "
DATA_HEX = "64617461"   # "data"
CANONICAL_HEADER = 44

CLIP_FIELDS = ["sample_rate", "channels", "bits", "block_align", "frames", "duration", "error"]

CLIP_SCHEMA = T.StructType([
    T.StructField("sample_rate", T.LongType()),
    T.StructField("channels", T.LongType()),
    T.StructField("bits", T.LongType()),
    T.StructField("block_align", T.LongType()),
    T.StructField("frames", T.LongType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("error", T.StringType()),
])


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def le_uint(b: Column, offset: int, nbytes: int) -> Column:
    """Unsigned little-endian integer of ``nbytes`` at 0-based ``offset``."""
    hex_be = F.concat(*[F.hex(F.substring(b, offset + k + 1, 1))
                        for k in reversed(range(nbytes))])
    return F.conv(hex_be, 16, 10).cast("long")


def _tag(b: Column, offset: int, tag_hex: str) -> Column:
    return F.hex(F.substring(b, offset + 1, 4)) == F.lit(tag_hex)


def le_hex(x: Column, nbytes: int) -> Column:
    """Little-endian hex text of an integer column (writer side)."""
    h = F.lpad(F.hex(x.cast("long")), 2 * nbytes, "0")
    return F.concat(*[F.substring(h, 2 * nbytes - 2 * k - 1, 2) for k in range(nbytes)])


def wav_bytes(rate: Column, channels: Column, bits: Column, payload: Column,
              size: Column | None = None) -> Column:
    """Canonical 44-byte PCM header followed by ``payload`` (binary). Pass
    ``size`` (payload bytes) when it is known, so the payload is not
    measured once per header byte."""
    block = channels * (bits / 8).cast("long")
    size = F.length(payload).cast("long") if size is None else size.cast("long")
    header = F.concat(
        F.lit(RIFF_HEX), le_hex(size + 36, 4), F.lit(WAVE_HEX), F.lit(FMT_HEX),
        le_hex(F.lit(16), 4), le_hex(F.lit(1), 2), le_hex(channels, 2), le_hex(rate, 4),
        le_hex(rate * block, 4), le_hex(block, 2), le_hex(bits, 2), F.lit(DATA_HEX),
        le_hex(size, 4))
    return F.concat(F.unhex(header), payload)


def _le_at(b: Column, off: Column, nbytes: int) -> Column:
    """Unsigned little-endian integer at a 0-based offset given as a column."""
    hex_be = F.concat(*[F.hex(b.substr(off + (k + 1), F.lit(1))) for k in reversed(range(nbytes))])
    return F.conv(hex_be, 16, 10).cast("long")


def chunk_walk(b: Column) -> Column:
    """Walk the RIFF chunk list: struct of the body offsets of the first
    ``fmt `` (16 bytes or more) and ``data`` chunks and the data size. One
    ``aggregate`` over as many steps as chunks fit into the bytes (8 each at
    least), so no chunk list is too long; only clips that are not in the
    canonical layout take it."""
    n = F.length(b)
    init = F.struct(F.lit(12).cast("long").alias("pos"), F.lit(None).cast("long").alias("fmt"),
                    F.lit(None).cast("long").alias("data"), F.lit(None).cast("long").alias("dsize"))

    def step(acc, _):
        pos = acc["pos"]
        tag = F.hex(b.substr(pos + 1, F.lit(4)))
        size = _le_at(b, pos + 4, 4)
        done = acc["data"].isNotNull()
        is_fmt = acc["fmt"].isNull() & (tag == FMT_HEX) & (size >= 16)
        is_data = ~done & (tag == DATA_HEX) & (pos + 8 <= n)
        return F.struct(
            F.when(done, pos).otherwise(pos + 8 + size + size % 2).alias("pos"),
            F.when(is_fmt & ~done, pos + 8).otherwise(acc["fmt"]).alias("fmt"),
            F.when(is_data, pos + 8).otherwise(acc["data"]).alias("data"),
            F.when(is_data, size).otherwise(acc["dsize"]).alias("dsize"))

    most = F.greatest(F.floor((n - 12) / 8), F.lit(0)) + 1
    walked = F.aggregate(F.sequence(F.lit(1).cast("long"), most), init, step)
    # the canonical 44-byte layout (fmt of 16 bytes at 12, data at 36) is
    # read directly; only other layouts pay for the walk
    canonical = ((n >= CANONICAL_HEADER) & _tag(b, 12, FMT_HEX) & (le_uint(b, 16, 4) == 16)
                 & _tag(b, 36, DATA_HEX))
    direct = F.struct(F.lit(CANONICAL_HEADER).cast("long").alias("pos"), F.lit(20).cast("long").alias("fmt"),
                      F.lit(CANONICAL_HEADER).cast("long").alias("data"), le_uint(b, 40, 4).alias("dsize"))
    return F.when(canonical, direct).otherwise(walked)


def add_clip_info(df: DataFrame, bytes_col: str, out: str = "clip") -> DataFrame:
    """F6 + B9: add a struct ``out`` (rate, channels, bits, block align,
    frames, duration = frames / rate, error) read from WAV bytes.

    The RIFF chunk list is walked with column expressions (:func:`chunk_walk`),
    so ``fmt `` and ``data`` are found after extra chunks (LIST, fact, a
    longer fmt) in the same single pass over the bytes. Error codes:
    ``null_bytes``, ``truncated``, ``not_riff``, ``zero_rate``, and
    ``no_data`` when the bytes end before both a format and a data chunk. A
    data chunk that declares more bytes than present is read up to the bytes present.
    """
    b = F.col(bytes_col)
    n = F.length(b)
    df = df.withColumn("_w", chunk_walk(b))
    fmt = F.col("_w.fmt")
    df = df.withColumns({
        "_w_ch": _le_at(b, fmt + 2, 2), "_w_rate": _le_at(b, fmt + 4, 4),
        "_w_block": _le_at(b, fmt + 12, 2), "_w_bits": _le_at(b, fmt + 14, 2)})
    rate, block = F.col("_w_rate"), F.col("_w_block")
    error = (F.when(b.isNull(), F.lit("null_bytes"))
             .when(n < 12, F.lit("truncated"))
             .when(~(_tag(b, 0, RIFF_HEX) & _tag(b, 8, WAVE_HEX)), F.lit("not_riff"))
             .when(n < CANONICAL_HEADER, F.lit("truncated"))
             .when(fmt.isNull() | F.col("_w.data").isNull(), F.lit("no_data"))
             .when((rate == 0) | (block == 0), F.lit("zero_rate")))
    df = df.withColumn("_w_err", error)
    ok = F.col("_w_err").isNull()
    present = F.greatest(n - F.col("_w.data"), F.lit(0)).cast("long")
    frames = F.floor(F.try_divide(F.least(F.col("_w.dsize"), present), block)).cast("long")
    clip = F.struct(
        F.when(ok, rate).alias("sample_rate"), F.when(ok, F.col("_w_ch")).alias("channels"),
        F.when(ok, F.col("_w_bits")).alias("bits"), F.when(ok, block).alias("block_align"),
        F.when(ok, frames).alias("frames"),
        F.when(ok, F.try_divide(frames.cast("double"), rate.cast("double"))).alias("duration"),
        F.col("_w_err").alias("error"))
    return df.withColumn(out, clip).drop("_w", "_w_ch", "_w_rate", "_w_block", "_w_bits", "_w_err")


def read_chunks(data: bytes | None) -> dict | None:
    """Format and data place of one clip: channels, rate, block, bits, start and
    size of the samples present; None for anything that is not a readable clip."""
    if data is None or len(data) < CANONICAL_HEADER or data[0:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    pos, fmt = 12, None
    while pos + 8 <= len(data):
        tag, size = data[pos:pos + 4], struct.unpack_from("<I", data, pos + 4)[0]
        body = pos + 8
        if tag == b"fmt " and fmt is None and size >= 16 and body + 16 <= len(data):
            fmt = struct.unpack_from("<HHIIHH", data, body)
        elif tag == b"data":
            if fmt is None or fmt[2] == 0 or fmt[4] == 0:
                return None
            return {"channels": fmt[1], "rate": fmt[2], "block": fmt[4], "bits": fmt[5],
                    "start": body, "size": min(size, len(data) - body)}
        pos = body + size + (size & 1)
    return None


def peak_normalize(arr) -> Column:
    """divide every sample by the largest absolute sample.

    Magnitudes are taken after widening to double, so the most negative
    16-bit value does not overflow. A silent clip (peak 0) gives NULL rather
    than a division by zero.
    """
    a = _c(arr)
    peak = F.array_max(F.transform(a, lambda v: F.abs(v.cast("double"))))
    return F.when(peak > 0, F.transform(a, lambda v: (v.cast("double") / peak).cast("float")))
