import struct

from pyspark.sql import functions as F

from wavelens.functions.wav import add_clip_info, read_chunks
from wavelens.operators.labels import pcm16_peak_normalized
from wavelens.operators import quality as qc


def wav(rate=16000, channels=1, bits=16, frames=100, extra_chunk=False, fmt_size=16, n_extra=1):
    block = channels * bits // 8
    data = b"\x01\x00" * (frames * block // 2)
    fmt = struct.pack("<HHIIHH", 1, channels, rate, rate * block, block, bits) + b"\x00" * (fmt_size - 16)
    chunks = b"fmt " + struct.pack("<I", fmt_size) + fmt
    if extra_chunk:
        chunks += (b"LIST" + struct.pack("<I", 4) + b"INFO") * n_extra
    chunks += b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def _info(spark, blobs):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blobs)], "utt_id long, b binary")
    out = add_clip_info(df, "b", "clip")
    return {r.utt_id: r.clip for r in out.collect()}


def test_header_fields_and_errors(spark):
    blobs = [wav(frames=16000), wav(rate=8000, channels=2, frames=4000), b"not a wav file at all",
             wav()[:30], wav(rate=0), None, wav(frames=1000, extra_chunk=True), wav(frames=800, fmt_size=18),
             wav(frames=16000)[:-100]]
    i = _info(spark, blobs)
    assert i[0].duration == 1.0 and i[0].error is None
    assert i[1].frames == 4000 and i[1].channels == 2 and i[1].duration == 0.5   # frames, not samples
    assert i[2].error == "not_riff"
    assert i[3].error == "truncated"
    assert i[4].error == "zero_rate"
    assert i[5].error == "null_bytes"
    assert i[6].error is None and i[6].frames == 1000      # extra chunk before data
    assert i[7].error is None and i[7].frames == 800
    assert i[8].frames == 16000 - 50                         # data cut short: read what is there


def test_exactly_one_second_is_not_short(spark):
    df = spark.createDataFrame([(1, "train", wav(frames=16000)), (2, "train", wav(frames=15999))],
                               "utt_id long, split string, b binary")
    clips = add_clip_info(df, "b", "clip")
    assert [r.utt_id for r in qc.short_clips(clips).collect()] == [2]


def test_fail_mode_raises(spark):
    df = spark.createDataFrame([(1, b"junk junk junk")], "utt_id long, b binary")
    clips = add_clip_info(df, "b", "clip")
    try:
        qc.clip_errors(clips, on_error="fail").collect()
    except Exception as e:  # noqa: BLE001
        assert "unreadable clip" in str(e)
    else:
        raise AssertionError("expected a failure")
    assert qc.clip_errors(clips).count() == 1
    assert F is not None


def test_far_data_chunk_is_found(spark):
    """No cap on the chunk list: totals hold every readable clip and count the others."""
    blobs = [wav(frames=500, extra_chunk=True, n_extra=20), wav(frames=300, extra_chunk=True, n_extra=400),
             wav(rate=8000, channels=2, bits=8, frames=4000), wav(bits=24, frames=16000), b"junk" * 30, wav(rate=0),
             wav(frames=16000)[:36] + b"xxxx" * 8, None]
    i = _info(spark, blobs)
    assert [i[k].error for k in range(4)] == [None] * 4
    assert [i[k].frames for k in range(4)] == [500, 300, 4000, 16000]
    assert [i[k].error for k in range(4, 8)] == ["not_riff", "zero_rate", "no_data", "null_bytes"]
    df = spark.createDataFrame([(k, "train", b) for k, b in enumerate(blobs)], "utt_id long, split string, b binary")
    t = qc.duration_totals(add_clip_info(df, "b", "clip")).first()
    assert t.n_clips == 4 and t.n_unreadable == 4
    assert abs(t.total_seconds - (800 / 16000 + 0.5 + 1.0)) < 1e-9


def test_samples_come_from_the_data_chunk(spark):
    x = struct.pack("<6h", 100, -200, 300, -32768, 5, 0)
    head = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16)
    listed = b"LIST" + struct.pack("<I", 4) + b"INFO" + head + b"data" + struct.pack("<I", len(x)) + x + b"tail" + struct.pack("<I", 2) + b"zz"
    clip = b"RIFF" + struct.pack("<I", 4 + len(listed)) + b"WAVE" + listed
    assert read_chunks(clip)["size"] == 12 and read_chunks(b"junk" * 40) is None
    df = spark.createDataFrame([(1, clip), (2, b"junk" * 40), (3, wav(bits=8, frames=100)), (4, None)], "i long, b binary")
    got = {r.i: r.x for r in df.select("i", pcm16_peak_normalized("b").alias("x")).collect()}
    assert [round(v * 32768) for v in got[1]] == [100, -200, 300, -32768, 5, 0]
    assert got[2] is None and got[3] is None and got[4] is None
