import pytest
from pyspark.sql import functions as F

from wavelens.operators import labels as lb


def _utts(spark):
    rows = [(1, "train", "the cat sat"), (2, "train", "the cat"), (3, "train", ""), (4, "train", "the dog ran far")]
    return spark.createDataFrame(rows, "utt_id long, split string, transcription string")


def test_dictionary_and_tokenize(spark):
    u = _utts(spark)
    d = lb.build_dictionary(u)
    ids = {r.token: r.id for r in d.collect()}
    assert ids["<|endoftext|>"] == lb.EOT_ID and ids["the"] == 3 and ids["cat"] == 4   # by count, then text
    lab = {r.utt_id: r.labels for r in lb.tokenize(u, ["utt_id"], d).collect()}
    assert lab[2] == [lb.SOT_ID, 3, 4, lb.EOT_ID]
    assert lab[3] == [lb.SOT_ID, lb.EOT_ID]
    unk = spark.createDataFrame([(9, "the unicorn")], "utt_id long, transcription string")
    assert lb.tokenize(unk, ["utt_id"], d).first().labels == [lb.SOT_ID, 3, lb.UNK_ID, lb.EOT_ID]


def test_pad_truncate_and_masks(spark):
    df = spark.createDataFrame([([1, 5, 6, 0],)], "ids array<int>")
    r = df.select(lb.pad_truncate(F.col("ids"), 6).alias("p"), lb.pad_truncate(F.col("ids"), 2).alias("t"),
                  lb.attention_mask(F.size("ids"), 6).alias("m")).first()
    assert r.p == [1, 5, 6, 0, 0, 0] and r.t == [1, 5] and r.m == [1, 1, 1, 1, 0, 0]
    r2 = df.select(lb.restore_pad(lb.loss_mask(F.col("ids"), F.array(*[F.lit(x) for x in (1, 1, 0, 0)]))).alias("x"),
                   lb.loss_mask(F.col("ids"), F.array(*[F.lit(x) for x in (1, 1, 0, 0)])).alias("y")).first()
    assert r2.y == [1, 5, -100, -100] and r2.x == [1, 5, 0, 0]


def test_collate_trims_start_only_when_whole_batch_has_it(spark):
    rows = [("s", 0, 1, [1, 7, 0]), ("s", 0, 2, [1, 8, 9, 0]), ("s", 1, 3, [1, 7, 0]), ("s", 1, 4, [7, 0])]
    df = spark.createDataFrame(rows, "split string, batch_id long, utt_id long, labels array<int>")
    out = {r.utt_id: r for r in lb.collate(df).collect()}
    assert out[1].label_ids == [7, 0, -100] and out[1].start_trimmed
    assert out[3].label_ids == [1, 7, 0] and not out[3].start_trimmed
    assert out[4].label_ids == [7, 0, -100]


def test_decode_round_trip_and_batches(spark):
    u = _utts(spark)
    d = lb.build_dictionary(u)
    b = lb.assign_batches(lb.tokenize(u, ["utt_id"], d).withColumn("split", F.lit("train")), 2)
    assert {r.utt_id: r.batch_id for r in b.collect()} == {1: 0, 2: 0, 3: 1, 4: 1}
    c = lb.collate(b)
    text = {r.utt_id: r.text for r in lb.decode(c, ["utt_id"], d).collect()}
    assert text == {1: "the cat sat", 2: "the cat", 3: "", 4: "the dog ran far"}


def test_cap_report(spark):
    u = _utts(spark).unionByName(spark.createDataFrame([(5, "test", "a b c d e f g")],
                                                       "utt_id long, split string, transcription string"))
    lab = lb.tokenize(u, ["utt_id"], lb.build_dictionary(u)).join(u.select("utt_id", "split"), "utt_id")
    cap = lb.length_cap(lab, margin=2)
    assert cap == 6 + 2
    rep = {r.split: r.n_over_cap for r in lb.length_cap_report(lab, cap).collect()}
    assert rep == {"train": 0, "test": 1}


def test_peak_normalized_samples(spark):
    import struct
    data = struct.pack("<4h", 100, -32768, 0, 50)
    hdr = (b"RIFF" + b"\x00" * 4 + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16)
           + b"data" + struct.pack("<I", len(data)))
    df = spark.createDataFrame([(hdr + data,), (hdr + b"\x00\x00",)], "b binary")
    r = df.select(lb.pcm16_peak_normalized(F.col("b")).alias("s")).collect()
    assert r[0].s[1] == -1.0 and abs(r[0].s[0] - 100 / 32768) < 1e-7
    assert r[1].s is None                                   # silent clip


def test_token_lengths_equal_tokenised_sizes(spark):
    u = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        F.col("doc_id").alias("utt_id"), F.col("text").alias("transcription"))
    lab = lb.tokenize(u, ["utt_id"], lb.build_dictionary(u))
    j = lab.join(u.select("utt_id", lb.token_lengths().alias("n")), "utt_id")
    assert j.filter(F.size("labels") != F.col("n")).count() == 0


def _hot_texts(spark):
    """A word that stands for a third of all words and is in no dictionary, long words, rare words."""
    rows = [(i, " ".join(["zebra"] * 40 + [f"w{i * k % 90}" for k in range(60)] + [f"rare{i}", "q" * 80])) for i in range(120)]
    u = spark.createDataFrame(rows, "utt_id long, transcription string").repartition(4)
    return rows, u, lb.build_dictionary(u.filter("utt_id % 2 = 0").withColumn(
        "transcription", F.regexp_replace("transcription", "zebra ", "")))


@pytest.mark.parametrize("heavy", [0, 10, 1 << 16])
def test_head_and_tail_of_the_dictionary(spark, heavy):
    """Hot, rare and unknown words, with all, some and none of the dictionary beside the row,
    without adaptive execution."""
    rows, u, d = _hot_texts(spark)
    ids = {r.token: r.id for r in d.collect() if not r.is_special}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lab = lb.tokenize(u, ["utt_id"], d, heavy=heavy)
        got = {r.utt_id: r.labels for r in lab.collect()}
        text = {r.utt_id: r.text for r in lb.decode(lab, ["utt_id"], d, ids_col="labels", heavy=heavy).collect()}
        full = {r.utt_id: r.text for r in lb.decode(lab, ["utt_id"], d, "labels", skip_special=False, heavy=heavy).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for i, t in rows:
        assert got[i] == [lb.SOT_ID, *(ids.get(w, lb.UNK_ID) for w in t.split()), lb.EOT_ID]
        assert text[i] == " ".join(w for w in t.split() if w in ids)
        assert full[i] == " ".join([lb.SOT, *(w if w in ids else lb.UNK for w in t.split()), lb.EOT])


def test_decode_ids_outside_the_dictionary(spark):
    _, _, d = _hot_texts(spark)
    n = d.count()
    df = spark.createDataFrame([(1, [1, 3, n, 10 ** 6, -5, -100, 4, 0]), (2, []), (3, None)], "utt_id long, label_ids array<int>")
    by_id = {r.id: r.token for r in d.collect()}
    for heavy in (0, 4, 1 << 16):
        got = {r.utt_id: r.text for r in lb.decode(df, ["utt_id"], d, heavy=heavy).collect()}
        assert got[1] == f"{by_id[3]} {by_id[4]}" and not got[2] and not got[3]


def test_one_exchange_of_the_texts(spark):
    """Texts are dealt once; explode, head lookup and regroup follow in that stage, and only the
    tail's result is dealt by the keys again, also where nothing but the head is broadcast."""
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in off}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        _, u, d = _hot_texts(spark)
        plan = lb.tokenize(u, ["utt_id"], d)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning(utt_id" in x]
    assert sum("ENSURE_REQUIREMENTS" in x for x in exchanges) == 1
    assert {x[x.index("REPARTITION"):].split(",")[0] for x in exchanges if "ENSURE" not in x} == {"REPARTITION_BY_COL"}


def test_words_meet_the_head_in_the_row(spark):
    """No word of the head is a row of its own (each was exploded and sorted); keys that come twice, or
    are missing, give what they gave: one label of all their words by position."""
    u = spark.createDataFrame([(1, "b a c"), (1, "a zz"), (None, "a zz b"), (4, None), (5, "c")],
                              "utt_id long, transcription string").repartition(3)
    d = spark.createDataFrame([("a", 3, False), ("b", 4, False), ("c", 5, False), (lb.EOT, 0, True)],
                              "token string, id int, is_special boolean")
    want = {1: [1, 3, 4, 2, 3, 5, 0], None: [1, 3, 4, 0], 4: [1, 0], 5: [1, 5, 0]}
    assert {r.utt_id: r.labels for r in lb.tokenize(u, ["utt_id"], d).collect()} == want
    plan = lb.tokenize(u, ["utt_id"], d)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan
    lab = spark.createDataFrame([(1, [1, 3, 6, 4, 0]), (1, [6, 3, -100]), (2, [])], "utt_id long, label_ids array<int>")
    more = d.unionByName(spark.createDataFrame([("far", 6, False)], d.schema))
    for heavy in (4, 10):
        got = sorted((r.utt_id, r.text) for r in lb.decode(lab, ["utt_id"], more, heavy=heavy).collect())
        if heavy == 10:
            assert got == [(1, "a far b"), (1, "far a"), (2, "")]
        else:                               # the tails of rows with the same key are one
            assert got == [(1, "far a far b"), (1, "far a far b"), (2, "")]


def test_clip_samples_leave_in_bounded_parts(monkeypatch):
    """Samples of a batch of clips are given out part by part, not all at once."""
    import struct

    import pyarrow as pa
    hdr = (b"RIFF" + b"\x00" * 4 + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16)
           + b"data" + struct.pack("<I", 2000))
    clips = [hdr + struct.pack("<1000h", *([i - 5] * 1000)) for i in range(10)] + [None, b"x"]
    monkeypatch.setattr(lb, "SAMPLES_OUT", 2500)
    parts = list(lb.pcm16_peak_normalized.func(iter([pa.array(clips, pa.binary()), pa.array([], pa.binary())])))
    assert max(len(p.flatten()) for p in parts) <= 3500 and len(parts) >= 4
    rows = [x for p in parts for x in p.to_pylist()]
    assert rows == [None if i in (5, 10, 11) else [1.0 if i > 5 else -1.0] * 1000 for i in range(12)]


@pytest.mark.parametrize("name", ["f10_j3_tokenize", "f14_f16_decode_all_splits",
                                  "a7_materialize_prepared",
                                  "f11_pad_truncate",
                                  "f15_padded_mask_all_splits",
                                  "f18_u1_prepare_split",
                                  "u2_collate_all_splits",
                                  "u2_collate_f12_f13_f15_f17",
                                  "u2_collate_mixed_starts"])
def test_rest_of_the_dictionary_is_not_sent_through_the_driver(spark, monkeypatch, name):
    """Files of a dictionary below Spark's broadcast threshold hold words enough to fill the driver:
    nothing that is made of its words outside the head is a broadcast, and no word is copied."""
    from wavelens.plans import registry
    monkeypatch.setattr(registry, "materialize", lambda df, *a, **k: df)        # a7: the plan of what it stores
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    depth, scans = None, 0
    for line in plan.splitlines():
        at = len(line) - len(line.lstrip(" :+-*(0123456789)"))
        if depth is not None and at <= depth:
            depth = None
        if "BroadcastExchange" in line:
            depth = at
        if "FileScan" in line and "token#" in line:
            scans += 1
            assert depth is None, plan
    assert scans and "explode(org.apache" not in plan


def test_words_outside_the_head_leave_in_bounded_parts(monkeypatch):
    """Rows for the words outside the head are given out part by part, each with the keys of its text."""
    from types import SimpleNamespace

    import pyarrow as pa
    monkeypatch.setattr(lb, "TAIL_OUT", 5)
    texts = ["a x y", None, "", "x x x x x x", "a a", "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(texts)], names=["utt_id", "_text"])
    parts = list(lb._tail_words(SimpleNamespace(value={"a": 3}), 1)(iter([batch])))
    assert len(parts) == 2 and max(p.num_rows for p in parts) <= 10
    rows = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    assert rows == [(0, 1, "x"), (0, 2, "y"), *((3, k, "x") for k in range(6)), (5, 0, "z")]
