import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavelens.operators import wer


def dp(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def _edits(spark, pairs):
    df = spark.createDataFrame([(" ".join(a), " ".join(b)) for a, b in pairs], "reference string, hypothesis string")
    return [r.n_edits for r in wer.pair_scores(df).select("n_edits").collect()]


def test_edit_distance_matches_dynamic_program(spark):
    rnd = random.Random(7)
    vocab = ["a", "b", "c", "dé", "ä", "x_y", "zzzz"]
    pairs = [([rnd.choice(vocab) for _ in range(rnd.randint(0, 12))],
              [rnd.choice(vocab) for _ in range(rnd.randint(0, 12))]) for _ in range(300)]
    assert _edits(spark, pairs) == [dp(a, b) for a, b in pairs]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from(["w1", "w2", "w3", "wé"]), max_size=8),
       st.lists(st.sampled_from(["w1", "w2", "w4"]), max_size=8))
def test_edit_distance_property(spark, a, b):
    assert _edits(spark, [(a, b)]) == [dp(a, b)]


def test_corpus_wer_is_total_edits_over_total_words(spark):
    df = spark.createDataFrame([("a b c d", "a x c d", "m"), ("e f", "", "m")],
                               "reference string, hypothesis string, model string")
    r = wer.corpus_wer(wer.pair_scores(df), ["model"]).first()
    assert (r.n_edits, r.n_ref_words) == (3, 6)
    assert r.wer == 0.5            # not the mean of 0.25 and 1.0


def test_normalised_wer_ignores_format(spark):
    df = spark.createDataFrame([("Hello, world! Ça va?", "hello world ça va", "m")],
                               "reference string, hypothesis string, model string")
    r = wer.corpus_wer(wer.pair_scores(df), ["model"]).first()
    assert r.n_edits_norm == 0 and r.n_edits > 0


def test_empty_reference_gives_null_rate(spark):
    df = spark.createDataFrame([("", "a b", "m")], "reference string, hypothesis string, model string")
    r = wer.corpus_wer(wer.pair_scores(df), ["model"]).first()
    assert r.n_edits == 2 and r.wer is None


def test_pairing_report(spark):
    refs = spark.createDataFrame([(1,), (2,)], "k long")
    hyps = spark.createDataFrame([(1, "m"), (3, "m")], "k long, model string")
    rep = {(r.k, r.status) for r in wer.pairing_report(refs, hyps, ["k"], ["m"]).collect()}
    assert rep == {(1, "paired"), (2, "missing_hypothesis"), (3, "missing_reference")}


def test_rank_and_share(spark):
    m = spark.createDataFrame([("a", 0.4, 0.3), ("b", 0.2, 0.2)], "model string, wer double, gt_wer double")
    r = {x.model: x for x in wer.rank_models(wer.formatting_share(m)).collect()}
    assert r["b"].rank == 1 and abs(r["a"].format_share - 0.25) < 1e-12
    assert F is not None


def test_custom_normalizer_u3(spark):
    refs = spark.createDataFrame([(1, "Hello, World")], "k long, reference string")
    hyps = spark.createDataFrame([(1, "m", "hello, world")], "k long, model string, hypothesis string")
    lower_only = wer.evaluate(refs, hyps, ["k"], ["model"], normalizer=lambda c: F.lower(c)).first()
    assert lower_only.n_edits == 2 and lower_only.n_edits_norm == 0


def test_collision_fallback_is_exact(spark):
    # thousands of distinct words in one pair: hash codes collide, the
    # positional coding takes over
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(6000)]
    a = [rnd.choice(vocab) for _ in range(1200)]
    b = [w if rnd.random() < 0.7 else rnd.choice(vocab) for w in a]
    assert _edits(spark, [(a, b)]) == [dp(a, b)]
    df = spark.createDataFrame([(" ".join(vocab[:3000]),)], "t string")
    from wavelens.functions.text import wer_words
    assert not df.select(wer._collision_free(F.array_distinct(wer_words("t")), F.xxhash64)).first()[0]


def test_long_pairs_with_few_edits_stay_in_the_band(spark):
    """20 000 words, a few edits at both ends and in the middle: exact, and far from quadratic."""
    import time
    rnd = random.Random(11)
    ref = [f"w{rnd.randrange(4000)}" for _ in range(20_000)]
    hyp = ["new", *ref[:9000], "in", "between", *ref[9001:19_990], "x", *ref[19_991:], "end"]
    start = time.monotonic()
    assert _edits(spark, [(ref, hyp), (ref, ref), (ref, ref[:-1]), ([], ref), (ref[1:], ref)]) == [5, 0, 1, 20_000, 1]
    assert time.monotonic() - start < 120


def test_bands_against_the_dynamic_program(spark):
    """Distances on both sides of every bound."""
    rnd = random.Random(12)
    pairs = []
    for n, edits in ((80, 20), (80, 33), (80, 80), (400, 100), (400, 250), (400, 270), (700, 0)):
        a = [f"w{rnd.randrange(50)}" for _ in range(n)]
        b = list(a)
        for _ in range(edits):
            at = rnd.randrange(len(b))
            b[at:at + 1] = rnd.choice([[f"v{rnd.randrange(50)}"], [], [b[at], "z"]])
        pairs.append((a, b))
    assert _edits(spark, pairs) == [dp(a, b) for a, b in pairs]


def test_pair_edits_equal_the_column_form(spark):
    """The batch form against the column form and the dynamic program, with parts of one pair and of many;
    word lists never leave a row (they were shuffled, 16 bytes a word)."""
    import pyarrow as pa
    rnd = random.Random(21)
    vocab = ["a", "b", "dé", "\u4e2d", "x\ny", "zzzz"]
    pairs = [([rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 5, 40, 130]))],
              [rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 6, 39, 70]))]) for _ in range(80)]
    pairs += [(a, [*a[:3], *a[4:]]) for a, _ in pairs]
    ref, hyp = (pa.array(["  ".join(p[k]) + " " * (i % 2) for i, p in enumerate(pairs)]) for k in (0, 1))
    want = [{"n": len(a), "edits": dp(a, b)} for a, b in pairs]
    assert wer._counted(ref, hyp).to_pylist() == want
    assert wer._counted(ref.slice(7, 90), hyp.slice(7, 90)).to_pylist() == want[7:97]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    got = df.select(wer.word_edits(F.col("a"), F.col("b")).alias("e")).collect()
    assert [r.e for r in got] == [w["edits"] for w in want]
    refs = spark.createDataFrame([(1, "a b")], "k long, reference string")
    assert {c: t for c, t in wer.prepare_references(refs).dtypes}["_rw"] == "string"
