import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelens.llm import op08_toxicity as op


def _table(spark, toxic, n=2000):
    """Texts with two words, each in half of them, labelled by a rule on the two."""
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(n):
        a, b = rng.random(2) < 0.5
        words = ["filler%d" % k for k in rng.integers(0, 40, 6)] + ["insult"] * bool(a) + ["group"] * bool(b)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic(a, b))))
    return spark.createDataFrame(rows, "doc_id long, text string"), labels


@pytest.mark.parametrize("rule", ["and", "xor"])
def test_interaction_that_linear_weights_miss(spark, rule):
    """Only the meeting of two words tells; for xor each word is as frequent in both classes."""
    docs, labels = _table(spark, {"and": lambda a, b: a and b, "xor": lambda a, b: a != b}[rule])
    m = op.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), op.Fit(epochs=25))
    got = {r.doc_id: r for r in op.score(docs, m).collect()}
    right = sum((got[i].predicted == 1) == (t == 1) for i, t in labels)
    assert right >= 0.97 * len(labels)


def test_no_pairs_in_noise(spark):
    rng = np.random.default_rng(3)
    docs, labels = _table(spark, lambda a, b: rng.random() < 0.3)
    m = op.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert len(m.chosen) == 0 and not any(r.predicted for r in op.score(docs, m).collect())


def test_margin_is_the_sum_over_pairs():
    m = op.Machine(np.arange(5), op.Fit())
    m.w[:] = [1, -2, .5, 0, 3]
    m.v = np.random.default_rng(0).normal(size=m.v.shape)
    at = np.array([0, 2, 4])
    want = m.w[at].sum() + sum(m.v[i] @ m.v[j] for i in at for j in at if i < j)
    assert np.isclose(m.margin(np.zeros(3, int), at, 1)[0], want)


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    m = op.fit(docs, labels.filter(~held))
    got = op.score(docs, m).join(labels.filter(held), "doc_id").select("toxic", "predicted", "score").collect()
    # about one labelled row in ten of this small table shows no term that repeats elsewhere
    toxic = [r.predicted for r in got if r.toxic == 1]
    assert sum(toxic) >= 0.8 * len(toxic) and not any(r.predicted for r in got if r.toxic == 0)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, None), (None, 1), (7, 1), (9, 0), (99, 1)], "doc_id long, toxic int")
    m = op.fit(odd_docs, labels, op.Fit(min_chi2=0.0))
    got = op.score(odd_docs, m).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    none = op.fit(odd_docs, labels.limit(0))
    assert {r.score for r in op.score(odd_docs, none).collect()} == {0.0}
    assert op.score(no_docs, m).count() == 0
