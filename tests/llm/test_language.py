import numpy as np
from pyspark.sql import functions as F

from wavelens.llm import op01_langid as op


def test_code_lengths_are_a_code(spark, sample_docs):
    """In any context the probabilities of the 256 bytes sum to one."""
    model = op.fit(sample_docs.select("text", "lang"))
    for tree in model.trees:
        known = int(tree.grams[op.ORDER][0][7] >> np.uint64(8))
        for ctx in (known, 0x7A7A7A, 0x202061, 0):
            strings = np.arange(256, dtype=np.uint64) | np.uint64(ctx << 8)
            assert abs((2.0 ** -tree.bits(strings)).sum() - 1) < 1e-9


def test_scores_equal_byte_by_byte_sums(spark, sample_docs):
    model = op.fit(sample_docs.select("text", "lang"))
    texts = [r.text for r in sample_docs.select("text").limit(5).collect()] + ["", "zzz~~~ q"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0] + [len(t.encode()) for t in texts])
    got = model.code_lengths(data, offs)
    for i, t in enumerate(texts):
        padded = b" " * op.ORDER + t.encode()
        strings = np.array([sum(padded[k + op.ORDER - j] << (8 * j) for j in range(op.ORDER + 1))
                            for k in range(len(t.encode()))], np.uint64)
        for j, tree in enumerate(model.trees):
            assert abs(got[i, j] - (tree.bits(strings).sum() if len(strings) else 0)) < 1e-3 * max(1, got[i, j])


def test_held_out_accuracy(spark, sample_docs):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = op.fit(sample_docs.filter(~held).select("text", "lang"))
    got = op.predict(sample_docs.filter(held), model, ["lang"]).collect()
    assert len(got) > 20 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark, odd_docs, no_docs):
    model = op.fit(odd_docs.select("text", "lang"))
    got = op.predict(odd_docs, model).collect()
    assert len(got) == odd_docs.count()
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {1, 2, 3, 4}
    empty = op.fit(no_docs.select("text", "lang"))
    assert {r.lang_pred for r in op.predict(odd_docs, empty).collect()} == {"und"}
    assert op.predict(no_docs, model).count() == 0


def _ppm(texts, order):
    """Prediction by partial matching once more, with dictionaries: escape C, exclusion."""
    counts = [{} for _ in range(order + 1)]
    for t in texts:
        x = b" " * order + t.encode()
        for i in range(order, len(x)):
            for k in range(order + 1):
                seen = counts[k].setdefault(x[i - k:i], {})
                seen[x[i]] = seen.get(x[i], 0) + 1

    def bits(context, byte):
        out, excluded = 0.0, set()
        for k in range(order, -1, -1):
            seen = counts[k].get(context[len(context) - k:])
            if seen is None:
                continue
            left = {b: n for b, n in seen.items() if b not in excluded}
            total = sum(left.values()) + len(left)
            if byte in left:
                return out - np.log2(left[byte] / total)
            if left:
                out -= np.log2(len(left) / total)
            excluded |= set(seen)
        return out + np.log2(256 - len(excluded))

    return bits


def test_against_plain_ppm(spark):
    """Whole predictions against dictionaries: code lengths, winners and scores."""
    rng = np.random.default_rng(8)
    words = {"aa": ["the", "of", "and", "in", "thing", "other"], "bb": ["que", "la", "de", "ión", "otra", "cosa"]}
    train = [(100 + i, " ".join(rng.choice(words[lang], 25)), lang) for i in range(30) for lang in words]
    asked = [(i, t) for i, t in enumerate(["the other thing", "otra cosa que", "ión", "z", "the que of la", "日本 the", "a" * 300,
                                           "\x00\x7f~ and", "of  of", "Thé"])]
    model = op.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in op.predict(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    plain = {lang: _ppm([t for _, t, x in train if x == lang], op.ORDER) for lang in words}
    for i, t in asked:
        x = b" " * op.ORDER + t.encode()
        bits = {lang: sum(f(x[k - op.ORDER:k], x[k]) for k in range(op.ORDER, len(x))) for lang, f in plain.items()}
        best = min(sorted(bits), key=bits.get)
        assert got[i].lang_pred == best and abs(got[i].bits - bits[best]) < 1e-3 * max(1, bits[best])
        assert abs(got[i].score - 1 / sum(2.0 ** max(-1000, bits[best] - b) for b in bits.values())) < 1e-2
