import collections
import random
import re

from wavelens.llm import op04_quality as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    cover = {k for i in range(len(w) - 7) if c[tuple(w[i:i + 8])] > 1 for k in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover),
            len(w) < 20 or 100 * len(cover) > 30 * len(w))


def test_base_counts(spark, sample_docs, odd_docs):
    for docs in (sample_docs, odd_docs):
        got = op.score(docs.select("doc_id", "text")).collect()
        assert len(got) == docs.count()
        for r in got:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                    r.base_failed) == _brute(r.text)
            assert not (r.kept and r.base_failed)


def test_compression_verdicts(spark):
    rng = random.Random(1)
    words = [re.sub(r"\W", "", w) for w in "the of and to in that is was for with as his they at this have from one had by".split()]
    prose = " ".join(rng.choice(words) + rng.choice(["s", "ed", "ing", "er", ""]) + rng.choice("abcdefgh") for _ in range(900))
    stutter = " ".join(" ".join([f"{rng.choice(words)}{i}"] * 7) for i in range(60))
    noise = " ".join("".join(chr(rng.randrange(0x4E00, 0x9FA0)) + chr(rng.randrange(33, 126)) for _ in range(30)) for _ in range(60))
    rows = [(1, prose), (2, stutter), (3, noise), (4, prose + "\n" + noise + noise)]
    got = {r.doc_id: r for r in op.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept
    assert not got[2].base_failed and not got[2].kept and got[2].ratio < 0.31
    assert not got[3].base_failed and not got[3].kept and got[3].ratio > 0.7


def _verdict(text):
    """The rules of the bands once more, in plain Python."""
    import zstandard
    z = zstandard.ZstdCompressor(level=3)
    x = (text or "").encode()
    if _brute(text)[5]:
        return False, len(z.compress(x)) / len(x) if x else None, None
    lo, hi = 0.0, float("inf")
    for start, a, b in op.Bands().whole:
        if len(x) >= start:
            lo, hi = a, b
    parts = [x[i:i + 2048] for i in range(0, len(x) - 2047, 2048)]
    bad = sum(not 0.22 <= len(z.compress(p)) / len(p) <= 0.78 for p in parts) / len(parts) if parts else 0.0
    ratio = len(z.compress(x)) / len(x)
    return lo <= ratio <= hi and bad <= 0.30, ratio, bad


def test_verdicts_of_the_tables(spark, sample_docs, odd_docs):
    for docs in (sample_docs, odd_docs, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        for r in op.score(docs.select("doc_id", "text")).collect():
            kept, ratio, bad = _verdict(r.text)
            assert (r.kept, r.ratio) == (kept, ratio) and (bad is None or r.bad_chunks == bad)


def test_columns_with_the_names_of_its_own(spark, odd_docs):
    clash = odd_docs.withColumnRenamed("lang", "kept").withColumnRenamed("source", "ratio")
    got, want = op.score(clash), op.score(odd_docs.select("doc_id", "text", "n_chars"))
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_keep_returns_the_columns(spark, odd_docs, no_docs):
    docs = odd_docs.withColumnRenamed("lang", "kept").withColumnRenamed("source", "ratio")
    out = op.keep(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    assert {r.doc_id for r in out.collect()} <= {7, 8, 9}
    assert op.keep(no_docs).count() == 0
