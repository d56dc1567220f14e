import math
import re
from collections import defaultdict
from fractions import Fraction

from wavelens.llm import op07_mixing as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _targets(size):
    """Water filling step by step."""
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total = Fraction(3, 2) * sum(size.values())
    goal, open_ = {}, set(names)
    while open_:
        left = total - sum(goal.values())
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w >= 2 * size[s]]
        if not over:
            goal.update({s: left * weight[s] / w for s in open_})
            break
        for s in over:
            goal[s] = Fraction(2 * size[s])
            open_.remove(s)
    return goal


def _check(docs, mix=op.Mix()):
    rows = docs.collect()
    size = defaultdict(int)
    for r in rows:
        size[r.source] += len(WORD.findall(r.text or ""))
    got = op.taken(docs, mix).collect()
    assert len(got) == len(rows)
    goal = _targets(size)
    words = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and 0 <= r.taken <= 2 * r.size
        assert math.isclose(r.target, float(goal[r.source]), rel_tol=1e-9, abs_tol=1e-9)
        words[r.source] += r.taken
    for s in size:
        assert abs(words[s] - goal[s]) <= max(2 * mix.block_words, 0.01 * float(goal[s])), (s, words[s], float(goal[s]))
    key = lambda r: (repr(r.doc_id), repr(r.source), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, op.taken(docs, mix).collect()))
    return got


def test_targets_and_quotas(spark, sample_docs):
    _check(sample_docs)
    _check(sample_docs, op.Mix(shard_words=500, block_words=16))


def test_highest_quotients(spark):
    rows = [(1, s, w) for s, w in enumerate([53.0, 24.0, 23.0, 0.0, 1.5, 7.25])]
    df = spark.createDataFrame(rows, "g int, p int, w double").selectExpr("*", "cast(20 as long) as total")
    got = {r.p: r.seats for r in op._seats(df, "w", "total", ["g"], "p").collect()}
    quot = sorted(((-w / (2 * k + 1), p) for _, p, w in rows if w for k in range(20)))[:20]
    assert got == {p: sum(x[1] == p for x in quot) for _, p, _ in rows}


def test_mix_holds_the_taken_words(spark, sample_docs):
    docs = sample_docs.withColumnRenamed("n_chars", "size")
    out = op.mixed(docs)
    assert out.columns == docs.columns
    words = defaultdict(int)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        kept, whole = WORD.findall(r.text), iter(WORD.findall(texts[r.doc_id]))
        assert all(w in whole for w in kept)          # in order
    assert {r.doc_id: r.taken for r in op.taken(docs).collect() if r.taken} == dict(words)


def test_odd_rows(spark, odd_docs, no_docs):
    _check(odd_docs)
    assert op.taken(no_docs).count() == 0 and op.mixed(no_docs).count() == 0
    got = op.mixed(odd_docs)
    n = sum(len(WORD.findall(r.text)) for r in got.collect())
    assert n == sum(r.taken for r in op.taken(odd_docs).collect())
