import hashlib
import random

import numpy as np
import pytest

from wavelens.llm import op09_repeats as op
from wavelens.llm import suffixes as sx


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for _ in range(60):
        t = rng.integers(0, 3, rng.integers(1, 150)).astype(np.int16)
        order, rank = sx.suffix_array(t)
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert order.tolist() == want and (rank[order] == np.arange(len(t))).all()
        got = sx.common_prefixes(t, order, 6)
        for x in range(1, len(want)):
            a, b, k = want[x - 1], want[x], 0
            while a + k < len(t) and b + k < len(t) and t[a + k] == t[b + k]:
                k += 1
            assert got[x] == min(k, 6)


def _brute(rows, width=100):
    """Rows in (id, text) order; texts of one id differ here or are equal."""
    out, seen = [], set()
    for i, text in rows:
        x = (text or "").encode()
        gone = np.zeros(len(x), bool)
        for a in range(len(x) - width + 1):
            w = x[a:a + width]
            if w in seen:
                gone[a:a + width] = True
            seen.add(w)
        rest = np.frombuffer(x, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(x) else 0
        out.append((repr(i), len(x), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out)


def _got(docs):
    return sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                  for r in op.remove_repeats(docs).collect())


def test_table(spark, sample_docs):
    rows = sorted((r.doc_id, r.text) for r in sample_docs.collect())
    assert _got(sample_docs) == _brute(rows)


def _passages(rng):
    shared = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (99, 100, 101, 150, 400, 80)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(shared)
            if rng.random() < 0.3:
                p = p[rng.randrange(0, 20):len(p) - rng.randrange(0, 20)]
            parts += ["".join(rng.choice("xyzu ") for _ in range(rng.randrange(0, 60))), p]
        rows.append((i, "".join(parts)))
    rows += [(200, "ab" * 400), (201, "q" * 350), (202, "q" * 99), (203, "")]
    return rows


def test_passages_and_runs(spark, monkeypatch):
    rows = _passages(random.Random(3))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = _brute(rows)
    assert _got(docs) == want
    monkeypatch.setattr(op, "MAX_GROUP", 3)       # frequent keys fill several shards
    assert _got(docs) == want
    monkeypatch.setattr(op, "HELD", 50)           # tasks settle few records at a time
    assert _got(docs.repartition(7)) == want


def test_no_two_windows_of_one_run_are_equal():
    """What lets a piece with a key of its own go: also periodic texts have no such run."""
    rng = random.Random(5)
    for k in range(60):
        unit = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 60)))
        data = np.frombuffer((unit * 700)[:rng.randrange(100, 700)], np.uint8)
        for _, _, first, count, _ in op.anchors(data, 100):
            for a, n in zip(first, count):
                windows = [data[x:x + 100].tobytes() for x in range(a, a + n)]
                assert len(set(windows)) == len(windows)


def test_a_gram_in_every_document(spark):
    """One line in all texts, in contexts of its own or in copies: its records are spread."""
    rng = random.Random(9)
    line = "this line stands in every text of the table"
    rows = []
    for i in range(300):
        side = "".join(rng.choice("abcdef ") for _ in range(90)) if i % 3 else "copied words around the line, again and again, " * 2
        rows.append((i, side + line + side[::-1]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert _got(docs) == _brute(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    assert _got(odd_docs) == _brute(rows)
    assert _got(no_docs) == []


def test_texts_with_equal_low_digest_bits(spark):
    """Texts whose xxhash64 agree in the low 32 bits, under a null and under a repeated id."""
    text = lambda i: "".join(hashlib.sha256(str(x).encode()).hexdigest() for x in (i, -i - 1))
    rows = [(None, text(29050)), (None, text(275360)), (5, text(47992)), (5, text(383798))]
    assert _got(spark.createDataFrame(rows, "doc_id long, text string")) == _brute(rows)


def test_widths_that_places_can_hold(spark, no_docs):
    for width in (85, 279):
        with pytest.raises(ValueError):
            op.remove_repeats(no_docs, width)
    assert op.remove_repeats(no_docs, 278).count() == 0
