import hashlib
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavelens.llm import op12_merkle as op
from wavelens.llm import queries as q

from .conftest import DOCS


def _h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def _leaf(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _proofs(nodes):
    """(root, siblings of each leaf as (before, after) lists), level by level over the whole list."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i // 3 * 3
            paths[k].append((nodes[run:i], nodes[i + 1:run + 3]))
        at = [i // 3 for i in at]
        nodes = [_h("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r, r["text"]), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: _proofs([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    root, ups = _proofs([subs[s][0] for s in sources])
    out = []
    for s, up in zip(sources, ups):
        for (_, _, leaf, r), path in zip(sorted(by[s], key=lambda x: x[:3]), subs[s][1]):
            text, path = r["text"], path + up
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            x = _leaf(r, text)
            for a, b in path:
                x = _h("".join(a) + x + "".join(b))
            out.append((r["doc_id"], leaf, subs[s][0], root, _h("".join("".join(a + b) for a, b in path)), x, x == root))
    return sorted(out, key=repr)


COLS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _rows(df):
    return sorted((tuple(r[c] for c in COLS) for r in df.collect()), key=repr)


@pytest.mark.parametrize("home", [7, 64, 100_000])
def test_whole_table(spark, sample_docs, home):
    """Many homes for a source, and many sources in a home."""
    assert _rows(q.merkle_digests(sample_docs, home)) == brute([r.asDict() for r in sample_docs.collect()])


def test_odd_rows(spark, odd_docs):
    for home in (2, 1000):
        assert _rows(q.merkle_digests(odd_docs, home)) == brute([r.asDict() for r in odd_docs.collect()])


def test_repeated_rows_are_parted(spark):
    """A third of all rows is one row again and again, the rest one source or sources of one row."""
    rows = [(1, "same\ntext", "en", "a", 9)] * 90 + [(i, f"t{i}\n", None, "a", i) for i in range(60)]
    rows += [(i, f"u{i}", "de", f"s{i}" if i % 7 else None, None) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = op.manifest(docs, home_leaves=10)
    assert _rows(q.merkle_digests(docs, 10)) == brute([r.asDict() for r in docs.collect()])
    assert got.count() == len(rows)


@pytest.mark.parametrize("home", [5, 11, 18])
def test_sources_parted_in_every_way(spark, home):
    """Sources of 1 to 14 rows over homes of a few: runs of whole sources between parted ones."""
    rows, n = [], 0
    for s in range(60):
        for _ in range((s * 7919 >> 3) % 14 + 1):
            rows.append((n, f"text {n}\n", "en", f"s{s:02}", n))
            n += 1
    docs = spark.createDataFrame(rows, DOCS)
    assert _rows(q.merkle_digests(docs, home)) == brute([r.asDict() for r in docs.collect()])


def test_empty_single_and_clashes(spark, no_docs):
    assert q.merkle_digests(no_docs, 10).collect() == []
    one = spark.createDataFrame([(1, "x", "en", None, 1, 5, "z", 7)], DOCS + ", home long, leaf string, row long")
    got = q.merkle_digests(one, 10).collect()
    assert len(got) == 1 and got[0].leaf == got[0].subroot == got[0].root == got[0].folded_root and got[0].verified
    assert got[0].proof_sha256 == _h("")


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 200), st.data())
def test_edges_answer_every_wish(n, data):
    """Whatever the cuts, the edges of all runs give each node that some run lacks, and no more
    than four nodes a level leave or reach a run."""
    leaves = [_h(str(i)) for i in range(n)]
    cuts = sorted({0, n, *data.draw(st.lists(st.integers(0, n), max_size=8))})
    nodes, spans = {}, list(zip(cuts, cuts[1:]))
    depth = len(op.sizes(n))
    for a, b in spans:
        got = op.edges(a, leaves[a:b], n)
        assert len(got) <= 4 * depth
        nodes |= {(level, i): x for level, i, x in got}
    op.climb(nodes, n)
    root, want = _proofs(leaves)
    for a, b in spans:
        lacks = op.wanted(a, b, n)
        assert len(lacks) <= 4 * depth and len(set(lacks)) == len(lacks)
        proofs, top = op.paths(a, leaves[a:b], n, {k: nodes[k] for k in lacks})
        assert top == root
        assert proofs == [tuple(("".join(x), "".join(y)) for x, y in p) for p in want[a:b]]
