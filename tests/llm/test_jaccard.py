import random
import re

import numpy as np

from wavelens.llm import op03_jaccard as op


def _sets(rows):
    out = {}
    for r in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        s = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        out.setdefault(r.doc_id, []).append(s)
    return out


def _brute(rows):
    """{id: component} by comparing every pair."""
    sets = {i: s for i, s in _sets(rows).items() if i is not None}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if j < i and any(a and b and 100 * len(a & b) >= 80 * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def _check(docs):
    rows = docs.collect()
    want, sets = _brute(rows), _sets(rows)
    got = op.membership(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles in {len(s) for s in sets[r.doc_id]}
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)


def test_against_all_pairs(spark, sample_docs):
    _check(sample_docs.select("doc_id", "text"))


def test_edited_copies_of_every_size(spark):
    """Chains and stars of edits around the threshold, from one word to hundreds."""
    rng = random.Random(5)
    rows = []
    for size in [1, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 17, 20, 24, 29, 35, 44, 60, 90, 150, 320]:
        base = [f"v{rng.randrange(10 ** 6)}" for _ in range(size)]
        for k in range(6):
            w = list(base)
            for _ in range(max(1, size // 40) * (k % 3)):
                at = rng.randrange(len(w))
                w[at:at + 1] = rng.choice([["edit%d" % rng.randrange(99)], [], ["more", w[at]]])
            if k == 5:
                w = w[:max(1, int(size * 0.85))]
            rows.append((len(rows), " ".join(w)))
    common = " ".join(f"c{i}" for i in range(12))
    rows += [(len(rows) + i, common + f" own{i} tail{i} end{i}") for i in range(12)]
    _check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_odd_rows(spark, odd_docs, no_docs):
    _check(odd_docs.select("doc_id", "text"))
    assert op.membership(no_docs).count() == 0
    kept = op.keep_one(odd_docs.withColumnRenamed("lang", "component"))
    assert kept.columns == ["doc_id", "text", "component", "source", "n_chars"]
    assert {r.doc_id for r in kept.collect()} == {None, 1, 2, 3, 4, 5, 7, 9}


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, rows without an id, an id with several texts; near and exact copies."""
    base = [f"v{i}" for i in range(60)]
    text, near, other = " ".join(base), " ".join([*base[:59], "edit"]), " ".join(f"o{i}" for i in range(30))
    rows = [(5, text, "a"), (5, text, "b"), (5, text, "a"), (6, text, "a"), (None, text, "a"), (None, text, "z"), (9, near, "a"),
            (None, near, "a"), (7, other, "a"), (7, "quite another text of seven words here", "a"), (None, "alone without id", "a"),
            (None, "alone without id", "a"), (None, None, "a"), (None, None, "a"), (11, "", "a"), (11, "", "a"), (12, other, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in op.keep_one(docs).collect()), key=repr)
    assert kept == sorted([(5, text), (7, other), (7, "quite another text of seven words here"), (None, "alone without id"),
                           (None, None), (None, None), (11, ""), (11, "")], key=repr)


def test_allocation_covers_the_differences():
    rng = np.random.default_rng(3)
    for n in (1, 2, 4, 5, 9, 16, 40, 41, 200, 1000):
        own = op.BANDS[int(np.searchsorted(op._LOWS, n, side="right")) - 1]
        for b in range(own.number + 1):
            band = op.BANDS[b]
            if band.hi * 5 < n * 4:
                continue
            need = (n + min(n, band.hi)) // 9 + 1
            assert band.segments >= need
            t = op._allocate(rng.random(band.segments), 1 + rng.random(band.deletions), need)
            assert (t + 1).sum() >= need


def test_subsets_by_plain_loops():
    """Segment sums, costs, deletions and their extra costs against loops over the elements."""
    rng = np.random.default_rng(3)
    df = rng.integers(1, 50, op.SLOTS).astype(float)
    for n in (1, 2, 9, 60, 400, 5000):
        s = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for band in (b for b in op.BANDS if b.lo <= n <= b.hi * 5 // 4):
            salt, base = op._places(band)
            values, freqs = op.mix(s ^ op._VAL), df[(s >> np.uint64(48)).astype(np.int64)]
            sigs, cost, del_seg, del_sigs, extra = op._subsets(s, values, freqs, band, 77.0)
            seg = [((int(x) >> 32) * band.segments) >> 32 for x in op.mix(s ^ op._SEG ^ salt)]
            lost = {}
            for j in range(band.segments):
                inside = [i for i in range(n) if seg[i] == j]
                total = sum(int(values[i]) for i in inside)
                assert int(op.mix(np.array([total % (1 << 64)], np.uint64) ^ base[j])[0]) == int(sigs[j])
                f = sorted(freqs[i] for i in inside)
                assert cost[j] == (f[0] if f else 77.0)
                if j < band.deletions:
                    lost[j] = sorted(((total - int(values[i])) % (1 << 64)) ^ int(base[j]) for i in inside)
                    want = cost[j] + f[1] + (len(f) - 1) * f[0] if len(f) >= 2 else 77.0
                    assert extra[j] == max(want, cost[j])
            for j, want in lost.items():
                assert sorted(op.mix(np.array(want, np.uint64)).tolist()) == sorted(del_sigs[del_seg == j].tolist())


def test_fingerprints_of_empty_and_full_sets():
    sets = [np.array(x, np.uint64) for x in ([], [5], [], [], [7, 1 << 63, 9], [])]
    f1, f2 = op.fingerprints(np.concatenate(sets), np.array([len(x) for x in sets]))
    for i, x in enumerate(sets):
        assert f1[i] == op.mix(np.array([x.sum(dtype=np.uint64) + np.uint64(len(x))]))[0]
        assert f2[i] == (op.mix(x ^ op._VAL).sum(dtype=np.uint64) if len(x) else 0)
