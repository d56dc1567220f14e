import hashlib
import re

from wavelens.llm import op10_decontam as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def _brute(docs, items, n=13):
    grams = {}
    for i, t in items:
        w = _words(t)
        k = min(n, len(w))
        for s in range(len(w) - k + 1) if w else []:
            grams.setdefault(tuple(w[s:s + k]), set()).add(i)
    sizes = sorted({len(g) for g in grams})
    out = []
    for d, t in docs:
        w, hit, ids = _words(t), set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                g = tuple(w[s:s + k])
                if g in grams:
                    hit.update(range(s, s + k))
                    ids |= grams[g]
        text = ",".join(sorted(str(i) for i in ids if i is not None))
        out.append((repr(d), len(w), len(hit), len(ids), hashlib.sha256(text.encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def _got(docs, bench, **kw):
    return sorted((repr(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
                  for r in op.report(docs, bench, **kw).collect())


def test_table(spark, sample_docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = _brute([(r.doc_id, r.text) for r in sample_docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert _got(sample_docs, bench) == want
    assert any(w[-1] for w in want)


def test_short_items_and_odd_rows(spark, odd_docs, no_docs):
    items = [(1, "One, TWO!"), (2, "one two"), (3, None), (4, ""), (5, "..."), (None, "null id words"),
             (10, " ".join(f"w{i % 977} x{i}" for i in range(100, 120))), (11, "çødé"), (12, "words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = _brute([(r.doc_id, r.text) for r in odd_docs.collect()], items)
    assert _got(odd_docs, bench) == want
    assert _got(odd_docs, bench, max_windows=3) == want          # more windows than one set holds
    assert _got(no_docs, bench) == []
    clean = _got(odd_docs, bench.limit(0))
    assert len(clean) == odd_docs.count() and not any(r[-1] for r in clean)


def test_item_lengths_and_shared_windows(spark):
    """Items of every length, in one pass and in several, and a window that all long items share."""
    text = [f"v{i}" for i in range(400)]
    items = [(k, " ".join(text[10 * k:10 * k + k])) for k in range(1, 14)]
    items += [(100 + k, " ".join([f"own{k}"] * 3 + text[300:313] + [f"own{k}"])) for k in range(40)]
    docs = [(1, " ".join(text)), (2, " ".join(text[300:313])), (3, " ".join(text[301:313])), (4, " ".join(reversed(text)))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = _brute(docs, items)
    assert _got(d, b) == want == _got(d, b, max_windows=20)


def test_removal(spark):
    text = " ".join(f"t{i}" for i in range(15))
    docs = spark.createDataFrame(
        [(1, f"Before; {text.upper()}, after.", "r"), (2, "clean text", "w"), (3, " ".join(f"z{i}" for i in range(900)) + " " + text, None)],
        "doc_id long, text string, row string")
    bench = spark.createDataFrame([(7, text)], "item_id long, text string")
    kept = op.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    cut = {r.doc_id: r.text for r in op.decontaminate(docs, bench, mode="span").collect()}
    assert cut[1] == "Before; after." and cut[2] == "clean text" and cut[3].endswith("z899 ")
