import zlib
from collections import Counter

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline as cp
from wavelens.llm import queries
from wavelens.llm.queries import tokenizer_path
from wavelens.llm.store import stage

SF = "/root/testdata/sf0.001"


def test_registered():
    assert set(queries.QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert all(any(q.startswith(f"op{n}_") for q in entry.queries()) for n in range(1, 14))


def test_stages_against_plain_rules(spark):
    """Every stage on its predecessor's rows, held against the operators' own tests' rules."""
    from tokenizers import Tokenizer
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    from tests.llm import test_decontam as td, test_jaccard as tj, test_quality as tq
    rows = {0: docs.collect()}
    for i, (_, step) in enumerate(cp.STAGES):
        docs = stage(step(spark, docs, SF), f"test-pipeline-{i}")
        rows[i + 1] = docs.collect()
        assert docs.columns == (columns if i < 4 else ["doc_id", "start", "n_tokens", "ids_crc32"])
    assert all(not tq._brute(r.text)[5] for r in rows[1])
    comp = tj._brute(rows[1])
    assert {r.doc_id for r in rows[2]} == {i for i, c in comp.items() if i == c}
    judged = {r[0]: r[-1] for r in td._brute([(r.doc_id, r.text) for r in rows[2]], bench)}
    assert {r.doc_id for r in rows[3]} == {r.doc_id for r in rows[2] if not judged[repr(r.doc_id)]}
    words = lambda rs: sum(len(tq.WORD.findall(r.text)) for r in rs)
    assert abs(words(rows[4]) - 1.5 * words(rows[3])) <= 0.02 * words(rows[3])
    tok = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in rows[4]:
        ids = [*tok.encode(r.text, add_special_tokens=False).ids, 2]
        want[(r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows[5]) == want
    assert cp.run(spark, SF).count() == len(rows[5])
