import subprocess
import sys

import pytest

from wavelens.llm import op13_counts as op
from wavelens.llm import queries as q

from .conftest import DOCS, ROOT


@pytest.fixture(scope="module")
def path():
    return q.tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    return lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)


def _check(docs, got, library):
    want = sorted(((r.doc_id, len((r.text or "").encode()), library(r.text)) for r in docs.collect()), key=repr)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()), key=repr) == want


def test_whole_table(spark, sample_docs, path, library):
    _check(sample_docs, op.count_tokens(sample_docs, path), library)


@pytest.mark.parametrize("heavy", [0, 3, 50])
def test_tail_join(sample_docs, path, library, heavy):
    """Most pre-tokens outside the dictionary: their sizes come by the join."""
    docs = sample_docs.limit(40)
    _check(docs, op.count_tokens(docs, path, heavy=heavy), library)


def test_odd_rows(spark, odd_docs, path, library):
    _check(odd_docs, op.count_tokens(odd_docs, path), library)


def test_special_and_odd_texts(spark, path, library):
    texts = ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext| >", "it's we'll 'S  x\n\n y \t", "\x1c\x1d a\x85b c ",
             "x² ½ Ⅷ ٣ 1_000 _a_ __", "é 日本語 한국 ไทย 🙂🙂 ‍", "=" * 5000, "a" * 100_000, "z" * 65 + " " + "z" * 64,
             " " * 300, "\r\n" * 70, "　  x", "ŉǅ ʼn ＡＢ １２", "\x00\x01\x7f", "\U0001F1E6͸԰a"]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts * 2)], DOCS)
    _check(docs, op.count_tokens(docs, path, heavy=10), library)


def test_every_character(path):
    """Characters that ``re`` and the library class differently are split by the library."""
    s = op.Splitter(path)
    for start in range(0, 0x30000, 0x1000):
        text = "".join(f"a{chr(c)} {chr(c)}0 !{chr(c)}\n" for c in range(start, start + 0x1000, 7) if not 0xD800 <= c < 0xE000)
        assert s.split(text)[0] == [text[a:b] for _, (a, b) in s.tok.pre_tokenizer.pre_tokenize_str(text)]
    assert s.agreed and s.odd


def test_empty_and_clashes(spark, no_docs, path):
    assert op.count_tokens(no_docs, path).collect() == []
    docs = spark.createDataFrame([(1, "a b", 5, 6, 7, 8)], "doc_id long, text string, row long, n long, tail long, key long")
    assert [tuple(r) for r in op.count_tokens(docs, path).collect()] == [(1, 3, 2)]


def test_other_tokenizers_refused():
    with pytest.raises(ValueError):
        op.Splitter(q.tokenizer_path("word_bpe_49k.json"))


def test_query(spark, library):
    df = q.op13_token_counts(spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert all(r.over_limit == (r.n_tokens > 1024) for r in df.collect())


def test_sizes_start_no_threads(path):
    """A worker's memory is that of one thread, and the sizes are those of the library."""
    code = f"""
import os
from tokenizers import Tokenizer
from wavelens.llm.op13_counts import sizes_of
tok = Tokenizer.from_file({path!r})
pieces = [f" w{{i * 7919}}x" for i in range(2000)] + ["", " the", "é", "a" * 500]
before = len(os.listdir("/proc/self/task"))
got = sizes_of(tok, pieces)
assert len(os.listdir("/proc/self/task")) == before
assert got == [len(x.ids) for x in tok.encode_batch(pieces, add_special_tokens=False)]
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)
