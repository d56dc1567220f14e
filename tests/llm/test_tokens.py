import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavelens.llm import op02_tokens as op
from wavelens.llm.queries import tokenizer_path
from wavelens.llm.store import fresh_path

ENC = op.WordEncoder(tokenizer_path())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aZé'sS \n\t.1<|>")), max_size=60))
def test_words_give_the_ids_of_the_whole_text(text):
    got = np.frombuffer(ENC.encode_batch([text])[0], ENC.dtype).tolist()
    assert got == ENC.tok.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2 ** 32 - 1), max_size=50))
def test_ranks_round_trip(numbers):
    x = np.array(numbers, "<u4")
    assert (op.decode_ranks(*op.encode_ranks(x), len(x)) == x).all()


def test_ranks_follow_frequency():
    ids = np.array([9] * 5 + [3] * 2 + [7] * 2 + [300], "<u4")
    ranked, control, data = op.encode_block(ids)
    assert np.frombuffer(ranked, "<u4").tolist() == [9, 3, 7, 300]
    assert len(data) == len(ids) and len(control) == 3
    assert (op.decode_block(ranked, control, data, len(ids)) == ids).all()


def _expected(rows):
    out, at = [], 0
    enc = {}
    for r in rows:
        ids = enc.setdefault(r.text, [*ENC.tok.encode(r.text or "", add_special_tokens=False).ids, 2])
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        out.append((r.doc_id, len(ids), crc))
    return out


@pytest.mark.parametrize("shards", [1, 3])
def test_files_round_trip(spark, sample_docs, odd_docs, shards, monkeypatch):
    for docs in (sample_docs, odd_docs):
        path = fresh_path(spark, "test-tokens")
        op.write(docs, path, tokenizer_path(), 2, shards)
        got = op.read(spark, path).collect()
        want = _expected(docs.collect())
        assert sorted((repr(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted(
            (repr(d), n, c) for d, n, c in want)
        got.sort(key=lambda r: r.start)
        at = 0
        for r in got:
            assert r.start == at and len(r.ids) == 4 * r.n_tokens
            at += r.n_tokens
        ids = [-1 if r.doc_id is None else r.doc_id for r in got]
        assert ids == sorted(ids)


def test_empty_table(spark, no_docs):
    path = fresh_path(spark, "test-tokens")
    op.write(no_docs, path, tokenizer_path(), 2)
    assert op.read(spark, path).count() == 0
