"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

``write`` encodes whole texts with a tokenizer file, deals the documents by
ranges of ``doc_id`` to shards and stores every shard as blocks of whole
documents. A block is one Parquet row (Spark's own writer and commit protocol,
so any file system Spark can write and any lost task are covered):

* ``ranked``: the ids of the block by falling frequency (ties: smaller id
  first), 32-bit little endian;
* ``control``: two bits for every id, four ids to a byte, lowest bits first:
  the number of bytes of its rank less one;
* ``data``: the ranks, one to four bytes each, little endian, no gaps;
* ``doc_ids``, ``doc_lens``: the documents in ascending order and their ids.

``read`` decodes with table lookups in numpy: 256 x 4 lengths by control byte,
one running sum for the offsets, then one gather for each byte of a rank.

The only shuffle carries packed ids once. Shard bounds are quantiles of
``doc_id`` over all rows; one document is the smallest unit, so a hot source
or a group of copies is spread like any other rows. Null text is an empty
text, null ids come first, rows with the same id are ordered by their ids'
bytes, and every input row gives one output row. Extra columns are not read.
An empty table writes no block and reads back as no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_IDS = 1 << 21        # ids of a block, except for a longer document
MEMO_WORDS = 600_000       # words a worker remembers before it starts afresh
_U4 = np.dtype("<u4")


# ---------------------------------------------------------------- coding

_LENS = np.array([[((c >> (2 * j)) & 3) + 1 for j in range(4)] for c in range(256)], np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of 32-bit numbers."""
    n = len(ranks)
    r = ranks.astype(_U4)
    size = 1 + (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    codes = np.zeros(-(-n // 4) * 4, np.uint8)
    codes[:n] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    kept = np.arange(4) < size[:, None]
    return control.astype(np.uint8).tobytes(), r.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _LENS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    raw = np.frombuffer(data, np.uint8)
    ends = np.cumsum(size, dtype=np.int64)
    at = ends - size
    out = raw[at].astype(_U4)
    for j in (1, 2, 3):
        more = np.flatnonzero(size > j)
        if not len(more):
            break
        out[more] |= raw[at[more] + j].astype(_U4) << np.uint32(8 * j)
    return out


def encode_block(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(ranked, control, data) of a block's ids."""
    counts = np.bincount(ids)
    used = np.flatnonzero(counts)
    ranked = used[np.argsort(-counts[used], kind="stable")]
    rank = np.zeros(len(counts), _U4)
    rank[ranked] = np.arange(len(ranked), dtype=_U4)
    control, data = encode_ranks(rank[ids])
    return ranked.astype(_U4).tobytes(), control, data


def decode_block(ranked: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ranked, _U4)[decode_ranks(control, data, n)]


# ------------------------------------------------------------- tokenizer

def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 characters stand for themselves,
    the other bytes for the characters from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class WordEncoder:
    """Ids of a text, word by word, with a memory of the words seen.

    The tokenizer drops white space and never merges across it, so a text's
    ids are the ids of its pieces between blanks and line feeds in a row.
    Pieces of printable ASCII and precomposed Latin letters take the library's
    BPE model directly (lower case, then runs of letters, single digits, runs
    of other signs); every other piece, and any that may hold a special
    token, goes through the library's whole pipeline. Both give the ids that
    the tokenizer gives for the whole text (tests compare them).
    """

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        import regex
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.wide = self.tok.get_vocab_size(True) > 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        # the direct way holds for the word-splitting pipeline only
        self.direct = _is_word_pipeline(self.tok)
        self.plain = regex.compile(r"[\x21-\x7EÀ-ÖØ-öø-įı-ȳ]+")
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.letters = _byte_letters()
        self.memo_words = memo_words
        self.words: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {}

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'I' if self.wide else 'H'}", *ids)

    def _part(self, part: str) -> bytes:
        text = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
        got = self.parts[part] = self._packed([t.id for t in self.tok.model.tokenize(text)])
        return got

    def _word(self, word: str) -> bytes:
        plain = word.isprintable() if word.isascii() else self.plain.fullmatch(word)
        if not plain or "<|" in word:
            return self._packed(self.tok.encode(word, add_special_tokens=False).ids)
        low, parts = word.lower(), self.parts
        if low.isalpha():
            return parts.get(low) or self._part(low)
        return b"".join([parts.get(p) or self._part(p) for p in self.pieces.findall(low)])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        if not self.direct:
            return [self._packed(x.ids) for x in self.tok.encode_batch(texts, add_special_tokens=False)]
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.words) > self.memo_words:
            self.words = {"": b""}
        if len(self.parts) > self.memo_words:
            self.parts = {}
        known = self.words
        for words in split:
            for w in set(words).difference(known):
                known[w] = self._word(w)
        get = known.__getitem__
        return [b"".join(map(get, words)) for words in split]


def _is_word_pipeline(tok) -> bool:
    """True if white space is dropped and the pieces are those of ``WordEncoder``."""
    import json
    spec = json.loads(tok.to_str())
    norm = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (norm == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in pre] == ["Split", "ByteLevel"]
            and pre[0].get("invert") and pre[0].get("behavior") == "Removed"
            and pre[0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"})


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One encoder (and its memory) for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


# ---------------------------------------------------------------- writing

def encode_documents(docs: DataFrame, tokenizer: str, bounds: list[int], end_id: int) -> DataFrame:
    """(doc_id, shard, ids) for every row: packed ids with ``end_id`` at the end."""
    cuts = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            ids_col, text_col = batch.column("doc_id"), batch.column("text")
            lo = 0
            while lo < len(batch):                      # some MB of text at a time
                hi, size, texts = lo, 0, []
                while hi < len(batch) and size < 1 << 22:
                    texts.append(text_col[hi].as_py() or "")
                    size += len(texts[-1])
                    hi += 1
                packed = [x + end for x in enc.encode_batch(texts)]
                part = ids_col.slice(lo, hi - lo)
                keys = part.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [part, pa.array(np.searchsorted(cuts, keys, side="left").astype(np.int32)),
                     pa.array([enc.dtype.itemsize] * (hi - lo), pa.int32()), pa.array(packed, pa.binary())],
                    names=["doc_id", "shard", "width", "ids"])
                lo = hi

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, shard int, width int, ids binary"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted documents of one shard to blocks."""
    def block(docs: list, at: int, number: int) -> pa.RecordBatch:
        ids = np.concatenate([x for _, _, x in docs])
        ranked, control, data = encode_block(ids)
        return pa.RecordBatch.from_pylist([{
            "shard": docs[0][1], "block": number, "shard_start": at, "n_ids": len(ids),
            "doc_ids": [d for d, _, _ in docs], "doc_lens": [len(x) for _, _, x in docs],
            "ranked": ranked, "control": control, "data": data}], schema=_BLOCK_ARROW)

    held, size, at, number = [], 0, 0, 0
    for batch in batches:
        for d, s, w, ids in zip(*(batch.column(c) for c in ("doc_id", "shard", "width", "ids"))):
            x = np.frombuffer(ids.as_buffer(), f"<u{w.as_py()}").astype(_U4)
            if held and size + len(x) > BLOCK_IDS:
                yield block(held, at, number)
                at, number, held, size = at + size, number + 1, [], 0
            held.append((d.as_py(), s.as_py(), x))
            size += len(x)
    if held:
        yield block(held, at, number)


_BLOCK_ARROW = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("shard_start", pa.int64()), ("n_ids", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())),
    ("ranked", pa.binary()), ("control", pa.binary()), ("data", pa.binary())])
_BLOCK_DDL = ("shard int, block int, shard_start long, n_ids long, doc_ids array<long>, "
              "doc_lens array<long>, ranked binary, control binary, data binary")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, n_shards: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and store the blocks under ``path``."""
    spark = docs.sparkSession
    n = n_shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = []
    if n > 1:
        cut = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / n for i in range(1, n)],
                                           max(10_000, 20 * n))).first()[0]
        bounds = sorted(set(cut or []))
    (encode_documents(docs, tokenizer, bounds, end_id)
     .repartitionById(len(bounds) + 1, "shard")
     .sortWithinPartitions("doc_id", "ids")
     .mapInArrow(_pack, _BLOCK_DDL)
     .write.mode("errorifexists").option("compression", "uncompressed").parquet(path))


# ---------------------------------------------------------------- reading

def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(len(batch)):
            row = {k: batch.column(k)[r] for k in batch.schema.names}
            lens = np.array(row["doc_lens"].as_py(), np.int64)
            ids = decode_block(row["ranked"].as_buffer(), row["control"].as_buffer(),
                               row["data"].as_buffer(), row["n_ids"].as_py())
            ends = np.cumsum(lens)
            starts = ends - lens
            doc_ids = row["doc_ids"].as_py()
            lo = 0
            while lo < len(lens):                       # some MB of ids at a time
                hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + (1 << 20), side="right")))
                yield pa.RecordBatch.from_pylist(
                    [{"doc_id": doc_ids[i], "shard": row["shard"].as_py(),
                      "in_shard": row["shard_start"].as_py() + int(starts[i]), "n_tokens": int(lens[i]),
                      "ids": ids[starts[i]:ends[i]].tobytes(),
                      "ids_crc32": zlib.crc32(ids[starts[i]:ends[i]])} for i in range(lo, hi)], schema=_DOC_ARROW)
                lo = hi


_DOC_ARROW = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("in_shard", pa.int64()),
                        ("n_tokens", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64())])


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32 and, with ``with_ids``,
    ids (32-bit little endian). ``start`` counts the ids of all documents before."""
    stored = spark.read.schema(_BLOCK_DDL).parquet(path)
    # one row for each shard, a shard being one task's output
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = (stored.groupBy("shard").agg(F.sum("n_ids").alias("n"))
              .select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before")))

    def unpack(batches):
        for out in _unpack(batches):
            yield out if with_ids else out.drop_columns(["ids"])

    ids = ", ids binary" if with_ids else ""
    rows = stored.mapInArrow(unpack, f"doc_id long, shard int, in_shard long, n_tokens long{ids}, ids_crc32 long")
    return (rows.join(before, "shard")
            .select("doc_id", (F.col("before") + F.col("in_shard")).alias("start"), "n_tokens",
                    *(["ids"] if with_ids else []), "ids_crc32"))
