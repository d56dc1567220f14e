"""Token counts: each distinct pre-token is tokenised once.

A byte-level tokenizer never merges across pre-tokens, so a text's token count is
the sum over its pre-tokens. ``count_tokens`` works in three steps:

1. every task counts the pre-tokens of its texts; one aggregation gives the table of
   distinct pre-tokens with their frequencies, and the library tokenises each of
   these once (``vocabulary``);
2. the ``heavy`` most frequent pre-tokens go to the tasks as a dictionary of at most
   ``heavy`` entries of at most ``LONG`` characters: their part of a document's count
   is a sum inside the row, so no pre-token that many rows share is ever shuffled;
3. the other pre-tokens of a document leave the row as (key, frequency), are joined
   with the table on the key and summed for each document.

No ids of documents are made. A pre-token longer than ``LONG`` characters travels as
its SHA-256 (a line feed before it: no pre-token mixes line feeds with letters).

Splitting uses Python's ``re``; a text with a character that ``re`` and the library
put in different classes (asked from the library once per character) is split by the
library itself. The special strings of the tokenizer file inside texts count as one
token each, as the library takes them by default.

Null text counts as empty: 0 bytes, 0 tokens. Every input row gives one output row,
also for null or repeated ids. Only ``doc_id`` and ``text`` are read; an empty table
gives no rows. A tokenizer file that is not byte level, or changes texts before
splitting, raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelens.llm.store import batches_of, stage

LONG = 64              # characters up to which a pre-token is its own key
HEAVY = 1 << 16        # pre-tokens whose counts every task holds
HELD = 100_000         # distinct pre-tokens a task holds before it passes them on
PROBED = 0x3000        # characters below are compared once, by the driver
ROWS = 512             # rows worked on at a time, and texts in a batch


class Splitter:
    """Pre-tokens of whole texts for a byte-level tokenizer file. ``rules`` of another splitter
    of the file (its special strings and odd characters below ``PROBED``) save loading the file
    as long as no character from ``PROBED`` on is met."""

    def __init__(self, path: str, rules: tuple[list[str], list[str]] | None = None):
        self.path, self._tok = path, None
        if rules is None:
            rules = self._read_rules()
        self.rules = special, odd = rules
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        # fixed by the tokenizer's kind: contractions, words, numbers, other signs, white space
        self.pieces = re.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
        self.odd = set(odd)
        self.agreed = set(map(chr, range(PROBED))) - self.odd

    @property
    def tok(self):
        if self._tok is None:
            from tokenizers import Tokenizer
            self._tok = Tokenizer.from_file(self.path)
        return self._tok

    def _read_rules(self) -> tuple[list[str], list[str]]:
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        if (pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex")
                or spec.get("normalizer") or any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added)):
            raise ValueError(f"{self.path}: not a plain byte-level tokenizer")
        special = sorted((a["content"] for a in added), key=len, reverse=True)
        return special, [c for c in map(chr, range(PROBED)) if not self._agrees(c)]

    def _agrees(self, c: str) -> bool:
        """Do ``re`` and the library put ``c`` in the same class?"""
        joins = [len(self.tok.pre_tokenizer.pre_tokenize_str(x + c)) == 1 for x in "a0\n!"]
        return joins == [bool(re.fullmatch(p, c)) for p in (r"[^\W\d_]", r"\d", r"\s", r"[^\s\w]|_")]

    def _split(self, text: str) -> list[str]:
        chars = set(text) - self.agreed
        for c in chars - self.odd:
            (self.agreed if self._agrees(c) else self.odd).add(c)
        if self.odd.isdisjoint(chars):
            return self.pieces(text)
        return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def split(self, text: str) -> tuple[list[str], int]:
        """(pre-tokens, special strings) of a text."""
        parts = self.special.split(text) if self.special else [text]
        if len(parts) == 1:
            return self._split(text), 0
        return [p for part in parts for p in self._split(part)], len(parts) - 1


def key_of(piece: str) -> str:
    return piece if len(piece) <= LONG else "\n" + hashlib.sha256(piece.encode()).hexdigest()


def sizes_of(tok, pieces: list[str]) -> list[int]:
    """Tokens of each pre-token, one by one: ``encode_batch`` starts a thread for every core of
    the machine in each worker, and each thread keeps memory of its own."""
    return [len(tok.encode(p, add_special_tokens=False)) for p in pieces]


def vocabulary(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(key, freq, n_tokens) of every distinct pre-token of ``docs.text``, stored."""
    rules = Splitter(tokenizer).rules

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, held = Splitter(tokenizer, rules), Counter()

        def out():
            keys = [key_of(p) for p in held]
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([p if len(p) > LONG else None for p in held], pa.string()),
                 pa.array(list(held.values()), pa.int64())], names=["key", "long", "freq"])

        for batch in batches:
            for text in batch.column("text"):
                held.update(splitter.split(text.as_py())[0])
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = Splitter(tokenizer, rules).tok
        for batch in batches:
            key, long = batch.column("key").to_pylist(), batch.column("long").to_pylist()
            n = sizes_of(tok, [k if p is None else p for k, p in zip(key, long)])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("freq"), pa.array(n, pa.int64())],
                                             names=["key", "freq", "n_tokens"])

    counted = (docs.select(F.col("text").cast("string").alias("text")).filter("text <> ''")
               .mapInArrow(pieces, "key string, long string, freq long")
               .groupBy("key", "long").agg(F.sum("freq").alias("freq")))
    with batches_of(docs.sparkSession, ROWS):
        return stage(counted.mapInArrow(sizes, "key string, freq long, n_tokens long"), "counts-pieces")


def frequent(known: DataFrame, heavy: int) -> dict[str, int]:
    """Token counts of the most frequent keys of ``known``, ``heavy`` at most: all from the
    least frequency band (sixteen to a doubling) on that keeps their number below."""
    band = F.floor(F.log2("freq") * 16)
    low, n = None, 0
    for r in known.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("band")).collect():
        n += r.n                                # some hundred bands
        if n > heavy:
            break
        low = r.band
    return {} if low is None else {r.key: r.n_tokens for r in known.filter(band >= low).select("key", "n_tokens").collect()}


def count_tokens(docs: DataFrame, tokenizer: str, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens for every row of ``docs``."""
    spark, rules = docs.sparkSession, Splitter(tokenizer).rules
    known = vocabulary(docs, tokenizer)
    table = spark.sparkContext.broadcast(frequent(known, heavy))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, size = Splitter(tokenizer, rules), table.value
        for batch in batches:
            head, tails = [], []
            for text in batch.column("text"):
                pieces, n = splitter.split(text.as_py() or "")
                tail = {}
                for piece, times in Counter(pieces).items():
                    key = piece if len(piece) <= LONG else key_of(piece)
                    each = size.get(key)
                    if each is None:
                        tail[key] = times
                    else:
                        n += each * times
                head.append(n)
                tails.append(list(tail.items()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(head, pa.int64()),
                 pa.array(tails, pa.map_(pa.string(), pa.int64()))], names=["doc_id", "n_bytes", "n", "tail"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = (read.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
               .mapInArrow(rows, "doc_id long, n_bytes long, n long, tail map<string,long>")
               .withColumn("row", F.monotonically_increasing_id()))
    with batches_of(spark, ROWS):
        parts = stage(counted, "counts-rows")
    rest = (parts.select("row", F.explode("tail").alias("key", "times")).join(known.select("key", "n_tokens"), "key")
            .groupBy("row").agg(F.sum(F.col("times") * F.col("n_tokens")).alias("more")))
    return (parts.select("row", "doc_id", "n_bytes", "n").join(rest, "row", "left")
            .select("doc_id", "n_bytes", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n_tokens")))
