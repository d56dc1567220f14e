"""Quality rules by compression bands.

Base counts (words, symbols, repeated lines, repeated 8-word windows) reject
the plainly bad texts; the verdict on the rest comes from zstandard ratios
(compressed bytes / bytes) of the whole document and of fixed chunks. A
repetitive text compresses far below ordinary prose, encoded or random bytes
far above it; the ratio of ordinary prose falls with length, so the limits
depend on the length.

Rows are judged one by one in Arrow batches: no shuffle, whole texts, memory
of one text at a time. Null or empty text: no words, fails the base rule.
Repeated rows, ties and null ids each give their own row; extra columns are
passed through by ``score``, but for those that have the name of one of its own columns: its
own take their place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wavelens.llm.bytetext import (
    BLOCK_BYTES, blocks, cover_count, span_hashes, window_hashes, word_spans)

SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


@dataclass(frozen=True)
class Bands:
    """Ratio limits by length in bytes: the entry with the largest ``from_bytes``
    not above the length holds. Below the first entry no limit applies (zstandard's
    frame outweighs the text)."""
    whole: tuple[tuple[int, float, float], ...] = (
        (128, 0.42, 1.10), (256, 0.36, 1.00), (512, 0.31, 0.90), (1024, 0.28, 0.80),
        (2048, 0.25, 0.74), (8192, 0.22, 0.70), (32768, 0.20, 0.68))
    chunk_bytes: int = 2048
    chunk: tuple[float, float] = (0.22, 0.78)
    max_bad_chunks: float = 0.30   # share of the full chunks outside the chunk band
    level: int = 3

    def limits(self, n: int) -> tuple[float, float]:
        lo, hi = 0.0, float("inf")
        for start, a, b in self.whole:
            if n >= start:
                lo, hi = a, b
        return lo, hi


COLUMNS = (("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
           ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()),
           ("ratio", pa.float64()), ("bad_chunks", pa.float64()), ("kept", pa.bool_()))
DDL = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
       "base_failed boolean, ratio double, bad_chunks double, kept boolean")


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def _ratio(z, text: bytes) -> float:
    return len(z.compress(text)) / len(text)


def _bad_chunks(z, text: bytes, bands: Bands) -> float:
    size = bands.chunk_bytes
    full = len(text) // size
    if full == 0:
        return 0.0
    lo, hi = bands.chunk
    return sum(not lo <= _ratio(z, text[i * size:(i + 1) * size]) <= hi for i in range(full)) / full


def measure(data: np.ndarray, offs: np.ndarray, bands: Bands, z) -> dict[str, list]:
    """The columns of ``COLUMNS`` for the documents of one block."""
    n_docs = len(offs) - 1
    starts, ends, doc = word_spans(data, offs)
    n_words = np.bincount(doc, minlength=n_docs)
    chars = (data & 0xC0) != 0x80                 # first bytes of code points
    in_word = np.concatenate([[0], np.cumsum(chars)])
    word_chars = np.bincount(doc, weights=in_word[ends] - in_word[starts], minlength=n_docs)
    symbols = np.concatenate([[0], np.cumsum(_IS_SYMBOL[data])])
    hashes = span_hashes(data, starts, ends)
    win, first = window_hashes(hashes, doc, 8)
    win_doc = doc[first] if len(first) else first
    cut = np.searchsorted(win_doc, np.arange(n_docs + 1))
    out: dict[str, list] = {k: [] for k, _ in COLUMNS}
    for i in range(n_docs):
        h, pos = win[cut[i]:cut[i + 1]], first[cut[i]:cut[i + 1]]
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        text = data[offs[i]:offs[i + 1]].tobytes()
        nw, rep = int(n_words[i]), cover_count(pos[twice], 8)
        failed = nw < 20 or 100 * rep > 30 * nw
        ratio = _ratio(z, text) if text else None
        lo, hi = bands.limits(len(text))
        bad = _bad_chunks(z, text, bands)
        out["n_words"].append(nw)
        out["word_chars"].append(int(word_chars[i]))
        out["n_symbols"].append(int(symbols[offs[i + 1]] - symbols[offs[i]]))
        out["n_dup_lines"].append(_dup_lines(text))
        out["n_repeat_words"].append(rep)
        out["base_failed"].append(failed)
        out["ratio"].append(ratio)
        out["bad_chunks"].append(bad)
        out["kept"].append(not failed and lo <= ratio <= hi and bad <= bands.max_bad_chunks)
    return out


def score(docs: DataFrame, text_col: str = "text", bands: Bands = Bands(),
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with the base counts, the ratios and the verdict ``kept``."""
    own = [c for c, _ in COLUMNS]
    if text_col in own:
        raise ValueError(f"the text column may not be called {text_col}")
    docs = docs.drop(*(c for c in own if c in docs.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        z = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            for lo, hi, data, offs in blocks(batch, text_col, block_bytes):
                got = measure(data, offs, bands, z)
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, *(pa.array(got[k], t) for k, t in COLUMNS)],
                    names=[*rows.schema.names, *(k for k, _ in COLUMNS)])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, {DDL}")


def keep(docs: DataFrame, text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The documents that pass, with their own columns only. The verdict is
    carried under a name of its own, so a column ``kept`` in ``docs`` is safe."""
    from pyspark.sql import functions as F
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
                        F.col(f"`{text_col}`").alias("text"))
    return score(inner, "text", bands).filter("kept").select("row.*")
