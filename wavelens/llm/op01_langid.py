"""Language identification by prediction by partial matching.

Every language has a variable-order byte context tree (orders 0 to ``order``)
counted on a bounded sample of labelled text and then frozen. The code length
of a byte follows escape method C with exclusion: in the longest known context
a seen byte costs -log2(count / (total + distinct)), an unseen one pays the
escape distinct / (total + distinct) and goes on in the next shorter context,
where the bytes of the longer one are excluded; below order 0 the bytes not
seen are equally likely. A text starts after ``order`` blanks. The language
with the shortest exact code of the whole text wins (ties: first by code point).

Scoring: the costs of all byte strings of the sample (context and byte) are
worked out once for all languages, so most bytes need one table lookup; the
rest of a block are worked out once per distinct string from the same trees.

The sample is bounded: about ``docs_per_lang`` chunks of at most
``chunk_chars`` characters for each language, chosen by a digest of the row (its id
included, if it has one), at a place chosen by the digest. Its trees are broadcast (a few MB). Texts are
scored where they are read: no shuffle. Memory follows one block of text.

Null text or text without a letter: ``und``, score 0. No labelled row at all:
``und`` for every row. Every input row gives one row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelens.llm.bytetext import blocks

ORDER = 3                 # longest context in bytes; context and byte fit 32 bits
DOCS_PER_LANG = 1500      # bound of the training sample, chunks for each language
CHUNK_CHARS = 2000
_BITS = np.float32


class _Lookup:
    """Open addressing from 32-bit keys to their places, looked up by numpy."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint32(32 - max(4, int(len(keys) * 4).bit_length()))
        size = 1 << (32 - int(self.shift))
        self.mask = size - 1
        self.keys = np.zeros(size, np.uint32)
        self.place = np.full(size, -1, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.place[slot] < 0
            cand, cs = todo[free], slot[free]
            _, first = np.unique(cs, return_index=True)
            self.place[cs[first]] = cand[first]
            self.keys[cs[first]] = keys[cand[first]]
            left = self.place[slot] != todo
            todo, slot = todo[left], (slot[left] + 1) & self.mask
        self.empty = not len(keys)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435761)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of every key, -1 where unknown."""
        slot = self._slot(keys)
        out = self.place[slot]
        wrong = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & self.mask
            out[wrong] = self.place[slot[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[slot[wrong]] != keys[wrong])]
        return out


class Tree:
    """Context tree of one language: counts of byte strings of 1 to order + 1 bytes."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]]):
        # grams[k]: sorted strings of k context bytes and one byte, and their counts
        self.grams = grams
        self.contexts = []
        for k, (keys, n) in enumerate(grams):
            ctx, first = np.unique(keys >> np.uint64(8), return_index=True)
            total = np.add.reduceat(n, first) if len(n) else np.zeros(0)
            distinct = np.diff(np.append(first, len(keys)))
            # bytes of the longer context, as this shorter context counts them
            shorter = np.zeros(len(ctx))
            if k:
                low, low_n = grams[k - 1]
                short = (keys & np.uint64((1 << (8 * k)) - 1))
                per = low_n[np.minimum(np.searchsorted(low, short), len(low) - 1)]
                shorter = np.add.reduceat(per, first) if len(per) else shorter
            self.contexts.append((ctx, total.astype(float), distinct.astype(float), shorter.astype(float)))

    @staticmethod
    def _at(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return i, keys[i] == x

    def bits(self, strings: np.ndarray) -> np.ndarray:
        """Exact code length of the last byte of each string (order + 1 bytes)."""
        cost = np.zeros(len(strings))
        open_ = np.ones(len(strings), bool)
        gone_n = np.zeros(len(strings))      # what exclusion takes from the total
        gone_d = np.zeros(len(strings))      # and from the distinct bytes
        for k in range(len(self.grams) - 1, -1, -1):
            part = strings & np.uint64((1 << (8 * (k + 1))) - 1)
            c, has = self._at(self.contexts[k][0], part >> np.uint64(8))
            g, seen = self._at(self.grams[k][0], part)
            use = open_ & has
            if not use.any():
                continue
            ctx, total, distinct, shorter = self.contexts[k]
            n = np.where(use, total[c] - gone_n, 1.0)
            d = np.where(use, distinct[c] - gone_d, 0.0)
            hit = use & seen
            if hit.any():
                cost[hit] -= np.log2(self.grams[k][1][g[hit]] / (n[hit] + d[hit]))
            miss = use & ~seen
            # nothing new below the exclusion: the escape is certain
            pay = miss & (d > 0) & (n + d > 0)
            cost[pay] -= np.log2(d[pay] / (n[pay] + d[pay]))
            gone_n = np.where(miss, shorter[c], gone_n)
            gone_d = np.where(miss, distinct[c], gone_d)
            open_ &= ~hit
        cost[open_] += np.log2(np.maximum(1.0, 256.0 - gone_d[open_]))
        return cost


class Model:
    """Frozen trees of all languages with the costs of the sample's strings."""

    def __init__(self, langs: list[str], trees: list[Tree], order: int):
        self.langs, self.trees, self.order = langs, trees, order
        top = [t.grams[order][0] for t in trees]
        keys = np.unique(np.concatenate(top)) if top else np.zeros(0, np.uint64)
        self.known = _Lookup(keys.astype(np.uint32))
        self.costs = self.exact(keys)

    def exact(self, strings: np.ndarray) -> np.ndarray:
        return (np.stack([t.bits(strings) for t in self.trees], 1) if self.trees
                else np.zeros((len(strings), 0))).astype(_BITS)

    def code_lengths(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Bits of every document in every language."""
        n = len(offs) - 1
        out = np.zeros((n, len(self.langs)))
        if not len(data) or not self.langs:
            return out
        x = data.astype(np.uint32)
        key = x.copy()
        inside = np.arange(len(x)) - np.repeat(offs[:-1], np.diff(offs))
        for j in range(1, self.order + 1):
            back = np.empty_like(x)
            back[:j] = 32
            back[j:] = x[:-j]
            back[inside < j] = 32
            key |= back << np.uint32(8 * j)
        place = self.known.find(key)
        rare = np.flatnonzero(place < 0)
        if len(rare):
            strings, at = np.unique(key[rare], return_inverse=True)
            place[rare] = len(self.costs) + at
            costs = np.concatenate([self.costs, self.exact(strings.astype(np.uint64))])
        else:
            costs = self.costs
        full = np.flatnonzero(np.diff(offs) > 0)
        for j in range(len(self.langs)):
            out[full, j] = np.add.reduceat(costs[:, j][place], offs[:-1][full], dtype=np.float64)
        return out


def training_sample(rows: DataFrame, docs_per_lang: int, chunk_chars: int) -> DataFrame:
    """(lang, chunk) of a bounded sample of the labelled rows (text, lang and, if there, an id)."""
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    per = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = {r["lang"]: min(1.0, docs_per_lang / r["n"]) for r in per.collect()}   # one row for each language
    if not share:
        return rows.select("lang", F.col("text").alias("chunk")).limit(0)
    # all columns, so that with an id among them copies of one text are drawn by themselves
    digest = F.xxhash64(*rows.columns)
    pick = F.lit(False)
    for lang, p in sorted(share.items()):
        pick = pick | ((F.col("lang") == lang) & (F.pmod(digest, F.lit(1 << 30)) < int(p * (1 << 30)) + 1))
    start = F.pmod(F.shiftright(digest, 30), F.greatest(F.char_length("text") - chunk_chars, F.lit(0)) + 1) + 1
    return rows.filter(pick).select("lang", F.col("text").substr(start.cast("int"), F.lit(chunk_chars)).alias("chunk"))


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lo, hi, data, offs in blocks(batch, "chunk"):
                for lang in sorted(set(langs[lo:hi])):
                    texts = [b" " * order + data[offs[i]:offs[i + 1]].tobytes()
                             for i in range(hi - lo) if langs[lo + i] == lang]
                    for k in range(order + 1):
                        keys = []
                        for t in texts:
                            x = np.frombuffer(t, np.uint8).astype(np.int64)
                            key = np.zeros(len(x) - order, np.int64)
                            for j in range(k + 1):
                                key |= x[order - j:len(x) - j] << (8 * j)
                            keys.append(key)
                        got, n = np.unique(np.concatenate(keys), return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(got)), pa.array([k] * len(got), pa.int32()),
                             pa.array(got), pa.array(n.astype(np.int64))], names=["lang", "k", "gram", "n"])
    return run


def fit(rows: DataFrame, order: int = ORDER, docs_per_lang: int = DOCS_PER_LANG,
        chunk_chars: int = CHUNK_CHARS) -> Model:
    """Trees of every language of ``rows`` (text, lang). Counting is a Spark job;
    the counts brought to the driver are bounded by the sample."""
    sample = training_sample(rows, docs_per_lang, chunk_chars)
    counts = (sample.mapInArrow(_count(order), "lang string, k int, gram long, n long")
              .groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).toPandas())
    langs = sorted(counts["lang"].unique())
    trees = []
    for lang in langs:
        own = counts[counts["lang"] == lang]
        grams = []
        for k in range(order + 1):
            part = own[own["k"] == k].sort_values("gram")
            grams.append((part["gram"].to_numpy(np.int64).astype(np.uint64), part["n"].to_numpy(float)))
        trees.append(Tree(grams))
    return Model(langs, trees, order)


def predict(docs: DataFrame, model: Model, extra: list[str] = ()) -> DataFrame:
    """doc_id, lang_pred, score (share of the winner if all languages are equally
    likely beforehand) and ``bits`` (its code length) for every row."""
    # by value: executors need no copy of this package
    model_b = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = cloudpickle.loads(model_b.value)
        for batch in batches:
            letters = batch.column("_letter").to_pylist()
            for lo, hi, data, offs in blocks(batch, "text", 1 << 20):
                bits = m.code_lengths(data, offs)
                names, score, best_bits = [], [], []
                for i in range(hi - lo):
                    if not letters[lo + i] or not m.langs:
                        names.append("und"), score.append(0.0), best_bits.append(None)
                        continue
                    best = int(np.argmin(bits[i]))
                    names.append(m.langs[best])
                    score.append(float(1.0 / np.exp2(np.maximum(bits[i][best] - bits[i], -1000.0)).sum()))
                    best_bits.append(float(bits[i][best]))
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(c) for c in ("doc_id", *extra)]
                    + [pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(best_bits, pa.float64())],
                    names=["doc_id", *extra, "lang_pred", "score", "bits"])

    src = docs.select("doc_id", *extra, F.col("text").cast("string").alias("text"),
                      F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.select("doc_id", *extra).schema.fields)
    return src.mapInArrow(run, f"{fields}, lang_pred string, score double, bits double")
