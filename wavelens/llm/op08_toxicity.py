"""Toxicity: a factorization machine over hashed terms.

Terms of a text: its words (runs of letters, digits and non-ASCII bytes, A-Z
lower-cased), each hashed to one of 2^20 numbers, and the words' first 4 and 5 bytes, hashed
to numbers of their own. A beginning is taken as evidence only if it stands in many rows and
tells much (``prefix_rows``, ``prefix_chi2``), since a harmless word may share it. score = sigmoid(w0 + sum w_i + sum over pairs of <v_i, v_j>) over the terms
present, the pairwise part by the usual identity in linear time. So two terms
that are harmless alone (an insult's word, a group's name) can add up, which
linear weights miss.

Fit: a bounded sample of ``max_rows`` labelled rows, chosen by a digest. Spark counts
every term by label over the sample; terms whose chi-square statistic reaches
``min_chi2`` (at most ``max_terms``, the highest) are the machine's inputs, and so are
the terms of pairs whose meeting tells more than both terms by themselves: of the
``pair_terms`` most frequent words, those pairs whose chi-square exceeds the sum of their
terms' by ``min_gain`` (at most ``max_pairs``, the highest). So a pair counts also if its
terms are as frequent in both classes. The presence of these terms in the sampled
texts (a few hundred numbers a row) comes to the driver, where AdaGrad fits the weights
with a fixed seed. The model (some hundred KB) is broadcast.
Scoring reads whole texts where they lie, no shuffle.

Null or empty text has no terms: its score is the machine's base rate. Without a
labelled row every score is 0. Null labels are not learned from; repeated rows and ids
each give their own row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelens.llm.bytetext import LOWER, blocks, span_hashes, word_spans

BUCKETS = 1 << 20
PREFIXES = (4, 5)
TERMS = 2 * BUCKETS        # words, then beginnings
_NOT_WORD = np.ones(256, bool)
_NOT_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


@dataclass(frozen=True)
class Fit:
    max_rows: int = 20_000
    max_terms: int = 4096
    min_chi2: float = 20.0
    prefix_chi2: float = 200.0
    prefix_rows: int = 40
    pair_terms: int = 1024
    max_pairs: int = 256
    min_gain: float = 40.0
    toxic_weight: float = 2.0      # weight of a toxic row against a clean one
    factors: int = 8
    epochs: int = 12
    rate: float = 0.2
    l2: float = 1e-4
    seed: int = 8


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every term of the block's texts, with repeats."""
    low = LOWER[data]
    starts, ends, doc = word_spans(low, offs, _NOT_WORD)
    got, docs = [], []
    for k in (0, *PREFIXES):
        take = slice(None) if k == 0 else np.flatnonzero(ends - starts > k)
        first = starts[take]
        h = span_hashes(low, first, ends[take] if k == 0 else first + k)
        salt = np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        got.append(((h ^ salt) >> np.uint64(44)).astype(np.int64) + (BUCKETS if k else 0))
        docs.append(doc[take])
    return np.concatenate(docs), np.concatenate(got)


def _distinct(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(doc * TERMS + term)
    return key // TERMS, key % TERMS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = np.array(batch.column("toxic").to_pylist(), np.int64)
        for lo, _, data, offs in blocks(batch, "text"):
            doc, term = _distinct(*terms(data, offs))
            key, n = np.unique(term * 2 + label[lo + doc], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key // 2), pa.array((n * (key % 2)).astype(np.int64)),
                 pa.array((n * (1 - key % 2)).astype(np.int64))], names=["term", "pos", "neg"])


class Machine:
    """Weights of the chosen terms; ``place`` maps a bucket to them (-1: not chosen)."""

    def __init__(self, chosen: np.ndarray, cfg: Fit):
        self.chosen = np.sort(chosen.astype(np.int64))
        n = len(self.chosen)
        self.bias = 0.0
        self.w = np.zeros(n)
        self.v = np.random.default_rng(cfg.seed).normal(0, 0.01, (n, cfg.factors))

    def place(self) -> np.ndarray:
        out = np.full(TERMS, -1, np.int32)
        out[self.chosen] = np.arange(len(self.chosen), dtype=np.int32)
        return out

    def margin(self, doc: np.ndarray, at: np.ndarray, n_docs: int) -> np.ndarray:
        """Log-odds of documents from distinct (document, chosen term) pairs."""
        out = np.full(n_docs, self.bias)
        np.add.at(out, doc, self.w[at])
        s = np.zeros((n_docs, self.v.shape[1]))
        np.add.at(s, doc, self.v[at])
        q = np.zeros(n_docs)
        np.add.at(q, doc, (self.v[at] ** 2).sum(1))
        return out + 0.5 * ((s ** 2).sum(1) - q)

    def train(self, rows: list[np.ndarray], labels: np.ndarray, cfg: Fit) -> None:
        rng = np.random.default_rng(cfg.seed)
        n, k = self.v.shape
        g_b, g_w, g_v = 1e-6, np.full(n, 1e-6), np.full((n, k), 1e-6)
        rate = float(np.clip(labels.mean(), 1e-4, 1 - 1e-4)) if len(labels) else 0.5
        self.bias = float(np.log(rate / (1 - rate)))
        for _ in range(cfg.epochs):
            order = rng.permutation(len(rows))
            for lo in range(0, len(order), 64):
                part = order[lo:lo + 64]
                doc = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
                at = np.concatenate([rows[i] for i in part]).astype(np.int64) if len(part) else np.zeros(0, np.int64)
                p = 1 / (1 + np.exp(-np.clip(self.margin(doc, at, len(part)), -30, 30)))
                err = (p - labels[part]) * np.where(labels[part] == 1, cfg.toxic_weight, 1.0)
                s = np.zeros((len(part), k))
                np.add.at(s, doc, self.v[at])
                d_w, d_v = np.zeros(n), np.zeros((n, k))
                np.add.at(d_w, at, err[doc])
                np.add.at(d_v, at, err[doc, None] * (s[doc] - self.v[at]))
                seen = np.unique(at)
                d_w[seen] += cfg.l2 * len(part) * self.w[seen]
                d_v[seen] += cfg.l2 * len(part) * self.v[seen]
                g_w += d_w ** 2
                g_v += d_v ** 2
                g_b += err.sum() ** 2
                self.w -= cfg.rate * d_w / np.sqrt(g_w)
                self.v -= cfg.rate * d_v / np.sqrt(g_v)
                self.bias -= cfg.rate * err.sum() / np.sqrt(g_b)


def chi2(pos, neg, n_pos: int, n_neg: int):
    """Chi-square statistic of being present (numbers or columns) against the label."""
    rate = (pos + neg) / (n_pos + n_neg)
    return (pos / n_pos - neg / n_neg) ** 2 / (rate * (1 - rate) * (1 / n_pos + 1 / n_neg) + 1e-12)


def telling_pairs(rows: list[np.ndarray], labels: np.ndarray, terms: np.ndarray, cfg: Fit) -> np.ndarray:
    """Those of ``terms`` that stand in a telling pair. ``rows``: term numbers of each text."""
    place = np.full(max([int(terms.max()), *(int(r.max()) for r in rows if len(r))]) + 1, -1) if len(terms) else None
    if place is None:
        return terms
    place[terms] = np.arange(len(terms))
    met = np.zeros((2, len(terms), len(terms)), np.float32)
    for lo in range(0, len(rows), 2048):
        x = np.zeros((len(rows[lo:lo + 2048]), len(terms)), np.float32)
        for i, r in enumerate(rows[lo:lo + 2048]):
            at = place[r]
            x[i, at[at >= 0]] = 1
        for k in (0, 1):
            part = x[labels[lo:lo + 2048] == k]
            met[k] += part.T @ part
    n_pos, n_neg = int((labels == 1).sum()), int((labels == 0).sum())
    both = chi2(met[1].astype(float), met[0].astype(float), n_pos, n_neg)
    single = np.diag(both)
    gain = np.triu(both - single[:, None] - single[None, :], 1)
    best = np.argsort(-gain, axis=None, kind="stable")[:cfg.max_pairs]
    a, b = np.unravel_index(best[gain.reshape(-1)[best] >= cfg.min_gain], gain.shape)
    return terms[np.unique(np.concatenate([a, b]))]


def fit(docs: DataFrame, labels: DataFrame, cfg: Fit = Fit()) -> Machine:
    """The machine for ``labels`` (doc_id, toxic) over the texts of ``docs``."""
    spark = docs.sparkSession
    labels = (labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
              .select("doc_id", F.col("toxic").cast("int").alias("toxic")))
    share = min(1.0, cfg.max_rows / max(1, labels.count()))
    sample = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    # the sample is bounded by max_rows, so it may be sent to the texts
    texts = (docs.select("doc_id", F.col("text").cast("string").alias("text"))
             .join(F.broadcast(sample), "doc_id").select("text", "toxic"))
    counts = (texts.mapInArrow(_count, "term long, pos long, neg long")
              .groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    sums = texts.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    pos, neg = int(sums[0]), int(sums[1] - sums[0])
    if not pos or not neg:
        return Machine(np.zeros(0), cfg)
    told = chi2(F.col("pos"), F.col("neg"), pos, neg)
    word = F.col("term") < BUCKETS
    enough = F.when(word, F.col("chi2") >= cfg.min_chi2).otherwise(
        (F.col("chi2") >= cfg.prefix_chi2) & (F.col("pos") + F.col("neg") >= cfg.prefix_rows))
    best = (counts.withColumn("chi2", told).filter(enough)
            .orderBy(F.col("chi2").desc(), "term").limit(cfg.max_terms).select("term"))
    often = counts.filter(word).orderBy((F.col("pos") + F.col("neg")).desc(), "term").limit(cfg.pair_terms).select("term")
    single, often = (np.array([r[0] for r in x.collect()], np.int64) for x in (best, often))
    both = Machine(np.union1d(single, often), cfg)
    place_b = spark.sparkContext.broadcast(both.place())

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = place_b.value
        for batch in batches:
            label = batch.column("toxic")
            for lo, hi, data, offs in blocks(batch, "text"):
                doc, term = _distinct(*terms(data, offs))
                at = place[term]
                doc, at = doc[at >= 0], at[at >= 0]
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [label.slice(lo, hi - lo),
                     pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(at.astype(np.int32)))],
                    names=["toxic", "at"])

    table = (texts.mapInArrow(present, "toxic int, at array<int>")
             .select("toxic", F.sort_array("at").alias("at")).orderBy("toxic", "at").toArrow())
    label = table.column("toxic").to_numpy().astype(float)
    rows = [x.values.to_numpy() for x in table.column("at")]
    paired = telling_pairs(rows, label, np.searchsorted(both.chosen, np.sort(often)), cfg)
    machine = Machine(np.union1d(single, both.chosen[paired]), cfg)
    place = machine.place()[both.chosen]
    machine.train([place[r][place[r] >= 0] for r in rows], label, cfg)
    return machine


def score(docs: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs``."""
    # by value: executors need no copy of this package
    machine_b = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(machine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = cloudpickle.loads(machine_b.value)
        place = m.place()
        for batch in batches:
            for lo, hi, data, offs in blocks(batch, "text"):
                n = hi - lo
                if len(m.chosen):
                    doc, term = terms(data, offs)
                    at = place[term]
                    hit = at >= 0
                    key = np.unique(doc[hit] * np.int64(TERMS) + at[hit])
                    z = m.margin(key // TERMS, key % TERMS, n)
                    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                else:
                    p = np.zeros(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, n), pa.array(p, pa.float64()),
                     pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
