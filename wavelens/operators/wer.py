"""Word error rate (E1-E6) and pairing of hypotheses with references.

E1 in ``pair_scores`` works on a batch of pairs at a time (``pair_edits``): Arrow's dictionary encoding
numbers the words, array arithmetic cuts those that both texts begin or end with, and what
is left takes a bit-parallel edit distance (a row of the table in an integer). ``word_edits`` is E1 with
column expressions alone: words become code points (from U+10000 up, so never a surrogate) and Spark's
``levenshtein`` gives the distance within a band that grows as needed. The evaluation is
narrow per row, followed by one partial + final aggregation. Until it is scored a text stays
one string, its words between spaces: word lists are never shuffled.

Corpus WER is total edits over total reference words, not the mean of
per-row rates. A corpus with no reference words gives NULL, not an error.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelens.functions import text as tx

CODE_BASE = 0xFFFF  # array_position is 1-based: the first word maps to U+10000
PLANE_START = 0x10000
PLANE_SIZE = 0x100000  # U+10000 .. U+10FFFF: no surrogates in this range
BANDS = (32, 256, 2048)  # bounds tried before the full distance
_COUNTS = T.StructType([T.StructField("n", T.LongType()), T.StructField("edits", T.LongType())])
PAIR_BYTES = 1 << 19    # characters of references and hypotheses coded at a time


def _codes_to_text(hexes: Column) -> Column:
    return F.decode(F.unhex(F.array_join(hexes, "")), "UTF-32")


def _word_codes(words: Column, vocab: Column) -> Column:
    """Exact coding: each word becomes the code point of its position in
    ``vocab`` (a linear search per word)."""
    return _codes_to_text(F.transform(
        words, lambda w: F.lpad(F.hex(F.array_position(vocab, w) + CODE_BASE), 8, "0")))


def _hash_code(w: Column, fn) -> Column:
    return F.pmod(fn(w), F.lit(PLANE_SIZE)) + PLANE_START


def _hashed_codes(words: Column, fn) -> Column:
    """Fast coding: each word becomes the code point of its hash (constant
    time per word); exact only when no two words of the pair collide."""
    return _codes_to_text(F.transform(words, lambda w: F.lpad(F.hex(_hash_code(w, fn)), 8, "0")))


def _collision_free(vocab: Column, fn) -> Column:
    return F.size(F.array_distinct(F.transform(vocab, lambda w: _hash_code(w, fn)))) == F.size(vocab)


def word_vocab(ref_words: Column, hyp_words: Column) -> Column:
    """Distinct words of a pair."""
    return F.array_distinct(F.concat(ref_words, hyp_words))


def _band_distance(a: Column, b: Column, bands: Sequence[int] = BANDS) -> Column:
    """Edit distance of two texts: the bounded distance (a band around the diagonal) with a
    growing bound, so few edits cost little however long the texts are. A lambda names each
    bounded distance, so it is computed once."""
    if not bands:
        return F.levenshtein(a, b)
    return F.transform(F.array(F.levenshtein(a, b, bands[0])),
                       lambda d: F.when(d >= 0, d).otherwise(_band_distance(a, b, bands[1:])))[0]


def word_edits(ref_words: Column, hyp_words: Column, vocab: Column | None = None) -> Column:
    """Minimum number of word substitutions, deletions and insertions.

    Words become single code points and Spark's ``levenshtein`` (which
    counts code points) does the rest, within a band first. The code of a word is its hash when
    the pair's distinct words do not collide (checked per pair, two hash
    functions tried); otherwise its position in the pair's vocabulary. Both
    ways give distinct words distinct codes, so the count is exact.

    Pass ``vocab`` as a column computed in an earlier projection: an
    expression used inside a per-word lambda would be re-evaluated for every
    word.
    """
    if vocab is None:
        vocab = word_vocab(ref_words, hyp_words)

    def codes(code):
        return F.struct(code(ref_words).alias("r"), code(hyp_words).alias("h"))

    both = (F.when((F.size(ref_words) == 0) | (F.size(hyp_words) == 0), F.lit(None))
            .when(_collision_free(vocab, F.xxhash64), codes(lambda w: _hashed_codes(w, F.xxhash64)))
            .when(_collision_free(vocab, F.hash), codes(lambda w: _hashed_codes(w, F.hash)))
            .otherwise(codes(lambda w: _word_codes(w, vocab))))
    # the codes are made once and named by the lambda
    distance = F.transform(F.array(both), lambda c: _band_distance(c["r"], c["h"]))[0]
    return F.coalesce(distance, F.greatest(F.size(ref_words), F.size(hyp_words)))


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between spaces of all texts, and how many each has."""
    lists = pc.split_pattern(texts, " ")
    words, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(real, dtype=np.int64)])[np.concatenate([[0], ends])]
    return (words if real.all() else words.filter(pa.array(real))), np.diff(upto)


def _shared_run(a: np.ndarray, b: np.ndarray, at: np.ndarray, bt: np.ndarray, n: np.ndarray, step: int) -> np.ndarray:
    """For each pair, how many of ``n`` words from ``at`` and ``bt`` on (``step`` 1 or -1) agree
    before the first that does not."""
    out, some = n.copy(), np.flatnonzero(n)
    if len(some):
        k = n[some]
        first = np.cumsum(k) - k
        i = np.arange(int(k.sum())) - np.repeat(first, k)
        apart = a[np.repeat(at[some], k) + step * i] != b[np.repeat(bt[some], k) + step * i]
        out[some] = np.minimum(np.minimum.reduceat(np.where(apart, i, np.iinfo(np.int64).max), first), k)
    return out


def _distance(a: list[int], b: list[int]) -> int:
    """Edit distance of two lists of word codes, a row of the table at a time as bits of an integer."""
    if len(a) < len(b):
        a, b = b, a
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    n = len(a)
    full, last, get = (1 << n) - 1, 1 << n >> 1, places.get
    up, down = full, 0                  # where a row rises or falls by one
    for y in b:
        eq = get(y, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        rise = down | (full & ~(x | up))
        fall = up & x
        if rise & last:
            n += 1
        elif fall & last:
            n -= 1
        rise = rise << 1 | 1
        eq |= down
        up = full & (fall << 1 | ~(eq | rise))
        down = full & rise & eq
    return n


def _counted(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    (rw, rn), (hw, hn) = _split(ref), _split(hyp)
    codes = pa.concat_arrays([rw, hw]).dictionary_encode().indices.to_numpy().astype(np.int64)
    a, b = codes[:len(rw)], codes[len(rw):]
    at, bt = np.cumsum(rn) - rn, np.cumsum(hn) - hn
    head = _shared_run(a, b, at, bt, np.minimum(rn, hn), 1)
    foot = _shared_run(a, b, at + rn - 1, bt + hn - 1, np.minimum(rn, hn) - head, -1)
    edits = np.maximum(rn, hn) - head - foot
    for i in np.flatnonzero(np.minimum(rn, hn) > head + foot):
        edits[i] = _distance(a[at[i] + head[i]:at[i] + rn[i] - foot[i]].tolist(),
                             b[bt[i] + head[i]:bt[i] + hn[i] - foot[i]].tolist())
    return pa.StructArray.from_arrays([pa.array(rn), pa.array(edits)], names=["n", "edits"])


@F.arrow_udf(_COUNTS)
def pair_edits(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """E1 for pairs of texts (words between spaces): words of the reference, and the minimum number
    of word substitutions, deletions and insertions."""
    ref, hyp = pc.fill_null(ref, ""), pc.fill_null(hyp, "")
    size = np.cumsum(pc.binary_length(ref).to_numpy(zero_copy_only=False).astype(np.int64)
                     + pc.binary_length(hyp).to_numpy(zero_copy_only=False))
    out, lo = [], 0
    while lo < len(ref):                    # a part at a time, one pair at least
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + PAIR_BYTES, side="right")))
        out.append(_counted(ref.slice(lo, hi - lo), hyp.slice(lo, hi - lo)))
        lo = hi
    return pa.concat_arrays(out) if out else _counted(ref, hyp)


def prepare_references(refs: DataFrame, ref_col: str = "reference",
                       normalizer: Callable[[Column], Column] = tx.normalize_text) -> DataFrame:
    """The text of each reference whose words lie between spaces, plain (``_rw``) and normalised
    (``_rn``), computed once per reference however many hypotheses (models)
    are scored against it."""
    ref = F.coalesce(F.col(ref_col), F.lit(""))
    return refs.withColumn("_rw", tx.wer_text(ref)).withColumn("_rn", normalizer(ref)).drop(ref_col)


def pair_scores(pairs: DataFrame, ref_col: str = "reference", hyp_col: str = "hypothesis",
                normalizer: Callable[[Column], Column] = tx.normalize_text) -> DataFrame:
    """Per pair: reference words and edits, plain and after ``normalizer``.
    Uses the reference texts of :func:`prepare_references` when present."""
    if "_rw" not in pairs.columns:
        pairs = prepare_references(pairs, ref_col, normalizer)
    hyp = F.coalesce(F.col(hyp_col), F.lit(""))
    return (pairs.withColumn("_hw", tx.wer_text(hyp)).withColumn("_hn", normalizer(hyp))
            .withColumn("_p", pair_edits("_rw", "_hw")).withColumn("_q", pair_edits("_rn", "_hn"))
            .withColumn("n_ref_words", F.col("_p.n")).withColumn("n_edits", F.col("_p.edits"))
            .withColumn("n_ref_words_norm", F.col("_q.n")).withColumn("n_edits_norm", F.col("_q.edits"))
            .drop("_rw", "_hw", "_rn", "_hn", "_p", "_q"))


def join_pairs(refs: DataFrame, hyps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J1 (inner): hypotheses paired with their reference by key. Inputs
    read from a few small files can be fanned out first with
    :func:`wavelens.plans.parallel.spread`."""
    return hyps.join(refs, list(keys), "inner")


def pairing_report(refs: DataFrame, hyps: DataFrame, keys: Sequence[str],
                   models: Sequence[str]) -> DataFrame:
    """J1 (full outer): every (key, model) with its status: ``paired``,
    ``missing_hypothesis`` or ``missing_reference``. The model list is a
    parameter, so references are widened by a fixed-size explode."""
    r = refs.select(*keys, F.explode(F.array(*[F.lit(m) for m in models])).alias("model"),
                    F.lit(True).alias("_has_ref"))
    h = hyps.select(*keys, "model", F.lit(True).alias("_has_hyp"))
    j = r.join(h, list(keys) + ["model"], "full_outer")
    status = (F.when(F.col("_has_ref") & F.col("_has_hyp"), F.lit("paired"))
              .when(F.col("_has_ref"), F.lit("missing_hypothesis"))
              .otherwise(F.lit("missing_reference")))
    return j.select(*keys, "model", status.alias("status"))


def corpus_wer(scored: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Plain and normalised corpus WER per group, one pass."""
    return (scored.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.sum("n_ref_words").alias("n_ref_words"),
        F.sum("n_edits").alias("n_edits"),
        F.sum("n_ref_words_norm").alias("n_ref_words_norm"),
        F.sum("n_edits_norm").alias("n_edits_norm"))
        .withColumn("wer", F.try_divide(F.col("n_edits").cast("double"), F.col("n_ref_words").cast("double")))
        .withColumn("gt_wer", F.try_divide(F.col("n_edits_norm").cast("double"),
                                           F.col("n_ref_words_norm").cast("double"))))


def evaluate(refs: DataFrame, hyps: DataFrame, keys: Sequence[str], group_cols: Sequence[str],
             normalizer: Callable[[Column], Column] = tx.normalize_text) -> DataFrame:
    """The metric function: pair, score, aggregate."""
    prepared = prepare_references(refs, normalizer=normalizer)
    return corpus_wer(pair_scores(join_pairs(prepared, hyps, keys), normalizer=normalizer), group_cols)


def formatting_share(metrics: DataFrame) -> DataFrame:
    """E5: share of WER removed by normalisation, ``(wer - gt_wer) / wer``."""
    return metrics.withColumn("format_share", F.try_divide(F.col("wer") - F.col("gt_wer"), F.col("wer")))


def rank_models(metrics: DataFrame, metric: str = "wer", model_col: str = "model") -> DataFrame:
    """Models ordered by a metric, lower is better. The input holds one
    row per model (already aggregated), so the global window is small."""
    w = Window.orderBy(F.col(metric).asc_nulls_last(), F.col(model_col))
    return metrics.withColumn("rank", F.rank().over(w))
