"""Label preparation.

The model's own sub-word tokeniser is a per-row library and is not rebuilt.
In its place the word dictionary is a Spark table: words are exploded,
counted and ranked (count desc, word asc) with a distributed index, so ids are frequency
ranks. A dictionary is a table ``(token, id, is_special)`` with dense ids. Both directions
treat its head and its tail apart: the ``HEAVY_WORDS`` lowest ids (almost all words of
almost all texts) are looked up beside the row, and only what is left over is joined. A user can also supply
``labels`` from their own tokeniser (a ``pandas_udf``) and use the rest.

Batch-wide steps (F12, F17) use windows over ``batch_id``: a batch holds a
handful of rows, so those windows are bounded.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelens.functions.text import words
from wavelens.functions.wav import read_chunks
from wavelens.plans.scan import dense_index
from wavelens.sources.materialize import materialize

# Special tokens and the lengths the reference trains with.
EOT = "<|endoftext|>"            # also the padding token
SOT = "<|startoftranscript|>"    # decoder start token
UNK = "<|unk|>"
SPECIALS = (EOT, SOT, UNK)
EOT_ID, SOT_ID, UNK_ID = 0, 1, 2
PAD_ID = EOT_ID
IGNORE_ID = -100
MAX_LABEL_LENGTH = 367           # longest label 347 + margin 20
LENGTH_MARGIN = 20
TRAIN_BATCH = 4
EVAL_BATCH = 8

HEAVY_WORDS = 1 << 16            # lowest ids of a dictionary, known to every task
HEAVY_LENGTH = 64                # longest word among them
TAIL_OUT = 1 << 18               # words outside the head given out at once
RANK_BLOCK = 4096                # ids of a block when decoding
SAMPLES_OUT = 1 << 20            # samples of clips given out at once
DROPPED = "\x00"                 # slot of a special token that decoding leaves out


def build_dictionary(texts: DataFrame, text_col: str = "transcription", store_key: dict | None = None) -> DataFrame:
    """Word dictionary ``(token, id, is_special, count)``: special tokens
    first, then words by count (desc) and text. Counting is a partial
    aggregate; ids come from a distributed running index over the counts.

    With ``store_key`` (parameters identifying the input), the counts and
    the finished dictionary are stored under the shared checkpoint folder
    and reused by later jobs, as a tokeniser's vocabulary is built once."""
    spark = texts.sparkSession

    def build():
        counts = (texts.select(F.explode(words(text_col)).alias("token"))
                  .groupBy("token").agg(F.count(F.lit(1)).alias("count"))
                  .withColumn("_neg", -F.col("count")))
        if store_key is not None:
            counts = materialize(counts, "word_counts", store_key)
        ranked = dense_index(counts, [], ["_neg", "token"], out="_rank", stored=store_key is not None)
        special = spark.createDataFrame([(t, i) for i, t in enumerate(SPECIALS)], "token string, id int")
        return (ranked.select("token", (F.col("_rank") + len(SPECIALS)).cast("int").alias("id"),
                              F.lit(False).alias("is_special"), "count")
                .unionByName(special.select("token", "id", F.lit(True).alias("is_special"),
                                            F.lit(0).cast("long").alias("count"))))

    return materialize(build, "dictionary", store_key, spark=spark) if store_key is not None else build()


def _is_heavy(heavy: int) -> Column:
    """Rows of a dictionary that are sent to every task: ``heavy`` at most (ids are dense), of
    at most ``HEAVY_LENGTH`` characters, so a few MB."""
    return (F.col("id") < heavy) & (F.length("token") <= HEAVY_LENGTH)


def _word_ids(head):
    """A column function: text to ``ids`` of its words (-1: not in the dictionary ``head``, a broadcast).
    Python's ``split`` and :func:`words` know the same white space."""
    @F.arrow_udf("array<int>")
    def ids(text: pa.Array) -> pa.Array:
        get, flat, ends = head.value.get, array("i"), [0]
        for t in text:
            found = t.as_py()
            flat.extend([get(w, -1) for w in found.split()] if found else [])
            ends.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))
    return ids


def _tail_words(head, keys: int):
    """A function of batches of ``keys`` key columns and a text: a row (keys, pos, token) for each word
    outside the dictionary ``head`` (a broadcast). Rows are given out when there are ``TAIL_OUT`` of them."""
    def tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        for batch in batches:
            row, pos, token = array("i"), array("i"), []
            for i, t in enumerate(batch.column(keys)):
                found = t.as_py()
                found = found.split() if found else []
                out = [p for p, w in enumerate(found) if w not in known]
                row.extend([i] * len(out))
                pos.extend(out)
                token.extend([found[p] for p in out])
                if len(token) >= TAIL_OUT:
                    yield _rows_at(batch, keys, row, pos=pos, token=pa.array(token, pa.string()))
                    row, pos, token = array("i"), array("i"), []
            yield _rows_at(batch, keys, row, pos=pos, token=pa.array(token, pa.string()))
    return tail


def _rows_at(batch: pa.RecordBatch, keys: int, row, **more) -> pa.RecordBatch:
    """The key columns of the rows numbered ``row``, and the columns ``more`` beside them."""
    at = pa.array(np.array(row, np.int32))
    more = {k: v if isinstance(v, pa.Array) else pa.array(np.array(v, np.int32)) for k, v in more.items()}
    return pa.RecordBatch.from_arrays([batch.column(k).take(at) for k in range(keys)] + list(more.values()),
                                      names=[*batch.schema.names[:keys], *more])


def _offsets(lists: pa.ListArray) -> np.ndarray:
    return lists.offsets.to_numpy().astype(np.int64)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _labels_of(rows: pa.Array, more: pa.Array) -> pa.Array:
    """Labels of each key: the ids of its rows' words and those of the tail (``more``: pos << 32 | id) by
    position, between SOT and EOT. Arithmetic over the whole batch; only where a key has several
    rows, or a word that no tail brings, are its words sorted."""
    outer, inner, ids = _offsets(rows), _offsets(rows.values), rows.values.values.to_numpy()
    first, last = inner[outer[0]], inner[outer[-1]]
    n_row = np.diff(inner[outer[0]:outer[-1] + 1])
    key_of_row = np.repeat(np.arange(len(rows)), np.diff(outer))
    ids, key = ids[first:last], np.repeat(key_of_row, n_row)
    pos = np.arange(len(ids)) - np.repeat(np.cumsum(n_row) - n_row, n_row)
    m = _offsets(more)
    both = more.values.to_numpy()[m[0]:m[-1]]
    more_id, more_pos = (both & 0xFFFFFFFF).astype(np.int32), both >> 32
    more_key = np.repeat(np.arange(len(rows)), np.diff(m))
    known = ids >= 0
    n = np.bincount(key[known], minlength=len(rows)) + np.diff(m)
    out = np.full(int(n.sum()) + 2 * len(rows), EOT_ID, np.int32)
    start = np.concatenate([[0], np.cumsum(n + 2)])
    out[start[:-1]] = SOT_ID
    odd = (np.diff(outer) > 1) | (n != np.bincount(key, minlength=len(rows)))
    plain = known & ~odd[key]
    out[(start[key] + 1 + pos)[plain]] = ids[plain]
    plain = ~odd[more_key]
    out[(start[more_key] + 1 + more_pos)[plain]] = more_id[plain]
    if odd.any():
        a, b = known & odd[key], odd[more_key]
        k, p, i = (np.concatenate([x[a], y[b]]) for x, y in ((key, more_key), (pos, more_pos), (ids, more_id)))
        order = np.lexsort((i, p, k))
        k, i = k[order], i[order]
        per = np.bincount(k, minlength=len(rows))
        out[start[k] + 1 + np.arange(len(k)) - (np.cumsum(per) - per)[k]] = i
    return pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(out))


def tokenize(df: DataFrame, key_cols: Sequence[str], dictionary: DataFrame,
             text_col: str = "transcription", out: str = "labels", heavy: int = HEAVY_WORDS) -> DataFrame:
    """F10 + J3: ``labels`` = [SOT] + word ids + [EOT]; unknown words get
    UNK. Word positions are kept, so the order of words is exact. Texts with no words give
    [SOT, EOT].

    The head of the dictionary is a broadcast; the words of a text meet it in the row, and the
    row goes on as ids, dealt by the keys once. Words outside the
    head travel as (keys, position, word) to the rest of the dictionary and their ids come
    back. The rest is dealt by word, each word once: it grows with the vocabulary, so it is never
    copied nor sent through the driver, however small its files; an unknown word that a third of all
    texts share is split by Spark's skew join. The rows of a key are one label, their words by position."""
    keys = list(key_cols)
    known = dictionary.filter(~F.col("is_special")).select("token", "id")
    head = df.sparkSession.sparkContext.broadcast(
        {r.token: r.id for r in known.filter(_is_heavy(heavy)).collect()})      # ``heavy`` short words at most
    coded = df.select(*keys, _word_ids(head)(text_col).alias("_ids")).repartition(*keys)
    rows = coded.groupBy(*keys).agg(F.collect_list("_ids").alias("_rows"))
    texts = df.select(*keys, F.col(text_col).alias("_text")).dropna(subset=keys)        # a missing key meets none
    tail = texts.mapInArrow(_tail_words(head, len(keys)), T.StructType(
        [*texts.schema.fields[:-1], T.StructField("pos", T.IntegerType()), T.StructField("token", T.StringType())]))
    rare = known.filter(~_is_heavy(heavy))
    at = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.coalesce("id", F.lit(UNK_ID)).cast("long"))
    rest = (tail.join(rare.hint("merge"), "token", "left").select(*keys, at.alias("_at"))
            .groupBy(*keys).agg(F.collect_list("_at").alias("_more")))
    more = F.coalesce("_more", F.array().cast("array<bigint>"))
    return rows.join(rest.hint("merge"), keys, "left").select(*keys, _labels_of("_rows", more).alias(out))


def token_lengths(text_col: str = "transcription") -> Column:
    """Label length of the word tokeniser without tokenising: one id per
    word plus SOT and EOT (exactly ``size(tokenize(...))``)."""
    return F.size(words(text_col)) + 2


def _length(col: str | Column) -> Column:
    """Length of a label array column, or a ready length column."""
    return F.size(col) if isinstance(col, str) else col


def max_token_length(labels: DataFrame, group_cols: Sequence[str] = ("split",),
                     col: str | Column = "labels") -> DataFrame:
    """Longest label per group (``col``: the label array, or a length
    column such as :func:`token_lengths`)."""
    return labels.groupBy(*group_cols).agg(F.max(_length(col)).cast("long").alias("max_tokens"))


def length_cap(labels: DataFrame, cap_from: str = "train", margin: int = LENGTH_MARGIN,
               col: str | Column = "labels") -> int:
    """D5, first half: cap = longest label of ``cap_from`` + margin (one
    number back to the driver; the reference fixed 347 + 20 = 367 the same
    way)."""
    m = labels.filter(F.col("split") == cap_from).agg(F.max(_length(col))).first()[0]
    return int(m or 0) + margin


def length_cap_report(labels: DataFrame, cap: int, col: str | Column = "labels") -> DataFrame:
    """D5, second half: per split, rows longer than ``cap`` (they would be
    cut by truncation)."""
    return labels.groupBy("split").agg(
        F.lit(cap).cast("long").alias("cap"),
        F.count_if(_length(col) > F.lit(cap)).cast("long").alias("n_over_cap"),
        F.count(F.lit(1)).alias("n_rows"))


def pad_truncate(ids: Column, length: int | Column, pad: int = PAD_ID) -> Column:
    """keep the first ``length`` ids, pad with ``pad`` up to ``length``."""
    n = F.lit(length) if isinstance(length, int) else length
    kept = F.slice(ids, 1, n)
    return F.concat(kept, F.array_repeat(F.lit(pad), F.greatest(n - F.size(kept), F.lit(0))))


def attention_mask(true_len: Column, length: Column | int) -> Column:
    """1 for real positions, 0 for padding, ``length`` entries."""
    n = F.lit(length) if isinstance(length, int) else length
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i <= true_len, 1).otherwise(0))


def loss_mask(ids: Column, mask: Column) -> Column:
    """padding positions become -100 (ignored by the loss)."""
    return F.zip_with(ids, mask, lambda x, m: F.when(m == 1, x).otherwise(F.lit(IGNORE_ID)))


def restore_pad(ids: Column, pad: int = PAD_ID) -> Column:
    """F16: -100 back to the pad id before decoding."""
    return F.transform(ids, lambda x: F.when(x == IGNORE_ID, F.lit(pad)).otherwise(x))


def split_batch_size(split_col: str = "split") -> Column:
    """Batch size by split: training batches of 4, evaluation batches of 8."""
    return F.when(F.col(split_col) == "train", F.lit(TRAIN_BATCH)).otherwise(F.lit(EVAL_BATCH))


def assign_batches(df: DataFrame, batch_size: int | Column, group_cols: Sequence[str] = ("split",),
                   order_col: str = "utt_id", out: str = "batch_id") -> DataFrame:
    """Consecutive rows in ``order_col`` order form a batch, per split
    (``batch_size`` may be a column, e.g. :func:`split_batch_size`). The row
    position comes from a distributed index, so ids need not be dense. Pass
    the narrow id table (split, id) and join the result to wide rows; the
    index then shuffles ids only."""
    idx = dense_index(df, list(group_cols), [order_col], out="_row")
    size = F.lit(batch_size) if isinstance(batch_size, int) else batch_size
    return idx.withColumn(out, F.floor(F.col("_row") / size).cast("long")).drop("_row")


def collate(batched: DataFrame, labels_col: str = "labels", batch_cols: Sequence[str] = ("split", "batch_id"),
            start_id: int = SOT_ID, mask_from: str = "labels") -> DataFrame:
    """The collator over ``batch_id``. Labels are padded to the longest in
    the batch (F12), padding is masked with -100 (F13/F15), and the start token is removed only if
    every row of the batch begins with it (F17). The mask comes from each row's own length
    (``mask_from="labels"``) or, as where labels are stored padded already and nothing else is
    known of them, from the padded length (``"padded"``): then nothing is masked."""
    if mask_from not in ("labels", "padded"):
        raise ValueError(f"unknown mask_from {mask_from!r}")
    w = Window.partitionBy(*batch_cols)
    n = F.size(labels_col)
    out = (batched.withColumn("_len", n)
           .withColumn("batch_len", F.max("_len").over(w))
           .withColumn("_all_start", F.bool_and(F.element_at(labels_col, 1) == F.lit(start_id)).over(w)))
    padded = pad_truncate(F.col(labels_col), F.col("batch_len"))
    mask = attention_mask(F.col("_len" if mask_from == "labels" else "batch_len"), F.col("batch_len"))
    masked = loss_mask(padded, mask)
    trimmed = F.when(F.col("_all_start"), F.slice(masked, 2, F.col("batch_len") - 1)).otherwise(masked)
    return (out.withColumn("attention_mask", mask).withColumn("label_ids", trimmed)
            .withColumnRenamed("_all_start", "start_trimmed").drop("_len"))


def _ids_beyond(slots, keys: int):
    """A function of batches of ``keys`` key columns and ids: a row (keys, pos, id) for each id the tokens
    ``slots`` (a broadcast; "": none) do not cover."""
    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = np.array([t != "" for t in slots.value] + [False])
        for batch in batches:
            ids = batch.column(keys)
            ends, flat = _offsets(ids), _flat_ids(ids)
            out = (flat >= 0) & ~here[np.clip(flat, -1, len(here) - 1)]
            pos = np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], np.diff(ends))
            row = np.repeat(np.arange(len(ids)), np.diff(ends))
            yield _rows_at(batch, keys, row[out], pos=pos[out], id=flat[out])
    return beyond


def _flat_ids(ids: pa.ListArray) -> np.ndarray:
    """All ids of the lists, -1 for a missing one."""
    return pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False)


def _text_of(slots):
    """A column function: ids and the tokens found elsewhere ("pos token") to text."""
    @F.arrow_udf("string")
    def text(ids: pa.Array, more: pa.Array) -> pa.Array:
        tokens = np.array([t if t and t != DROPPED else None for t in slots.value] + [None], object)
        ends, m, flat = _offsets(ids), _offsets(more), _flat_ids(ids)
        own = tokens[np.where((flat < 0) | (flat >= len(tokens)), len(tokens) - 1, flat)]
        out = []
        for i, null in enumerate(ids.is_null().to_pylist()):
            got = own[ends[i] - ends[0]:ends[i + 1] - ends[0]]
            far = [x.split(" ", 1) for x in more.values.slice(m[i], m[i + 1] - m[i]).to_pylist()]
            if far:
                p, t = [int(k) for k, _ in far], [x for _, x in far]
                if len(p) == len(set(p)) and max(p) < len(got) and not any(got[p]):
                    got[p] = t
                else:                       # rows with the same keys: all their tokens by position
                    both = [(k, x) for k, x in enumerate(got) if x] + list(zip(p, t))
                    got = np.array([x for _, x in sorted(both)], object)
            out.append(None if null else " ".join([x for x in got.tolist() if x]))
        return pa.array(out, pa.string())
    return text


def decode(df: DataFrame, key_cols: Sequence[str], dictionary: DataFrame, ids_col: str = "label_ids",
           out: str = "text", skip_special: bool = True, heavy: int = HEAVY_WORDS) -> DataFrame:
    """F14 + J3: ids back to text, special tokens dropped, -100 restored to
    padding first (F16); ids outside the dictionary give nothing. The ids are dealt by the keys once,
    for both uses. The tokens of the ``heavy`` lowest ids are a broadcast (a few MB) and are looked up in the row. Only the
    ids beyond leave it: they meet the rest of the dictionary in blocks of ``RANK_BLOCK`` ranks,
    an array for each block, so no id is a key of a shuffle; the blocks follow the vocabulary and
    are not sent through the driver, however small their files."""
    keys = list(key_cols)
    head = {r.id: r for r in dictionary.filter(_is_heavy(heavy)).select("id", "token", "is_special").collect()}

    def slot(i: int) -> str:
        r = head.get(i)
        return "" if r is None else DROPPED if skip_special and r.is_special else r.token

    # words hold no white space; an empty slot means: not here
    slots = df.sparkSession.sparkContext.broadcast([slot(i) for i in range(max(head, default=-1) + 1)])
    rows = df.select(*keys, restore_pad(F.col(ids_col)).alias("_ids")).repartition(*keys)
    rest = dictionary.filter(~_is_heavy(heavy) & ~(F.col("is_special") & F.lit(skip_special)))
    block = F.floor(F.col("id") / RANK_BLOCK)
    blocks = (rest.groupBy(block.alias("_block")).agg(F.array_sort(F.collect_list(F.struct("id", "token"))).alias("_tokens"))
              .withColumn("_first", F.col("_tokens")[0]["id"]))
    entry = F.get("_tokens", (F.col("id") - F.col("_first")).cast("int"))
    tail = (rows.mapInArrow(_ids_beyond(slots, len(keys)), T.StructType(
                [*rows.schema.fields[:-1], *(T.StructField(c, T.IntegerType()) for c in ("pos", "id"))]))
            .withColumn("_block", block).join(blocks.hint("merge"), "_block")
            .select(*keys, "pos", F.when(entry["id"] == F.col("id"), entry["token"]).alias("token"))
            .filter(F.col("token").isNotNull())
            .groupBy(*keys).agg(F.collect_list(F.concat(F.col("pos").cast("string"), F.lit(" "), "token")).alias("_more")))
    more = F.coalesce("_more", F.array().cast("array<string>"))
    return rows.join(tail.hint("merge"), keys, "left").select(*keys, _text_of(slots)("_ids", more).alias(out))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def pcm16_peak_normalized(audio: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """F7 on clips: the 16-bit PCM samples of the clip's data chunk (channels in
    their stored order), divided by the peak magnitude (widened first, so
    -32768 does not overflow). NULL for a silent clip and for bytes that are
    no 16-bit clip (F6 names the error). Numpy per clip; samples are given out when there are
    ``SAMPLES_OUT`` of them, so beside Spark's batch of clips a task holds some MB."""
    def lists(clips: list) -> pa.Array:
        ends = np.cumsum([0, *(0 if x is None else len(x) for x in clips)])
        flat = [x for x in clips if x is not None]
        return pa.ListArray.from_arrays(
            pa.array(ends.astype(np.int32)), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.float32)),
            mask=pa.array([x is None for x in clips], pa.bool_()))

    for batch in audio:
        held, size = [], 0
        for b in batch:
            data = b.as_py()
            clip = read_chunks(data)
            x = None
            if clip is not None and clip["bits"] == 16:
                whole = clip["size"] // clip["block"] * clip["block"]
                x = np.frombuffer(data, "<i2", whole // 2, clip["start"])
                peak = max(-int(x.min()), int(x.max())) if len(x) else 0
                x = None if peak == 0 else x.astype(np.float32) / np.float32(peak)
            held.append(x)
            size += 0 if x is None else len(x)
            if size >= SAMPLES_OUT:
                yield lists(held)
                held, size = [], 0
        if held or not len(batch):
            yield lists(held)


def prepare_split(utts: DataFrame, dictionary: DataFrame, max_length: int = MAX_LABEL_LENGTH,
                  with_samples: bool = False) -> DataFrame:
    """One job from utterances to training rows: clip duration from
    the header (F6), optional normalised samples (F7), labels (F10) cut and
    padded to ``max_length`` (F11), plus the true label length."""
    from wavelens.operators.quality import with_clip_info
    clips = with_clip_info(utts)
    base = clips.select("utt_id", "split", "transcription", F.col("clip.duration").alias("duration"),
                        *(["audio"] if with_samples else []))
    lab = tokenize(base, ["utt_id"], dictionary)
    j = base.join(lab, "utt_id")
    out = j.select("utt_id", "split", "duration",
                   F.least(F.size("labels"), F.lit(max_length)).alias("label_len"),
                   pad_truncate(F.col("labels"), max_length).alias("labels"),
                   *([pcm16_peak_normalized(F.col("audio.bytes")).alias("samples")] if with_samples else []))
    return out
