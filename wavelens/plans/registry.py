"""The query catalogue: one Spark query per SURVEY §2 id, plus its oracle SQL.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the full tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelens.functions import text as tx
from wavelens.functions.wav import peak_normalize
from wavelens.operators import labels as lb
from wavelens.operators import profile as pf
from wavelens.operators import quality as qc
from wavelens.operators import runs as rn
from wavelens.operators import wer
from wavelens.plans import sqlmacros as M
from wavelens.plans.parallel import spread
from wavelens.session import scratch_path
from wavelens.sources import catalog as cat
from wavelens.sources import fixtures as fx
from wavelens.sources import logs as lg
from wavelens.sources.clips import export_clips
from wavelens.sources.materialize import file_signature, materialize, run_tag
from wavelens.sources.tables import table_path
from wavelens.streaming import metrics as sm

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- text

register("f5_normalize_conversations", f"""
SELECT conv_id, turn, {M.norm('text')} AS norm_text FROM conversations
""")(lambda spark, d: fx.read_table(spark, d, "conversations")
     .select("conv_id", "turn", tx.normalize_text("text").alias("norm_text")))

register("f5_normalize_documents", f"""
SELECT doc_id, {M.norm('text')} AS norm_text FROM documents
""")(lambda spark, d: spread(fx.read_table(spark, d, "documents"), ["doc_id"])
     .select("doc_id", tx.normalize_text("text").alias("norm_text")))

register("f1_f4_steps_documents", f"""
SELECT doc_id,
       CAST(len({M.words('lower(text)')}) AS BIGINT) AS n_lower_words,
       length(regexp_replace(text, {M.q(tx.PUNCT_RE)}, '', 'g')) AS n_chars_no_punct,
       length(regexp_replace(text, {M.q(tx.WS_RUN_RE)}, ' ', 'g')) AS n_chars_collapsed,
       length(regexp_replace(text, {M.q(tx.WS_ENDS_RE)}, '', 'g')) AS n_chars_stripped
FROM documents
""")(lambda spark, d: spread(fx.read_table(spark, d, "documents"), ["doc_id"]).select(
    "doc_id",
    F.size(tx.words(tx.lower("text"))).cast("long").alias("n_lower_words"),
    F.length(tx.remove_punctuation("text")).cast("long").alias("n_chars_no_punct"),
    F.length(tx.collapse_whitespace("text")).cast("long").alias("n_chars_collapsed"),
    F.length(tx.strip_ws("text")).cast("long").alias("n_chars_stripped")))


# ---------------------------------------------------------------- WER

def _pairs_sql(models=fx.ORACLE_MODELS) -> str:
    """Per (pair, model) word and edit counts from the fixture rules."""
    rw, nw = "rw", "nw"
    per_model = {
        "substitute": (f"len({rw}) // 5",
                       f"coalesce(list_sum(list_transform(list_filter({rw}, lambda w, i: i % 5 = 0), "
                       f"lambda w: greatest(1, len({M.norm_words('w')})))), 0)"),
        "delete": (f"len({rw}) // 7",
                   f"coalesce(list_sum(list_transform(list_filter({rw}, lambda w, i: i % 7 = 0), "
                   f"lambda w: len({M.norm_words('w')}))), 0)"),
        "insert": ("1", "1"),
        "empty": (f"len({rw})", f"len({nw})"),
        "format_only": (f"(len({rw}) + {fx.FORMAT_EVERY - 1}) // {fx.FORMAT_EVERY}", "0"),
    }
    parts = []
    for m in models:
        e, en = per_model[m]
        parts.append(
            f"SELECT conv_id, turn, role, '{m}' AS model, CAST(len({rw}) AS BIGINT) AS n_ref_words, "
            f"CAST({e} AS BIGINT) AS n_edits, CAST(len({nw}) AS BIGINT) AS n_ref_words_norm, "
            f"CAST({en} AS BIGINT) AS n_edits_norm FROM r")
    return (f"WITH r AS (SELECT conv_id, turn, role, {M.wer_words('text')} AS rw, "
            f"{M.norm_words('text')} AS nw FROM conversations) "
            + " UNION ALL ".join(parts))


def _corpus_sql(group: str, where: str = "") -> str:
    return f"""
SELECT {group}, count(*) AS n_pairs,
       CAST(sum(n_ref_words) AS BIGINT) AS n_ref_words, CAST(sum(n_edits) AS BIGINT) AS n_edits,
       CAST(sum(n_ref_words_norm) AS BIGINT) AS n_ref_words_norm,
       CAST(sum(n_edits_norm) AS BIGINT) AS n_edits_norm,
       CAST(sum(n_edits) AS DOUBLE) / NULLIF(CAST(sum(n_ref_words) AS DOUBLE), 0) AS wer,
       CAST(sum(n_edits_norm) AS DOUBLE) / NULLIF(CAST(sum(n_ref_words_norm) AS DOUBLE), 0) AS gt_wer
FROM ({_pairs_sql()}) p {where} GROUP BY {group}"""


def _scored(spark, d, models=fx.ORACLE_MODELS):
    refs = wer.prepare_references(fx.references(spark, d))
    hyps = fx.hypotheses(spark, d, models)
    return wer.pair_scores(wer.join_pairs(refs, hyps, ["conv_id", "turn"]))


register("e1_pair_edits", f"""
SELECT conv_id, turn, model, n_ref_words, n_edits, n_ref_words_norm, n_edits_norm
FROM ({_pairs_sql()}) p
""")(lambda spark, d: _scored(spark, d).select(
    "conv_id", "turn", "model", "n_ref_words", "n_edits", "n_ref_words_norm", "n_edits_norm"))


@register("e4_wer_by_role", _corpus_sql("role", "WHERE model = 'substitute'"))
def e4_wer_by_role(spark, d):
    refs = fx.references(spark, d)
    hyps = fx.hypotheses(spark, d, ("substitute",))
    return wer.evaluate(refs, hyps, ["conv_id", "turn"], ["role"])


@register("e4_wer_by_model", _corpus_sql("model"))
def e4_wer_by_model(spark, d):
    return wer.corpus_wer(_scored(spark, d), ["model"])




# ---------------------------------------------------------------- clips and quality


U = M.UTTERANCES
SPLIT_LABEL_SQL = "CASE split WHEN 'train' THEN 'training' ELSE split END"


def _clips(spark, d):
    return qc.with_clip_info(fx.utterances(spark, d))


register("f6_clip_duration", f"""
SELECT utt_id, split, CAST(1000 AS BIGINT) AS sample_rate, frames, audio_duration AS duration FROM {U}
""")(lambda spark, d: _clips(spark, d).select(
    "utt_id", "split", F.col("clip.sample_rate").alias("sample_rate"), F.col("clip.frames").alias("frames"),
    F.col("clip.duration").alias("duration")))

register("b9_clip_errors", f"""
SELECT split, CAST(NULL AS VARCHAR) AS error, count(*) AS n FROM {U} GROUP BY split
""")(lambda spark, d: _clips(spark, d).groupBy("split", F.col("clip.error").alias("error"))
     .agg(F.count(F.lit(1)).alias("n")))

register("b6_short_clips", f"""
SELECT utt_id, split, audio_duration AS seconds FROM {U} WHERE audio_duration < 1.0
""")(lambda spark, d: qc.short_clips(_clips(spark, d)).select(
    "utt_id", "split", F.col("clip.duration").alias("seconds")))

_TWO_DP = "printf('%.2f', audio_duration)"

@register("a10_quality_log", f"""
SELECT 'short_clip' AS "check", split, utt_id, audio_duration AS seconds,
       'Warning: Audio file at index ' || utt_id || ' in ' || {SPLIT_LABEL_SQL} ||
       ' data is too short (' || {_TWO_DP} || ' seconds)' AS message
FROM {U} WHERE audio_duration < 1.0
""")
def a10_quality_log(spark, d):
    """Through the sink: findings appended to a log table, read back."""
    path = scratch_path(spark, f"quality_log/{run_tag(d)}/{uuid.uuid4().hex}")
    qc.quality_findings(fx.utterances(spark, d)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


# clips of every kind (see fixtures.odd_utterances)
ODD = """(SELECT doc_id AS utt_id, n_chars, doc_id % 10 AS kind,
  CASE doc_id % 20 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split,
  CASE doc_id % 10 WHEN 0 THEN 'null_bytes' WHEN 1 THEN 'truncated' WHEN 2 THEN 'not_riff' WHEN 3 THEN 'zero_rate' END AS error,
  CASE WHEN doc_id % 10 <= 3 THEN NULL WHEN doc_id % 10 = 5 THEN n_chars // 2 WHEN doc_id % 10 = 6 THEN 2 * n_chars
       ELSE n_chars END AS frames FROM documents WHERE n_chars IS NOT NULL)"""

register("b9_f6_odd_clips", f"""
SELECT utt_id, split, error, coalesce(frames, -1) AS frames,
       CASE WHEN error IS NOT NULL THEN -1 WHEN kind = 5 THEN 2 ELSE 1 END AS channels,
       CASE WHEN error IS NOT NULL THEN -1 WHEN kind = 6 THEN 8 ELSE 16 END AS bits,
       coalesce(frames / 1000.0, -1.0) AS duration FROM {ODD}
""")(lambda spark, d: qc.with_clip_info(fx.odd_utterances(spark, d)).select(
    "utt_id", "split", "clip.error", *[F.coalesce(f"clip.{c}", F.lit(-1)).alias(c)
                                       for c in ("frames", "channels", "bits", "duration")]))

register("d2_d3_odd_duration_totals", f"""
SELECT split, count(*) FILTER (WHERE error IS NULL) AS n_clips, count(error) AS n_unreadable,
       coalesce(sum(frames), 0) / 1000.0 AS total_seconds, round(coalesce(sum(frames), 0) / 1000.0 / 3600.0, 2) AS hours
FROM {ODD} GROUP BY split
""")(lambda spark, d: qc.duration_totals(qc.with_clip_info(fx.odd_utterances(spark, d))))


@register("a12_quality_log_parse", f"""
SELECT utt_id, {SPLIT_LABEL_SQL} AS split_label,
       CAST(printf('%.2f', audio_duration) AS DOUBLE) AS seconds
FROM {U} WHERE audio_duration < 1.0
""")
def a12_quality_log_parse(spark, d):
    from wavelens.sources import logs
    lines = qc.quality_findings(fx.utterances(spark, d)).select(F.col("message").alias("value"))
    return logs.parse_quality_log(lines).select("utt_id", "split_label", "seconds")


@register("a12_quality_log_errors", f"""
SELECT utt_id, {SPLIT_LABEL_SQL} AS split_label, error FROM {ODD} WHERE error IS NOT NULL
""")
def a12_quality_log_errors(spark, d):
    """The log of clips of every kind, written as text and read back: its error lines."""
    path = scratch_path(spark, f"quality_text/{run_tag(d)}/{uuid.uuid4().hex}")
    qc.quality_findings(fx.odd_utterances(spark, d)).select("message").write.text(path)
    return lg.parse_quality_errors(spark.read.text(path))


def _missing_sql(table_sql: str, cols: list[str], floats: set[str], group: str | None = None) -> str:
    g = f"{group}, " if group else ""
    parts = []
    for c in cols:
        cond = f"{c} IS NULL" + (f" OR isnan({c})" if c in floats else "")
        parts.append(f"SELECT {g}'{c}' AS \"column\", CAST(count(*) FILTER (WHERE {cond}) AS BIGINT) AS n_missing "
                     f"FROM {table_sql} t" + (f" GROUP BY {group}" if group else ""))
    return " UNION ALL ".join(parts)


register("d1_missing_utterances", _missing_sql(
    f"(SELECT split, 1 AS audio, row_num, transcription, audio_duration, transcription_length, utt_id FROM {U})",
    ["audio", "row_num", "transcription", "audio_duration", "transcription_length", "utt_id"],
    {"audio_duration"}, "split"))(lambda spark, d: qc.missing_values(fx.utterances(spark, d), ["split"]))

_D1_TABLES = {
    "lineitem": (["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                  "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
                 {"l_quantity", "l_extendedprice", "l_discount", "l_tax"}),
    "orders": (["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
               {"o_totalprice"}),
    "events": (["event_id", "ts", "user_id", "event_type", "value", "props"], {"value"}),
    "documents": (["doc_id", "text", "lang", "source", "n_chars"], set()),
}
for _t, (_cols, _fl) in _D1_TABLES.items():
    register(f"d1_missing_{_t}", _missing_sql(_t, _cols, _fl))(
        lambda spark, d, _t=_t: qc.missing_values(fx.read_table(spark, d, _t)))

# a table with every kind of missing value: NULL and NaN numbers, NULL texts, clips that are NULL
# and clips whose path or bytes are NULL (not missing, as the reference counts them)
GAPPY = """(SELECT doc_id AS utt_id, CASE WHEN doc_id % 13 = 5 THEN NULL ELSE text END AS transcription,
  CASE WHEN doc_id % 7 = 0 THEN 'nan'::DOUBLE WHEN doc_id % 11 = 0 THEN NULL ELSE n_chars / 1000.0 END AS audio_duration,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 1 END AS audio,
  CASE WHEN doc_id % 5 = 2 THEN NULL ELSE n_chars END AS transcription_length,
  CASE doc_id % 20 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM documents)"""


@register("d1_missing_of_every_kind", _missing_sql(
    GAPPY, ["audio", "transcription", "audio_duration", "transcription_length", "utt_id"], {"audio_duration"}, "split"))
def d1_missing_of_every_kind(spark, d):
    k, audio = F.col("utt_id"), F.col("audio")
    clip = F.struct(F.when(k % 4 != 1, audio["bytes"]).alias("bytes"), F.when(k % 2 == 0, audio["path"]).alias("path"))
    u = fx.utterances(spark, d, with_bytes=False).select(
        F.when(k % 3 != 0, clip).alias("audio"), F.when(k % 13 != 5, F.col("transcription")).alias("transcription"),
        F.when(k % 7 == 0, F.lit(float("nan"))).when(k % 11 != 0, F.col("audio_duration")).alias("audio_duration"),
        F.when(k % 5 != 2, F.col("transcription_length")).alias("transcription_length"), "utt_id", "split")
    return qc.missing_values(u, ["split"])


register("d2_d3_duration_totals", f"""
SELECT split, count(*) AS n_clips, 0::BIGINT AS n_unreadable, sum(frames) / 1000.0 AS total_seconds,
       round(sum(frames) / 1000.0 / 3600.0, 2) AS hours FROM {U} GROUP BY split
""")(lambda spark, d: qc.duration_totals(_clips(spark, d)))

@register("a9_duration_report", f"""
SELECT CASE split WHEN 'train' THEN 0 WHEN 'test' THEN 1 ELSE 2 END AS line_no,
       printf('Total duration of %s dataset: %.2f hours ', split, sum(frames) / 1000.0 / 3600.0) AS value
FROM {U} GROUP BY split
""")
def a9_duration_report(spark, d):
    """Through the sink: the report is written as text and read back."""
    path = scratch_path(spark, f"report/{run_tag(d)}/{uuid.uuid4().hex}")
    lines = qc.duration_report_lines(qc.duration_totals(_clips(spark, d)))
    lines.orderBy("line_no").select("value").coalesce(1).write.text(path)
    split = F.regexp_extract("value", "of ([a-z]+) dataset", 1)
    return spark.read.text(path).select(
        F.when(split == "train", 0).when(split == "test", 1).otherwise(2).alias("line_no"), "value")

register("d6_duplicate_counts", f"""
SELECT split, count(*) AS n_rows, count(*) - count(DISTINCT (row_num, transcription, audio_duration,
       transcription_length, utt_id)) AS n_duplicates FROM {U} GROUP BY split
""")(lambda spark, d: qc.duplicate_counts(fx.utterances(spark, d, with_bytes=False)))

register("d6_duplicate_counts_transcription", f"""
SELECT split, count(*) AS n_rows, count(*) - count(DISTINCT transcription) AS n_duplicates FROM {U} GROUP BY split
""")(lambda spark, d: qc.duplicate_counts(fx.utterances(spark, d, with_bytes=False), subset=["transcription"]))

register("d7_w1_duplicate_rows_transcription", f"""
SELECT utt_id, split, first_utt_id FROM (
  SELECT utt_id, split, min(utt_id) OVER (PARTITION BY split, transcription) AS first_utt_id FROM {U})
WHERE utt_id <> first_utt_id
""")(lambda spark, d: qc.duplicate_rows(fx.utterances(spark, d, with_bytes=False), subset=["transcription"])
     .select("utt_id", "split", "first_utt_id"))

register("b5_id_in_list", f"""
SELECT utt_id, path, 44 + 2 * frames AS n_bytes FROM {U} WHERE utt_id IN (445, 628, 642, 1092)
""")(lambda spark, d: qc.id_filter(fx.utterances(spark, d), [445, 628, 642, 1092]).select(
    "utt_id", F.col("audio.path").alias("path"), F.length("audio.bytes").cast("long").alias("n_bytes")))


@register("j2_key_lookup_short_clips", f"""
SELECT utt_id, path, 44 + 2 * frames AS n_bytes FROM {U} WHERE audio_duration < 1.0
""")
def j2_key_lookup(spark, d):
    # lengths are taken in the scan: no clip bytes enter the join
    utts = fx.utterances(spark, d).select(
        "utt_id", F.col("audio.path").alias("path"), F.length("audio.bytes").cast("long").alias("n_bytes"))
    keys = qc.short_clips(_clips(spark, d)).select("utt_id")
    return qc.id_filter(utts, keys)


register("f8_basename_pages", """
SELECT page_id, string_split(url, '/')[-1] AS base_name FROM pages
""")(lambda spark, d: fx.read_table(spark, d, "pages").select("page_id", tx.basename("url").alias("base_name")))

register("f9_two_decimals", f"""
SELECT utt_id, {_TWO_DP} AS seconds_text FROM {U}
""")(lambda spark, d: _clips(spark, d).select("utt_id", tx.two_decimals(F.col("clip.duration")).alias("seconds_text")))


# ---------------------------------------------------------------- profiling


P = (f"(SELECT utt_id, split, audio_duration, transcription_length, "
     f"CAST(len({M.words('transcription')}) AS BIGINT) AS n_words FROM {U})")


def _prof(spark, d):
    return pf.profile_frame(fx.utterances(spark, d, with_bytes=False))


def _vals_sql(col: str, groups: str = "split", src: str = P) -> str:
    return (f"(SELECT {groups}, CAST({col} AS DOUBLE) AS x FROM {src} t "
            f"WHERE {col} IS NOT NULL AND NOT isnan(CAST({col} AS DOUBLE)))")


def _round(c: str, n: int) -> F.Column:
    return F.round(F.col(c), n).alias(c)


@register("d8_correlation", f"""
WITH s AS (SELECT split, stddev_samp(audio_duration) AS sd0, stddev_samp(n_words) AS sd1,
                  corr(audio_duration, n_words) AS r01 FROM {P} GROUP BY split)
SELECT split, 'audio_duration' AS x, 'audio_duration' AS y, CASE WHEN sd0 > 0 THEN 1.0 ELSE 'nan'::DOUBLE END AS r FROM s
UNION ALL SELECT split, 'audio_duration', 'n_words', round(r01, 9) FROM s
UNION ALL SELECT split, 'n_words', 'audio_duration', round(r01, 9) FROM s
UNION ALL SELECT split, 'n_words', 'n_words', CASE WHEN sd1 > 0 THEN 1.0 ELSE 'nan'::DOUBLE END FROM s
""")
def d8_correlation(spark, d):
    c = pf.correlation(_prof(spark, d), ["audio_duration", "n_words"], ["split"])
    return c.select("split", "x", "y", _round("r", 9))


def _hist_sql(col: str, bins: int = pf.HIST_BINS) -> str:
    edge = lambda k: f"(CASE WHEN {k} >= {bins} THEN el ELSE CAST({k} AS DOUBLE) * step + e0 END)"
    return f"""
WITH v AS {_vals_sql(col)},
st AS (SELECT split, CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS e0,
              CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS el FROM v GROUP BY split),
st2 AS (SELECT *, (el - e0) / {float(bins)} AS step FROM st),
b0 AS (SELECT v.split, x, e0, el, step,
              CAST(least(greatest(floor((x - e0) / step), 0), {bins - 1}) AS INTEGER) AS b FROM v JOIN st2 USING (split)),
b1 AS (SELECT split, x, e0, el, step, greatest(CASE WHEN x < {edge('b')} THEN b - 1 ELSE b END, 0) AS b FROM b0),
b2 AS (SELECT split, CASE WHEN b < {bins - 1} AND x >= {edge('(b + 1)')} THEN b + 1 ELSE b END AS bin FROM b1),
c AS (SELECT split, bin, count(*) AS n FROM b2 GROUP BY split, bin),
a AS (SELECT split, e0, el, step, CAST(r.bin AS INTEGER) AS bin FROM st2, range(0, {bins}) r(bin))
SELECT a.split, '{col}' AS "column", a.bin, {edge('a.bin')} AS bin_lo, {edge('(a.bin + 1)')} AS bin_hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM a LEFT JOIN c ON a.split = c.split AND a.bin = c.bin"""


for _col in ("audio_duration", "transcription_length"):
    register(f"d9_histogram_{_col}", _hist_sql(_col))(
        lambda spark, d, _col=_col: pf.histogram(_prof(spark, d), _col, ["split"]))


def _kde_sql(col: str, grid: int, cut: float, group: str = "split", src: str = P, bins: int | None = 30) -> str:
    gcols = [g.strip() for g in group.split(",")]
    using = ", ".join(gcols)
    scaled = (f", round(sum(exp(-0.5 * ((gx - v.x) / bw) * ((gx - v.x) / bw))) / (n * bw * sqrt(2 * pi())) "
              f"* n * (hi - lo) / {float(bins)}, 6) AS count_scaled") if bins else ""
    return f"""
WITH v AS {_vals_sql(col, group, src)},
st AS (SELECT {group}, count(*) AS n, min(x) AS lo, max(x) AS hi, stddev_samp(x) AS sd FROM v GROUP BY {group}
       HAVING count(*) >= 2),
st2 AS (SELECT *, sd * pow(CAST(n AS DOUBLE), -0.2) AS bw FROM st),
st3 AS (SELECT *, lo - bw * {cut} AS g0, hi + bw * {cut} AS gl FROM st2 WHERE bw > 0),
st4 AS (SELECT *, (gl - g0) / {float(grid - 1)} AS gstep FROM st3),
g AS (SELECT {", ".join("st4." + c for c in gcols)}, r.gi, n, bw, lo, hi,
             CASE WHEN r.gi >= {grid - 1} THEN gl ELSE CAST(r.gi AS DOUBLE) * gstep + g0 END AS gx
      FROM st4, range(0, {grid}) r(gi))
SELECT {", ".join("g." + c for c in gcols)}, '{col}' AS "column", CAST(gi AS INTEGER) AS grid_index, round(gx, 9) AS x,
       round(sum(exp(-0.5 * ((gx - v.x) / bw) * ((gx - v.x) / bw))) / (n * bw * sqrt(2 * pi())), 12) AS density
       {scaled}
FROM g JOIN v USING ({using}) GROUP BY {", ".join("g." + c for c in gcols)}, gi, gx, n, bw, lo, hi"""


def _kde_q(spark, d, col, group_cols, grid, cut, bins, src=None):
    df = src if src is not None else _prof(spark, d)
    k = pf.kde(df, col, group_cols, grid=grid, cut=cut, bins=bins)
    cols = [*group_cols, "column", "grid_index", _round("x", 9), _round("density", 12)]
    if bins:
        cols.append(_round("count_scaled", 6))
    return k.select(*cols)


for _col in ("audio_duration", "transcription_length"):
    register(f"d10_kde_{_col}", _kde_sql(_col, pf.HIST_KDE_GRID, pf.HIST_KDE_CUT))(
        lambda spark, d, _col=_col: _kde_q(spark, d, _col, ["split"], pf.HIST_KDE_GRID, pf.HIST_KDE_CUT, pf.HIST_BINS))


def _box_sql(col: str, group: str = "split", src: str = P) -> str:
    return f"""
WITH v AS {_vals_sql(col, group, src)},
q AS (SELECT {group}, count(*) AS n,
             round(quantile_cont(x, 0.25), 9) AS q25, round(quantile_cont(x, 0.5), 9) AS q50,
             round(quantile_cont(x, 0.75), 9) AS q75,
             quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM v GROUP BY {group})
SELECT q.{group.replace(',', ', q.')}, q.n, q25, q50, q75,
       min(x) FILTER (WHERE x >= a - 1.5 * (b - a)) AS whisker_lo,
       max(x) FILTER (WHERE x <= b + 1.5 * (b - a)) AS whisker_hi,
       CAST(count(*) FILTER (WHERE x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a)) AS BIGINT) AS n_outliers,
       '{col}' AS "column"
FROM q JOIN v USING ({group}) GROUP BY q.{group.replace(',', ', q.')}, q.n, q25, q50, q75"""


def _box_q(df, col, group_cols):
    b = pf.box_stats(df, col, group_cols)
    return b.select(*group_cols, "n", _round("q25", 9), _round("q50", 9), _round("q75", 9),
                    "whisker_lo", "whisker_hi", "n_outliers", "column")


for _col in ("audio_duration", "transcription_length"):
    register(f"d11_box_{_col}", _box_sql(_col))(
        lambda spark, d, _col=_col: _box_q(_prof(spark, d), _col, ["split"]))


def _cut_sql(col: str = "audio_duration", bins: int = pf.CUT_BINS) -> str:
    e = lambda k: f"(CASE WHEN {k} >= {bins} THEN s_last ELSE CAST({k} AS DOUBLE) * cstep + s0 END)"
    code = " + ".join(f"(CASE WHEN x > {e(k)} THEN 1 ELSE 0 END)" for k in range(1, bins))
    return f"""
WITH st AS (SELECT split, min(CAST({col} AS DOUBLE)) AS lo, max(CAST({col} AS DOUBLE)) AS hi FROM {P} GROUP BY split),
st2 AS (SELECT split, lo, hi,
               CASE WHEN lo = hi THEN lo - (CASE WHEN lo <> 0 THEN abs(lo) * 0.001 ELSE 0.001 END) ELSE lo END AS s0,
               CASE WHEN lo = hi THEN hi + (CASE WHEN hi <> 0 THEN abs(hi) * 0.001 ELSE 0.001 END) ELSE hi END AS s_last,
               CASE WHEN lo = hi THEN 0.0 ELSE (hi - lo) * 0.001 END AS adj FROM st),
st3 AS (SELECT *, (s_last - s0) / {float(bins)} AS cstep FROM st2),
c AS (SELECT p.utt_id, p.split, p.transcription_length, CAST({col} AS DOUBLE) AS x, s0, s_last, cstep, adj
      FROM {P} p JOIN st3 USING (split)),
c2 AS (SELECT *, CAST({code} AS INTEGER) AS category FROM c)
SELECT utt_id, split, category,
       CASE WHEN category = 0 THEN {e('0')} - adj ELSE {e('category')} END AS category_lo,
       {e('(category + 1)')} AS category_hi, transcription_length
FROM c2"""


CUT_SQL = _cut_sql()


def _cut(spark, d):
    return pf.cut_categories(_prof(spark, d), "audio_duration", ["split"])


register("d12_cut_categories", CUT_SQL)(lambda spark, d: _cut(spark, d).select(
    "utt_id", "split", "category", "category_lo", "category_hi", "transcription_length"))

register("d13_box_by_category", _box_sql("transcription_length", "split, category", f"({CUT_SQL})"))(
    lambda spark, d: _box_q(_cut(spark, d), "transcription_length", ["split", "category"]))

register("d14_category_counts", f"""
WITH c AS ({CUT_SQL}),
a AS (SELECT s.split, CAST(r.category AS INTEGER) AS category FROM (SELECT DISTINCT split FROM c) s, range(0, 5) r(category))
SELECT a.split, a.category, CAST(count(c.utt_id) AS BIGINT) AS count
FROM a LEFT JOIN c ON a.split = c.split AND a.category = c.category GROUP BY a.split, a.category
""")(lambda spark, d: pf.category_counts(_cut(spark, d)))

register("d15_violin_density", _kde_sql("transcription_length", pf.VIOLIN_GRID, pf.VIOLIN_CUT, "split, category",
                                        f"({CUT_SQL})", bins=None))(
    lambda spark, d: _kde_q(spark, d, "transcription_length", ["split", "category"], pf.VIOLIN_GRID,
                            pf.VIOLIN_CUT, None, src=_cut(spark, d)))

register("d16_ecdf_audio_duration", f"""
WITH v AS {_vals_sql('audio_duration')},
c AS (SELECT split, x, count(*) AS count FROM v GROUP BY split, x)
SELECT split, x, count, CAST(sum(count) OVER (PARTITION BY split ORDER BY x) AS BIGINT) AS cum,
       CAST(sum(count) OVER (PARTITION BY split ORDER BY x) AS DOUBLE) / sum(count) OVER (PARTITION BY split) AS ecdf
FROM c
""")(lambda spark, d: pf.ecdf(_prof(spark, d), "audio_duration", ["split"]))

register("d17_scatter", f"""
SELECT utt_id, split, CAST(audio_duration AS DOUBLE) AS x, CAST(transcription_length AS DOUBLE) AS y FROM {P}
""")(lambda spark, d: pf.scatter_points(_prof(spark, d), "audio_duration", "transcription_length"))

register("d18_pair_points", f"""
SELECT utt_id, split, 'audio_duration' AS x_name, 'transcription_length' AS y_name,
       CAST(audio_duration AS DOUBLE) AS x, CAST(transcription_length AS DOUBLE) AS y FROM {P}
UNION ALL
SELECT utt_id, split, 'transcription_length', 'audio_duration',
       CAST(transcription_length AS DOUBLE), CAST(audio_duration AS DOUBLE) FROM {P}
""")(lambda spark, d: pf.pair_points(_prof(spark, d), ["audio_duration", "transcription_length"]))


# ---------------------------------------------------------------- labels


WORDS_U = M.words("transcription")
DICT_SQL = f"""dict AS (
  SELECT token, CAST(2 + row_number() OVER (ORDER BY cnt DESC, token) AS INTEGER) AS id FROM (
    SELECT token, count(*) AS cnt FROM (SELECT unnest({WORDS_U}) AS token FROM {U} WHERE split = 'train') GROUP BY token))"""
TOK_SQL = f"""{DICT_SQL},
uw AS (SELECT utt_id, split, {WORDS_U} AS ws FROM {U}),
x AS (SELECT utt_id, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos FROM uw),
xi AS (SELECT x.utt_id, x.pos, coalesce(dict.id, 2) AS id FROM x LEFT JOIN dict USING (token)),
agg AS (SELECT utt_id, CAST(sum(id) AS BIGINT) AS s, min(CASE WHEN pos = 1 THEN id END) AS first_id FROM xi GROUP BY utt_id),
tok AS (SELECT uw.utt_id, uw.split, CAST(len(uw.ws) + 2 AS INTEGER) AS n_tokens,
               CAST(coalesce(agg.s, 0) + 1 AS BIGINT) AS id_sum,
               CAST(coalesce(agg.first_id, 0) AS INTEGER) AS first_word_id
        FROM uw LEFT JOIN agg USING (utt_id))"""


def _dictionary(spark, d):
    train = spread(fx.utterances(spark, d, with_bytes=False), ["utt_id"]).filter(F.col("split") == "train")
    key = {"source": d, "split": "train", "documents": file_signature(spark, f"{d.rstrip('/')}/documents.parquet"),
           "version": 1}
    return lb.build_dictionary(train, store_key=key)


def _labels(spark, d):
    u = spread(fx.utterances(spark, d, with_bytes=False), ["utt_id"])
    return lb.tokenize(u, ["utt_id", "split"], _dictionary(spark, d))


def _id_sum(c):
    return F.aggregate(F.col(c), F.lit(0).cast("long"), lambda a, x: a + x)


register("f10_j3_tokenize", f"WITH {TOK_SQL} SELECT utt_id, split, n_tokens, id_sum, first_word_id FROM tok")(
    lambda spark, d: _labels(spark, d).select(
        "utt_id", "split", F.size("labels").alias("n_tokens"), _id_sum("labels").alias("id_sum"),
        F.element_at("labels", 2).alias("first_word_id")))

register("d4_max_token_length", f"""
SELECT split, CAST(max(len({WORDS_U})) + 2 AS BIGINT) AS max_tokens FROM {U} GROUP BY split
""")(lambda spark, d: lb.max_token_length(fx.utterances(spark, d, with_bytes=False), col=lb.token_lengths()))


@register("d5_length_cap", f"""
WITH c AS (SELECT max(len({WORDS_U})) + 2 + 20 AS cap FROM {U} WHERE split = 'train')
SELECT split, CAST(c.cap AS BIGINT) AS cap, CAST(count(*) FILTER (WHERE len({WORDS_U}) + 2 > c.cap) AS BIGINT) AS n_over_cap,
       count(*) AS n_rows FROM {U}, c GROUP BY split, c.cap
""")
def d5_length_cap(spark, d):
    """Label lengths straight from the text (no dictionary join needed)."""
    u = fx.utterances(spark, d, with_bytes=False)
    return lb.length_cap_report(u, lb.length_cap(u, col=lb.token_lengths()), col=lb.token_lengths())


# every id times its place, over labels cut and padded to 367: the start token's 1, then the words
KEPT_SQL = """kept AS (SELECT uw.utt_id, CAST(1 + coalesce(sum(CASE WHEN pos + 1 <= 367 THEN (pos + 1) * id END), 0) AS BIGINT) AS placed_sum
         FROM uw LEFT JOIN xi USING (utt_id) GROUP BY uw.utt_id)"""


def _placed_sum(ids):
    return F.aggregate(F.transform(ids, lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)


register("f11_pad_truncate", f"""
WITH {TOK_SQL}, {KEPT_SQL}
SELECT utt_id, CAST(least(n_tokens, 367) AS INTEGER) AS label_len, CAST(367 - least(n_tokens, 367) AS INTEGER) AS n_pad,
       CASE WHEN n_tokens >= 367 THEN NULL ELSE 0 END AS last_id_if_padded, placed_sum FROM tok JOIN kept USING (utt_id)
""")(lambda spark, d: _labels(spark, d).select(
    _placed_sum(lb.pad_truncate(F.col("labels"), 367)).alias("placed_sum"),
    "utt_id", F.least(F.size("labels"), F.lit(367)).alias("label_len"),
    (F.lit(367) - F.least(F.size("labels"), F.lit(367))).alias("n_pad"),
    F.when(F.size("labels") < 367, F.element_at(lb.pad_truncate(F.col("labels"), 367), 367)).alias("last_id_if_padded")))

register("w6_batch_ids", f"""
SELECT utt_id, split, CAST((row_number() OVER (PARTITION BY split ORDER BY utt_id) - 1) // 8 AS BIGINT) AS batch_id FROM {U}
""")(lambda spark, d: lb.assign_batches(fx.utterances(spark, d, with_bytes=False).select("utt_id", "split"),
                                        lb.EVAL_BATCH))


@register("u2_collate_f12_f13_f15_f17", f"""
WITH {TOK_SQL},
b AS (SELECT *, (row_number() OVER (PARTITION BY split ORDER BY utt_id) - 1) // 8 AS batch_id FROM tok),
c AS (SELECT *, max(n_tokens) OVER (PARTITION BY split, batch_id) AS batch_len FROM b)
SELECT utt_id, split, CAST(batch_id AS BIGINT) AS batch_id, batch_len, CAST(batch_len - 1 AS INTEGER) AS label_len,
       CAST(batch_len - n_tokens AS INTEGER) AS n_ignored, TRUE AS start_trimmed, CAST(n_tokens AS BIGINT) AS mask_sum FROM c
""")
def u2_collate(spark, d):
    lab = _labels(spark, d)
    ids = fx.utterances(spark, d, with_bytes=False).select("utt_id", "split")
    c = lb.collate(lab.join(lb.assign_batches(ids, lb.EVAL_BATCH), ["utt_id", "split"]))
    return c.select("utt_id", "split", "batch_id", "batch_len", F.size("label_ids").alias("label_len"),
                    F.size(F.filter("label_ids", lambda x: x == lb.IGNORE_ID)).alias("n_ignored"),
                    "start_trimmed", _id_sum("attention_mask").alias("mask_sum"))


@register("f14_f16_decode_roundtrip", f"""
SELECT utt_id, array_to_string({WORDS_U}, ' ') AS text FROM {U}
""")
def f14_decode(spark, d):
    """The round trip over every split, with a dictionary of all their words."""
    utts = spread(fx.utterances(spark, d, with_bytes=False), ["utt_id"])
    known = lb.build_dictionary(utts.select("transcription"), store_key={
        "source": d, "split": "all", "documents": file_signature(spark, table_path(d, "documents"))})
    lab = lb.tokenize(utts.select("utt_id", "transcription"), ["utt_id"], known)
    c = lb.collate(lab.join(lb.assign_batches(utts.select("utt_id", "split"), lb.TRAIN_BATCH), "utt_id"))
    return lb.decode(c, ["utt_id"], known)


@register("u2_collate_all_splits", f"""
WITH {TOK_SQL},
b AS (SELECT *, (row_number() OVER (PARTITION BY split ORDER BY utt_id) - 1)
                // (CASE split WHEN 'train' THEN 4 ELSE 8 END) AS batch_id FROM tok),
c AS (SELECT *, max(n_tokens) OVER (PARTITION BY split, batch_id) AS batch_len FROM b)
SELECT utt_id, split, CAST(batch_id AS BIGINT) AS batch_id, batch_len, CAST(batch_len - 1 AS INTEGER) AS label_len,
       CAST(batch_len - n_tokens AS INTEGER) AS n_ignored, TRUE AS start_trimmed, CAST(n_tokens AS BIGINT) AS mask_sum FROM c
""")
def u2_collate_all(spark, d):
    """The collator over every split, training batches of 4, evaluation 8."""
    lab = _labels(spark, d)
    ids = fx.utterances(spark, d, with_bytes=False).select("utt_id", "split")
    c = lb.collate(lab.join(lb.assign_batches(ids, lb.split_batch_size()), ["utt_id", "split"]))
    return c.select("utt_id", "split", "batch_id", "batch_len", F.size("label_ids").alias("label_len"),
                    F.size(F.filter("label_ids", lambda x: x == lb.IGNORE_ID)).alias("n_ignored"),
                    "start_trimmed", _id_sum("attention_mask").alias("mask_sum"))


# labels of every 16th utterance lack the start token: their batches keep it
@register("u2_collate_mixed_starts", f"""
WITH {TOK_SQL},
m AS (SELECT utt_id, split, utt_id % 16 <> 3 AS has_start, n_tokens - (utt_id % 16 = 3)::INT AS n FROM tok),
b AS (SELECT *, (row_number() OVER (PARTITION BY split ORDER BY utt_id) - 1) // 8 AS batch_id FROM m),
c AS (SELECT *, max(n) OVER (PARTITION BY split, batch_id) AS batch_len,
             bool_and(has_start) OVER (PARTITION BY split, batch_id) AS start_trimmed FROM b),
r AS (SELECT *, n - start_trimmed::INT AS real, batch_len - start_trimmed::INT AS label_len,
             (has_start AND NOT start_trimmed)::INT AS off FROM c),
s AS (SELECT r.utt_id, sum((pos + off) * id) AS words FROM r JOIN xi USING (utt_id) GROUP BY r.utt_id)
SELECT utt_id, split, CAST(batch_id AS BIGINT) AS batch_id, batch_len, label_len, start_trimmed, CAST(n AS BIGINT) AS mask_sum,
       CAST(off + coalesce(words, 0) - 100 * (label_len * (label_len + 1) // 2 - real * (real + 1) // 2) AS BIGINT) AS placed_sum
FROM r LEFT JOIN s USING (utt_id)
""")
def u2_collate_mixed(spark, d):
    """The collator over batches in which some rows lack the start token (F17): it is taken
    off only where every row of a batch begins with it. Ids and masked places are compared by place."""
    lab = _labels(spark, d).withColumn("labels", F.when(F.col("utt_id") % 16 == 3, F.slice("labels", 2, F.size("labels")))
                                       .otherwise(F.col("labels")))
    ids = fx.utterances(spark, d, with_bytes=False).select("utt_id", "split")
    c = lb.collate(lab.join(lb.assign_batches(ids, lb.EVAL_BATCH), ["utt_id", "split"]))
    return c.select("utt_id", "split", "batch_id", "batch_len", F.size("label_ids").alias("label_len"), "start_trimmed",
                    _id_sum("attention_mask").alias("mask_sum"), _placed_sum(F.col("label_ids")).alias("placed_sum"))


@register("f15_padded_mask_all_splits", f"""
WITH {TOK_SQL},
k AS (SELECT uw.utt_id, CAST(coalesce(sum(CASE WHEN pos <= 366 THEN pos * id END), 0) AS BIGINT) AS placed_sum
      FROM uw LEFT JOIN xi USING (utt_id) GROUP BY uw.utt_id)
SELECT utt_id, split, CAST((row_number() OVER (PARTITION BY split ORDER BY utt_id) - 1) // 8 AS BIGINT) AS batch_id,
       367 AS batch_len, 366 AS label_len, 0 AS n_ignored, CAST(367 AS BIGINT) AS mask_sum, placed_sum
FROM tok JOIN k USING (utt_id)
""")
def f15_padded_mask(spark, d):
    """The collator over labels stored cut and padded (F11), the mask taken from the padded
    length: the outcome of the reference, which masks nothing."""
    lab = _labels(spark, d).withColumn("labels", lb.pad_truncate(F.col("labels"), lb.MAX_LABEL_LENGTH))
    ids = fx.utterances(spark, d, with_bytes=False).select("utt_id", "split")
    c = lb.collate(lab.join(lb.assign_batches(ids, lb.EVAL_BATCH), ["utt_id", "split"]), mask_from="padded")
    return c.select("utt_id", "split", "batch_id", "batch_len", F.size("label_ids").alias("label_len"),
                    F.size(F.filter("label_ids", lambda x: x == lb.IGNORE_ID)).alias("n_ignored"),
                    _id_sum("attention_mask").alias("mask_sum"), _placed_sum(F.col("label_ids")).alias("placed_sum"))


@register("f14_f16_decode_all_splits", f"""
WITH {DICT_SQL},
uw AS (SELECT utt_id, {WORDS_U} AS ws FROM {U}),
x AS (SELECT utt_id, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos FROM uw),
k AS (SELECT x.utt_id, x.pos, x.token FROM x JOIN dict USING (token))
SELECT uw.utt_id, coalesce(string_agg(k.token, ' ' ORDER BY k.pos), '') AS text
FROM uw LEFT JOIN k USING (utt_id) GROUP BY uw.utt_id
""")
def f14_decode_all(spark, d):
    """Decode every split's collated labels; words outside the training
    dictionary were tokenised as UNK and are dropped as special tokens."""
    lab = _labels(spark, d)
    ids = fx.utterances(spark, d, with_bytes=False).select("utt_id", "split")
    c = lb.collate(lab.join(lb.assign_batches(ids, lb.split_batch_size()), ["utt_id", "split"]))
    return lb.decode(c, ["utt_id"], _dictionary(spark, d))


register("f7_peak_normalize_embeddings", """
WITH e AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE)))) AS peak
           FROM embeddings),
n AS (SELECT vec_id, peak, CASE WHEN peak > 0 THEN list_transform(embedding, lambda v: CAST(CAST(v AS DOUBLE) / peak AS FLOAT))
                        END AS x FROM e)
SELECT vec_id, peak, round(list_max(list_transform(x, lambda v: abs(CAST(v AS DOUBLE)))), 9) AS norm_peak,
       round(list_sum(list_transform(x, lambda v: CAST(v AS DOUBLE))), 9) AS norm_sum FROM n
""")(lambda spark, d: fx.read_table(spark, d, "embeddings")
     .withColumn("x", peak_normalize("embedding"))
     .select("vec_id", F.array_max(F.transform("embedding", lambda v: F.abs(v.cast("double")))).alias("peak"),
             F.round(F.array_max(F.transform("x", lambda v: F.abs(v.cast("double")))), 9).alias("norm_peak"),
             F.round(F.aggregate(F.transform("x", lambda v: v.cast("double")), F.lit(0.0), lambda a, v: a + v), 9)
             .alias("norm_sum")))

register("f7_clip_samples", f"""
SELECT utt_id, CAST(frames AS INTEGER) AS n_samples, CASE WHEN frames > 0 THEN CAST(1.0 AS DOUBLE) END AS max_sample
FROM {U}
""")(lambda spark, d: fx.utterances(spark, d).select(
    "utt_id", lb.pcm16_peak_normalized(F.col("audio.bytes")).alias("s")).select(
    "utt_id", F.coalesce(F.size("s"), F.lit(0)).alias("n_samples"),
    F.array_max("s").cast("double").alias("max_sample")))



# the samples of an odd clip go 1, -2, 5; a clip of two or more samples peaks at 2, of three or more at 5
register("f7_odd_clip_samples", f"""
WITH k AS (SELECT utt_id, kind, n_chars, CASE WHEN error IS NOT NULL OR kind = 6 THEN NULL
                  WHEN kind = 5 THEN n_chars // 2 * 2 ELSE n_chars END AS n FROM {ODD}),
p AS (SELECT *, CASE WHEN n >= 3 THEN 5.0 WHEN n = 2 THEN 2.0 WHEN n = 1 THEN 1.0 END AS peak FROM k)
SELECT utt_id, CAST(CASE WHEN peak IS NULL THEN 0 ELSE n END AS INTEGER) AS n_samples,
       coalesce(round(CAST(CASE WHEN n >= 3 THEN 5.0 ELSE 1.0 END / peak AS FLOAT)::DOUBLE, 6), -9.0) AS max_sample,
       coalesce(round(CAST(CASE WHEN n >= 2 THEN -2.0 ELSE 1.0 END / peak AS FLOAT)::DOUBLE, 6), -9.0) AS min_sample,
       coalesce(round((n // 3 * 4 + CASE n % 3 WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END) / peak, 3), -9.0) AS sum_samples FROM p
""")(lambda spark, d: fx.odd_utterances(spark, d).select(
    "utt_id", lb.pcm16_peak_normalized(F.col("audio.bytes")).alias("s")).select(
    "utt_id", F.coalesce(F.size("s"), F.lit(0)).alias("n_samples"),
    *(F.coalesce(F.round(x, n), F.lit(-9.0)).alias(c) for c, x, n in (
        ("max_sample", F.array_max("s").cast("double"), 6), ("min_sample", F.array_min("s").cast("double"), 6),
        ("sum_samples", F.aggregate("s", F.lit(0.0), lambda a, x: a + x.cast("double")), 3)))))


def _prepared(spark, d):
    return lb.prepare_split(fx.utterances(spark, d), _dictionary(spark, d))


register("f18_u1_prepare_split", f"""
WITH {TOK_SQL}, {KEPT_SQL}
SELECT u.utt_id, u.split, u.audio_duration AS duration, CAST(least(t.n_tokens, 367) AS INTEGER) AS label_len,
       367 AS n_labels, placed_sum
FROM {U} u JOIN tok t USING (utt_id) JOIN kept USING (utt_id)
""")(lambda spark, d: _prepared(spark, d).select("utt_id", "split", "duration", "label_len", F.size("labels").alias("n_labels"),
                                                 _placed_sum(F.col("labels")).alias("placed_sum")))


@register("a7_materialize_prepared", f"""
SELECT split, count(*) AS n_rows, CAST(sum(least(len({WORDS_U}) + 2, 367)) AS BIGINT) AS n_label_tokens
FROM {U} GROUP BY split
""")
def a7_materialize(spark, d):
    stored = materialize(_prepared(spark, d), "prepared_split",
                         {"source": d, "max_length": lb.MAX_LABEL_LENGTH, "dictionary": "train-words", "version": 3,
                          "documents": file_signature(spark, table_path(d, "documents"))})
    return stored.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"),
                                       F.sum("label_len").cast("long").alias("n_label_tokens"))


# ---------------------------------------------------------------- run logs


LOG = "(SELECT user_id AS run, event_id AS step, event_type AS metric, value, ts FROM events)"


def _log(spark, d):
    return rn.metric_log(fx.read_table(spark, d, "events"))


register("w3_u4_wide_to_long", """
SELECT user_id AS run, event_id AS step, 'k' AS metric, CAST(json_extract(props, '$.k') AS DOUBLE) AS value
FROM events WHERE json_extract(props, '$.k') IS NOT NULL
""")(lambda spark, d: rn.wide_to_long(fx.read_table(spark, d, "events").select(
    F.col("user_id").alias("run"), F.col("event_id").alias("step"),
    F.from_json("props", "map<string,double>").alias("logs"))))

register("w3_metric_series", f"SELECT run, metric, step, value FROM {LOG}")(
    lambda spark, d: rn.metric_series(_log(spark, d)))

register("w4_running_best", f"""
SELECT run, metric, step, value,
       min(value) OVER (PARTITION BY run, metric ORDER BY step ROWS UNBOUNDED PRECEDING) AS best_so_far FROM {LOG}
""")(lambda spark, d: rn.running_best(_log(spark, d)))

register("w2_early_stopping", f"""
WITH a AS (SELECT *, row_number() OVER w - 1 AS idx,
                  min(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM {LOG}
           WINDOW w AS (PARTITION BY run, metric ORDER BY step)),
b AS (SELECT *, CASE WHEN prior IS NULL OR (value < prior AND abs(value - prior) > 0.0005) THEN idx END AS imp FROM a),
c AS (SELECT *, max(imp) OVER (PARTITION BY run, metric ORDER BY step ROWS UNBOUNDED PRECEDING) AS last_imp FROM b)
SELECT run, metric, count(*) AS n_evals, min(value) AS best_value,
       min(CASE WHEN idx - last_imp >= 15 THEN step END) AS stop_step FROM c GROUP BY run, metric
""")(lambda spark, d: rn.early_stopping(_log(spark, d)))

register("w5_cadence_gaps", f"""
WITH a AS (SELECT run, metric, step, lag(step) OVER (PARTITION BY run, metric ORDER BY step) AS prev FROM {LOG})
SELECT run, metric, count(*) AS n_rows, count(*) FILTER (WHERE prev IS NOT NULL AND step - prev <> 50) AS n_irregular,
       max(step - prev) AS max_gap FROM a GROUP BY run, metric
""")(lambda spark, d: rn.cadence_gaps(_log(spark, d)))

register("c3_best_checkpoint", f"""
SELECT run, metric, min(value) AS best_value, arg_min(step, (value, step)) AS best_step FROM {LOG}
WHERE value IS NOT NULL GROUP BY run, metric
""")(lambda spark, d: rn.best_checkpoint(_log(spark, d)))

register("c4_kept_checkpoints", f"""
WITH b AS (SELECT run, metric, arg_min(step, (value, step)) AS best_step FROM {LOG} WHERE value IS NOT NULL
           GROUP BY run, metric),
t AS (SELECT l.run, l.metric, l.step, l.step = b.best_step AS is_best FROM {LOG} l JOIN b USING (run, metric)),
r AS (SELECT *, row_number() OVER (PARTITION BY run, metric ORDER BY is_best DESC, step DESC) AS rn FROM t)
SELECT run, metric, step, is_best FROM r WHERE rn <= 5
""")(lambda spark, d: rn.kept_checkpoints(_log(spark, d)))

SPEED_SQL = f"""(SELECT run, CAST(round(CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DECIMAL(18,0)) * 0.000001, 4) AS DOUBLE)
       AS eval_runtime, count(*) AS n, avg(value) AS eval_loss FROM {LOG} GROUP BY run)"""
SPEED2_SQL = f"""(SELECT run, eval_runtime, eval_loss,
       round(n / NULLIF(eval_runtime, 0), 3) AS eval_samples_per_second,
       round(ceil(n / 8) / NULLIF(eval_runtime, 0), 3) AS eval_steps_per_second FROM {SPEED_SQL})"""
_SPEED_COLS = ["eval_loss", "eval_runtime", "eval_samples_per_second", "eval_steps_per_second"]


def _run_results(spark, d):
    lines = rn.results_lines(rn.eval_speed(_log(spark, d)), "run", _SPEED_COLS)
    return lg.parse_results(lines, source_col="run")


register("a11_results_parse", f"""
SELECT run, metric, round(value, 9) AS value FROM (
  UNPIVOT {SPEED2_SQL} ON eval_loss, eval_runtime, eval_samples_per_second, eval_steps_per_second
  INTO NAME metric VALUE value)
""")(lambda spark, d: lg.results_long(_run_results(spark, d), ["run"]).select(
    "run", "metric", _round("value", 9)))

register("d19_throughput", f"""
SELECT run, eval_runtime, round(eval_runtime * eval_samples_per_second, 0) AS implied_rows,
       round(eval_runtime * eval_steps_per_second, 0) AS implied_batches FROM {SPEED2_SQL}
""")(lambda spark, d: rn.throughput(_run_results(spark, d), "run"))

MODEL_SQL = _corpus_sql("model")

register("e5_format_share", f"""
SELECT model, wer, gt_wer, (wer - gt_wer) / NULLIF(wer, 0) AS format_share FROM ({MODEL_SQL})
""")(lambda spark, d: wer.formatting_share(e4_wer_by_model(spark, d)).select("model", "wer", "gt_wer", "format_share"))

register("e6_model_rank", f"""
SELECT model, wer, CAST(rank() OVER (ORDER BY wer ASC NULLS LAST, model) AS INTEGER) AS rank FROM ({MODEL_SQL})
""")(lambda spark, d: wer.rank_models(e4_wer_by_model(spark, d)).select("model", "wer", "rank"))


@register("j5_results_by_model", f"""
SELECT model, metric, value FROM (UNPIVOT (SELECT model, wer AS eval_wer, gt_wer AS eval_ground_truths_wer,
       CAST(n_pairs AS DOUBLE) AS eval_samples FROM ({MODEL_SQL}))
  ON eval_wer, eval_ground_truths_wer, eval_samples INTO NAME metric VALUE value)
""")
def j5_results_by_model(spark, d):
    """Write one results file per model, read them back with partition
    discovery (the model is the folder), parse and combine (A11 + J5)."""
    m = e4_wer_by_model(spark, d).select("model", F.col("wer").alias("eval_wer"),
                                         F.col("gt_wer").alias("eval_ground_truths_wer"),
                                         F.col("n_pairs").cast("double").alias("eval_samples"))
    lines = rn.results_lines(m, "model", ["eval_wer", "eval_ground_truths_wer", "eval_samples"])
    path = scratch_path(spark, f"results_by_model/{run_tag(d)}/{uuid.uuid4().hex}")   # a folder for each call
    lines.write.mode("overwrite").partitionBy("model").text(path)
    parsed = lg.parse_results(spark.read.text(path), source_col="model")
    return lg.results_long(parsed, ["model"])


# ---------------------------------------------------------------- stream

STREAM_PARTS = 3            # appends to the log, and triggers of the stream


@register("s1_stream_metric_state", f"""
SELECT run, metric, count(*) AS n_records, min(value) AS best_value, arg_max(value, step) AS latest_value,
       max(step) AS latest_step FROM {LOG} GROUP BY run, metric
""")
def s1_stream_metric_state(spark, d):
    """Runs the stream over the events in several files to completion (available-now
    trigger, one file a trigger, update mode) and returns the state table it wrote."""
    tag = f"{run_tag(d)}/{uuid.uuid4().hex}"   # a fresh stream (and state) per call
    table, files = (scratch_path(spark, f"s1/{tag}/{x}") for x in ("table", "events"))
    fx.read_table(spark, d, "events").repartition(STREAM_PARTS).write.parquet(files)
    q = sm.start_metric_state(spark, f"{files}/*.parquet", table, scratch_path(spark, f"s1/{tag}/checkpoint"),
                              max_files_per_trigger=1)
    q.awaitTermination()
    return sm.read_latest(spark, table)


@register("s1_w2_stream_early_stopping", ORACLE["w2_early_stopping"])
def s1_w2_stream_early_stopping(spark, d):
    """Early stopping evaluated as metric records stream in: the log arrives in several
    appends in step order, the query is started after each and goes on from its state; the
    latest decision per (run, metric) equals the batch rule."""
    tag = f"{run_tag(d)}/{uuid.uuid4().hex}"
    files, decisions, checkpoint = (scratch_path(spark, f"s1w2/{tag}/{x}") for x in ("events", "decisions", "checkpoint"))
    events = fx.read_table(spark, d, "events")
    cuts = events.agg(F.percentile_approx("event_id", [i / STREAM_PARTS for i in range(1, STREAM_PARTS)])).first()[0] or []
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        part = events if lo is None else events.filter(F.col("event_id") > lo)
        (part if hi is None else part.filter(F.col("event_id") <= hi)).write.mode("append").parquet(files)
        sm.start_early_stop_monitor(spark, f"{files}/*.parquet", decisions, checkpoint).awaitTermination()
    return sm.read_latest(spark, decisions).drop("n_late")


# ---------------------------------------------------------------- scans and catalogue


register("a1_b1_b7_full_scan", f"""
SELECT utt_id, row_num, transcription, audio_duration, transcription_length, split FROM {U}
""")(lambda spark, d: fx.utterances(spark, d).drop("audio"))


@register("a2_first_table", "SELECT * FROM benchmark")
def a2_first_table(spark, d):
    from wavelens.sources.tables import TABLES, register_views
    register_views(spark, d, TABLES)
    return cat.first_table(spark)


@register("a3_list_tables", "SELECT table_name AS name FROM information_schema.tables WHERE table_name IN ("
          + ", ".join(f"'{t}'" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                                         "events", "documents", "embeddings", "pages", "benchmark", "labels",
                                         "conversations")) + ")")
def a3_list_tables(spark, d):
    from wavelens.sources.tables import TABLES, register_views
    register_views(spark, d, TABLES)
    return cat.list_tables(spark).filter(F.col("name").isin(list(TABLES))).select("name")


register("a4_describe_documents", """
SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS position, column_name AS name FROM (DESCRIBE documents)
""")(lambda spark, d: cat.describe(fx.read_table(spark, d, "documents")).select("position", "name"))


@register("a6_j4_combine_splits", f"""
SELECT split, count(*) AS n_rows, CAST(sum(transcription_length) AS BIGINT) AS n_chars FROM {U} GROUP BY split
""")
def a6_combine_splits(spark, d):
    u = fx.utterances(spark, d, with_bytes=False).drop("audio")
    frames = {s: u.filter(F.col("split") == s).drop("split") for s in ("train", "validation", "test")}
    path = scratch_path(spark, f"splits/{run_tag(d)}/{uuid.uuid4().hex}")
    cat.write_splits(cat.combine_splits(frames), path)
    stored = cat.read_splits(spark, path)
    return stored.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"),
                                       F.sum("transcription_length").cast("long").alias("n_chars"))


register("b2_b3_struct_fields", f"""
SELECT utt_id, CAST(44 + 2 * frames AS BIGINT) AS n_bytes, path FROM {U}
""")(lambda spark, d: fx.utterances(spark, d).select(
    "utt_id", F.length(F.col("audio")["bytes"]).cast("long").alias("n_bytes"), F.col("audio.path").alias("path")))

register("c1_ordered_limit", f"""
SELECT utt_id, split, transcription_length FROM {U} ORDER BY utt_id LIMIT 5
""")(lambda spark, d: cat.ordered_limit(fx.utterances(spark, d, with_bytes=False), 5)
     .select("utt_id", "split", "transcription_length"))

register("c2_preview_lineitem", """
SELECT * FROM lineitem ORDER BY ALL LIMIT 5
""")(lambda spark, d: cat.ordered_limit(fx.read_table(spark, d, "lineitem"), 5, _D1_TABLES["lineitem"][0]))


@register("a8_export_short_clips", f"""
SELECT utt_id, utt_id || '_' || utt_id || '.wav' AS file_name, CAST(44 + 2 * frames AS BIGINT) AS n_bytes
FROM {U} WHERE audio_duration < 1.0
""")
def a8_export_short_clips(spark, d):
    short = qc.short_clips(_clips(spark, d))
    manifest = export_clips(short, scratch_path(spark, f"clips/{run_tag(d)}/{uuid.uuid4().hex}"))
    return manifest.select("utt_id", tx.basename("path").alias("file_name"), "n_bytes")


@register("j1_pairing_report", """
SELECT CASE WHEN role = 'system' THEN 'missing_hypothesis' ELSE 'paired' END AS status, 'substitute' AS model,
       count(*) AS n FROM conversations GROUP BY 1
""")
def j1_pairing_report(spark, d):
    refs = fx.references(spark, d)
    hyps = (fx.hypotheses(spark, d, ("substitute",)).join(refs.select("conv_id", "turn", "role"), ["conv_id", "turn"])
            .filter(F.col("role") != "system").drop("role"))
    rep = wer.pairing_report(refs, hyps, ["conv_id", "turn"], ["substitute"])
    return rep.groupBy("status", "model").agg(F.count(F.lit(1)).alias("n"))

register("w5_irregular_steps", f"""
SELECT run, metric, step, prev_step, step - prev_step AS gap FROM (
  SELECT run, metric, step, lag(step) OVER (PARTITION BY run, metric ORDER BY step) AS prev_step FROM {LOG}) a
WHERE prev_step IS NOT NULL AND step - prev_step <> 50
""")(lambda spark, d: rn.irregular_steps(_log(spark, d)))
