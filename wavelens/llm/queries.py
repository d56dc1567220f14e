"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelens.llm import (
    op01_langid, op02_tokens, op03_jaccard, op04_quality, op05_urls, op06_pagetext, op07_mixing, op08_toxicity,
    op09_repeats, op10_decontam, op11_repair, op12_merkle, op13_counts)
from wavelens.llm.store import fresh_path, stage
from wavelens.plans.scan import dense_index
from wavelens.sources.tables import read_table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _remainder(n: int) -> Column:
    """crc32 of the decimal id modulo ``n``; a null id has none."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n)), F.lit(-1))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = op01_langid.fit(docs.filter(_remainder(4) != 2).select("doc_id", "text", "lang"))
    return op01_langid.predict(docs, model).select(
        "doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score", "bits")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    op02_tokens.write(read_table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    return op02_tokens.read(spark, path, with_ids=False)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_jaccard.membership(read_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return op04_quality.score(docs).drop("text")


#: seconds between two pages' fetch times
FETCH_STEP = 7919


def _url_list(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Captures (pages with a fetch time in the span of the events) and a dated list
    log: every event, at its own time, adds (error, click) or removes (any other type) one of
    the pages' keys, the one whose number is the event's user modulo the number of keys."""
    pages, events = read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "events")
    span = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(
        F.unix_seconds(F.col("a").cast("timestamp")), F.unix_seconds(F.col("b").cast("timestamp"))).first()
    first, seconds = span[0] or 0, max(1, (span[1] or 0) - (span[0] or 0))
    captures = pages.select("page_id", "url", F.timestamp_seconds(
        F.lit(first) + F.pmod(F.col("page_id") * FETCH_STEP, F.lit(seconds))).alias("fetched_at"))
    listed = stage(dense_index(pages.select(F.explode(op05_urls.keys(F.col("url"))).alias("key")).distinct(),
                               [], ["key"], out="number"), "url-keys")
    log = events.select(F.pmod("user_id", F.lit(max(1, listed.count()))).alias("number"), F.col("ts").cast("timestamp").alias("at"),
                        F.when(F.col("event_type").isin("error", "click"), F.lit("add")).otherwise(F.lit("remove")).alias("action"))
    return captures, log.join(listed, "number").select("key", "at", "action")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, entries = _url_list(spark, sf_dir)
    return op05_urls.judge(captures, entries).select(
        "row.page_id", "row.url", F.unix_seconds("row.fetched_at").alias("fetched_at"), "listed", "n_matches", "key",
        F.coalesce(F.unix_seconds("since"), F.lit(-1)).alias("since"))


OP5_SQL = rf"""
WITH span AS (SELECT floor(epoch(min(ts)))::BIGINT AS a, floor(epoch(max(ts)))::BIGINT AS b FROM events),
cap AS (
  SELECT row_number() OVER () AS rid, page_id, url, a + (page_id * {FETCH_STEP}) % greatest(1, b - a) AS fetched_at,
    lower(regexp_extract(coalesce(url, ''), '{op05_urls.HOST}', 1)) AS host,
    regexp_extract(coalesce(url, ''), '{op05_urls.PART}', 1) AS part FROM pages, span),
labels AS (SELECT *, string_split(host, '.') AS l FROM cap WHERE host <> ''),
keyed AS (
  SELECT DISTINCT rid, fetched_at, key FROM (
    SELECT rid, fetched_at, array_to_string(l[i:len(l)], '.') AS key
    FROM (SELECT *, unnest(generate_series(1, greatest(len(l) - 1, 1))) AS i FROM labels)
    UNION ALL SELECT rid, fetched_at, host || '/' || part FROM labels WHERE part <> '')),
listed AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS number FROM (SELECT DISTINCT key FROM keyed)),
log AS (
  SELECT key, epoch_us(ts) AS t, bool_and(event_type IN ('error', 'click')) AS adds
  FROM events JOIN listed ON number = user_id % (SELECT count(*) FROM listed) GROUP BY key, epoch_us(ts)),
entries AS (SELECT key, t, adds, lead(t) OVER (PARTITION BY key ORDER BY t) AS upto FROM log),
met AS (
  SELECT rid, count(*) AS n, min(struct_pack(k := keyed.key, s := entries.t)) AS m
  FROM keyed JOIN entries ON entries.key = keyed.key AND adds AND entries.t <= fetched_at * 1000000
    AND (upto IS NULL OR fetched_at * 1000000 < upto) GROUP BY rid)
SELECT page_id, url, fetched_at, met.rid IS NOT NULL AS listed, coalesce(n, 0)::BIGINT AS n_matches,
  m.k AS key, coalesce(m.s // 1000000, -1)::BIGINT AS since
FROM cap LEFT JOIN met ON met.rid = cap.rid
"""


def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_pagetext.extract(read_table(spark, sf_dir, "pages"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_mixing.taken(read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    machine = op08_toxicity.fit(docs, labels.filter(_remainder(3) != 1))
    return op08_toxicity.score(docs, machine).select(
        "doc_id", (_remainder(3) == 1).alias("held_out"), "score", "predicted")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_repeats.remove_repeats(read_table(spark, sf_dir, "documents"), with_text=False)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_decontam.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """Every conversation of ``rows`` after damage and repair, with the digest of its repaired rows."""
    convs, repaired = op11_repair.repair(op11_repair.damage(rows))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    ids = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn(
        "conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    return (ids.join(convs, "conv", "left").join(op11_repair.digests(repaired), "conv", "left")
            .select("conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(read_table(spark, sf_dir, "conversations"))


def merkle_digests(docs: DataFrame, home_leaves: int = op12_merkle.HOME) -> DataFrame:
    """Proofs of all rows, checked against rows whose line feeds are gone where 2 divides
    the crc32 of the decimal id (a null id stays as it is)."""
    tampered = F.when(_remainder(2) == 0, op12_merkle.leaf(F.translate("text", "\n", "")))
    proofs = op12_merkle.manifest(docs, tampered, home_leaves)
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", op12_merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
        op12_merkle.fold(F.coalesce("others", "leaf"), F.col("proof")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_digests(read_table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = op13_counts.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


QUERIES = {f.__name__: f for f in (
    op1_language, op2_token_files, op3_jaccard_join, op4_quality_rules, op5_url_filter, op6_page_text,
    op7_source_mixing, op8_toxicity, op9_repeats, op10_decontamination, op11_conversation_repair, op12_merkle_manifest, op13_token_counts)}
ORACLE = {"op5_url_filter": OP5_SQL, "op7_source_mixing": op07_mixing.oracle(), "op10_decontamination": op10_decontam.ORACLE}
