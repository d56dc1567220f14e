"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sizes are words. Sources in code-point order (null last) weigh 3, 1, 2, 3, 1,
2 ...; together they take ``total_share`` of all words, and a source's target
stops at ``max_repeat`` times its size, the excess being shared again by weight
until none is above its stop (closed form: with the sources sorted by
stop / weight, a source is stopped if the level reached before it covers it).

Every source is dealt to shards by a seeded digest of the document, a shard
being cut into blocks of (nearly) equal words, ``block_words`` each. The whole
number of blocks goes to the sources by the highest quotients
wanted / (2 k + 1), and a source's quota to its shards by the highest quotients
too. In a shard the quota is served by whole passes over its blocks and, for
the rest, by a seeded selection of blocks: block j is selected if
(j * step + shift) mod n_blocks is below the rest, a permutation as ``step``
is a prime above any block number. So a block is taken at most
``max_repeat`` times, and a document at most that often its size.

Only (document, source, size) rows are shuffled; a hot source has as many
shards as its words ask for. Window groups: a shard (bounded words), the
shards of a source, the sources. Null text counts no word; a null source is a
source of its own; rows with equal ids are told apart by their text's digest,
and rows equal in both share one place (their words are dealt like any
others). An empty table mixes to an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: fixed values: primes above any block number of a shard
STEPS = (2147483647, 2147483629, 2147483587, 2147483579)


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (3, 1, 2)
    total_share: float = 1.5
    max_repeat: int = 2
    block_words: int = 64
    shard_words: int = 1 << 20
    seed: str = "mix"


def _digest(*cols: Column) -> Column:
    """60 bits of an MD5 digest as a whole number."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 15), 16, 10).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a digest of the text for every row."""
    return docs.select(
        F.col("doc_id"), F.col("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.md5(F.col("text")), F.lit("")).alias("text_key"))


def targets(sized: DataFrame, mix: Mix) -> DataFrame:
    """One row for each source: source, place, source_size, target."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in mix.weights])
    per = (per.withColumn("place", F.row_number().over(place) - 1)
           .withColumn("weight", F.element_at(weights, (F.col("place") % len(mix.weights) + 1).cast("int")))
           .withColumn("stop", (F.col("source_size") * mix.max_repeat).cast("double")))
    by_stop = Window.orderBy(F.col("stop") / F.col("weight"), "place")
    whole = Window.partitionBy()
    per = (per.withColumn("total", F.sum("source_size").over(whole) * F.lit(float(mix.total_share)))
           .withColumn("stopped_before", F.coalesce(
               F.sum("stop").over(by_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
           .withColumn("weight_left", F.sum("weight").over(by_stop.rowsBetween(0, Window.unboundedFollowing)))
           .withColumn("level", (F.col("total") - F.col("stopped_before")) / F.col("weight_left"))
           .withColumn("is_stopped", F.col("level") * F.col("weight") >= F.col("stop")))
    # stopped sources come first in this order; the others share one level
    free = F.min(F.when(~F.col("is_stopped"), F.struct((F.col("stop") / F.col("weight")).alias("a"),
                                                       F.col("place").alias("b"),
                                                       F.col("level").alias("level")))).over(whole)
    return (per.withColumn("free", free)
            .select("source", "place", "source_size",
                    F.when(F.col("is_stopped"), F.col("stop"))
                    .otherwise(F.col("free.level") * F.col("weight")).alias("target")))


def _seats(df: DataFrame, share: str, total: str, group: list[str], order: str) -> DataFrame:
    """Sainte-Laguë: ``total`` seats of a group by the highest quotients
    share / (2 k + 1). Quotients that are certainly among the highest are counted
    by their threshold, the few around it are ranked one by one."""
    g = Window.partitionBy(*group)
    df = (df.withColumn("_n", F.count(F.lit(1)).over(g)).withColumn("_all", F.sum(share).over(g))
          .withColumn("_part", F.when(F.col("_all") > 0, F.col(share) / F.col("_all")).otherwise(F.lit(0.0)))
          .withColumn("_sure", F.floor(F.col("_part") * F.greatest(F.col(total) - F.col("_n") / 2, F.lit(0.0))
                                       + F.lit(0.5)).cast("long"))
          .withColumn("_sure", F.when(F.col("_part") > 0, F.col("_sure")).otherwise(F.lit(0)))
          .withColumn("_open", F.col(total) - F.sum("_sure").over(g))
          .withColumn("_more", F.ceil(F.col("_part") * F.col("_n")).cast("long") + 3))
    tries = (df.select(*group, order, share, "_sure", "_open",
                       F.explode(F.sequence(F.lit(0).cast("long"), F.col("_more") - 1)).alias("_k"))
             .filter(F.col(share) > 0)
             .withColumn("_q", F.col(share) / (2 * (F.col("_sure") + F.col("_k")) + 1)))
    best = Window.partitionBy(*group).orderBy(F.col("_q").desc(), order)
    won = (tries.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= F.col("_open"))
           .groupBy(*group, order).agg(F.count(F.lit(1)).alias("_won")))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, order]]
    keep = [c for c in df.columns if not c.startswith("_")]
    return (df.alias("a").join(won.alias("b"), on, "left")
            .select(*[F.col(f"a.{c}") for c in keep],
                    (F.col("a._sure") + F.coalesce(F.col("b._won"), F.lit(0))).alias("seats")))


def plan(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, text_key, source_size, target,
    place, shard, start (first word in its shard), shard_size, n_blocks, quota, step, shift."""
    sized = sizes(docs)
    goal = targets(sized, mix)
    shard = (F.pmod(_digest(F.lit(mix.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_key")),
                    F.floor(F.col("source_size") / mix.shard_words) + 1))
    rows = (sized.alias("d").join(goal.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
            .select("doc_id", "d.source", "size", "text_key", "place", "source_size", "target")
            .withColumn("shard", shard))
    # blocks of a shard; the blocks each source wants in all
    shards = (rows.groupBy("place", "shard").agg(F.sum("size").alias("shard_size"),
                                                 F.first("source_size").alias("source_size"),
                                                 F.first("target").alias("target"))
              .withColumn("n_blocks", F.when(F.col("shard_size") > 0, F.greatest(
                  F.lit(1).cast("long"), F.round(F.col("shard_size") / mix.block_words).cast("long")))
                  .otherwise(F.lit(0).cast("long"))))
    per_source = (shards.groupBy("place").agg(F.sum("n_blocks").alias("blocks"), F.first("target").alias("target"),
                                              F.first("source_size").alias("source_size"))
                  .withColumn("wanted", F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks")
                                               / F.col("source_size")).otherwise(F.lit(0.0)))
                  .withColumn("all_blocks", F.round(F.sum("wanted").over(Window.partitionBy())).cast("long"))
                  .withColumn("one", F.lit(1)))
    quota = (_seats(per_source, "wanted", "all_blocks", ["one"], "place")
             .select("place", F.least(F.col("seats"), F.col("blocks") * mix.max_repeat).alias("source_quota")))
    dealt = _seats(shards.join(quota, "place").withColumn("blocks_wanted", F.col("n_blocks").cast("double")),
                   "blocks_wanted", "source_quota", ["place"], "shard")
    dealt = dealt.select("place", "shard", "shard_size", "n_blocks",
                         F.least(F.col("seats"), F.col("n_blocks") * mix.max_repeat).alias("quota"))
    key = _digest(F.lit(mix.seed), F.col("place").cast("string"), F.col("shard").cast("string"))
    dealt = (dealt.withColumn("step", F.element_at(F.array(*[F.lit(s) for s in STEPS]),
                                                   (F.pmod(key, F.lit(len(STEPS))) + 1).cast("int")).cast("long"))
             .withColumn("shift", F.when(F.col("n_blocks") > 0, F.pmod(key, F.col("n_blocks"))).otherwise(F.lit(0))))
    inside = (Window.partitionBy("place", "shard")
              .orderBy(_digest(F.col("text_key"), F.lit(mix.seed)), F.col("doc_id").asc_nulls_first(), "text_key")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)).cast("long"))
    return placed.join(dealt, ["place", "shard"])


def _block_start(j: Column) -> Column:
    """First word of block ``j`` of a shard: equal parts, whole words."""
    return F.floor(j * F.col("shard_size") / F.col("n_blocks"))


def _times(j: Column) -> Column:
    """How often block ``j`` is taken."""
    rest = F.pmod(F.col("quota"), F.col("n_blocks"))
    hit = F.pmod(j * F.col("step") + F.col("shift"), F.col("n_blocks")) < rest
    return F.floor(F.col("quota") / F.col("n_blocks")) + hit.cast("long")


def runs(planned: DataFrame) -> Column:
    """The blocks a row meets as an array of (lo, hi, times): words lo to hi of
    the document, counted from 0, hi not included."""
    first = F.floor(F.col("start") * F.col("n_blocks") / F.col("shard_size")) - 1
    last = F.floor((F.col("start") + F.col("size") - 1) * F.col("n_blocks") / F.col("shard_size")) + 1
    blocks = F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.col("n_blocks") - 1))
    piece = F.transform(blocks, lambda j: F.struct(
        (F.greatest(_block_start(j), F.col("start")) - F.col("start")).alias("lo"),
        (F.least(_block_start(j + 1), F.col("start") + F.col("size")) - F.col("start")).alias("hi"),
        _times(j).alias("times")))
    none = F.array().cast("array<struct<lo:bigint,hi:bigint,times:bigint>>")
    return F.when(F.col("size") > 0, F.filter(piece, lambda x: x.hi > x.lo)).otherwise(none)


def taken(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, taken (words the mix takes)."""
    p = plan(docs, mix)
    words = F.aggregate(runs(p), F.lit(0).cast("long"),
                        lambda acc, x: acc + (x.hi - x.lo) * x.times)
    return p.select("doc_id", "source", "size", "source_size", "target", words.alias("taken"))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself, with the columns of ``docs``: for each pass over a document
    one row with the words that this pass takes (the whole text where it takes all of
    them, else the taken runs with the white space before each word). Documents of
    which nothing is taken are not in the mix."""
    names = docs.columns

    def key(text_key: Column) -> Column:
        return F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")),
                                 F.coalesce(F.md5("source"), F.lit("-")), text_key))

    # one shuffle of the texts: rows and plan are numbered and joined on one key;
    # rows equal in id, source and text share their places, one plan row each
    ordered = Window.partitionBy("_key")
    planned = plan(docs, mix)
    p = (planned.select(key(F.col("text_key")).alias("_key"), "size", runs(planned).alias("_runs"))
         .withColumn("_m", F.row_number().over(ordered.orderBy("_runs"))))
    src = (docs.select(key(F.coalesce(F.md5(F.col("text")), F.lit(""))).alias("_key"),
                       F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
           .withColumn("_n", F.row_number().over(ordered.orderBy(F.lit(1)))))
    both = (src.join(p, "_key").filter((F.col("_n") <= F.col("_m")) & (F.col("_n") >= F.col("_m")))
            .select("row", "size", "_runs"))
    passes = both.select("row", "size", "_runs", F.explode(F.sequence(F.lit(1), F.lit(mix.max_repeat))).alias("_pass"))
    passes = passes.withColumn("_cut", F.filter("_runs", lambda x: x.times >= F.col("_pass")))
    got = F.aggregate("_cut", F.lit(0).cast("long"), lambda a, x: a + x.hi - x.lo)
    passes = passes.withColumn("_got", got).filter(F.col("_got") > 0)
    words = F.regexp_extract_all(F.col("row.text"), F.lit(r"[\x20\x09-\x0D]*" + WORD), 0)
    cut = F.array_join(F.flatten(F.transform("_cut", lambda x: F.slice(
        F.col("_words"), (x.lo + 1).cast("int"), (x.hi - x.lo).cast("int")))), "")
    passes = passes.withColumn("_words", F.when(F.col("_got") < F.col("size"), words))
    text = F.when(F.col("_got") == F.col("size"), F.col("row.text")).otherwise(cut)
    return passes.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names])


def oracle(mix: Mix = Mix()) -> str:
    """The query's rows in DuckDB SQL: quotas by ranking every quotient."""
    def digest(*cols: str) -> str:
        return f"('0x' || substr(md5(concat_ws('|', {', '.join(cols)})), 1, 15))::BIGINT"

    seed, b, most = f"'{mix.seed}'", mix.block_words, mix.max_repeat
    return rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    CASE WHEN text IS NULL THEN '' ELSE md5(text) END AS tk FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM per),
weighted AS (SELECT *, {list(mix.weights)}[place % {len(mix.weights)} + 1] AS weight, (source_size * {most})::DOUBLE AS stop FROM placed),
filled AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * {float(mix.total_share)} - coalesce(sum(stop) OVER (ORDER BY stop / weight, place
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY stop / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
goal AS (
  SELECT f.*, CASE WHEN level * weight >= stop THEN stop ELSE weight * (
      SELECT arg_min(level, struct_pack(a := stop / weight, b := place)) FROM filled WHERE level * weight < stop) END AS target FROM filled f),
r AS (
  SELECT s.*, g.place, g.source_size, g.target,
    {digest(seed, "coalesce(doc_id::VARCHAR, '')", 'tk')} % (g.source_size // {mix.shard_words} + 1) AS shard
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
sh AS (
  SELECT place, shard, sum(size)::BIGINT AS shard_size, any_value(source_size) AS source_size, any_value(target) AS target,
    CASE WHEN sum(size) > 0 THEN greatest(1, round(sum(size)::DOUBLE / {b}))::BIGINT ELSE 0 END AS n_blocks FROM r GROUP BY place, shard),
src AS (
  SELECT place, sum(n_blocks)::BIGINT AS blocks,
    CASE WHEN any_value(source_size) > 0 THEN any_value(target) * sum(n_blocks)::DOUBLE / any_value(source_size) ELSE 0.0 END AS wanted
  FROM sh GROUP BY place),
won AS (
  SELECT place, count(*) AS seats FROM (
    SELECT place, row_number() OVER (ORDER BY wanted / (2 * k + 1) DESC, place) AS rk
    FROM (SELECT *, unnest(generate_series(0, blocks * {most} + 2)) AS k FROM src WHERE wanted > 0))
  WHERE rk <= (SELECT round(sum(wanted)) FROM src) GROUP BY place),
quota AS (SELECT src.place, least(coalesce(seats, 0), blocks * {most}) AS source_quota FROM src LEFT JOIN won USING (place)),
sh_won AS (
  SELECT place, shard, count(*) AS seats FROM (
    SELECT place, shard, source_quota, row_number() OVER (PARTITION BY place ORDER BY n_blocks::DOUBLE / (2 * k + 1) DESC, shard) AS rk
    FROM (SELECT *, unnest(generate_series(0, n_blocks * {most} + 2)) AS k FROM sh JOIN quota USING (place) WHERE n_blocks > 0))
  WHERE rk <= source_quota GROUP BY place, shard),
dealt AS (
  SELECT sh.place, sh.shard, shard_size, n_blocks, least(coalesce(seats, 0), n_blocks * {most}) AS quota,
    {digest(seed, 'sh.place::VARCHAR', 'sh.shard::VARCHAR')} AS key
  FROM sh LEFT JOIN sh_won ON sh_won.place = sh.place AND sh_won.shard = sh.shard),
spot AS (
  SELECT r.*, d.shard_size, d.n_blocks, d.quota, {list(STEPS)}[key % {len(STEPS)} + 1] AS step, key, row_number() OVER () AS rid,
    coalesce(sum(size) OVER (PARTITION BY r.place, r.shard ORDER BY {digest('tk', seed)}, doc_id NULLS FIRST, tk
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM r JOIN dealt d ON d.place = r.place AND d.shard = r.shard),
met AS (
  SELECT *, floor(j * shard_size / n_blocks)::BIGINT AS lo, floor((j + 1) * shard_size / n_blocks)::BIGINT AS hi FROM (
    SELECT *, unnest(generate_series(greatest(floor(start * n_blocks / shard_size)::BIGINT - 1, 0),
      least(floor((start + size - 1) * n_blocks / shard_size)::BIGINT + 1, n_blocks - 1))) AS j FROM spot WHERE size > 0)),
got AS (
  SELECT rid, sum((least(hi, start + size) - greatest(lo, start))
    * (quota // n_blocks + ((j * step + key % n_blocks) % n_blocks < quota % n_blocks)::BIGINT)) AS taken
  FROM met WHERE least(hi, start + size) > greatest(lo, start) GROUP BY rid)
SELECT doc_id, source, size, source_size, target, coalesce(got.taken, 0)::BIGINT AS taken
FROM spot LEFT JOIN got ON got.rid = spot.rid
"""
