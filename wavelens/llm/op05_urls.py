"""URL filter by a temporal list join.

A dated list log (key, at, action) becomes validity intervals: an ``add`` holds from
its time until the key's next entry, a ``remove`` ends what was open; of entries of
one key and time a ``remove`` wins. Keys are hosts, parent domains, or a host with its first path
part. An as-of join evaluates every capture (url, fetched_at) against the entries
active when it was fetched: start <= fetched_at < end.

The entries of a key are put in order hour by hour: the next entry is looked for within the
hour, else it is the first one of the key's next hour with entries, so a key that holds a
large part of the log is ordered by many tasks. Both sides meet on (key, day): an
interval is laid out over the days of the captures' own span, so a key with a long history
or many captures is spread over days, and Spark splits what is still uneven. Captures are made distinct before they meet the
list and only urls and times are shuffled, never page bodies.

DataFrame functions only. Null or unparsable url, null time: not listed, no match. Null
keys, times or unknown actions in the list are passed over. Repeated rows give a
row each; empty list: nothing is listed. Extra columns stay (``filter_captures``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PART = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]+)"


def host(url: Column) -> Column:
    """Host of an absolute url in lower case (empty if there is none)."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def keys(url: Column) -> Column:
    """The list keys a url falls under: its host, the host's parent domains down to
    two labels, and the host with the first path part."""
    h = host(url)
    labels = F.split(h, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
                          lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    part = F.regexp_extract(F.coalesce(url, F.lit("")), PART, 1)
    with_part = F.when(part != "", F.array(F.concat(h, F.lit("/"), part))).otherwise(F.array().cast("array<string>"))
    return F.when(h == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.concat(parents, with_part)))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, start, end) from a log (key, at, action); ``end`` is null while open."""
    known = (entries.filter(F.col("key").isNotNull() & F.col("at").isNotNull()
                            & F.col("action").isin("add", "remove"))
             .groupBy("key", "at").agg(F.max(F.col("action") == "remove").alias("removed")))
    known = known.withColumn("hour", F.date_trunc("hour", "at"))
    hours = known.groupBy("key", "hour").agg(F.min("at").alias("first"))       # a row for each hour of a key
    later = hours.select("key", "hour", F.lead("first").over(Window.partitionBy("key").orderBy("hour")).alias("later"))
    after = Window.partitionBy("key", "hour").orderBy("at")
    return (known.withColumn("next", F.lead("at").over(after)).join(later, ["key", "hour"]).filter(~F.col("removed"))
            .select("key", F.col("at").alias("start"), F.coalesce("next", "later").alias("end")))


def matches(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Distinct captures (url, fetched_at) with n_matches, the least matching ``key`` and
    its ``since``; captures without a match are absent."""
    caps = captures.select("url", F.col("fetched_at").cast("timestamp").alias("fetched_at")) \
        .filter(F.col("url").isNotNull() & F.col("fetched_at").isNotNull()).distinct()
    span = caps.agg(F.min(F.to_date("fetched_at")), F.max(F.to_date("fetched_at"))).first()
    spread = intervals(entries)
    if span[0] is None:
        spread = spread.limit(0)
    lo, hi = F.lit(span[0]).cast("date"), F.lit(span[1]).cast("date")
    first = F.greatest(F.to_date("start"), lo)
    last = F.least(F.coalesce(F.to_date("end"), hi), hi)
    spread = (spread.withColumn("first", first).withColumn("last", last).filter(F.col("first") <= F.col("last"))
              .select("key", "start", "end", F.explode(F.sequence("first", "last")).alias("day")))
    probe = caps.select("url", "fetched_at", F.to_date("fetched_at").alias("day"), F.explode(keys(F.col("url"))).alias("key"))
    met = probe.join(spread, ["key", "day"]).filter(
        (F.col("start") <= F.col("fetched_at")) & (F.col("end").isNull() | (F.col("fetched_at") < F.col("end"))))
    return met.groupBy("url", "fetched_at").agg(
        F.count(F.lit(1)).alias("n_matches"), F.min(F.struct("key", "start")).alias("m")).select(
        "url", "fetched_at", "n_matches", F.col("m.key").alias("key"), F.col("m.start").alias("since"))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Every row of ``captures`` as a struct ``row`` with listed, n_matches, key, since."""
    names = captures.columns
    rows = captures.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    met = matches(captures, entries)
    on = (F.col("row.url") == met["url"]) & (F.col("row.fetched_at").cast("timestamp") == met["fetched_at"])
    return rows.join(met, on, "left").select(
        "row", F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"),
        met["key"].isNotNull().alias("listed"), met["key"].alias("key"), met["since"].alias("since"))


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """The captures that no active entry lists, with their own columns."""
    return judge(captures, entries).filter(~F.col("listed")).select("row.*")
