"""Benchmark decontamination by a broadcast hash set of test n-grams.

Texts are lower-cased (A-Z only) and cut into words of ASCII letters and
digits and of non-ASCII characters. A window is ``n`` consecutive words of a
benchmark item; an item of fewer words, but not none, is one window. The
64-bit hashes of the item windows form one hash set that travels with the
plan, ``max_windows`` hashes at most; a benchmark with more is cut by hash into as many
sets as it needs, each probed in a pass of its own over the table the pass before stored.
Every word position of every
training text is probed inside the scan, in the row, without a shuffle: only
rows with a hit go on. There the windows' words themselves are compared (a
hash alone decides nothing), hits are merged to covered words and counted.

DataFrame functions only. Null text or text without words: no words, clean.
Null and repeated items count like others (items that share a window all
count); a null item id is left out of the list of ids but its windows hit.
Rows with the same id are kept apart by their text, equal rows give equal
results, one for each. Empty tables: every document is clean. Extra columns
stay (``decontaminate``) or are ignored (``report``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelens.llm.store import stage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: the same words in a text whose A-Z are not lower-cased, and what lies between them
_RAW_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MAX_WINDOWS = 200_000      # hashes of a set: 8 bytes each, a few MB with the plan


def words(text: Column) -> Column:
    """The normalised words of a text as an array (null: empty)."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), 0)


def _window_hashes(length: int) -> Column:
    """Hashes of all windows of ``length`` words of the array column ``w``
    (word hashes in ``h``); empty if there are fewer words."""
    at = F.sequence(F.lit(1), F.size("h") - length + 1)
    return F.when(F.size("h") >= length, F.transform(at, lambda i: F.xxhash64(F.slice("h", i, length)))) \
        .otherwise(F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame, n: int = 13) -> DataFrame:
    """(item_id, len, gram, hash): every window of every item."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(n))
    starts = F.sequence(F.lit(1), F.size("w") - length + 1)
    return (items.select("item_id", length.alias("len"), "w", F.explode(starts).alias("s"))
            .select("item_id", "len", F.slice("w", F.col("s"), F.col("len")).alias("gram"))
            .select("item_id", "len", F.array_join("gram", " ").alias("gram"),
                    F.xxhash64(F.transform("gram", lambda x: F.xxhash64(x))).alias("hash"))
            .distinct())


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 13, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Every row of ``docs`` (all columns, as a struct ``row``) with n_words, the
    places ``at`` (array of start, len) whose window hash is an item's and, where
    there are any, the words ``w``. Stored in the shared folder: the hashing
    is not repeated by what follows."""
    known = stage(item_windows(benchmark, n).select("len", "hash").distinct(), "decontam-hashes")
    sizes = {r.len: r.n for r in known.groupBy("len").agg(F.count(F.lit(1)).alias("n")).collect()}   # at most n rows
    total = sum(sizes.values())
    # sets of three quarters of the bound on average: the hashes deal them evenly
    passes = 1 if total <= max_windows else -(-total * 4 // (3 * max_windows))
    names = docs.columns
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
                        F.array().cast("array<struct<start:int,len:int>>").alias("at"))
    for i in range(passes):
        values = [r.hash for r in known.filter(F.pmod("hash", F.lit(passes)) == i).select("hash").distinct().collect()]

        def places(k: int) -> Column:
            marked = F.transform(_window_hashes(k), lambda x, j: F.when(
                x.isin(values), F.struct((j + 1).alias("start"), F.lit(k).alias("len"))))
            return F.filter(marked, lambda s: s.isNotNull())

        lengths = sorted(sizes)
        base = found.select("row", "at", words(F.col("row.text")).alias("w")).withColumn(
            "h", F.transform("w", lambda x: F.xxhash64(x)))
        at = F.concat("at", *(places(k) for k in lengths))
        found = stage(base.select("row", F.size("w").cast("long").alias("n_words"), at.alias("at"), "w")
                      .withColumn("w", F.when(F.size("at") > 0, F.col("w"))), "decontam")
    return found


def _spans(docs: DataFrame, benchmark: DataFrame, n: int, max_windows: int) -> DataFrame:
    """(row, n_words, spans, items, n_items): verified hits as sorted (start, len) and
    the ids of the items with occurring windows, sorted as strings."""
    grams = item_windows(benchmark, n)
    found = hits(docs, benchmark, n, max_windows)
    marked = found.filter(F.size("at") > 0)
    # every hit window with its words, once for each document text
    gram = F.transform("at", lambda s: F.struct(
        s.start.alias("start"), s.len.alias("len"),
        F.array_join(F.slice("w", s.start, s.len), " ").alias("gram")))
    key = F.md5(F.array_join("w", " "))
    texts = marked.select(key.alias("k"), F.explode(gram).alias("x")).select("k", "x.*").distinct()
    spans = (texts.join(grams.select("gram").distinct(), "gram", "left_semi")
             .groupBy("k").agg(F.sort_array(F.collect_list(F.struct("start", "len"))).alias("spans")))
    # the items of a document's distinct windows, each item once
    item = F.col("item_id").cast("string")
    items = (texts.select("k", "gram").distinct().join(grams.select("gram", item.alias("item")), "gram")
             .select("k", "item").distinct()
             .groupBy("k").agg(F.sort_array(F.collect_list("item")).alias("items"), F.count(F.lit(1)).alias("n_items")))
    each = spans.join(items, "k")
    dirty = marked.withColumn("k", key).join(each, "k", "left")
    none = F.array().cast("array<struct<start:int,len:int>>")
    strings = F.array().cast("array<string>")
    got = dirty.select("row", "n_words", F.coalesce("spans", none).alias("spans"),
                       F.coalesce("items", strings).alias("items"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"))
    clean = found.filter(F.size("at") == 0).select("row", "n_words", none.alias("spans"), strings.alias("items"),
                                                   F.lit(0).cast("long").alias("n_items"))
    return got.unionByName(clean)


def _n_hit() -> Column:
    """Words covered by the spans (sorted by start, then length)."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(1).alias("free"))
    return F.aggregate("spans", zero, lambda acc, s: F.struct(
        (acc.n + F.greatest(F.lit(0), s.start + s.len - F.greatest(acc.free, s.start))).alias("n"),
        F.greatest(acc.free, s.start + s.len).alias("free")), lambda acc: acc.n)


def judge(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20,
          max_windows: int = MAX_WINDOWS) -> DataFrame:
    """row, n_words, spans, items, n_items, n_hit, contaminated for every row;
    contaminated: a hit, and ``share`` times the hit words reach the words."""
    return (_spans(docs, benchmark, n, max_windows)
            .withColumn("n_hit", _n_hit().cast("long"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))))


def report(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20,
           max_windows: int = MAX_WINDOWS) -> DataFrame:
    return judge(docs.select("doc_id", "text"), benchmark, n, share, max_windows).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.col("n_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", n: int = 13, share: int = 20,
                  max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` without the benchmark's passages: ``document`` drops contaminated
    documents, ``span`` cuts every hit word (with the separators behind it)."""
    judged = judge(docs, benchmark, n, share, max_windows)
    names = docs.columns
    if mode == "document":
        return judged.filter(~F.col("contaminated")).select("row.*")
    if mode != "span":
        raise ValueError(f"unknown mode {mode!r}")
    # words (in either case) with the separators behind them; the text before the first word stays
    pieces = F.regexp_extract_all(F.col("row.text"), F.lit(f"{_RAW_WORD}{_RAW_SEPARATOR}*"), 0)
    head = F.regexp_extract(F.col("row.text"), rf"\A{_RAW_SEPARATOR}*", 0)
    kept = F.filter("_p", lambda x, i: ~F.exists("spans", lambda s: (i + 1 >= s.start) & (i + 1 < s.start + s.len)))
    text = F.when(F.size("spans") == 0, F.col("row.text")).otherwise(F.concat(head, F.array_join(kept, "")))
    return judged.withColumn("_p", pieces).select(
        *[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names])


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, text, row_number() OVER () AS rid,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (
  SELECT item_id, w, least(len(w), 13) AS n, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS s
  FROM bw WHERE len(w) > 0),
grams AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS gram FROM bs),
ns AS (SELECT DISTINCT n FROM grams),
ds AS (
  SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM dw, ns WHERE len(w) >= n),
met AS (
  SELECT ds.rid, ds.s, ds.n, grams.item_id FROM ds JOIN grams
    ON grams.n = ds.n AND grams.gram = array_to_string(ds.w[ds.s:ds.s + ds.n - 1], ' ')),
hit AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT rid, unnest(generate_series(s, s + n - 1)) AS p FROM met) GROUP BY rid),
its AS (
  SELECT rid, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM met GROUP BY rid)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(hit.n_hit, 0)::BIGINT AS n_hit,
  coalesce(its.n_items, 0)::BIGINT AS n_items, sha256(coalesce(its.ids, '')) AS items_sha256,
  coalesce(hit.n_hit, 0) > 0 AND 20 * coalesce(hit.n_hit, 0) >= len(dw.w) AS contaminated
FROM dw LEFT JOIN hit ON hit.rid = dw.rid LEFT JOIN its ON its.rid = dw.rid
"""
