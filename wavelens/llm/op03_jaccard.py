"""Exact Jaccard join on word shingles by universe partition and pigeonhole.

A document's set holds the 64-bit hashes of its distinct ``n``-word shingles (fewer
words: the whole sequence as one). Sets r and s, |s| <= |r|, link when
J >= 0.8; then |s| >= 0.8 |r| and they differ in at most H = (|r| + |s|) / 9 elements.

Sizes fall into bands. In a band the universe of elements is split by hashing
into m segments, m > H for every pair that can meet there. Every set is indexed in its
own band by its m segment subsets and, in the first m/16 segments, also by the
subsets less one element. A set probes its own band and the lower ones its
partners may lie in. A segment compared with threshold t (-1: skipped, 0: equal, 1: equal
up to one element, by the one-deletion neighbourhoods) accounts for t + 1 of the differences;
by the pigeonhole some segment matches if the thresholds of a probe add up to
more than H. Each probe takes the cheapest such allocation: costs are document frequencies
of the elements (a fixed table of counters over all documents), an empty subset costs most.

Signatures meet by one shuffle. Documents with equal sets are one node (their
smallest id). In a bucket every node is verified against its best connected node, not
against all others; components of these links are formed, and what is left, pairs of
one bucket in different components, is verified one by one. So a group of copies costs
links in proportion to its size and no link between components is missed. Verification
intersects the sets themselves. Groups of one partner are cut into parts of 256.

Null text, or text without words: empty set, linked with nothing. A null id is
never linked (its component is null). Rows with the same id are one document with
all their links, each row with its own set size. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelens.llm.bytetext import LOWER, blocks, mix, span_hashes, window_hashes, word_spans
from wavelens.llm.components import components
from wavelens.llm.store import stage

SLOTS = 1 << 16           # counters of the cost table
PART = 256                # partners of one node verified in one group
BITS = 2048               # parity bitmap of a set
BLOCK = 1024              # rows of a bucket compared with as many in one group
_SEG = np.uint64(0xA0761D6478BD642F)
_VAL = np.uint64(0xE7037ED1A0B428DB)


@dataclass(frozen=True)
class Band:
    number: int
    lo: int
    hi: int
    segments: int
    deletions: int        # segments that also have one-deletion neighbourhoods


def _bands() -> list[Band]:
    out, lo = [], 1
    while lo < 1 << 40:
        hi = max(lo, lo * 8 // 5)
        need = hi // 4 + 1
        m = need + max(1, need // 10)
        out.append(Band(len(out), lo, hi, m, max(1, m // 16)))
        lo = hi + 1
    return out


BANDS = _bands()
_LOWS = np.array([b.lo for b in BANDS], np.int64)


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every document of a block."""
    low = LOWER[data]
    starts, ends, doc = word_spans(low, offs)
    words = span_hashes(low, starts, ends)
    h, first = window_hashes(words, doc, n)
    h_doc = doc[first] if len(first) else first
    n_docs = len(offs) - 1
    cut = np.searchsorted(h_doc, np.arange(n_docs + 1))
    word_cut = np.searchsorted(doc, np.arange(n_docs + 1))
    out = []
    for i in range(n_docs):
        k = int(word_cut[i + 1] - word_cut[i])
        if k >= n:
            s = np.sort(h[cut[i]:cut[i + 1]])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif k:
            out.append(window_hashes(words[word_cut[i]:word_cut[i + 1]], np.zeros(k, np.int64), k)[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def parity_bitmap(s: np.ndarray) -> bytes:
    """Parity of the number of elements hashed to each of ``BITS`` places. Two sets that
    differ in d elements have bitmaps that differ in d places at most."""
    n = np.bincount((mix(s ^ _SEG) >> np.uint64(53)).astype(np.int64), minlength=BITS)
    return np.packbits((n & 1).astype(np.uint8)).tobytes()


def fingerprints(whole: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of every set; ``whole``: the sets one after the other."""
    full = size > 0
    first = (np.cumsum(size) - size)[full]
    f1, f2 = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
    if len(first):
        f1[full] = np.add.reduceat(whole, first)
        f2[full] = np.add.reduceat(mix(whole ^ _VAL), first)
    return mix(f1 + size.astype(np.uint64)), f2


# ------------------------------------------------------------ signatures

def _profile(n: int):
    """Per document its set size, 128-bit fingerprint and parity bitmap; at the end
    of a task the counters of its elements."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for lo, hi, data, offs in blocks(batch, "text"):
                sets = shingle_sets(data, offs, n)
                size = [len(s) for s in sets]
                whole = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                counts += np.bincount((whole >> np.uint64(48)).astype(np.int64), minlength=SLOTS)
                f1, f2 = fingerprints(whole, np.array(size, np.int64))
                k = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, k), pa.array(size, pa.int64()), pa.array(f1.view(np.int64)),
                     pa.array(f2.view(np.int64)), pa.array([parity_bitmap(s) for s in sets], pa.binary()),
                     pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64())],
                    names=["doc_id", "n_shingles", "f1", "f2", "bits", "slot", "n"])
        used = np.flatnonzero(counts)
        k = len(used)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()),
             pa.nulls(k, pa.binary()), pa.array(used.astype(np.int32)), pa.array(counts[used])],
            names=["doc_id", "n_shingles", "f1", "f2", "bits", "slot", "n"])
    return run


def _places(band: Band) -> tuple[np.uint64, np.ndarray]:
    """The salt of a band and the hashes of its segments' numbers."""
    salt = np.uint64(((band.number + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    return salt, mix(np.arange(1, band.segments + 1, dtype=np.uint64) * _SEG + salt)


def _subsets(s: np.ndarray, values: np.ndarray, freqs: np.ndarray, band: Band, empty_cost: float):
    """Segment subsets of a set in a band: signatures and costs of all segments,
    and for the segments with neighbourhoods the deletions and their extra cost.
    ``values``, ``freqs``: mixed hashes and document frequencies of the elements."""
    m = band.segments
    small = m <= 1 << 16                     # numbers of 16 bits are sorted by radix
    salt, base = _places(band)
    seg = (mix(s ^ (_SEG ^ salt)) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
    seg = seg.astype(np.uint16 if small else np.int64)
    order = np.argsort(seg, kind="stable")
    seg, val, freq = seg[order].astype(np.int64), values[order], freqs[order]
    first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    present = seg[first]
    sums = np.zeros(m, np.uint64)
    sums[present] = np.add.reduceat(val, first)
    cost = np.full(m, empty_cost)
    cost[present] = np.minimum.reduceat(freq, first)
    sigs = mix(sums ^ base)
    # one-deletion neighbourhoods of the first segments
    u = band.deletions
    end = int(np.searchsorted(seg, u))
    del_seg = seg[:end]
    del_sigs = mix((sums[del_seg] - val[:end]) ^ base[del_seg])
    extra = np.full(u, empty_cost)
    if end:
        sorted_freq = freq[:end][np.lexsort((freq[:end], del_seg))]
        at = first[:np.searchsorted(present, u)]
        size = np.concatenate([at[1:], [end]]) - at
        at, size = at[size >= 2], size[size >= 2]
        j = seg[at]
        extra[j] = cost[j] + sorted_freq[at + 1] + (size - 1) * sorted_freq[at]
    return sigs, cost, del_seg, del_sigs, np.maximum(extra, cost[:u])


def _allocate(cost: np.ndarray, extra: np.ndarray, need: int) -> np.ndarray:
    """Thresholds (-1, 0, 1) with sum(t + 1) >= need at least cost: the ``need``
    cheapest steps, a segment's second step never before its first."""
    steps = np.concatenate([cost, extra])
    take = np.argsort(steps, kind="stable")[:need]
    t = np.full(len(cost), -1)
    t[take[take < len(cost)]] = 0
    up = take[take >= len(cost)] - len(cost)
    t[up[t[up] == 0]] = 1
    return t


def signatures(s: np.ndarray, df: np.ndarray, n_docs: int) -> np.ndarray:
    """Records of one set: signature with two low bits (1: probes, 2: a deletion)."""
    n = len(s)
    own = BANDS[int(np.searchsorted(_LOWS, n, side="right")) - 1]
    out = []
    values, freqs = mix(s ^ _VAL), df[(s >> np.uint64(48)).astype(np.int64)]
    b = own.number
    while b >= 0 and BANDS[b].hi * 5 >= n * 4:
        band = BANDS[b]
        sigs, cost, del_seg, del_sigs, extra = _subsets(s, values, freqs, band, float(n_docs) + 1.0)
        t = _allocate(cost, extra, (n + min(n, band.hi)) // 9 + 1)
        clear = ~np.uint64(3)
        probe = (t >= 0).astype(np.uint64)
        del_probe = (t[del_seg] == 1).astype(np.uint64)
        keep, keep_del = slice(None), slice(None)
        if band is not own:                  # a visitor: probes only
            keep, keep_del = t >= 0, t[del_seg] == 1
        out.append(((sigs & clear) | probe)[keep])
        out.append(((del_sigs & clear) | np.uint64(2) | del_probe)[keep_del])
        b -= 1
    return np.concatenate(out)


def _emit(n: int, df_b, n_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = df_b.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in blocks(batch, "text", 1 << 20):
                sets = shingle_sets(data, offs, n)
                got = [(signatures(s, df, n_docs) if len(s) else s) for s in sets]
                count = [len(g) for g in got]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(got).view(np.int64)),
                     pa.array(np.repeat(ids[lo:hi].astype(np.int64), count))], names=["sig", "id"])
    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of records sorted by signature, those whose signature another record has."""
    last = None                              # the last record, and whether it was given out
    for batch in batches:
        sig, ids = (batch.column(c).to_numpy() for c in ("sig", "id"))
        if not len(sig):
            continue
        key = sig >> 2
        same = np.zeros(len(key), bool)
        eq = key[1:] == key[:-1]
        same[1:] |= eq
        same[:-1] |= eq
        if last is not None:
            if last[0] >> 2 == key[0]:
                same[0] = True
                if not last[2]:
                    yield pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]])], names=["sig", "id"])
        last = (sig[-1], ids[-1], bool(same[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(sig[same]), pa.array(ids[same])], names=["sig", "id"])


# ---------------------------------------------------------- verification

def _sets_of(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in blocks(batch, "text"):
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("hub"), rows.column("part"), rows.column("role"), rows.column("id"),
                     pa.array([s.tobytes() for s in shingle_sets(data, offs, n)], pa.binary())],
                    names=["hub", "part", "role", "id", "elements"])
    return run


def _compare(per_cent: int):
    """Hub rows first in each (hub, part): every other row against the hub's sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hubs = None, []
        for batch in batches:
            a, b, k = [], [], []
            cols = [batch.column(c).to_pylist() for c in ("hub", "part", "role", "id")]
            for i, (hub, part, role, doc) in enumerate(zip(*cols)):
                s = np.frombuffer(batch.column("elements")[i].as_buffer(), np.uint64)
                if (hub, part) != at:
                    at, hubs = (hub, part), []
                if role == 0:
                    hubs.append(s)
                    continue
                for h in hubs:
                    both = len(np.intersect1d(h, s, assume_unique=True))
                    if both and 100 * both >= per_cent * (len(h) + len(s) - both):
                        a.append(hub)
                        b.append(doc)
                        k.append(both)
                        break
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(k, pa.int64())], names=["a", "b", "common"])
    return run


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group: the pairs of a query row and another row of the group, of
    different components, one of them a probe, whose sizes and bitmaps leave room for a link."""
    def pairs(rows: list) -> pa.RecordBatch:
        query = [r for r in rows if r[0]]
        other = [r for r in rows if not r[0]]
        a_out, b_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if query and other:
            bits = np.frombuffer(b"".join(r[5] for r in other), np.uint64).reshape(len(other), -1)
            node, comp, probe, size = (np.array([r[k] for r in other]) for k in (1, 2, 3, 4))
            for q in query:
                room = (q[4] + size) // 9
                ok = (comp != q[2]) & ((probe | q[3]) == 1) & (np.abs(size - q[4]) <= room)
                at = np.flatnonzero(ok)
                if len(at):
                    apart = np.bitwise_count(bits[at] ^ np.frombuffer(q[5], np.uint64)).sum(1, dtype=np.int64)
                    at = at[apart <= room[at]]
                    a_out.append(np.minimum(node[at], q[1]))
                    b_out.append(np.maximum(node[at], q[1]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))],
                                          names=["a", "b"])

    at, rows = None, []
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in
                ("bucket", "part", "q_part", "query", "node", "comp", "probe", "n_shingles", "bits")]
        for group, row in zip(zip(*cols[:3]), zip(*cols[3:])):
            if group != at:
                if rows:
                    yield pairs(rows)
                at, rows = group, []
            rows.append(row)
    if rows:
        yield pairs(rows)


def _left_apart(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of one bucket in different components that may still link.
    ``mixed``: bucket, node, comp, main, probe, n_all, n_minor; ``sets``: node, n_shingles, bits. The
    rows outside a bucket's main component are compared with all its rows, block by
    block inside the tasks; only what the bitmaps cannot rule out comes out."""
    rows = mixed.join(sets, "node")
    parts, q_parts = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("n_all", "n_minor"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    q_own = F.pmod(F.xxhash64("node"), F.col("q_parts")).cast("int")
    rows = rows.withColumns({"parts": parts, "q_parts": q_parts})
    cols = ["bucket", "part", "q_part", "query", "node", "comp", "probe", "n_shingles", "bits"]
    every = rows.withColumn("part", own).withColumn(
        "q_part", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1))).withColumn("query", F.lit(False))
    asked = rows.filter(F.col("comp") != F.col("main")).withColumn("q_part", q_own).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("query", F.lit(True))
    return (every.select(*cols).unionByName(asked.select(*cols)).repartition("bucket", "part", "q_part")
            .sortWithinPartitions("bucket", "part", "q_part").mapInArrow(_near, "a long, b long").distinct())


def verify(docs: DataFrame, pairs: DataFrame, n: int, per_cent: int) -> DataFrame:
    """The pairs (a, b) whose texts' sets reach the similarity, with the size of their
    intersection. ``docs``: doc_id, text of all documents."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).cast("long").alias("parts"))
    cut = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    wanted = (cut.select(F.col("b").alias("id"), F.col("a").alias("hub"), "part", F.lit(1).alias("role"))
              .unionByName(cut.select(F.col("a").alias("id"), F.col("a").alias("hub"), "part", F.lit(0).alias("role"))
                           .distinct()))
    texts = docs.join(wanted, docs["doc_id"] == wanted["id"]).select("hub", "part", "role", "id", "text")
    sets = texts.mapInArrow(_sets_of(n), "hub long, part long, role int, id long, elements binary")
    return (sets.repartition("hub", "part").sortWithinPartitions("hub", "part", "role")
            .mapInArrow(_compare(per_cent), "a long, b long, common long"))


# ------------------------------------------------------------------ join

@dataclass
class JaccardJoin:
    """Results of ``join``: ``documents`` (doc_id, n_shingles, node), ``links`` (a, b, common:
    verified links between nodes, enough to connect every component) and
    ``components`` (id, component) of the linked nodes."""
    documents: DataFrame
    links: DataFrame
    components: DataFrame

    def membership(self) -> DataFrame:
        """doc_id, n_shingles, component_id for every row."""
        comp = self.components.select(F.col("id").alias("node"), "component")
        return self.documents.join(comp, "node", "left").select(
            "doc_id", "n_shingles", F.coalesce("component", "node", "doc_id").alias("component_id"))


def join(docs: DataFrame, n: int = 5, per_cent: int = 80) -> JaccardJoin:
    """Link the documents of ``docs`` (doc_id, text)."""
    if per_cent < 80:
        raise ValueError("the bands hold for a similarity of 0.8 or more")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = stage(docs.mapInArrow(
        _profile(n), "doc_id long, n_shingles long, f1 long, f2 long, bits binary, slot int, n long"), "jaccard-profile")
    df = np.zeros(SLOTS)
    for r in told.filter(F.col("slot").isNotNull()).groupBy("slot").agg(F.sum("n").alias("n")).collect():
        df[r["slot"]] = r["n"]                       # at most SLOTS rows
    rows = told.filter(F.col("slot").isNull())
    n_docs = rows.count()
    live = rows.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    equal = live.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("least"))
    node = (live.join(equal, ["f1", "f2", "n_shingles"]).groupBy("doc_id").agg(F.min("least").alias("node")))
    node = stage(node, "jaccard-nodes")
    documents = rows.select("doc_id", "n_shingles").join(node, "doc_id", "left")
    # ids with several sets tie their sets' nodes together
    ties = (live.join(equal, ["f1", "f2", "n_shingles"]).join(node, "doc_id")
            .filter(F.col("least") != F.col("node")).select(F.col("node").alias("a"), F.col("least").alias("b"))
            .withColumn("common", F.lit(0).cast("long")))

    df_b = spark.sparkContext.broadcast(df)
    records = (docs.filter(F.col("doc_id").isNotNull()).mapInArrow(_emit(n, df_b, n_docs), "sig long, id long")
               .repartition(F.shiftright("sig", 2)).sortWithinPartitions("sig")
               .mapInArrow(_shared, "sig long, id long"))
    # buckets of nodes: at least two, and a probe among them
    by_node = (records.join(node, records["id"] == node["doc_id"])
               .groupBy(F.shiftright("sig", 2).alias("bucket"), "node")
               .agg(F.max(F.col("sig").bitwiseAND(1)).alias("probe")))
    shared = (by_node.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.max("probe").alias("probes"))
              .filter((F.col("size") > 1) & (F.col("probes") == 1)).select("bucket", "size"))
    met = by_node.join(shared, "bucket").select("bucket", "node", "probe", "size")
    met = stage(met, "jaccard-buckets")

    # first round: everyone against the bucket's best connected node
    weight = met.groupBy("node").agg(F.sum("size").alias("weight"))
    placed = met.join(weight, "node")
    hub = placed.groupBy("bucket").agg(
        F.max(F.struct("probe", "weight", (-F.col("node")).alias("neg"))).alias("h")).select(
        "bucket", (-F.col("h.neg")).alias("a"))
    star = (met.join(hub, "bucket").filter(F.col("node") != F.col("a"))
            .select("a", F.col("node").alias("b")).distinct())
    star = stage(star, "jaccard-star")
    links = stage(verify(docs, star, n, per_cent).unionByName(ties), "jaccard-links")

    # second round: what the first left apart, pair by pair
    comp = components(links)
    tagged = (met.join(comp.withColumnRenamed("id", "node"), "node", "left")
              .select("bucket", "node", "probe", F.coalesce("component", "node").alias("comp")))
    sizes = tagged.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k"))
    main = (sizes.groupBy("bucket").agg(F.sum("k").alias("n_all"), F.max(F.struct("k", "comp")).alias("m"))
            .filter(F.col("n_all") > F.col("m.k"))
            .select("bucket", F.col("m.comp").alias("main"), "n_all", (F.col("n_all") - F.col("m.k")).alias("n_minor")))
    sets = (live.join(node.filter(F.col("doc_id") == F.col("node")), "doc_id").groupBy("node", "n_shingles", "bits")
            .agg(F.lit(1)).select("node", "n_shingles", "bits"))
    left = _left_apart(tagged.join(main, "bucket"), sets)
    done = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = stage(left.join(done, ["a", "b"], "left_anti"), "jaccard-rest")
    more = stage(verify(docs, left, n, per_cent), "jaccard-links")
    if not more.isEmpty():
        links = links.unionByName(more)
        comp = components(links)
    return JaccardJoin(documents, links, comp)


def membership(docs: DataFrame, n: int = 5, per_cent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    return join(docs, n, per_cent).membership()


#: ids given to rows without one lie below every id of a table
NO_ID = -(1 << 62)


def keep_one(docs: DataFrame, n: int = 5, per_cent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: of the smallest id (rows without an id come
    after all others, and are told apart by their texts), and of rows equal in id
    and text any one. Rows without words stay. If the kept id has several texts, each
    of them stays once."""
    names = docs.columns
    text = F.col("row.text").cast("string")
    bare = NO_ID - F.xxhash64(text).bitwiseAND((1 << 61) - 1)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).withColumn(
        "_id", F.coalesce(F.col("row.doc_id").cast("long"), bare))
    found = join(rows.select(F.col("_id").alias("doc_id"), text.alias("text")), n, per_cent)
    placed = (found.documents.filter(F.col("node").isNotNull())
              .join(found.components.select(F.col("id").alias("node"), "component"), "node", "left")
              .groupBy("doc_id", F.coalesce("component", "node").alias("component")).agg(F.count(F.lit(1)).alias("n")))
    best = placed.groupBy("component").agg(
        F.min(F.struct((F.col("doc_id") <= NO_ID).alias("bare"), "doc_id")).alias("best"))
    told = stage(placed.join(best, "component").select(
        F.col("doc_id").alias("_id"), (F.col("doc_id") != F.col("best.doc_id")).alias("gone"), "n")
        .filter(F.col("gone") | (F.col("n") > 1)), "jaccard-gone")
    once = rows.join(told, "_id", "left_anti")
    again = (rows.join(told.filter(~F.col("gone")), "_id", "left_semi")
             .withColumn("_text", F.sha2(text, 256)).dropDuplicates(["_id", "_text"]))
    return once.select("row.*").unionByName(again.select("row.*"))
