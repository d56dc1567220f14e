"""Merkle manifest of a documents table, with proofs built by octopus multiproof.

Every row is a leaf: the SHA-256 (lowercase hex) of its fields ``doc_id``, ``source``,
``lang``, ``n_chars`` and ``text``, each written as ``-`` if null, else as byte count,
colon, value. The leaves of a source in ascending ``doc_id`` form a tree in which every
three consecutive nodes (the last run may be shorter, even a single node) become the hash
of their concatenated hex digests, until one is left, the source's subroot; the
subroots in the order of their sources (null first, then by bytes) form the top tree.

``manifest`` deals the leaves, sorted by (source, doc_id), to homes of about ``HOME``
leaves. A home holds a run of neighbouring leaves of one or more sources:

1. *up*: every home hashes what its own leaves determine and passes on the few largest
   nodes at the edges of each run (four a level at most), and asks for the coordinates
   of the nodes that its proofs lack: the minimal union, again four a level at most;
2. the edges of a tree meet, give the nodes above them, and answer what was asked;
3. *down*: with the nodes fetched once, every home derives the interior nodes that its
   proofs share and expands the proof of each leaf locally.

The top tree goes the same way with subroots as leaves. What meets in one group is edges,
whose number follows the number of homes and the depth, never the leaves: a source
with a third of all rows is spread over as many homes as any other rows. Homes are
counted from the rows; equal rows may be parted, so they do not collect in one home.

Rows with the same source and ``doc_id`` (null first) are ordered by leaf; repeated rows
are neighbouring leaves. Null fields, empty and long texts are hashed as stated.
A lone leaf is its source's subroot and its proof holds the top tree's part only. An
empty table gives no rows. Only the five columns and ``others`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelens.llm.store import stage

FAN = 3
HOME = 1 << 16         # leaves of a home, on average
TOP = -1               # number of the top tree; a source's tree has its rank
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def leaf(text: Column | None = None) -> Column:
    """Digest of a row, with ``text`` in place of its own text if given."""
    def field(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return F.sha2(F.concat(*(field(text if text is not None and f == "text" else F.col(f)) for f in FIELDS)), 256)


# ------------------------------------------------------------------ shape

def sizes(total: int) -> list[int]:
    """Number of nodes of each level, from the leaves to the root."""
    out = [total]
    while out[-1] > 1:
        out.append(-(-out[-1] // FAN))
    return out


def wanted(start: int, stop: int, total: int) -> list[tuple[int, int]]:
    """Coordinates (level, index) that the proofs of the leaves [start, stop) lack."""
    out = []
    for level, n in enumerate(sizes(total)[:-1]):
        above, end = start // FAN, -(-stop // FAN)
        out += [(level, i) for i in range(above * FAN, start)]
        out += [(level, i) for i in range(stop, min(end * FAN, n))]
        start, stop = above, end
    return out


def edges(first: int, nodes: list[str], total: int) -> list[tuple[int, int, str]]:
    """The largest nodes (level, index, digest) that the leaves from ``first`` on determine."""
    out, a, held = [], first, nodes
    for level, n in enumerate(sizes(total)):
        b = a + len(held)
        up, end = -(-a // FAN), (-(-n // FAN) if b == n else b // FAN)
        if n == 1 or up >= end:
            return out + [(level, a + i, x) for i, x in enumerate(held)]
        out += [(level, i, held[i - a]) for i in (*range(a, up * FAN), *range(end * FAN, b))]
        held = [digest(held[i * FAN - a:i * FAN - a + FAN]) for i in range(up, end)]
        a = up
    return out


def climb(nodes: dict[tuple[int, int], str], total: int) -> None:
    """Add every node whose children are known."""
    counts = sizes(total)
    at: dict[int, set[int]] = {}
    for level, i in nodes:
        at.setdefault(level, set()).add(i)
    for level, n in enumerate(counts[:-1]):
        for up in {i // FAN for i in at.get(level, ())}:
            below = [nodes.get((level, i)) for i in range(up * FAN, min(up * FAN + FAN, n))]
            if None not in below and (level + 1, up) not in nodes:
                nodes[level + 1, up] = digest(below)
                at.setdefault(level + 1, set()).add(up)


def paths(start: int, nodes: list[str], total: int, fetched: dict[tuple[int, int], str],
          above: tuple = ()) -> tuple[list[tuple], str]:
    """(proof of each leaf, root): a proof is a tuple of (digests before, digests after)
    for each level, followed by ``above``. ``fetched`` has what ``wanted`` asks for."""
    counts, rows = sizes(total), []
    for level, n in enumerate(counts[:-1]):
        stop = start + len(nodes)
        first, end = start // FAN, -(-stop // FAN)
        whole = ([fetched[level, i] for i in range(first * FAN, start)] + nodes
                 + [fetched[level, i] for i in range(stop, min(end * FAN, n))])
        rows.append((start - first * FAN, len(nodes), whole))
        start, nodes = first, [digest(whole[i:i + FAN]) for i in range(0, len(whole), FAN)]
    proofs = [above] * len(nodes)
    for skip, count, whole in reversed(rows):
        proofs = [(("".join(whole[i // FAN * FAN:i]), "".join(whole[i + 1:i // FAN * FAN + FAN])), *proofs[i // FAN])
                  for i in range(skip, skip + count)]
    return proofs, nodes[0]


# -------------------------------------------------------------- exchanges

_NODE = "tree long, home long, total long, kind string, level int, at long, hash string"


def _exchange(runs: DataFrame) -> DataFrame:
    """Runs (tree, home, total, first, nodes, start, stop) to the digests that homes ask for
    and each tree's root: (tree, home, level, at, hash), home null for a root."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("tree", pa.int64()), ("home", pa.int64()), ("total", pa.int64()), ("kind", pa.string()),
                            ("level", pa.int32()), ("at", pa.int64()), ("hash", pa.string())])
        for batch in batches:
            for r in range(len(batch)):
                tree, home, total, first, nodes, start, stop = (
                    batch.column(c)[r].as_py() for c in ("tree", "home", "total", "first", "nodes", "start", "stop"))
                have = edges(first, nodes, total) if nodes else []
                top = len(sizes(total)) - 1
                rows = [(tree, home, total, "root" if level == top else "edge", level, i, x) for level, i, x in have]
                rows += [(tree, home, total, "want", level, i, None) for level, i in wanted(start, stop, total)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else
                                                 [pa.array([], f.type) for f in schema], schema=schema)

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        total = int(group["total"].iloc[0])
        have = group[group["kind"] != "want"]
        nodes = {(int(a), int(b)): x for a, b, x in zip(have["level"], have["at"], have["hash"])}
        climb(nodes, total)
        want = group.loc[group["kind"] == "want", ["tree", "home", "level", "at"]].astype({"home": "Int64"})
        top = len(sizes(total)) - 1
        root = pd.DataFrame({"tree": [group["tree"].iloc[0]], "home": pd.array([None], "Int64"), "level": [top], "at": [0]})
        out = pd.concat([want, root], ignore_index=True)
        return out.assign(hash=[nodes[int(a), int(b)] for a, b in zip(out["level"], out["at"])])

    asked = stage(runs.select("tree", "home", "total", "first", "nodes", "start", "stop").mapInArrow(ask, _NODE), "merkle-edges")
    # a tree that one home holds whole has its root at once and wants nothing; the top tree
    # is wanted by every home, so its root takes part in its group
    whole = asked.filter((F.col("kind") == "root") & (F.col("tree") != TOP))
    met = asked.filter((F.col("kind") != "root") | (F.col("tree") == TOP))
    return whole.select("tree", F.lit(None).cast("long").alias("home"), "level", "at", "hash").unionByName(
        met.groupBy("tree").applyInPandas(answer, "tree long, home long, level int, at long, hash string"))


def _runs(placed: DataFrame) -> DataFrame:
    """Sorted rows to one row for each (home, source): the leaves in order."""
    names = ("doc_id", "leaf", "others")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("home", pa.int64()), ("place", pa.int32()), ("source", pa.string()),
                            ("doc_ids", pa.list_(pa.int64())), ("nodes", pa.list_(pa.string())),
                            ("others", pa.list_(pa.string()))])

        def row():
            return pa.RecordBatch.from_pylist([{"home": home, "place": place, "source": key, "doc_ids": held[0],
                                                "nodes": held[1], "others": held[2]}], schema=schema)

        place, home, key, held = 0, None, None, None
        for batch in batches:
            sources, cols = batch.column("source").to_pylist(), [batch.column(c).to_pylist() for c in names]
            home, at = batch.column("home")[0].as_py() if len(batch) else home, 0
            while at < len(batch):
                if held is not None and sources[at] != key:
                    yield row()
                    place, held = place + 1, None
                if held is None:
                    key, held = sources[at], ([], [], [])
                end = at
                while end < len(batch) and sources[end] == key:
                    end += 1
                for h, c in zip(held, cols):
                    h += c[at:end]
                at = end
        if held is not None:
            yield row()

    return placed.mapInArrow(gather, "home long, place int, source string, doc_ids array<long>, "
                                     "nodes array<string>, others array<string>")


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a home (fetched digests, then its runs) to one row for each leaf."""
    step = pa.struct([("before", pa.string()), ("after", pa.string())])

    def emit(runs: list[dict], fetched: dict[int, dict]) -> Iterator[pa.RecordBatch]:
        got = [paths(r["first"], r["nodes"], r["total"], fetched.get(r["tree"], {})) for r in runs]
        ups, root = paths(runs[0]["tree"], [subroot for _, subroot in got], runs[0]["n_trees"], fetched.get(TOP, {}))
        for r, (proofs, subroot), up in zip(runs, got, ups):
            for lo in range(0, len(proofs), 2048):
                part = [p + up for p in proofs[lo:lo + 2048]]
                ends = [0]
                for p in part:
                    ends.append(ends[-1] + len(p))
                steps = pa.StructArray.from_arrays(
                    [pa.array([s[i] for p in part for s in p], pa.string()) for i in (0, 1)], fields=list(step))
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"][lo:lo + n], pa.int64()), pa.array([r["source"]] * n, pa.string()),
                     pa.array(range(r["first"] + lo, r["first"] + lo + n), pa.int64()),
                     pa.array(r["nodes"][lo:lo + n], pa.string()), pa.array(r["others"][lo:lo + n], pa.string()),
                     pa.array([subroot] * n, pa.string()), pa.array([root] * n, pa.string()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps)],
                    names=["doc_id", "source", "position", "leaf", "others", "subroot", "root", "proof"])

    home, runs, fetched = None, [], {}
    for batch in batches:
        for r in range(len(batch)):
            row = {c: batch.column(c)[r].as_py() for c in ("home", "tree")}
            if row["home"] != home:
                if runs:
                    yield from emit(runs, fetched)
                home, runs, fetched = row["home"], [], {}
            if batch.column("hash")[r].is_valid:
                fetched.setdefault(row["tree"], {})[batch.column("level")[r].as_py(), batch.column("at")[r].as_py()] = (
                    batch.column("hash")[r].as_py())
            else:
                runs.append(row | {c: batch.column(c)[r].as_py() for c in
                                   ("first", "total", "n_trees", "source", "doc_ids", "nodes", "others")})
    if runs:
        yield from emit(runs, fetched)


def manifest(docs: DataFrame, others: Column | None = None, home_leaves: int = HOME) -> DataFrame:
    """doc_id, source, position (of the leaf in its source), leaf, others, subroot, root and
    proof for every row of ``docs``. ``proof`` is an array of (before, after) from the leaf
    up to the root, the digests of a run left and right of the node, joined. ``others`` is a
    string column carried along with each row, such as a digest to be checked."""
    read = docs.select("doc_id", "source", leaf().alias("leaf"),
                       (F.lit(None) if others is None else others).cast("string").alias("others"))
    rows = stage(read.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                             "leaf", "others", F.monotonically_increasing_id().alias("row")), "merkle-leaves")
    n_homes = max(1, -(-rows.count() // home_leaves))
    order = ["source", "doc_id", "leaf", "row"]
    runs = stage(_runs(rows.repartitionByRange(n_homes, *order).sortWithinPartitions(*order)
                       .withColumn("home", F.spark_partition_id().cast("long"))), "merkle-runs")

    # where each run begins in its source, and the rank of its source: a row for each run
    before = Window.partitionBy("source").orderBy("home").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.select("home", "place", "source", F.size("nodes").cast("long").alias("n")).select(
        "home", "place", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
        F.sum("n").over(Window.partitionBy("source")).alias("total"))
    begins = (F.col("first") == 0).cast("long")
    earlier = Window.orderBy("home").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy(F.lit(0))
    homes = placed.groupBy("home").agg(F.sum(begins).alias("k")).select(     # a row for each home
        "home", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("ranked"), F.sum("k").over(everywhere).alias("n_trees"))
    inside = Window.partitionBy("home").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = stage(placed.join(homes, "home").withColumn("tree", F.col("ranked") + F.sum(begins).over(inside) - 1)
                   .drop("ranked"), "merkle-places")

    whole = runs.join(placed, ["home", "place"])
    asked = stage(_exchange(whole.withColumn("start", F.col("first")).withColumn("stop", F.col("first") + F.col("n"))),
                  "merkle-fetched")
    # runs of subroots: those of whole sources by home, one by itself if its source is parted,
    # since the homes on both sides of it have it on their paths
    trees = placed.filter("first = 0").withColumn("parted", F.when(F.col("n") < F.col("total"), F.col("tree")))
    held = (trees.select("tree", F.col("home").alias("at_home"), "parted", "n_trees")
            .join(asked.filter(F.col("home").isNull()).select("tree", "hash"), "tree")
            .groupBy("at_home", "parted").agg(
                F.min("tree").alias("first"), F.max("n_trees").alias("total"),
                F.array_sort(F.collect_list(F.struct("tree", "hash"))).getField("hash").alias("nodes")))
    spans = placed.groupBy("home").agg(F.min("tree").alias("start"), (F.max("tree") + 1).alias("stop"),
                                       F.max("n_trees").alias("total"))
    no_nodes = F.lit(None).cast("array<string>").alias("nodes")
    top = _exchange(held.select("first", "total", "nodes", F.lit(None).cast("long").alias("home"),
                                F.lit(0).cast("long").alias("start"), F.col("total").alias("stop"))
                    .unionByName(spans.select("home", "start", "stop", "total", F.col("start").alias("first"), no_nodes))
                    .withColumn("tree", F.lit(TOP).cast("long")))

    blank = {"level": "int", "at": "long", "hash": "string"}
    carried = {"place": "int", "first": "long", "total": "long", "n_trees": "long", "source": "string",
               "doc_ids": "array<long>", "nodes": "array<string>", "others": "array<string>"}
    fetched = asked.unionByName(top).filter(F.col("home").isNotNull()).select(
        "home", "tree", "level", "at", "hash", *(F.lit(None).cast(t).alias(c) for c, t in carried.items()))
    return (whole.select("home", "tree", *(F.lit(None).cast(t).alias(c) for c, t in blank.items()), *carried)
            .unionByName(fetched).repartition(n_homes, "home")
            .sortWithinPartitions("home", F.col("hash").isNull(), "place")
            .mapInArrow(_expand, "doc_id long, source string, position long, leaf string, others string, subroot string, "
                                 "root string, proof array<struct<before:string,after:string>>"))


def fold(leaf_digest: Column, proof: Column) -> Column:
    """Root that a proof gives for a leaf."""
    return F.aggregate(proof, leaf_digest, lambda x, step: F.sha2(F.concat(step["before"], x, step["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """Digest of a proof's digests, from the leaf's level up."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)
