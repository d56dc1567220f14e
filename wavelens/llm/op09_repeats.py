"""Exact removal of repeated passages with suffix arrays over shards.

Every byte covered by a string of ``width`` bytes that also starts earlier (in a document
before, or earlier in the same one) is removed; strings are judged on the input.

1. Anchors. Of every window of ``width`` bytes the least hash of its 24-byte grams
   (leftmost) is its anchor, so equal windows have equal anchors at equal places.
   Runs of windows with one anchor make one record: hash, digest of the bytes the run
   covers, place. About one record for 39 bytes crosses the only large shuffle.
2. Records with equal hash and bytes repeat the earliest of them: all their windows
   are repeats. The earliest of classes that share a hash with other classes go on. A task
   settles its own records before the shuffle: later copies are told at once, and the
   classes of a hash that has several in the task travel by hash and digest, with one
   marker for the hash, so a hash that a third of all records share is dealt to many tasks.
3. Their bytes are fetched, cut at the anchor into windows reaching right and left of
   it, and dealt to shards by 62 bytes around the anchor that all windows of a
   side share. A shard gets its suffix array by Larsson-Sadakane refinement and its common
   prefixes by Kasai's scan; in each run of prefixes of ``width`` bytes or more all but
   the earliest are repeats. A piece that shares its key with no other cannot hold a
   repeat: equal windows have their anchors at equal places, so no two windows of one run
   are equal.
4. The pieces of a key fill as many shards of about ``MAX_GROUP`` pieces as they need (a
   frequent phrase just below ``width``). The windows that are first in their shard are
   then merged across the shards of a key in sorted order of their 128-bit fingerprints;
   merging shards pairwise by binary search would cost the square of their number.
5. Repeat runs are gathered by document and joined to the texts once.

Documents are ordered by (doc_id, nulls first; digest of the text); of rows equal in both
one comes first, the others repeat it. Null text is empty; texts below ``width`` bytes
lose nothing. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavelens.llm.bytetext import blocks, mix
from wavelens.llm.store import stage
from wavelens.llm.suffixes import common_prefixes, suffix_array

WIDTH = 100
GRAM = 24
SIDE = 38                  # bytes beyond the anchor gram that a side's windows share
MAX_GROUP = 4096           # pieces of one key in a shard, on average
SHARD_BYTES = 1 << 20
_R = 0x9FB21C651E98DF25
_RINV = pow(_R, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if len(_POWERS.get("p", ())) < n:
        for k, x in (("p", _R), ("i", _RINV)):
            a = np.full(n, np.uint64(x), np.uint64)
            if n:
                a[0] = 1
            _POWERS[k] = np.cumprod(a, dtype=np.uint64)
    return _POWERS["p"], _POWERS["i"]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 24 bytes at every place."""
    x = data.astype(np.uint64)
    for s in (1, 2, 4):
        x = x[:-s] | x[s:] << np.uint64(8 * s)
    a, b, c = x[:-16], x[8:-8], x[16:]
    h = a * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h = (h + b) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h = (h + c) * np.uint64(0x165667B19E3779F9)
    return mix(h)


def _window_argmin(key: np.ndarray, w: int) -> np.ndarray:
    """Least of every ``w`` neighbours (prefix and suffix minima of blocks)."""
    n = len(key) - w + 1
    pad = -(-len(key) // w) * w
    full = np.full(pad, np.iinfo(np.uint64).max, np.uint64)
    full[:len(key)] = key
    rows = full.reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).reshape(-1)
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[w - 1:w - 1 + n])


CHUNK = 1 << 22            # window starts handled at a time, places fit 24 bits


def anchors(data: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, digest, first window start, windows, anchor place) of one document's records."""
    w = width - GRAM + 1
    for lo in range(0, max(0, len(data) - width + 1), CHUNK):
        part = data[lo:lo + CHUNK + width - 1]
        h = gram_hashes(part)
        places = np.arange(len(h), dtype=np.uint64)
        best = _window_argmin((h & ~np.uint64(0xFFFFFF)) | places, w)
        at = (best & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        count = np.diff(np.append(first, len(at)))
        p, inv = _powers(CHUNK + width) if len(h) > 1 << 16 else _powers(1 << 16)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * p[:len(h)], dtype=np.uint64)])
        end = first + count + w - 1                      # one past the last gram of the run
        digest = mix((sums[end] - sums[first]) * inv[first] + count.astype(np.uint64))
        yield h[at[first]], digest, first + lo, count, at[first] + lo


#: how a record travels: by its hash, by hash and digest, not at all (a repeat), or as a
#: marker of a hash with several classes in one task
BY_HASH, BY_CLASS, TOLD, MARKER = 0, 1, 2, 3
HELD = 1 << 20             # records that a task settles at a time
_RECORD = "kind int, h long, c long, did long, th long, place long"


def _settle(h: np.ndarray, c: np.ndarray, did: np.ndarray, th: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """A task's records with their kinds, markers added, equal records once."""
    by = np.lexsort((place, th, did, c, h))
    h, c, did, th, place = (x[by] for x in (h, c, did, th, place))
    same_h = np.append(False, h[1:] == h[:-1])
    same_c = same_h & np.append(False, c[1:] == c[:-1])
    again = same_c & np.append(False, (did[1:] == did[:-1]) & (th[1:] == th[:-1]) & (place[1:] == place[:-1]))
    number = np.cumsum(~same_h) - 1
    several = np.bincount(number, weights=~same_c)[number] > 1 if len(h) else np.zeros(0, bool)
    kind = np.where(same_c, TOLD, np.where(several, BY_CLASS, BY_HASH))[~again]
    marked = h[several & ~same_h]
    none = np.zeros(len(marked), np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.append(kind, none + MARKER).astype(np.int32)), pa.array(np.append(h[~again], marked)),
         *(pa.array(np.append(x[~again], none)) for x in (c, did, th, place))],
        names=["kind", "h", "c", "did", "th", "place"])


def _records(width: int):
    """The anchors' records; ``place``: first window start, windows, anchor offset (16 low bits)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[], [], [], [], []]
        for batch in batches:
            did, th = (batch.column(c).to_numpy() for c in ("did", "th"))
            for lo, hi, data, offs in blocks(batch, "text"):
                for i in range(hi - lo):
                    for h, c, a, k, at in anchors(data[offs[i]:offs[i + 1]], width):
                        n = len(h)
                        for col, x in zip(cols, (h.view(np.int64), c.view(np.int64), np.full(n, did[lo + i]),
                                                 np.full(n, th[lo + i]), a << 16 | k << 8 | at - a)):
                            col.append(x)
                if sum(map(len, cols[0])) > HELD:
                    yield _settle(*map(np.concatenate, cols))
                    cols = [[], [], [], [], []]
        if cols[0]:
            yield _settle(*map(np.concatenate, cols))
    return run


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records sorted by (way, h, marker first, c, document, place), way 0 by hash, 1 by class,
    2 told: ``repeat`` true for all but the first of a class; the first ones of hashes with
    several classes, ``repeat`` false."""
    names = ["did", "th", "place", "repeat"]
    prev = None                      # last record's way, h, kind, c, did, th, place
    held = None                      # the only class so far of the last hash: its first record
    for batch in batches:
        kind, h, c, did, th, a = (batch.column(x).to_numpy() for x in ("kind", "h", "c", "did", "th", "place"))
        told = kind == TOLD
        if told.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[told]) for x in (did, th, a, told)], names=names)
            kind, h, c, did, th, a = (x[~told] for x in (kind, h, c, did, th, a))
        if not len(h):
            continue
        by_class = kind == BY_CLASS
        last = prev or (~by_class[0], h[0], kind[0], ~c[0], 0, 0, 0)

        def like_before(j: int, x: np.ndarray) -> np.ndarray:
            return np.append(last[j] == x[0], x[1:] == x[:-1])

        same_h = like_before(0, by_class) & like_before(1, h)
        same_h[0] &= prev is not None
        same_c = same_h & like_before(2, kind) & like_before(3, c)
        again = same_c & like_before(4, did) & like_before(5, th) & like_before(6, a)
        lead = np.flatnonzero(~same_c)
        multi = np.zeros(len(lead), bool)
        if len(lead):
            eq = same_h[lead][1:]
            multi[1:] |= eq
            multi[:-1] |= eq
            if same_h[lead[0]]:              # the hash goes on from the last batch
                multi[0] = True
                if held is not None and held[3] == BY_HASH:
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*held[:3], False)], names=names)
            j = lead[-1]
            held = None if multi[-1] or by_class[j] else (did[j], th[j], a[j], kind[j])
        repeat = same_c & ~again & (kind != MARKER)       # equal rows of the table give equal records
        take = repeat.copy()
        take[lead[multi | by_class[lead]]] = True
        take &= kind != MARKER
        if take.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[take]) for x in (did, th, a, repeat)], names=names)
        prev = (by_class[-1], h[-1], kind[-1], c[-1], did[-1], th[-1], a[-1])


def _cut(width: int):
    """The bytes of the runs of a document, by side of the anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs")
            did, th = (batch.column(c).to_numpy() for c in ("did", "th"))
            for lo, hi, data, offs in blocks(batch, "text"):
                rows = []
                for i in range(hi - lo):
                    text = data[offs[i]:offs[i + 1]].tobytes()
                    for r in runs[lo + i].as_py():
                        a, n = r >> 16, r >> 8 & 255
                        p = a + (r & 255)
                        # windows from p - SIDE on reach SIDE bytes beyond the gram
                        split = min(max(a, p - SIDE), a + n)
                        for tag, x, y in ((b"l", a, split), (b"r", split, a + n)):
                            if x < y:
                                near = text[p - SIDE:p + GRAM] if tag == b"l" else text[p:p + GRAM + SIDE]
                                key = hashlib.blake2b(tag + near, digest_size=8).digest()
                                rows.append((int.from_bytes(key, "little", signed=True), int(did[lo + i]),
                                             int(th[lo + i]), x, text[x:y - 1 + width]))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, t) for v, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(),
                                                                     pa.binary()))],
                        names=["key", "did", "th", "a", "bytes"])
    return run


def shard_repeats(pieces: list[bytes], width: int) -> list[np.ndarray]:
    """Window starts of each piece (pieces in document order) whose window also starts in an
    earlier piece or earlier in the piece."""
    sizes = np.array([len(p) + 1 for p in pieces])
    text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    starts = np.cumsum(sizes) - sizes
    symbols = text.astype(np.int16) + 1
    symbols[starts + sizes - 1] = 0                       # between the pieces
    order, _ = suffix_array(symbols)
    prefix = common_prefixes(symbols, order, width)
    piece = np.searchsorted(starts, order, side="right") - 1
    whole = starts[piece] + sizes[piece] - 1 - order >= width
    run = np.cumsum((prefix < width) | ~whole)            # runs of equal windows
    order, run = order[whole], run[whole]
    first = np.full(int(run.max()) + 1 if len(run) else 1, len(text), np.int64)
    np.minimum.at(first, run, order)
    again = np.sort(order[order != first[run]])
    owner = np.searchsorted(starts, again, side="right") - 1
    cut = np.searchsorted(owner, np.arange(len(pieces) + 1))
    return [again[cut[i]:cut[i + 1]] - starts[i] for i in range(len(pieces))]


def _runs_of(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of neighbouring numbers as (first, count)."""
    if not len(starts):
        return []
    edge = np.flatnonzero(np.append(True, np.diff(starts) != 1))
    return list(zip(starts[edge].tolist(), np.diff(np.append(edge, len(starts))).tolist()))


_SPAN = [("did", pa.int64()), ("th", pa.int64()), ("a", pa.int64()), ("n", pa.int64()), ("print", pa.binary())]


def _shards(width: int):
    """Pieces sorted by (key, part): shards of whole parts. ``print`` null: runs of repeats
    within the shard; else a window that is the first of its kind in a key's part."""
    def flush(rows: list) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r[2], r[3], r[4]))
        out = []
        for (_, parts, did, th, a, data), starts in zip(rows, shard_repeats([r[5] for r in rows], width)):
            out += [(did, th, a + x, n, None) for x, n in _runs_of(starts)]
            if parts > 1:
                out += [(did, th, a + x, 1, hashlib.blake2b(data[x:x + width], digest_size=16).digest())
                        for x in sorted(set(range(len(data) - width + 1)).difference(starts.tolist()))]
        return pa.RecordBatch.from_arrays(
            [pa.array([o[j] for o in out], t) for j, (_, t) in enumerate(_SPAN)], names=[n for n, _ in _SPAN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, one, size, at = [], [], 0, None      # closed parts, the open part
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "parts", "did", "th", "a", "bytes"))):
                if r[:2] != at:
                    if len(one) > 1 or one and one[0][1] > 1:      # a lone piece holds no repeat
                        rows += one
                        size += sum(len(x[5]) for x in one)
                    if size > SHARD_BYTES:
                        yield flush(rows)
                        rows, size = [], 0
                    one, at = [], r[:2]
                one.append((r[0], *r[2:]))
        if len(one) > 1 or one and one[0][1] > 1:
            rows += one
        if rows:
            yield flush(rows)
    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows sorted by (print, document, place): all but the first of each print."""
    last = None
    for batch in batches:
        prints = batch.column("print").to_pylist()
        again = np.array([p == q for p, q in zip(prints, [last, *prints])], bool)
        last = prints[-1] if prints else last
        yield batch.select(["did", "th", "a", "n"]).filter(pa.array(again))


def repeat_runs(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(did, th, a, n): runs of window starts that repeat an earlier window. ``docs``:
    did (whole number), th (digest of the text), text."""
    records = docs.mapInArrow(_records(width), _RECORD)
    kind = F.col("kind")
    road = F.when(kind == TOLD, F.xxhash64("did", "place")).when(kind == BY_CLASS, F.xxhash64("h", "c")).otherwise(F.col("h"))
    way = F.when(kind == MARKER, BY_HASH).otherwise(kind)
    told = stage(records.repartition(road).sortWithinPartitions(way, "h", F.desc("kind"), "c", "did", "th", "place")
                 .mapInArrow(_classes, "did long, th long, place long, repeat boolean"), "repeats-classes")
    whole = told.filter("repeat").select("did", "th", F.shiftright("place", 16).alias("a"),
                                         F.shiftright("place", 8).bitwiseAND(255).alias("n"))
    open_runs = told.filter(~F.col("repeat")).groupBy("did", "th").agg(F.collect_list("place").alias("runs"))
    pieces = stage(docs.join(open_runs, ["did", "th"]).dropDuplicates(["did", "th"])
                   .select("did", "th", "text", "runs")
                   .mapInArrow(_cut(width), "key long, did long, th long, a long, bytes binary"), "repeats-pieces")
    counts = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    large = counts.filter(F.col("n") > MAX_GROUP).select("key", F.ceil(F.col("n") / MAX_GROUP).alias("many"))
    parts = F.coalesce("many", F.lit(1))
    sharded = stage(pieces.join(large, "key", "left").select(
        "key", F.pmod(F.xxhash64("did", "th", "a"), parts).alias("part"), parts.alias("parts"), "did", "th", "a", "bytes")
        .repartition("key", "part").sortWithinPartitions("key", "part")
        .mapInArrow(_shards(width), "did long, th long, a long, n long, print binary"), "repeats-shards")
    within = sharded.filter(F.col("print").isNull()).drop("print")
    across = (sharded.filter(F.col("print").isNotNull()).repartition("print")
              .sortWithinPartitions("print", "did", "th", "a").mapInArrow(_merge, "did long, th long, a long, n long"))
    return whole.unionByName(within).unionByName(across)


def _strip(width: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, nth = batch.column("runs"), batch.column("nth")
            for lo, hi, data, offs in blocks(batch, "text"):
                size, gone, spans, digest, kept = [], [], [], [], []
                for i in range(hi - lo):
                    text = data[offs[i]:offs[i + 1]]
                    n = len(text)
                    cover = np.zeros(n + 1, np.int32)
                    if nth[lo + i].as_py() > 1:
                        if n >= width:
                            cover[0], cover[n] = 1, -1
                    else:
                        got = runs[lo + i].as_py() or []
                        a = np.array([r["a"] for r in got], np.int64)
                        e = np.array([r["a"] + r["n"] - 1 + width for r in got], np.int64)
                        np.add.at(cover, a, 1)
                        np.add.at(cover, e, -1)
                    removed = np.cumsum(cover[:n]) > 0
                    rest = text[~removed].tobytes()
                    size.append(n)
                    gone.append(int(removed.sum()))
                    spans.append(int((removed & ~np.append(False, removed[:-1])).sum()) if n else 0)
                    digest.append(hashlib.sha256(rest).hexdigest())
                    kept.append(rest)
                cols = [batch.column("doc_id").slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(gone, pa.int64()),
                        pa.array(spans, pa.int64()), pa.array(digest, pa.string())]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    cols.append(pa.array(kept, pa.binary()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``with_text``, ``kept``
    (the remaining bytes; they may cut a character) for every row of ``docs``."""
    if not 2 * GRAM + SIDE <= width <= GRAM + 254:
        # a record's place has 8 bits each for its windows (width - 23 at most) and anchor offset
        raise ValueError(f"width must be from {2 * GRAM + SIDE} to {GRAM + 254}")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("did"),
                       F.xxhash64("text").alias("th"), "text")
    runs = (repeat_runs(base.select("did", "th", "text"), width).groupBy("did", "th")
            .agg(F.collect_list(F.struct("a", "n")).alias("runs")))
    numbered = base.withColumn("nth", F.row_number().over(Window.partitionBy("did", "th").orderBy(F.lit(1))))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return (numbered.join(runs, ["did", "th"], "left").select("doc_id", "text", "nth", "runs")
            .mapInArrow(_strip(width, with_text), out + (", kept binary" if with_text else "")))
