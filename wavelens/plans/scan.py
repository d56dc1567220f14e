"""Running aggregates over ordered groups without one task per group.

A window ``partitionBy(g).orderBy(o)`` puts every row of a group into one
task; with one group holding a third of the data that task is the job. Here
the input is stored once, dealt by ranges of (g, o) with Spark's own range
partitioner, and stored again with the number of its partition, the chunk. Chunk
numbers are read from the stored table, so every branch of the plan and every
retried task sees the same chunks; no key passes through the driver and none is
part of the plan. The number of chunks follows the rows; a hot group spans many
chunks.

Each (chunk, group) has its totals; a prefix scan of the totals over a group's
chunks gives what the chunks before it carry in. The carry enters the chunk as one
row before all others, and one ordinary window over (chunk, group) does the rest:
the rows and the carries meet in one shuffle, nothing is broadcast or joined.

Supported ops (inclusive of the current row unless noted):
``sum``, ``min``, ``max``, ``count`` (rows so far), ``lag`` (previous row's
value in the group, exclusive), ``index`` (0-based position in the group),
and ``sum_excl``, ``min_excl``, ``max_excl`` over the rows before the
current one (NULL for a group's first row).

Pass order columns that are unique within a group; ties are ordered
arbitrarily.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelens.sources.materialize import staged

CHUNK = "_scan_chunk"   # number of a row's chunk
_REAL = "_scan_real"    # false for a carry, which comes before the chunk's rows
_ALL = ("sum", "min", "max", "count", "lag", "index", "sum_excl", "min_excl", "max_excl")
CHUNK_ROWS = 1_000_000  # rows of a chunk


def _out_type(op: str, in_type: T.DataType) -> T.DataType:
    op = op.replace("_excl", "")
    if op in ("count", "index"):
        return T.LongType()
    if op == "sum":
        return T.LongType() if isinstance(in_type, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)) \
            else T.DoubleType()
    return in_type


def chunked(df: DataFrame, keys: Sequence[str], n: int | None = None, stored: bool = False) -> DataFrame:
    """``df`` in a stored table with its chunk numbers, chunks being ranges of ``keys`` in
    ascending order (``n`` of them; default one for each ``CHUNK_ROWS`` rows). ``df`` is
    read once; say ``stored`` if it is a stored table already."""
    src = df if stored else staged(df, "scan-input")
    n = n or max(1, -(-src.count() // CHUNK_ROWS))       # a stored table's count reads its footers
    if n == 1:
        return src.withColumn(CHUNK, F.lit(0))
    return staged(src.repartitionByRange(n, *keys).withColumn(CHUNK, F.spark_partition_id()), "scan-chunks")


def running(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
            aggs: dict[str, tuple[str, str | None]], n_partitions: int | None = None,
            stored: bool = False, keep_chunk: bool = False) -> DataFrame:
    """Add running aggregate columns ``aggs = {out: (op, column)}`` per group
    of ``group_cols`` in the order of ``order_cols``. A ``df`` with chunk numbers (of
    :func:`chunked`, or of a scan with ``keep_chunk`` over the same keys, stored) is taken
    as it is. ``stored``: see :func:`chunked`."""
    group_cols, order_cols = list(group_cols), list(order_cols)
    for out, (op, _) in aggs.items():
        if op not in _ALL:
            raise ValueError(f"unknown op {op} for {out}")
    src = df if CHUNK in df.columns else chunked(df, group_cols + order_cols, n_partitions, stored)
    types = {f.name: f.dataType for f in src.schema}
    cols = [c for c in src.columns if c != CHUNK]
    groups = [F.col(c) for c in group_cols]
    value = {o: f"_scan_v{i}" for i, o in enumerate(aggs)}          # what each window runs over

    # 1. totals of every chunk of a group, and from them what earlier chunks carry in
    fold = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.sum, "index": F.sum}
    base = {o: op.replace("_excl", "") for o, (op, _) in aggs.items()}
    operand = {o: (F.lit(1).cast("long") if base[o] in ("count", "index") else
                   F.col(c).cast(_out_type(op, types[c]))) for o, (op, c) in aggs.items()}
    place = F.struct(*[F.col(c) for c in order_cols])
    totals = src.groupBy(CHUNK, *groups).agg(*(
        (F.max_by(operand[o], place) if base[o] == "lag" else fold[base[o]](operand[o])).alias(value[o]) for o in aggs))
    by_chunk = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(CHUNK)
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(CHUNK, *groups, F.lag(F.lit(True)).over(by_chunk).alias("_scan_later"), *(
        (F.lag(value[o]).over(by_chunk) if base[o] == "lag" else fold[base[o]](value[o]).over(before)).alias(value[o])
        for o in aggs)).filter("_scan_later").drop("_scan_later")

    # 2. rows and carries together, one window for each chunk of a group
    rows = src.select("*", F.lit(True).alias(_REAL), *(operand[o].alias(value[o]) for o in aggs))
    both = rows.unionByName(carries.withColumn(_REAL, F.lit(False)), allowMissingColumns=True)
    order = Window.partitionBy(CHUNK, *groups).orderBy(_REAL, *order_cols)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    outs = []
    for o, (op, _) in aggs.items():
        v = F.col(value[o])
        got = F.lag(v).over(order) if op == "lag" else fold[base[o]](v).over(past if op.endswith("_excl") else upto)
        if op == "sum":
            got = F.coalesce(got, F.lit(0))
        outs.append((got - 1 if op == "index" else got).alias(f"{value[o]}_out"))
    done = both.select("*", *outs).filter(F.col(_REAL))
    return done.select(*cols, *([CHUNK] if keep_chunk else []), *(F.col(f"{value[o]}_out").alias(o) for o in aggs))


def dense_index(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                out: str = "idx", n_partitions: int | None = None, stored: bool = False) -> DataFrame:
    """0-based row position within each group (a distributed ``row_number - 1``)."""
    return running(df, group_cols, order_cols, {out: ("index", None)}, n_partitions, stored)
