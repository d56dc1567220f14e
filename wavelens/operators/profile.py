"""Profiling numbers behind the reference's charts.

Two passes, as a chart library does: pass 1 gets per-group statistics (min,
max, count, standard deviation); it is one row per group, so it is joined
back as a broadcast. Pass 2 bins, grids and ranks. Nothing collects a group:
exact quartiles and the cumulative distribution come from value counts
ranked with the distributed running sum of :mod:`wavelens.plans.scan`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelens.plans.scan import running
from wavelens.sources.materialize import staged

# Fixed values of the chart defaults being reproduced.
HIST_BINS = 30
HIST_KDE_GRID = 200
HIST_KDE_CUT = 0.0
KDE_BOX = 0.5                    # width of a box of values, in units of sqrt(2) x bandwidth
KDE_TERMS = 18                   # moments of a box
KDE_REACH = 6.5                  # units from a grid point to the farthest box it sums
VIOLIN_GRID = 100
VIOLIN_CUT = 2.0
CUT_BINS = 5
CUT_ADJUST = 0.001
WHISKER = 1.5
QUARTILES = (0.25, 0.5, 0.75)
SQRT_2PI = math.sqrt(2.0 * math.pi)


def _stats(df: DataFrame, col: str, group_cols: Sequence[str]) -> DataFrame:
    x = F.col(col)
    return (df.filter(x.isNotNull() & ~F.isnan(x)).groupBy(*group_cols)
            .agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"),
                 F.stddev_samp(x).alias("sd")))


def _lin_edge(k: Column, lo: Column, step: Column) -> Column:
    """Edge ``k`` as numpy's linspace computes it: k * step + start."""
    return k.cast("double") * step + lo


def _values(df: DataFrame, col: str, group_cols: Sequence[str]) -> DataFrame:
    x = F.col(col)
    return df.filter(x.isNotNull() & ~F.isnan(x)).select(*group_cols, x.cast("double").alias("x"))


def correlation(df: DataFrame, cols: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation matrix in long form ``(group..., x, y, r)``.
    The diagonal is 1 unless the column is constant (then NaN, as pandas)."""
    # r = cov / sqrt(var_a * var_b), with try_divide: Spark's ``corr`` raises
    # on a constant column under ANSI mode; pandas gives NaN there.
    # Every moment of a pair is taken over the rows that have both values.
    def present(c):
        x = F.col(c).cast("double")
        return F.when(~F.isnan(x), x)

    aggs = []
    for i, a in enumerate(cols):
        aggs.append(F.stddev_samp(present(a)).alias(f"_sd_{i}"))
        for j, b in enumerate(cols):
            if i < j:
                both = present(a).isNotNull() & present(b).isNotNull()
                x, y = F.when(both, present(a)), F.when(both, present(b))
                r = F.try_divide(F.covar_samp(x, y), F.sqrt(F.var_samp(x) * F.var_samp(y)))
                aggs.append(F.coalesce(r, F.lit(float("nan"))).alias(f"_r_{i}_{j}"))
    wide = df.groupBy(*group_cols).agg(*aggs)
    cells = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                r = F.when(F.col(f"_sd_{i}") > 0, F.lit(1.0)).otherwise(F.lit(float("nan")))
            else:
                r = F.col(f"_r_{min(i, j)}_{max(i, j)}")
            cells.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), r.alias("r")))
    return wide.select(*group_cols, F.explode(F.array(*cells)).alias("c")).select(*group_cols, "c.x", "c.y", "c.r")


def histogram(df: DataFrame, col: str, group_cols: Sequence[str] = ("split",), bins: int = HIST_BINS) -> DataFrame:
    """Equal-width histogram as numpy draws it: edges from linspace over
    [min, max] (widened by 0.5 when constant), bins closed on the left, the
    last also on the right. Every bin is listed, empty ones with 0."""
    st = _stats(df, col, group_cols).select(
        *group_cols,
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("e0"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("e_last"))
    st = st.withColumn("step", (F.col("e_last") - F.col("e0")) / F.lit(float(bins)))
    v = _values(df, col, group_cols).join(st, list(group_cols))
    edge = lambda k: F.when(k >= bins, F.col("e_last")).otherwise(_lin_edge(k, F.col("e0"), F.col("step")))
    b0 = F.least(F.greatest(F.floor((F.col("x") - F.col("e0")) / F.col("step")), F.lit(0)), F.lit(bins - 1)).cast("int")
    v = v.withColumn("_b0", b0)
    b1 = F.when(F.col("x") < edge(F.col("_b0")), F.col("_b0") - 1).otherwise(F.col("_b0"))
    v = v.withColumn("_b1", F.greatest(b1, F.lit(0)))
    b2 = F.when((F.col("_b1") < bins - 1) & (F.col("x") >= edge(F.col("_b1") + 1)), F.col("_b1") + 1).otherwise(F.col("_b1"))
    counts = v.groupBy(*group_cols, b2.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    all_bins = st.select(*group_cols, "e0", "e_last", "step", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = all_bins.join(counts, list(group_cols) + ["bin"], "left")
    return out.select(
        *group_cols, F.lit(col).alias("column"), "bin",
        edge(F.col("bin")).alias("bin_lo"), edge(F.col("bin") + 1).alias("bin_hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))


def _hermite_sum(moments: Column, u: Column) -> Column:
    """Sum of ``moments[n] * H_n(u) * exp(-u^2)`` with the Hermite polynomials H_n, by their
    recurrence H_(n+1) = 2 u H_n - 2 n H_(n-1)."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("before"), F.lit(1.0).alias("h"), F.lit(0.0).alias("n"))
    done = F.aggregate(moments, start, lambda s, m: F.struct(
        (s["sum"] + m * s["h"]).alias("sum"), s["h"].alias("before"),
        (2 * u * s["h"] - 2 * s["n"] * s["before"]).alias("h"), (s["n"] + 1).alias("n")), lambda s: s["sum"])
    return done * F.exp(-u * u)


def kde(df: DataFrame, col: str, group_cols: Sequence[str] = ("split",), grid: int = HIST_KDE_GRID,
        cut: float = HIST_KDE_CUT, bins: int | None = HIST_BINS) -> DataFrame:
    """Gaussian kernel density on a grid, bandwidth by Scott's
    rule (``sd * n^(-1/5)``), grid from ``min - cut*bw`` to ``max + cut*bw``.
    ``count_scaled`` is the curve a count histogram with ``bins`` bins draws
    (density x n x bin width).

    A fast Gauss transform: with ``unit = sqrt(2) bw`` the values fall into boxes half a unit
    wide, each of which keeps ``KDE_TERMS`` moments ``sum(t^n) / n!`` of the distances ``t`` to its
    centre in units (partial sums in the scan; one row for each box is shuffled). A
    grid point adds up the Hermite series of the boxes within ``KDE_REACH`` units, so the
    work is values x terms + grid x boxes in reach, and no value is ever repeated for the grid.
    Error: with |t| <= 1/4 the terms left out of one kernel sum to less than
    1.09 * (sqrt(2)/4)^18 / sqrt(18!) * 1.1 < 2e-16, and a box out of reach adds less than
    exp(-KDE_REACH^2) < 1e-18 of its rows, both of a kernel whose peak is 1; so the density
    is off by less than 3e-16 / (bw sqrt(2 pi)), besides rounding."""
    st = _stats(df, col, group_cols).filter(F.col("n") >= 2)
    st = st.withColumn("bw", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    st = st.filter(F.col("bw") > 0)
    st = (st.withColumn("g0", F.col("lo") - F.col("bw") * cut)
          .withColumn("g_last", F.col("hi") + F.col("bw") * cut)
          .withColumn("gstep", (F.col("g_last") - F.col("g0")) / F.lit(float(grid - 1)))
          .withColumn("unit", F.col("bw") * F.lit(math.sqrt(2.0))))
    keys = list(group_cols)
    gx = lambda i: F.when(i >= grid - 1, F.col("g_last")).otherwise(_lin_edge(i, F.col("g0"), F.col("gstep")))
    middle = F.col("g0") + (F.col("_box") + 0.5) * KDE_BOX * F.col("unit")
    v = _values(df, col, group_cols).join(st.select(*keys, "g0", "unit"), keys)
    v = v.withColumn("_box", F.floor((F.col("x") - F.col("g0")) / (F.col("unit") * KDE_BOX)))
    v = v.select(*keys, "_box", ((F.col("x") - middle) / F.col("unit")).alias("_t0"))
    # powers of t by repeated halving: t^n from the powers of half of n
    powers = {0: F.lit(1.0), 1: F.col("_t0")}
    for n in range(2, KDE_TERMS):
        v = v.withColumn(f"_t{n}", powers[n // 2] * powers[n - n // 2])
        powers[n] = F.col(f"_t{n}")
    boxes = v.groupBy(*keys, "_box").agg(F.array(*(
        F.sum(powers[n]) / F.lit(float(math.factorial(n))) for n in range(KDE_TERMS))).alias("_m"))
    near = boxes.join(st.select(*keys, "g0", "g_last", "gstep", "unit"), keys).withColumn("_mid", middle)
    reach = F.col("unit") * KDE_REACH
    first = F.greatest(F.ceil((F.col("_mid") - reach - F.col("g0")) / F.col("gstep")), F.lit(0))
    last = F.least(F.floor((F.col("_mid") + reach - F.col("g0")) / F.col("gstep")), F.lit(grid - 1))
    near = (near.withColumn("_first", first).withColumn("_last", last).filter(F.col("_first") <= F.col("_last"))
            .withColumn("gi", F.explode(F.sequence("_first", "_last"))))
    near = near.withColumn("_u", (gx(F.col("gi")) - F.col("_mid")) / F.col("unit"))
    sums = near.groupBy(*keys, F.col("gi").cast("int").alias("gi")).agg(
        F.sum(_hermite_sum(F.col("_m"), F.col("_u"))).alias("_k"))
    points = st.withColumn("gi", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    out = points.join(sums, [*keys, "gi"], "left")
    density = F.greatest(F.coalesce("_k", F.lit(0.0)), F.lit(0.0)) / (F.col("n") * F.col("bw") * F.lit(SQRT_2PI))
    cols = [*keys, F.lit(col).alias("column"), F.col("gi").alias("grid_index"),
            gx(F.col("gi")).alias("x"), density.alias("density")]
    if bins:
        cols.append((density * F.col("n") * (F.col("hi") - F.col("lo")) / F.lit(float(bins))).alias("count_scaled"))
    return out.select(*cols)


def value_ranks(df: DataFrame, col: str, group_cols: Sequence[str] = ("split",)) -> tuple[DataFrame, DataFrame]:
    """Value counts with their rank span: ``(group..., x, count, cum_before,
    cum)``; rows with rank r satisfy ``cum_before <= r < cum``. Also returns
    the row count per group (from the value counts, one row per group)."""
    vals = _values(df, col, group_cols)
    vc = vals.groupBy(*group_cols, "x").agg(F.count(F.lit(1)).alias("count"))
    vc = staged(vc, "value-counts")
    n = vc.groupBy(*group_cols).agg(F.sum("count").alias("n"))
    r = running(vc, list(group_cols), ["x"], {"cum": ("sum", "count")}, stored=True)
    return r.withColumn("cum_before", F.col("cum") - F.col("count")), n


def ecdf(df: DataFrame, col: str, group_cols: Sequence[str] = ("split",)) -> DataFrame:
    """Empirical CDF at each distinct value, ``cum / n``."""
    vr, n = value_ranks(df, col, group_cols)
    return (vr.join(n, list(group_cols))
            .select(*group_cols, "x", "count", "cum", (F.col("cum") / F.col("n")).alias("ecdf")))


def _lerp(a: Column, b: Column, t: Column) -> Column:
    """numpy's linear interpolation (exact at both ends)."""
    d = b - a
    return F.when(t >= 0.5, b - d * (F.lit(1.0) - t)).otherwise(a + d * t)


def quartiles(df: DataFrame, col: str, group_cols: Sequence[str] = ("split",),
              probs: Sequence[float] = QUARTILES) -> DataFrame:
    """Exact percentiles with linear interpolation (numpy's default), one
    row per group: ``q25, q50, q75`` (named by percent) and ``n``."""
    vr, n = value_ranks(df, col, group_cols)
    targets = n.select(*group_cols, "n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
    targets = (targets.withColumn("h", (F.col("n") - 1).cast("double") * F.col("p"))
               .withColumn("r_lo", F.floor("h").cast("long"))
               .withColumn("r_hi", F.least(F.col("r_lo") + 1, F.col("n") - 1))
               .withColumn("t", F.col("h") - F.col("r_lo")))
    tl = targets.select(*group_cols, "p", "t", F.explode(F.array(
        F.struct(F.lit("lo").alias("side"), F.col("r_lo").alias("r")),
        F.struct(F.lit("hi").alias("side"), F.col("r_hi").alias("r")))).alias("s"))
    tl = tl.select(*[F.col(c).alias(f"_t_{c}") for c in group_cols], "p", "t", "s.side", "s.r")
    hit = vr.join(tl, [F.col(c) == F.col(f"_t_{c}") for c in group_cols]
                  + [F.col("cum_before") <= F.col("r"), F.col("r") < F.col("cum")])
    pick = hit.groupBy(*group_cols, "p", "t").agg(
        F.max(F.when(F.col("side") == "lo", F.col("x"))).alias("v_lo"),
        F.max(F.when(F.col("side") == "hi", F.col("x"))).alias("v_hi"))
    q = pick.select(*group_cols, "p", _lerp(F.col("v_lo"), F.col("v_hi"), F.col("t")).alias("q"))
    wide = q.groupBy(*group_cols).pivot("p", [float(p) for p in probs]).agg(F.first("q"))
    wide = wide.select(*group_cols, *[F.col(f"`{float(p)}`").alias(f"q{int(round(p * 100)):02d}") for p in probs])
    return wide.join(n, list(group_cols))


def approx_quartiles(df: DataFrame, col: str, group_cols: Sequence[str] = ("split",),
                     accuracy: int = 10000) -> DataFrame:
    """Large-data option: ``percentile_approx`` (bounded-memory sketch,
    merged map-side); rank error about 1/accuracy of the group size."""
    return (_values(df, col, group_cols).groupBy(*group_cols)
            .agg(F.percentile_approx("x", [0.25, 0.5, 0.75], accuracy).alias("_q"), F.count(F.lit(1)).alias("n"))
            .select(*group_cols, F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("q50"),
                    F.col("_q")[2].alias("q75"), "n"))


def box_stats(df: DataFrame, col: str, group_cols: Sequence[str] = ("split",), approx: bool = False) -> DataFrame:
    """Quartiles, whisker ends (most extreme values within 1.5 IQR
    of the box) and the number of points beyond them. ``approx`` uses
    :func:`approx_quartiles` instead of the exact ranked quartiles."""
    q = approx_quartiles(df, col, group_cols) if approx else quartiles(df, col, group_cols)
    iqr = F.col("q75") - F.col("q25")
    q = q.withColumn("lim_lo", F.col("q25") - WHISKER * iqr).withColumn("lim_hi", F.col("q75") + WHISKER * iqr)
    v = _values(df, col, group_cols).join(q.select(*group_cols, "lim_lo", "lim_hi"), list(group_cols))
    w = v.groupBy(*group_cols).agg(
        F.min(F.when(F.col("x") >= F.col("lim_lo"), F.col("x"))).alias("whisker_lo"),
        F.max(F.when(F.col("x") <= F.col("lim_hi"), F.col("x"))).alias("whisker_hi"),
        F.count_if((F.col("x") < F.col("lim_lo")) | (F.col("x") > F.col("lim_hi"))).alias("n_outliers"))
    return q.drop("lim_lo", "lim_hi").join(w, list(group_cols)).withColumn("column", F.lit(col))


def cut_edges(df: DataFrame, col: str, group_cols: Sequence[str] = ("split",), bins: int = CUT_BINS) -> DataFrame:
    """D12 edges as pandas ``cut(x, bins)`` makes them: linspace over
    [min, max], first edge lowered by 0.1 % of the range (or, for a
    constant column, both ends moved by 0.1 %)."""
    st = _stats(df, col, group_cols)
    same = F.col("lo") == F.col("hi")
    nudge_lo = F.when(F.col("lo") != 0, F.abs(F.col("lo")) * CUT_ADJUST).otherwise(F.lit(CUT_ADJUST))
    nudge_hi = F.when(F.col("hi") != 0, F.abs(F.col("hi")) * CUT_ADJUST).otherwise(F.lit(CUT_ADJUST))
    st = (st.withColumn("s0", F.when(same, F.col("lo") - nudge_lo).otherwise(F.col("lo")))
          .withColumn("s_last", F.when(same, F.col("hi") + nudge_hi).otherwise(F.col("hi")))
          .withColumn("cstep", (F.col("s_last") - F.col("s0")) / F.lit(float(bins)))
          .withColumn("adj", F.when(same, F.lit(0.0)).otherwise((F.col("hi") - F.col("lo")) * CUT_ADJUST)))
    return st.select(*group_cols, "s0", "s_last", "cstep", "adj")


def cut_categories(df: DataFrame, col: str, group_cols: Sequence[str] = ("split",), bins: int = CUT_BINS,
                   out: str = "category") -> DataFrame:
    """Adds ``category`` (0..bins-1, right-closed intervals; the minimum
    falls in 0; NULL stays NULL) and its bounds ``category_lo/hi``."""
    ed = cut_edges(df, col, group_cols, bins)
    j = df.join(ed, list(group_cols), "left")
    x = F.col(col).cast("double")
    edge = lambda k: F.when(k >= bins, F.col("s_last")).otherwise(_lin_edge(k, F.col("s0"), F.col("cstep")))
    code = sum((F.when(x > edge(F.lit(k)), 1).otherwise(0) for k in range(1, bins)), F.lit(0))
    code = F.when(x.isNull() | F.isnan(x), F.lit(None)).otherwise(code)
    j = j.withColumn(out, code.cast("int"))
    lo = F.when(F.col(out) == 0, edge(F.lit(0)) - F.col("adj")).otherwise(edge(F.col(out)))
    return (j.withColumn(f"{out}_lo", F.when(F.col(out).isNotNull(), lo))
            .withColumn(f"{out}_hi", F.when(F.col(out).isNotNull(), edge(F.col(out) + 1)))
            .drop("s0", "s_last", "cstep", "adj"))


def category_counts(cat: DataFrame, group_cols: Sequence[str] = ("split",), out: str = "category",
                    bins: int = CUT_BINS) -> DataFrame:
    """Rows per category, empty categories listed with 0."""
    counts = cat.filter(F.col(out).isNotNull()).groupBy(*group_cols, out).agg(F.count(F.lit(1)).alias("count"))
    groups = cat.select(*group_cols).distinct()
    allc = groups.select(*group_cols, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias(out))
    return (allc.join(counts, list(group_cols) + [out], "left")
            .select(*group_cols, out, F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def scatter_points(df: DataFrame, x: str, y: str, id_cols: Sequence[str] = ("utt_id", "split"),
                   fraction: float | None = None, seed: int = 42) -> DataFrame:
    """The points of a scatter plot; ``fraction`` draws a seeded sample."""
    out = df.select(*id_cols, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return out.sample(fraction=fraction, seed=seed) if fraction else out


def pair_points(df: DataFrame, cols: Sequence[str], id_cols: Sequence[str] = ("utt_id", "split")) -> DataFrame:
    """D18 (off-diagonal): every ordered pair of distinct columns, long form
    ``(id..., x_name, y_name, x, y)``; the diagonal is :func:`histogram`."""
    cells = [F.struct(F.lit(a).alias("x_name"), F.lit(b).alias("y_name"), F.col(a).cast("double").alias("x"),
                      F.col(b).cast("double").alias("y")) for a in cols for b in cols if a != b]
    return df.select(*id_cols, F.explode(F.array(*cells)).alias("c")).select(*id_cols, "c.*")


def profile_frame(utts: DataFrame) -> DataFrame:
    """The numeric view the charts use: recorded duration and length, plus
    the word count (a second variable that is not a function of length)."""
    from wavelens.functions.text import words
    return utts.select("utt_id", "split", "audio_duration", "transcription_length",
                       F.size(words("transcription")).cast("long").alias("n_words"))
