import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wavelens.operators import profile as pf

SF = "/root/testdata/sf0.01"


def _docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select(
        F.lit("all").alias("split"), "doc_id", (F.col("n_chars") / 1000.0).alias("d"), "n_chars")


def test_histogram_equals_numpy(spark):
    df = _docs(spark)
    x = np.array([r.d for r in df.collect()])
    counts, edges = np.histogram(x, bins=np.histogram_bin_edges(x, bins=30))
    got = sorted((r.bin, r["count"], r.bin_lo) for r in pf.histogram(df, "d", ["split"]).collect())
    assert [c for _, c, _ in got] == counts.tolist()
    assert np.allclose([lo for _, _, lo in got], edges[:-1], rtol=0, atol=0)


def test_quartiles_and_box_equal_numpy(spark):
    df = _docs(spark)
    x = np.array([r.n_chars for r in df.collect()], dtype=float)
    b = pf.box_stats(df, "n_chars", ["split"]).first()
    q1, q2, q3 = np.percentile(x, [25, 50, 75])
    assert (b.q25, b.q50, b.q75) == (q1, q2, q3)
    iqr = q3 - q1
    assert b.whisker_hi == x[x <= q3 + 1.5 * iqr].max()
    assert b.n_outliers == int(((x < q1 - 1.5 * iqr) | (x > q3 + 1.5 * iqr)).sum())


def test_cut_equals_pandas(spark):
    df = _docs(spark)
    pdf = pd.DataFrame([(r.doc_id, r.d) for r in df.collect()], columns=["doc_id", "d"])
    codes = pd.cut(pdf["d"], bins=5).cat.codes
    expect = dict(zip(pdf["doc_id"], codes))
    got = {r.doc_id: r.category for r in pf.cut_categories(df, "d", ["split"]).collect()}
    assert got == expect


def test_constant_column(spark):
    df = spark.createDataFrame([("s", 2.0)] * 5, "split string, x double")
    h = pf.histogram(df, "x", ["split"]).collect()
    assert sum(r["count"] for r in h) == 5
    c = pf.cut_categories(df, "x", ["split"]).collect()
    assert {r.category for r in c} == {int(pd.cut(pd.Series([2.0] * 5), bins=5).cat.codes[0])}
    corr = {(r.x, r.y): r.r for r in pf.correlation(df.withColumn("y", F.col("x")), ["x", "y"], ["split"]).collect()}
    assert np.isnan(corr[("x", "x")])


def test_ecdf_and_counts(spark):
    df = spark.createDataFrame([("s", v) for v in [1.0, 2.0, 2.0, 3.0]], "split string, x double")
    e = {r.x: r.ecdf for r in pf.ecdf(df, "x", ["split"]).collect()}
    assert e == {1.0: 0.25, 2.0: 0.75, 3.0: 1.0}
    cat = pf.cut_categories(df, "x", ["split"])
    counts = {r.category: r["count"] for r in pf.category_counts(cat).collect()}
    assert len(counts) == 5 and sum(counts.values()) == 4


def test_kde_matches_formula(spark):
    vals = [1.0, 2.0, 2.5, 4.0, 7.0]
    df = spark.createDataFrame([("s", v) for v in vals], "split string, x double")
    k = sorted((r.grid_index, r.x, r.density) for r in pf.kde(df, "x", ["split"], grid=11).collect())
    x = np.array(vals)
    bw = x.std(ddof=1) * len(x) ** -0.2
    g = np.linspace(x.min(), x.max(), 11)
    dens = np.exp(-0.5 * ((g[:, None] - x[None, :]) / bw) ** 2).sum(1) / (len(x) * bw * np.sqrt(2 * np.pi))
    assert np.allclose([d for _, _, d in k], dens, rtol=1e-12)


def test_approx_box_close_to_exact(spark):
    df = _docs(spark)
    exact = pf.box_stats(df, "n_chars", ["split"]).first()
    approx = pf.box_stats(df, "n_chars", ["split"], approx=True).first()
    assert abs(approx.q50 - exact.q50) <= 0.02 * exact.q75


def test_correlation_uses_pairs_that_are_complete(spark):
    from wavelens.operators import profile as pf
    rows = [(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (100.0, None), (float("nan"), 7.0)]
    got = {(r.x, r.y): r.r for r in pf.correlation(spark.createDataFrame(rows, "a double, b double"), ["a", "b"]).collect()}
    assert abs(got[("a", "b")] - 0.5) < 1e-12


def test_kde_by_boxes_equals_the_direct_sum(spark):
    """Clusters, gaps, repeated values and outliers; the whole grid within the stated error."""
    import numpy as np

    from wavelens.operators import profile as pf
    rng = np.random.default_rng(6)
    groups = {"a": rng.normal(0, 1, 800), "b": np.concatenate([rng.normal(0, .01, 300), rng.normal(50, 3, 50), [400.0]]),
              "c": np.repeat([1.0, 2.0, 5.0], 40), "d": rng.exponential(2, 500)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), ("a", float("nan")), ("e", 3.0), ("e", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for grid, cut in ((200, 0.0), (100, 2.0)):
        got = pf.kde(df, "v", ["g"], grid=grid, cut=cut).collect()
        for g, x in groups.items():
            bw = x.std(ddof=1) * len(x) ** -0.2
            at = np.linspace(x.min() - cut * bw, x.max() + cut * bw, grid)
            want = np.exp(-0.5 * ((at[:, None] - x) / bw) ** 2).sum(1) / (len(x) * bw * np.sqrt(2 * np.pi))
            mine = {r.grid_index: r for r in got if r.g == g}
            assert sorted(mine) == list(range(grid))
            assert np.allclose([mine[i].x for i in range(grid)], at, rtol=1e-12, atol=1e-12)
            assert np.abs(np.array([mine[i].density for i in range(grid)]) - want).max() < 1e-13 / bw
        assert not any(r.g == "e" for r in got)
