"""Quantiles, fits, draws, densities, similarity and ordination against brute force."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from costweave.operators.curve import asymptotic_fit, asymptotic_predict
from costweave.operators.density import box_summary, histogram, kernel_density, rule_bandwidth
from costweave.operators.ordination import principal_axes
from costweave.operators.quantiles import approximate_median, exact_medians, exact_quantiles
from costweave.operators.regress import linear_fit
from costweave.operators.sampling import (
    bootstrap_sums,
    bootstrap_sums_poisson,
    median_interval,
    poisson_weight_bounds,
    resample_truncated,
    subsample_curve,
)
from costweave.operators.similarity import jaccard_distances, restrict_columns, shared_counts

PROBS = [0.0, 0.25, 0.5, 0.75, 1.0]


def check_quantiles(spark, groups, accuracy=100000):
    rows = [(g, None if v is None else float(v)) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in exact_quantiles(df, "v", PROBS, ["g"], accuracy).collect()}
    for g, values in groups.items():
        kept = [v for v in values if v is not None and not math.isnan(v)]
        if not kept:
            assert g not in got
            continue
        assert got[g].n == len(kept)
        want = np.quantile(np.array(kept), PROBS)
        assert [got[g][f"q{i}"] for i in range(5)] == pytest.approx(list(want), rel=1e-12, abs=1e-12)


def test_quantiles_by_group(spark):
    rng = np.random.default_rng(5)
    check_quantiles(
        spark,
        {
            "normal": list(rng.normal(0, 1e6, 1001)),
            "ties": [3.0] * 500 + [1.0] * 20 + [9.0] * 31,
            "one": [4.0],
            "two": [1.0, 2.0],
            "seven": [float(i) for i in range(7)],
            "gaps": [None, 2.0, None, 5.0, float("nan")],
            "none": [None, None],
            "zeros": [0.0, -0.0, 0.0],
            "narrow": [1.7e9 + i * 1e-6 for i in range(300)],
            "wide": [10.0**i for i in range(-200, 200)],
        },
    )


@pytest.mark.parametrize("accuracy", [20, 100, 1000])
def test_quantiles_with_a_coarse_sketch(spark, accuracy):
    rng = np.random.default_rng(accuracy)
    check_quantiles(spark, {"a": list(rng.exponential(3, 3000)), "b": list(rng.integers(0, 9, 2000).astype(float))}, accuracy)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e9, 1e9), min_size=1, max_size=30))
def test_quantiles_of_any_list(spark, values):
    check_quantiles(spark, {"x": values})


def test_global_and_several_medians(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 5.0), (4.0, 7.0)], "a double, b double")
    assert exact_quantiles(df, "a", [0.5]).first().q0 == 2.0
    assert tuple(exact_medians(df, ["a", "b"]).first()) == (2.0, 6.0)
    assert approximate_median(df, "a").first()["median"] == 2.0
    assert tuple(exact_medians(df.where("false"), ["a"]).first()) == (None,)


def test_fit_recovers_a_curve(spark):
    a, r0, lrc = 5e8, 1.2e9, -0.7
    points = [("g", float(x), a + (r0 - a) * math.exp(-math.exp(lrc) * x)) for x in range(1, 9)]
    points += [("h", float(x), 10 - 4 * math.exp(-math.exp(0.3) * x)) for x in range(1, 9)] + [("flat", 1.0, 2.0)]
    df = spark.createDataFrame(points, "g string, x double, y double")
    got = {r.g: r for r in asymptotic_fit(df, ["g"], "x", "y").collect()}
    assert set(got) == {"g", "h"}
    assert got["g"].lrc == pytest.approx(lrc, abs=1e-9)
    assert got["g"].asym == pytest.approx(a, rel=1e-6) and got["g"].r0 == pytest.approx(r0, rel=1e-6)
    assert got["g"].r2 == pytest.approx(1, abs=1e-9) and got["h"].lrc == pytest.approx(0.3, abs=1e-9)
    y = np.array([p[2] for p in points[:8]])
    mixed = ((np.log10(y) - y.mean()) ** 2).sum()
    assert got["g"].r2_mixed == pytest.approx(1 - got["g"].rss / mixed, abs=1e-6)
    whole = asymptotic_fit(df.where("g = 'h'"), [], "x", "y")
    assert whole.first().r0 == pytest.approx(6.0, rel=1e-6)
    line = asymptotic_predict(whole, [], 1, 2, 10).collect()
    assert len(line) == 11 and line[0].predicted == pytest.approx(10 - 4 * math.exp(-math.exp(0.3)), rel=1e-6)


def test_line(spark):
    df = spark.createDataFrame([(float(x), 3.0 - 2.0 * x) for x in range(5)] + [(None, 1.0)], "x double, y double")
    row = linear_fit(df, [], "x", "y").first()
    assert (row.n, row.slope, row.intercept, row.r2) == (5, pytest.approx(-2), pytest.approx(3), pytest.approx(1))
    assert row.equation == "y = 3.00 + -2.00 x"


def sample(spark, n=300):
    return spark.range(n).select(F.col("id").alias("k"), ((F.col("id") * 37) % 101).cast("double").alias("v"))


def test_draws_do_not_depend_on_partitions(spark):
    df = sample(spark)
    for make in (
        lambda d: bootstrap_sums(d, "k", "v", 20, 1).orderBy("replicate"),
        lambda d: bootstrap_sums_poisson(d, "k", "v", 20, 1).orderBy("replicate"),
        lambda d: subsample_curve(d, "k", "v", 1).orderBy("size"),
        lambda d: resample_truncated(d, "k", "v", d, "k", 1, 0.0, 100.0).orderBy("k"),
    ):
        assert make(df.repartition(1)).collect() == make(df.repartition(8)).collect()


def test_bootstrap_centres_on_the_total(spark):
    df = sample(spark)
    total = df.agg(F.sum("v")).first()[0]
    drawn = np.array([r.total for r in bootstrap_sums(df, "k", "v", 200, 2).collect()])
    assert len(drawn) == 200 and abs(drawn.mean() - total) < 4 * drawn.std() / math.sqrt(200)
    weighted = bootstrap_sums_poisson(df, "k", "v", 200, 2).collect()
    totals = np.array([r.total for r in weighted])
    assert abs(totals.mean() - total) < 4 * totals.std() / math.sqrt(200)
    assert abs(np.mean([r.draws for r in weighted]) - 300) < 6
    assert poisson_weight_bounds()[-1][0] == pytest.approx(1, abs=1e-8)


def test_subsamples_are_nested(spark):
    rows = subsample_curve(sample(spark), "k", "v", 4).orderBy("size").collect()
    assert [r.size for r in rows] == list(range(1, 301))
    steps = np.diff([0.0] + [r.total for r in rows])
    assert sorted(steps.round(6)) == sorted((i * 37) % 101 for i in range(300))
    assert rows[-1].mean == pytest.approx(rows[-1].total / 300)


def test_truncated_draws_stay_inside(spark):
    edge = spark.createDataFrame([(0, 0.0), (1, 100.0)], "k long, v double")
    draws = spark.range(4000).withColumnRenamed("id", "d")
    x = np.array([r.x for r in resample_truncated(edge, "k", "v", draws, "d", 9, 0.0, 100.0).collect()])
    assert len(x) == 4000 and x.min() >= 0 and x.max() <= 100
    low = x[x < 50]
    assert low.mean() == pytest.approx(math.sqrt(2 / math.pi), abs=0.05)


@pytest.mark.parametrize("low, high", [(9, 10), (8, 9), (5, 6), (-10, -9), (-6, -5), (-1, 3), (30, 31), (-40, 60), (200, 201)])
def test_truncated_tails(low, high, spark):
    """No mass on a bound, and the mean of the density between them, in either tail."""
    from costweave.operators.sampling import truncated_normal

    n = 20_000
    df = truncated_normal(spark.range(n).selectExpr("id AS d", "0D AS m"), "m", "d", 3, float(low), float(high))
    x = np.array([r.x for r in df.collect()])
    assert ((x > low) & (x < high)).all() and len(np.unique(x)) > n * 0.999
    grid = np.linspace(max(low, -8), min(high, 8), 400_001) if low < 0 < high else np.linspace(low, high, 400_001)
    weight = np.exp(-(grid**2 - grid[np.abs(grid).argmin()] ** 2) / 2)
    mean = (grid * weight).sum() / weight.sum()
    spread = math.sqrt(max(((grid - mean) ** 2 * weight).sum() / weight.sum(), 1e-12))
    assert abs(x.mean() - mean) < 4 * spread / math.sqrt(n) + 1e-5
    # the uniforms themselves, put through the exact inverse on the grid: within 1e-3 of every draw's own place
    cumulative = np.cumsum(weight) / weight.sum()
    assert abs(np.interp(np.sort(x), grid, cumulative) - (np.arange(n) + 0.5) / n).max() < 0.02


def test_binomial_splits_are_multinomial(spark, monkeypatch):
    """All draws arrive, shares follow the rows, whole or in chunks, and the sums are those of uniform picks."""
    from costweave.operators import multinomial

    n, replicates = 1000, 200
    for at_once in (1 << 22, 120):
        monkeypatch.setattr(multinomial, "DRAWS_AT_ONCE", at_once)
        rows = multinomial.leaf_counts(spark, n, replicates, 5, leaf=64).collect()
        counts = np.zeros((replicates, 16))
        for replicate, lo, draws in rows:
            counts[replicate - 1, lo // 64] += draws
        assert (counts.sum(axis=1) == n).all()
        share = np.array([64.0] * 15 + [1000 - 960]) / n
        want = n * share
        deviation = (counts.mean(axis=0) - want) / np.sqrt(want * (1 - share) / replicates)
        assert np.abs(deviation).max() < 4
        covariance = np.cov(counts.T)
        assert np.abs(np.diag(covariance) / (want * (1 - share)) - 1).max() < 0.5
        assert covariance[np.triu_indices(16, 1)].mean() == pytest.approx(-(n * share[0] ** 2), rel=0.3)
    monkeypatch.undo()
    monkeypatch.setattr(multinomial, "BROADCAST_BYTES", 0)
    values = spark.range(10_000).selectExpr("id AS k", "double(id % 7) AS v")
    totals = np.array([r["total"] for r in multinomial.bootstrap_sums(values, "k", "v", 300, 2).collect()])
    v = np.arange(10_000) % 7
    assert abs(totals.mean() - v.sum()) < 4 * math.sqrt(10_000 * v.var() / 300)
    assert 0.8 < totals.std() / math.sqrt(10_000 * v.var()) < 1.2
    assert all(float(t).is_integer() for t in totals)
    none = spark.createDataFrame([], "k long, v double")
    assert {r["total"] for r in multinomial.bootstrap_sums(none, "k", "v", 3, 2).collect()} == {0.0}


def test_median_interval(spark):
    df = sample(spark)
    v = np.array([(i * 37) % 101 for i in range(300)], dtype=float)
    row = median_interval(df, "v", 2.0).first()
    assert row["median"] == np.median(v)
    assert row.upper - row["median"] == pytest.approx(2 * v.std(ddof=1) / math.sqrt(300))


def test_density(spark):
    v = np.array([(i * 37) % 101 for i in range(300)], dtype=float)
    df = sample(spark)
    got = {r.x: r.density for r in kernel_density(df, "v", (-60, 160, 2), 11.0).collect()}
    assert sum(got.values()) * 0.5 == pytest.approx(1, abs=1e-3)
    want = np.exp(-((20.5 - v) ** 2) / 242).sum() / (300 * 11 * math.sqrt(2 * math.pi))
    assert got[20.5] == pytest.approx(want)
    h = 0.9 * min(v.std(ddof=1), (np.quantile(v, 0.75) - np.quantile(v, 0.25)) / 1.34) * 300**-0.2
    assert rule_bandwidth(df, "v").first()[0] == pytest.approx(h)
    by = df.withColumn("g", F.col("k") % 2)
    assert kernel_density(by, "v", (0, 10, 1), None, ["g"]).count() == 22


def test_histogram_and_box(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 100, 2, 3]] + [("a", None)], "g string, v double")
    cells = histogram(df, "v", 0.0, 2.0, ["g"]).collect()
    assert sum(r.density * 2 for r in cells) == pytest.approx(1) and sum(r.n for r in cells) == 7
    box = box_summary(df, "v", ["g"]).first()
    assert (box.q1, box.whisker_low, box.whisker_high, box.outside) == (3.0, 1.0, 4.0, 1)


def presence(n, m, seed=1):
    rng = np.random.default_rng(seed)
    return (rng.random((n, m)) < 0.15 + 0.5 * (np.arange(n)[:, None] % 4 == np.arange(m)[None, :] % 4)).astype(float)


def test_two_sets(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 3)] + [("b", x) for x in (2, 3, 4, 5)] * 2, "r string, c int")
    row = jaccard_distances(df, "r", "c").first()
    assert (row.row_i, row.row_j, row.shared, row.distance) == ("a", "b", 2, pytest.approx(0.6))


def test_disjoint_and_single_rows(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("c", None)], "r string, c int")
    assert jaccard_distances(df, "r", "c").count() == 0
    assert [tuple(r) for r in jaccard_distances(df, "r", "c", disjoint=True).collect()] == [("a", "b", 0, 1.0)]


@pytest.mark.parametrize("row_block,column_block", [(256, 4096), (7, 11)])
def test_jaccard_blocks(spark, row_block, column_block):
    m = presence(30, 40)
    df = spark.createDataFrame([(int(i), int(c)) for i, c in zip(*np.nonzero(m))], "r long, c long")
    got = jaccard_distances(df, "r", "c", disjoint=True, row_block=row_block, column_block=column_block).collect()
    shared, size = m @ m.T, m.sum(1)
    assert len(got) == 435
    for r in got:
        n = shared[r.row_i, r.row_j]
        assert r.row_i < r.row_j and r.shared == n
        assert r.distance == pytest.approx(1 - n / (size[r.row_i] + size[r.row_j] - n))


def test_hot_column_returns_pairs_once(spark):
    rows = [(i, 0) for i in range(60)] + [(i, 1 + i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "r long, c long")
    counts = shared_counts(df, "r", "c", row_block=16).collect()
    assert len(counts) == 60 * 59 // 2 and {r.shared for r in counts} == {1, 2}


def test_restricted_columns(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "r string, c int")
    listed = spark.createDataFrame([(2,), (2,)], "m int")
    assert [tuple(r) for r in restrict_columns(df, "c", listed, "m").collect()] == [("a", 2)]


def scaled(d, axes=2):
    n = len(d)
    j = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * j @ (d**2) @ j)
    order = np.argsort(values)[::-1][:axes]
    x = vectors[:, order] * np.sqrt(values[order])
    for a in range(axes):
        x[:, a] *= np.sign(x[np.argmax(np.abs(x[:, a])), a])
    return values[order], x


@pytest.mark.parametrize("row_block", [256, 13])
def test_axes_equal_eigenvectors(spark, row_block):
    m = presence(36, 50, 2)
    shared, size = m @ m.T, m.sum(1)
    d = 1 - shared / (size[:, None] + size[None] - shared)
    pairs = [(f"n{i:02d}", f"n{k:02d}", float(d[i, k])) for i in range(36) for k in range(i + 1, 36)]
    df = spark.createDataFrame(pairs, "row_i string, row_j string, distance double")
    rows = principal_axes(df, row_block=row_block).orderBy("row").collect()
    values, x = scaled(d)
    assert [rows[0].eigenvalue1, rows[0].eigenvalue2] == pytest.approx(list(values), rel=1e-8)
    assert np.abs(np.array([[r.axis1, r.axis2] for r in rows]) - x).max() < 1e-6


def test_axes_of_unlisted_pairs(spark):
    """Pairs that are not listed have distance 1."""
    d = np.ones((5, 5)) - np.eye(5)
    listed = [(0, 1, 0.2), (2, 3, 0.1), (3, 4, 0.3), (0, 2, 0.9)]
    for i, k, v in listed:
        d[i, k] = d[k, i] = v
    rows = principal_axes(spark.createDataFrame(listed, "row_i int, row_j int, distance double")).orderBy("row").collect()
    values, x = scaled(d)
    assert rows[0].eigenvalue1 == pytest.approx(values[0])
    assert np.abs(np.array([[r.axis1, r.axis2] for r in rows]) - x).max() < 1e-6


def test_axes_keep_isolated_rows(spark):
    d = np.ones((6, 6)) - np.eye(6)
    listed = [(0, 1, 0.2), (1, 2, 0.4), (0, 2, 0.9)]
    for i, k, v in listed:
        d[i, k] = d[k, i] = v
    pairs = spark.createDataFrame(listed, "row_i int, row_j int, distance double")
    every = spark.range(6).selectExpr("cast(id as int) as name")
    rows = principal_axes(pairs, entities=every).orderBy("row").collect()
    values, x = scaled(d)
    assert [r.row for r in rows] == list(range(6))
    assert rows[0].eigenvalue1 == pytest.approx(values[0])
    assert np.abs(np.array([r.axis1 for r in rows]) - x[:, 0]).max() < 1e-6


def test_fit_has_no_walls_and_does_not_cancel(spark):
    def curve(a, b, lrc, scale=1.0):
        return [(i * scale, a + b * math.exp(-math.exp(lrc) * i * scale)) for i in range(1, 31)]

    known = {"steep": (10.0, 5.0, 2.0, 0.05), "slow": (10.0, 5.0, -5.0, 4.0), "high": (1e12, 1e4, -0.5, 0.25)}
    points = [(g, x, y) for g, (a, b, lrc, scale) in known.items() for x, y in curve(a, b, lrc, scale)]
    points += [("line", float(x), 3.0 * x) for x in range(20)]
    df = spark.createDataFrame(points, "g string, x double, y double")
    got = {r.g: r for r in asymptotic_fit(df, ["g"], "x", "y").collect()}
    for g, (a, b, lrc, _) in known.items():
        assert got[g].lrc == pytest.approx(lrc, abs=1e-3) and got[g].rss >= 0
        assert got[g].asym == pytest.approx(a, rel=1e-3)
    assert got["line"].lrc is None and got["line"].n == 20


def test_narrow_bounds_have_no_mass_on_them(spark):
    edge = spark.createDataFrame([(0, 50.0)], "k long, v double")
    draws = spark.range(4000).withColumnRenamed("id", "d")
    x = np.array([r.x for r in resample_truncated(edge, "k", "v", draws, "d", 9, 49.9, 50.1).collect()])
    assert x.min() > 49.9 and x.max() < 50.1 and abs(x.mean() - 50) < 0.01


def test_density_of_constant_and_single_groups(spark):
    from costweave.operators.density import density_curve

    df = spark.createDataFrame([("a", 2.0)] * 5 + [("b", 0.0)] * 4 + [("c", 7.0)], "g string, v double")
    widths = {r.g: r.bandwidth for r in rule_bandwidth(df, "v", ["g"]).collect()}
    assert widths["a"] == pytest.approx(1.8 * 5**-0.2) and widths["b"] == pytest.approx(0.9 * 4**-0.2)
    assert widths["c"] is None
    curve = density_curve(df, "v", 64, ["g"])
    areas = {}
    for row in curve.collect():
        areas.setdefault(row.g, []).append((row.x, row.density))
    assert set(areas) == {"a", "b"}
    for points in areas.values():
        x, y = np.array(sorted(points)).T
        assert np.trapezoid(y, x) == pytest.approx(1, abs=0.01)


def test_rounding_leaves_large_values(spark):
    from costweave.functions.scalars import half_up

    df = spark.createDataFrame([(1e19,), (3e18,), (2.345,), (-0.05,)], "v double")
    got = [r[0] for r in df.select(half_up(F.col("v"), 1)).collect()]
    assert got == [1e19, 3e18, 2.3, 0.0]
