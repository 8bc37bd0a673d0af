"""Selection in rounds, measured attach and the density by expansion, with hot groups and values."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from costweave.operators import attach as attaching
from costweave.operators.attach import attach, attach_salted
from costweave.operators.density import density_curve, density_error_bound, kernel_density
from costweave.operators.fill import attach_group_size, fill_median
from costweave.operators.quantiles import exact_quantiles
from costweave.plans import QUERIES

PROBS = [0.0, 0.1, 0.5, 0.75, 1.0]


@pytest.fixture(scope="module")
def uneven(spark):
    """A group with most rows, one of a single value, one of two, one without a name, gaps and NaN."""
    rng = np.random.default_rng(5)
    rows = [("hot", float(v)) for v in rng.lognormal(0, 2, 4000)] + [("hot", 1.25)] * 1500
    rows += [("one", 3.0)] * 40 + [("two", 1.0), ("two", 2.0), (None, -5.0), (None, 9.0), (None, 9.5)]
    rows += [("hot", None), ("gap", None), ("hot", float("nan")), ("far", 1e300), ("far", -1e-300), ("far", 0.0)]
    return spark.createDataFrame(rows, "g string, v double").repartition(7), rows


def expected(rows):
    groups = {}
    for g, v in rows:
        if v is not None and not math.isnan(v):
            groups.setdefault(g, []).append(v)
    return groups


@pytest.mark.parametrize("accuracy, most", [(100000, 1_000_000), (50, 1_000_000), (20, 40), (20, 2)])
def test_quantiles_in_rounds(uneven, accuracy, most):
    df, rows = uneven
    got = {r.g: r for r in exact_quantiles(df, "v", PROBS, ["g"], accuracy, most).collect()}
    groups = expected(rows)
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g].n == len(values)
        for i, p in enumerate(PROBS):
            assert got[g][f"q{i}"] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_quantiles_in_rounds_without_groups(uneven):
    df, rows = uneven
    values = [v for held in expected(rows).values() for v in held]
    got = exact_quantiles(df, "v", [0.5, 0.9], (), 20, 10).first()
    assert got.n == len(values) and got.q0 == np.median(values)
    assert got.q1 == pytest.approx(np.quantile(values, 0.9), rel=1e-12)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert exact_quantiles(empty, "v", [0.5], ["g"]).count() == 0
    assert exact_quantiles(empty, "v", [0.5]).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_attach_gives_the_same_rows_in_both_forms(uneven, spark, how):
    df, _ = uneven
    wide = df.withColumn("m", F.create_map(F.lit("k"), F.col("v")))
    small = spark.createDataFrame([("hot", 1, [1.0]), ("two", 2, None), (None, 3, [])], "g string, k int, a array<double>")
    forms = [attach(wide, small, ["g"], how), attach(wide, small, ["g"], how, most=0), attach_salted(wide, small, ["g"], how)]
    rows = [sorted(map(str, f.select("g", "v", "m", "k", "a").collect())) for f in forms]
    assert rows[0] == rows[1] == rows[2]


def test_hot_key_is_dealt_out(spark):
    df = spark.range(20000).select(F.lit("hot").alias("g"), "id")
    small = spark.createDataFrame([("hot", 1), ("other", 2)], "g string, k int")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        joined = attach_salted(df, small, ["g"])
        tasks = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(r["count"] for r in tasks) == 20000 and max(r["count"] for r in tasks) < 8000


def test_fillers_and_sizes_do_not_depend_on_the_form(uneven, monkeypatch):
    df, _ = uneven

    def both():
        filled = fill_median(df, ["v"], ["g"], mode="replace").select("g", "v_filled")
        return [sorted(map(str, d.collect())) for d in (filled, attach_group_size(df, ["g"]))]

    broadcast = both()
    monkeypatch.setattr(attaching.attach, "__defaults__", ("inner", None, 0))
    assert both() == broadcast


SELECTIONS = ["median_ci", "box_summary", "kde_rule", "kde_grid", "group_median_window", "group_size_norm", "trait_budget"]


@pytest.mark.parametrize("name", SELECTIONS)
def test_raw_rows_are_not_keyed_by_the_group(name, spark, sf_dir):
    """Whatever is shuffled by the group alone has been aggregated before, also without automatic broadcasts."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    lines = text.splitlines()
    for line, below in zip(lines, lines[1:]):
        keyed = re.search(r"Exchange hashpartitioning\((?:coalesce\()?(event_type|p_type|success)#\d+(?:, )?(\d+|)", line)
        if keyed and (keyed[2] or "coalesce" in line):
            assert "Aggregate" in below or "ExistingRDD" in below, line + below


def bell_sum(values, x, h):
    z = (x - np.asarray(values)[:, None]) / h
    return np.exp(-z * z / 2).sum(axis=0) / (len(values) * h * math.sqrt(2 * math.pi))


def test_expansion_is_within_its_bound(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(0, 1, 3000), rng.normal(40, 0.01, 500), [1e4, -1e4, 5.0, 5.0]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert density_error_bound() < 1e-15
    for h in (0.05, 1.0, 30.0):
        got = kernel_density(df, "v", (-20, 60, 4), h).orderBy("x").collect()
        x = np.array([r.x for r in got])
        wanted = bell_sum(values, x, h)
        peak = 1.0 / (h * math.sqrt(2 * math.pi))
        # places far from the first one lose digits to rounding
        assert len(x) == 321 and np.abs(np.array([r.density for r in got]) - wanted).max() < 1e-11 * peak


def test_curve_by_group(uneven):
    df, rows = uneven
    held = df.where("g IN ('hot', 'one', 'two') OR g IS NULL")
    curve = density_curve(held, "v", 64, ["g"]).collect()
    groups = {g: v for g, v in expected(rows).items() if g != "far"}
    for g, values in groups.items():
        part = sorted((r for r in curve if r.g == g), key=lambda r: r.point)
        assert len(part) == 64
        n, sd = len(values), np.std(values, ddof=1)
        iqr = (np.quantile(values, 0.75) - np.quantile(values, 0.25)) / 1.34
        narrow = min(sd, iqr) or sd or max(map(abs, values))
        h = 0.9 * narrow * n**-0.2
        x = np.linspace(min(values) - 3 * h, max(values) + 3 * h, 64)
        assert np.allclose([r.x for r in part], x)
        assert np.abs(np.array([r.density for r in part]) - bell_sum(values, x, h)).max() < 1e-10 / h
