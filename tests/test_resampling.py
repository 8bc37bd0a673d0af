"""Draws whose number is free of the table."""

from collections import Counter

import numpy as np
import pytest

from costweave.operators import multinomial
from costweave.operators.multinomial import drawn_values
from costweave.operators.sampling import resample_truncated_many


def values(spark, n):
    return spark.range(n).selectExpr("id AS k", "CAST(id AS DOUBLE) AS v")


@pytest.mark.parametrize("n, draws", [(3, 5000), (5000, 20000), (9000, 50)])
def test_as_many_draws_as_asked_for(spark, n, draws):
    drawn = drawn_values(values(spark, n), "k", "v", draws, 5).collect()
    assert len(drawn) == draws and len({(d.leaf, d.draw) for d in drawn}) == draws
    picked = np.array([d.value for d in drawn])
    assert abs(picked.mean() - (n - 1) / 2) < 5 * n / np.sqrt(12 * draws)
    if draws > n:
        counts = np.bincount(picked.astype(int), minlength=n)
        spread = ((counts - draws / n) ** 2).sum() / (draws / n)
        assert abs(spread - (n - 1)) < 6 * np.sqrt(2 * n)


def test_draws_do_not_depend_on_how_they_are_dealt_out(spark, monkeypatch):
    def run():
        return Counter(map(tuple, drawn_values(values(spark, 5000), "k", "v", 3000, 2).collect()))

    before = run()
    monkeypatch.setattr(multinomial, "PICKS_AT_ONCE", 7)
    assert run() == before
    monkeypatch.setattr(multinomial, "BROADCAST_BYTES", 0)
    assert run() == before


def test_shares_of_many_draws_are_added_up_in_rows(spark, monkeypatch):
    monkeypatch.setattr(multinomial, "DRAWS_AT_ONCE", 1000)
    counts = multinomial.leaf_counts(spark, 20_000, 1, 3, draws=50_000).collect()
    assert sum(c.draws for c in counts) == 50_000 and len(counts) == 5
    for c in counts:
        mean = 50_000 * min(4096, 20_000 - c.lo) / 20_000
        assert abs(c.draws - mean) < 5 * np.sqrt(mean)


def test_nothing_to_draw_from(spark):
    none = spark.createDataFrame([], "k long, v double")
    assert drawn_values(none, "k", "v", 10, 1).collect() == []
    assert drawn_values(values(spark, 3), "k", "v", 0, 1).collect() == []
    gaps = spark.createDataFrame([(1, None), (2, None)], "k long, v double")
    assert resample_truncated_many(gaps, "k", "v", 10, 1, 0.0, 1.0).collect() == []
    with pytest.raises(ValueError):
        drawn_values(values(spark, 3), "k", "v", -1, 1)


def test_blurred_draws_stay_inside(spark):
    held = spark.createDataFrame([(1, 0.0), (2, 50.0), (3, 100.0), (4, None)], "k long, v double")
    drawn = resample_truncated_many(held, "k", "v", 6000, 4, 0.0, 100.0)
    x = np.array([d.x for d in drawn.collect()])
    assert x.size == 6000 and x.min() > 0 and x.max() < 100
    near = x[np.abs(x - 50) < 10]
    assert abs(near.size - 2000) < 200 and abs(near.std() - 1.0) < 0.08
    assert abs(x[x < 10].mean() - np.sqrt(2 / np.pi)) < 0.08


def test_merged_sketches_keep_their_rank_error(spark):
    from costweave.operators.sketches import merged_sketches, quantile_sketches, rank_error, sketched_quantiles

    rng = np.random.default_rng(3)
    groups = np.where(rng.random(60_000) < 0.6, 0, rng.integers(1, 40, 60_000))
    held = rng.lognormal(0, 2, 60_000)
    rows = [(int(g), int(g) % 3, float(v)) for g, v in zip(groups, held)] + [(99, 0, None), (98, 1, float("nan"))]
    fine = quantile_sketches(spark.createDataFrame(rows, "g long, s long, v double"), "v", ["g", "s"])
    probs = [0.05, 0.25, 0.5, 0.75, 0.95]
    for by in (["g", "s"], ["s"], []):
        level = fine if by == ["g", "s"] else merged_sketches(fine, by)
        found = sketched_quantiles(level, probs).collect()
        assert sum(r.n for r in found) == 60_000
        for r in found:
            mine = np.ones(60_000, bool)
            for c in by:
                mine &= (groups if c == "g" else groups % 3) == r[c]
            values = held[mine]
            for i, p in enumerate(probs):
                assert abs((values <= r[f"q{i}"]).mean() - p) < 3 * rank_error() + 1 / values.size
    none = spark.createDataFrame([], "g long, v double")
    assert quantile_sketches(none, "v").collect() == [] == merged_sketches(quantile_sketches(none, "v", ["g"])).collect()


def test_a_date_far_off_is_no_thousand_columns(spark, tmp_path):
    from costweave.plans.frames import SCHEMAS, year_span

    def save(name, dates):
        text = ", ".join(f"(TIMESTAMP_NTZ '{d}')" for d in dates)
        rows = spark.sql(f"SELECT * FROM VALUES {text} AS t(l_shipdate)")
        rows.write.parquet(str(tmp_path / name / "lineitem.parquet"))
        return str(tmp_path / name)

    assert "l_shipdate timestamp_ntz" in SCHEMAS["lineitem"]
    assert year_span(spark, save("near", ["1992-05-01 00:00:00", "1998-01-01 00:00:00"])) == (1992, 1998)
    with pytest.raises(ValueError, match="columns of years"):
        year_span(spark, save("far", ["1992-05-01 00:00:00", "9998-01-01 00:00:00"]))
