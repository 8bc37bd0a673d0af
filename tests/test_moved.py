"""Tables whose years, nation keys and months lie elsewhere: the queries and SQL that names no year, nation or day."""

import pytest
from oracle import TABLES, compare, connect
from pyspark.sql import functions as F

from costweave.plans import ORACLES, QUERIES

MOVED = """cost_by_time_kind cost_by_time cost_by_entity cost_by_development cost_union_rollup baseline_clamp_bins
    alternative_course_cost merge_first_bucket upregulated_long upregulated_cost regulon_rollup prefix_integral
    mean_spacing enrich_fill quality_by_cost cost_by_stage mean_positive_long presence_frequency conserved_presence
    presence_cost_fit increment_cost phase_totals presence_course_cost interval_deltas asymptotic_fit tagged_union""".split()


@pytest.fixture(scope="module")
def moved_dir(spark, sf_dir, tmp_path_factory):
    out = tmp_path_factory.mktemp("moved")
    years = F.when(F.col("l_orderkey") % 3 == 0, 11).otherwise(5)
    month = F.when(F.col("event_id") % 2 == 0, 31).otherwise(3)
    changes = {
        "lineitem": {"l_shipdate": (F.add_months("l_shipdate", years * 12)).cast("timestamp_ntz")},
        "nation": {"n_nationkey": F.col("n_nationkey") + 60},
        "supplier": {"s_nationkey": F.col("s_nationkey") + 60},
        "events": {"ts": F.col("ts") + F.make_dt_interval(month)},
    }
    for name in TABLES:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        df.withColumns(changes.get(name, {})).coalesce(1).write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.mark.parametrize("name", MOVED)
def test_same_rows(name, spark, moved_dir):
    assert compare(QUERIES[name](spark, str(moved_dir)), connect(moved_dir, "/*.parquet"), ORACLES[name]) == ""


def test_a_key_without_label_fails(spark):
    from costweave.operators.reshape import widen

    df = spark.createDataFrame([("a", 1, 2.0), ("a", 3, 1.0)], "e string, k int, v double")
    with pytest.raises(Exception, match="no label lists the key 3"):
        widen(df, "e", F.col("k"), F.col("v"), {"t1": 1}).collect()
