"""The registered queries on tables with hot keys, and on empty ones, against their SQL."""

import pytest
from oracle import TABLES, compare, connect
from pyspark.sql import functions as F

from costweave.plans import ORACLES, QUERIES

HOT = """cost_by_time_kind cost_by_stage first_appearance prefix_integral interval_deltas phase_totals presence_frequency
    conserved_presence regex_join resolve_synonyms null_safe_join group_median_window median_fill trait_budget median_ci
    box_summary kde_rule histogram_density dedupe_text bootstrap_sum subsample_curve truncnorm_resample asymptotic_fit
    jaccard_distance""".split()


def hot(column, value, key):
    """A third of the rows get one value."""
    return F.when(F.pmod(F.xxhash64(key), F.lit(3)) == 0, F.lit(value)).otherwise(F.col(column))


@pytest.fixture(scope="module")
def hot_dir(spark, sf_dir, tmp_path_factory):
    out = tmp_path_factory.mktemp("hot")
    changes = {
        "lineitem": {
            "l_partkey": hot("l_partkey", 7, "l_extendedprice").cast("long"),
            "l_suppkey": hot("l_suppkey", 3, "l_quantity").cast("long"),
        },
        "events": {
            "user_id": hot("user_id", 2, "event_id").cast("long"),
            "event_type": hot("event_type", "view", "ts"),
            "value": hot("value", 12.5, "props"),
        },
        "documents": {"text": hot("text", "one text for many", "doc_id")},
        "part": {"p_brand": hot("p_brand", "Brand#7", "p_partkey"), "p_name": hot("p_name", "hot ring", "p_partkey")},
    }
    for name in TABLES:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        df.withColumns(changes.get(name, {})).coalesce(1).write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.fixture(scope="module")
def empty_dir(spark, sf_dir, tmp_path_factory):
    out = tmp_path_factory.mktemp("empty")
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").where("false").coalesce(1).write.parquet(f"{out}/{name}.parquet")
    return out


def folders(connection_dir):
    return connect(connection_dir, "/*.parquet")


@pytest.mark.parametrize("name", HOT)
def test_hot_keys(name, spark, hot_dir):
    assert compare(QUERIES[name](spark, str(hot_dir)), folders(hot_dir), ORACLES[name]) == ""


# nothing sums to 0 here, where SQL says NULL or gives no row
ZERO = {"cost_breakdown", "cost_kind_share", "dormant_cost"}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - ZERO))
def test_empty_tables(name, spark, empty_dir):
    assert compare(QUERIES[name](spark, str(empty_dir)), folders(empty_dir), ORACLES[name]) == ""


def test_nothing_costs_nothing(spark, empty_dir):
    rows = {name: QUERIES[name](spark, str(empty_dir)).collect() for name in ZERO}
    assert tuple(rows["dormant_cost"][0]) == (0.0, 0.0, 0.0)
    split = {r.process: r.cost for r in rows["cost_breakdown"]}
    assert split["replication_partial"] == split["transcription"] == split["translation"] == 0.0
    assert split["replication_rest"] == 417266190.0
    assert len(rows["cost_kind_share"]) == 2
