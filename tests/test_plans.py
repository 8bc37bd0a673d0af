"""What the physical plans must and must not hold."""

import re

import pytest

from costweave.plans import QUERIES

PYTHON = {"sequence_cost", "jaccard_distance", "jaccard_subset", "pcoa_axes", "ordination_costs"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark, sf_dir):
    return {name: plan(q(spark, sf_dir)) for name, q in QUERIES.items() if name not in ("pcoa_axes", "ordination_costs")}


def test_no_cross_joins(plans):
    for name, text in plans.items():
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text, name


def test_python_only_where_declared(plans):
    for name, text in plans.items():
        found = re.search(r"EvalPython|InPandas|MapInArrow|InArrow", text)
        assert bool(found) == (name in PYTHON), name


def test_windows_have_keys(plans):
    """Windows without keys only ever see segment totals."""
    for name, text in plans.items():
        for line in text.splitlines():
            if re.search(r"Window \[", line) and re.search(r"windowspecdefinition\((1|[a-z_]*__seg)", line):
                assert name in {"truncnorm_resample", "bootstrap_sum", "subsample_curve"}, name


def test_scans_read_only_what_is_used(plans):
    text = plans["cost_by_time_kind"]
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in text
    assert "ReadSchema: struct<event_type:string,value:double>" in plans["kde_grid"]


def test_course_is_shuffled_once(spark, sf_dir):
    from costweave.plans.frames import quantity_course

    text = plan(quantity_course(spark, sf_dir))
    assert text.count("Exchange") == 1 and "Window" not in text and "Sort" not in text


def test_every_name_of_the_catalogue_is_registered():
    names = """cost_by_time_kind tagged_union coerce_numeric patch_rows cost_union_rollup baseline_clamp_bins
        interval_deltas first_appearance upregulated_long regulon_rollup complete_cases prefix_integral
        band_classify_costs enrich_fill quality_by_cost full_outer_annotate conserved_presence regex_join
        resolve_synonyms full_outer_fill_zero null_safe_join cost_by_time cost_by_stage cost_by_entity strict_sum
        mean_positive_long median_fill median_ci cost_breakdown cost_kind_share presence_frequency sequence_cost
        trait_budget dedupe_text group_size_norm group_median_window merge_first_bucket replication_cost
        transcription_cost translation_cost translation_cost_length membrane_cost dormant_cost presence_course_cost
        phase_totals selection_coefficient ordination_costs pcoa_axes asymptotic_fit asymptotic_predict
        linear_fit_by_group truncnorm_resample bootstrap_sum subsample_curve kde_grid histogram_density box_summary
        jaccard_distance jaccard_subset scalar_suite""".split()
    assert set(names) <= set(QUERIES)


def test_flagship_without_broadcast_shuffles_three_times(spark, sf_dir):
    """Lines by entity, attributes by entity, sums by hour; the join adds no further shuffle of the course."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES["cost_by_time_kind"](spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert text.count("Exchange hashpartitioning") == 3 and "SortMergeJoin" in text


def test_checkpoints_go_where_the_session_says(spark, tmp_path):
    from costweave.session import cut_lineage

    df = cut_lineage(spark.range(5).withColumnRenamed("id", "k"))
    assert df.count() == 5 and "Range" not in plan(df)
    assert spark.sparkContext.getCheckpointDir()


def test_regex_join_is_no_product_without_broadcast(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES["regex_join"](spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_years_are_pushed_down_as_dates(spark, sf_dir):
    assert "GreaterThanOrEqual(l_shipdate" in plan(QUERIES["full_outer_fill_zero"](spark, sf_dir))
