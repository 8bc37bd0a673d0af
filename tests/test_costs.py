"""Formulas against values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from costweave.operators import costs as c
from costweave.operators.fill import attach_group_size, fill_attributes, fill_median
from costweave.operators.rollup import (
    append_rows,
    band_costs,
    kind_share,
    loose_sum,
    process_breakdown,
    rollup_costs,
    selection_long,
    share_of_total,
    strict_mean,
    strict_sum,
)
from costweave.params import DEFAULT, EARLY, LEGACY_GERMINATION, SUCCESS_BANDS
from costweave.functions.scalars import band


def one(spark, **columns):
    row = spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()
    return row.asDict()


def test_formulas(spark):
    got = one(
        spark,
        rep_o=c.replication_opportunity(F.lit(765.0)),
        rep_d=c.replication_direct(F.lit(765.0)),
        tra_o=c.transcription_opportunity(F.lit(18.0), F.lit(765.0)),
        tra_d=c.transcription_direct(F.lit(18.0), F.lit(765.0)),
        tla_o=c.translation_opportunity(F.lit(18.0), F.lit(5723.0)),
        tla_d=c.translation_direct(F.lit(18.0), F.lit(1351.0)),
        quarter=c.transcription_direct(F.lit(100.0), F.lit(300.0), 0.25),
    )
    want = dict(rep_o=53550, rep_d=21420, tra_o=7574.5734, tra_d=8307.5966, tla_o=182792.6772, tla_d=43150.9535)
    for name, value in want.items():
        assert got[name] == pytest.approx(value, abs=1e-3)
    assert got["quarter"] == pytest.approx(8517.336, abs=1e-3)


def test_variants(spark):
    got = one(
        spark,
        early=c.transcription_opportunity(F.lit(18.0), F.lit(765.0), EARLY),
        legacy=c.transcription_opportunity(F.lit(18.0), F.lit(765.0), LEGACY_GERMINATION),
        length=c.translation_by_length(F.lit(18.0), F.lit(254.0), "opportunity"),
    )
    assert got["early"] == pytest.approx(757.45734, abs=1e-4)
    assert got["legacy"] == pytest.approx(7574.5734 / 765, abs=1e-4)
    assert got["length"] == pytest.approx(18 * 1.774445 * 254 * 24, abs=1e-4)


def test_constants():
    assert c.genome_costs() == {"opportunity": 295036700.0, "direct": 122229490.0}
    assert c.genome_costs(unwinding=False)["direct"] == 118014680.0
    septum = c.septum_constants()
    assert septum["opportunity"] == pytest.approx(1302006.1538, abs=1e-3)
    assert septum["direct"] == pytest.approx(110547.6923, abs=1e-3)
    assert c.membrane_constants()["opportunity"] / 212 == pytest.approx(48197019.19, abs=0.01)


def test_membrane_columns_equal_constants(spark):
    lipids = c.lipid_molecules(F.lit(2500.0), F.lit(1000.0))
    got = one(spark, rod=c.lipid_cost(lipids, "direct"), septum=c.lipid_cost(c.septum_lipids(F.lit(1000.0)), "direct"))
    assert got["rod"] == pytest.approx(c.membrane_constants()["direct"])
    assert got["septum"] == pytest.approx(c.septum_constants()["direct"])
    sphere = one(spark, s=c.sphere_lipids(F.lit(870.0), discount=1.0))["s"]
    assert sphere == pytest.approx(18946599, rel=1e-6)


SEQUENCES = [("MKV", 80, 21), ("WWAC", 145, 30), ("MXB", 27, 11), ("", 0, 0), ("wWé", 114, 18), ("ßſı", 0, 0)]


@pytest.mark.parametrize("price", [c.price_sequences, c.price_texts])
def test_sequences(spark, price):
    df = spark.createDataFrame([(i, s[0]) for i, s in enumerate(SEQUENCES)] + [(99, None)], "i int, s string")
    got = {r.i: (r.seq_opportunity, r.seq_direct) for r in price(df, "s").collect()}
    assert [got[i] for i in range(len(SEQUENCES))] == [(float(o), float(d)) for _, o, d in SEQUENCES]
    assert got[99] == (None, None)


def test_both_pricings_agree(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    a = c.price_sequences(texts, "text").select("doc_id", "seq_opportunity", "seq_direct")
    b = c.price_texts(texts, "text").select("doc_id", "seq_opportunity", "seq_direct")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_fill(spark):
    df = spark.createDataFrame([(1, None, None), (2, 3.0, 4.0)], "id int, abundance double, gene_length double")
    rows = {r.id: r for r in fill_attributes(df, DEFAULT).collect()}
    assert (rows[1].abundance_filled, rows[1].gene_length_filled) == (18.0, 765.0)
    assert (rows[2].abundance_filled, rows[2].gene_length_filled) == (3.0, 4.0)


def test_fill_median_modes(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 3.0), ("a", None), ("b", 10.0), (None, 7.0), (None, None)], "g string, v double"
    )
    whole = {(r.g, r.v): r.v_filled for r in fill_median(df, ["v"]).collect()}
    assert whole[("a", None)] == 5.0 and whole[("b", 10.0)] == 10.0
    grouped = {(r.g, r.v): r.v_filled for r in fill_median(df, ["v"], ["g"]).collect()}
    assert grouped[("a", None)] == 2.0 and grouped[(None, None)] == 7.0
    replaced = {(r.g, r.v): r.v_filled for r in fill_median(df, ["v"], ["g"], mode="replace").collect()}
    assert replaced[("a", 1.0)] == 2.0 and replaced[("b", 10.0)] == 10.0
    with pytest.raises(ValueError):
        fill_median(df, ["v"], mode="other")


def test_group_size_keeps_missing_group(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "g string")
    assert sorted(r.group_size for r in attach_group_size(df, ["g"]).collect()) == [1, 2, 2]


def test_sums(spark):
    df = spark.createDataFrame([("n", None), ("m", 1.0), ("m", None), ("k", 2.0)], "g string, v double")
    got = {r.g: (r.a, r.b, r.c) for r in df.groupBy("g").agg(
        loose_sum("v").alias("a"), strict_sum("v").alias("b"), strict_mean("v").alias("c")
    ).collect()}
    assert got == {"n": (0.0, None, None), "m": (1.0, None, None), "k": (2.0, 2.0, 2.0)}


def filled(spark):
    rows = [(1, "x", True, 10.0, 100.0, 50.0, 20.0), (1, "x", False, 10.0, 100.0, 50.0, 20.0), (2, "y", True, 5.0, 200.0, 70.0, 30.0)]
    names = "e int, g string, first boolean, abundance_filled double, gene_length_filled double,"
    return spark.createDataFrame(rows, names + " seq_opportunity_filled double, seq_direct_filled double")


def test_once_counts_first_rows_only(spark):
    costed = c.with_costs(filled(spark), once="first")
    sums = {(r.e, r.process, r.kind): r.cost for r in rollup_costs(costed, ["e"]).collect()}
    assert sums[(1, "replication", "opportunity")] == 7000.0
    mrna = 10.0 / 100 * 1774445 / 1e6
    assert sums[(1, "transcription", "direct")] == pytest.approx(2 * mrna * 100 * 34)
    assert sums[(1, "transcription", "opportunity")] == pytest.approx(mrna * 100 * 31)


def test_rollups_add_up(spark):
    costed = c.with_costs(filled(spark))
    full = sum(r.cost for r in rollup_costs(costed, ["g"]).collect())
    for by in ((), ("kind",), ("process",)):
        assert sum(r.cost for r in rollup_costs(costed, ["g"], by).collect()) == pytest.approx(full)
    parts = process_breakdown(costed, 1e6, 500.0).collect()
    assert sum(r.share for r in parts) == pytest.approx(100)
    kinds = kind_share(costed, {"opportunity": 1.0, "direct": 2.0}).collect()
    assert sum(r.share for r in kinds) == pytest.approx(100)
    assert sum(r.cost for r in kinds) == pytest.approx(full + 3)


def test_bands(spark):
    scores = [0.2, 0.31, 0.4, 0.46, 0.5, 0.83, 0.9, None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "i int, s double")
    got = [r.b for r in df.select("i", band(F.col("s"), SUCCESS_BANDS).alias("b")).orderBy("i").collect()]
    assert got == ["essential", None, "50% failure", None, "10% failure", None, "90% success", None]


def test_band_costs_leave_out(spark):
    costed = c.with_costs(filled(spark))
    rows = band_costs(costed, "g", ["y"]).collect()
    assert {r.g for r in rows} == {"x"} and sum(r.ratio for r in rows) == pytest.approx(100)


def test_selection(spark):
    row = selection_long(c.with_costs(filled(spark)), ["e"], 2.6e10, 0.69).where(
        "e = 2 and process = 'replication' and kind = 'direct'"
    ).first()
    assert row.sc == pytest.approx(5600 / 2.6e10 * 0.69)
    assert row.ne == pytest.approx(-math.log10(row.sc))


def test_share_and_rows(spark):
    df = spark.createDataFrame([("a", 1.0)], "k string, v double")
    both = append_rows(df, [("b", 3.0)])
    assert {r.k: r.share for r in share_of_total(both, "v").collect()} == {"a": 25.0, "b": 75.0}
    empty = share_of_total(df.where("false"), "v")
    assert empty.count() == 0
