"""Reshaping, first appearance, joins and name resolution on hand-made rows."""

import re

import pytest
from pyspark.sql import functions as F

from costweave.operators.ordered import dense_index, mean_spacing, prefix, rank_slice, trapezoid
from costweave.operators.reshape import (
    column_steps,
    columns_at,
    columns_between,
    columns_except,
    columns_with_prefix,
    first_positive,
    fold_bucket,
    series_steps,
    subtract_baseline,
    sum_bins,
    tagged_union,
    to_long,
    widen,
)
from costweave.operators.resolve import (
    first_appearance,
    left_attach,
    lowest_per_text,
    mark_first,
    null_safe_join,
    outer_fill_zero,
    regex_join,
    required_literals,
    resolve_synonyms,
)


def test_column_choices(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "id int, t1 int, t2 int, x int")
    assert columns_with_prefix(df, "t") == ["t1", "t2"]
    assert columns_between(df, "t1", "x") == ["t1", "t2", "x"]
    assert columns_except(df, "id", "x") == ["t1", "t2"]
    assert columns_at(df, 2, 3) == ["t1", "t2"]


def test_rank_slice(spark):
    df = spark.createDataFrame([("e", i) for i in range(1, 6)] + [("f", 9)], "e string, t int")
    assert sorted(tuple(r) for r in rank_slice(df, ["e"], ["t"], 2, 3).collect()) == [("e", 2), ("e", 3)]


def test_wide_and_long(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 3.0), ("b", 2, 4.0)], "e string, k int, v double")
    wide = widen(df, "e", F.col("k"), F.col("v"), {"t1": 1, "t2": 2})
    assert {r.e: (r.t1, r.t2) for r in wide.collect()} == {"a": (5.0, None), "b": (None, 4.0)}
    long = to_long(wide, ["e"], ["t1", "t2"], labels={"t1": 1, "t2": 2}).where("value > 0")
    assert {(r.e, r.time): r.value for r in long.collect()} == {("a", 1): 5.0, ("b", 2): 4.0}
    named = to_long(wide, ["e"], ["t1"])
    assert {r.time for r in named.collect()} == {"t1"}


def test_first_positive(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0), (None, -1.0)], "t1 double, t2 double")
    got = [r[0] for r in df.select(first_positive(["t1", "t2"], {"t1": 1, "t2": 2})).collect()]
    assert got == [2, 1, None]


def test_baseline_uses_the_original(spark):
    df = spark.createDataFrame([(1, 5.0, 7.0, 2.0)], "id int, t0 double, t1 double, t2 double")
    row = subtract_baseline(df, ["t0", "t1", "t2"], "t0").first()
    assert (row.t0, row.t1, row.t2) == (0.0, 2.0, 0.0)
    assert sum_bins(df, {"h": ["t1", "t2"]}, ["id"]).first().h == 9.0


def test_steps(spark):
    df = spark.createDataFrame([(1, 10, 4, 9, 9, 12)], "id int, a int, b int, c int, d int, e int")
    steps = column_steps(df, [("s1", "b", "a"), ("s2", "c", "b"), ("s3", "d", "c"), ("s4", "e", "d")], ["id"])
    assert tuple(steps.first())[1:] == (-6, 5, 0, 3)
    kept = to_long(steps, ["id"], ["s1", "s2", "s3", "s4"]).where("value > 0")
    assert sorted(r.value for r in kept.collect()) == [3, 5]
    series = spark.createDataFrame([(1, 2, 4.0), (1, 1, 10.0), (2, 1, 1.0)], "e int, t int, v double")
    got = {(r.e, r.t): r.step for r in series_steps(series, ["e"], "t", "v").collect()}
    assert got == {(1, 1): None, (1, 2): -6.0, (2, 1): None}


def test_union_and_fold(spark):
    a, b = spark.createDataFrame([(1,)], "v int"), spark.createDataFrame([(2,), (3,)], "v int")
    assert sorted((r.source, r.v) for r in tagged_union({"a": a, "b": b}).collect()) == [("a", 1), ("b", 2), ("b", 3)]
    df = spark.createDataFrame([("H1", "k", 1.0), ("H2", "k", 2.0), ("H3", "k", 4.0)], "h string, k string, v double")
    assert {r.h: r.v for r in fold_bucket(df, "h", "H1", "H2", ["k"], "v").collect()} == {"H2": 3.0, "H3": 4.0}


def test_first_appearance_and_flag(spark):
    df = spark.createDataFrame([("a", 2, "q"), ("a", 1, "r"), ("b", 3, "q"), ("a", 1, "s")], "e string, t int, s string")
    got = {(r.e, r.t, r.s) for r in first_appearance(df, ["e"], ["t"], ["s"]).collect()}
    assert got == {("a", 1, "r"), ("b", 3, "q")}
    flagged = {(r.e, r.t, r.s) for r in mark_first(df, ["e"], ["t", "s"]).where("is_first").collect()}
    assert flagged == got
    for n in (1, 7):
        assert {tuple(r) for r in first_appearance(df.repartition(n), ["e"], ["t"], ["s"]).collect()} == {
            ("a", 1, "r"),
            ("b", 3, "q"),
        }


def test_lowest_per_text(spark):
    df = spark.createDataFrame([(5, "x"), (3, "x"), (9, "y"), (1, None)], "id int, t string")
    assert {(r.id, r.copies) for r in lowest_per_text(df, "t", "id").collect()} == {(3, 2), (9, 1)}
    assert {(r.id, r.t, r.copies) for r in lowest_per_text(df, "t", "id", ["t"]).collect()} == {(3, "x", 2), (9, "y", 1)}


def test_joins(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    right = spark.createDataFrame([(None, 10), ("b", 20)], "k string, v int")
    assert {tuple(r) for r in left_attach(left, right, ["k"]).collect()} == {("a", 1, None), (None, 2, None)}
    renamed = right.withColumnRenamed("v", "w")
    assert {tuple(r) for r in null_safe_join(left, renamed, ["k"]).collect()} == {(None, 2, 10)}
    full = {tuple(r) for r in null_safe_join(left, renamed, ["k"], "full").collect()}
    assert full == {(None, 2, 10), ("a", 1, None), ("b", None, 20)}
    a = spark.createDataFrame([("p", 1.0)], "k string, x double")
    b = spark.createDataFrame([("q", 2.0)], "k string, y double")
    assert {tuple(r) for r in outer_fill_zero(a, b, ["k"]).collect()} == {("p", 1.0, 0.0), ("q", 0.0, 2.0)}


def test_synonyms(spark):
    df = spark.createDataFrame(
        [(1, "p1", "hit", "no"), (2, "p2", "hit", "also"), (3, "p3", "no", None), (4, "p4", "hit", "hit")],
        "id int, name string, a string, b string",
    )
    known = spark.createDataFrame([("hit",), ("hit",), ("also",), (None,)], "gene string")
    got = {r.id: (r.alias_hits, r.resolved) for r in resolve_synonyms(df, "id", "name", ["a", "b"], known, "gene").collect()}
    assert got == {1: (1, "hit"), 2: (2, "p2"), 3: (0, "p3"), 4: (2, "p4")}


PATTERNS = ["ab", "abc", "a.c", "^abc", "xyz$", "colou?r", "(ab|cd)e", "ne+d", "b{2,3}a", "a*?bcd", "[0-9]+", "zzzz", r"\d"]
PATTERNS += ["abc|xyz", "abc|", "[bc]d", r"a\.b|neeed", "co[lx]ou?r|wxy", r"\d+|bba", "x?abc", "a|b", "", "[|]", "[^a]bcd"]


def test_required_literals(spark):
    df = spark.createDataFrame([(p,) for p in PATTERNS], "p string")
    got = {r.p: r.l for r in df.select("p", required_literals(F.col("p")).alias("l")).collect()}
    assert got["colou?r"] == ["colo"] and got["(ab|cd)e"] == [""] and got["a*?bcd"] == ["bcd"] and got["b{2,3}a"] == ["a"]
    assert got["abc|xyz"] == ["abc", "xyz"] and got["[bc]d"] == ["d"] and got["abc|"] == ["abc", ""]


@pytest.mark.parametrize("gram", [2, 3, 5])
def test_regex_join_equals_brute_force(spark, gram):
    texts = ["abcde", "xxabc", "wxyz", "color", "colour", "need", "neeed", "bba", "bbba", "bcd", "77", "", "abcde", "cde"]
    left = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "i int, t string")
    right = spark.createDataFrame([(p,) for p in PATTERNS], "p string")
    got = sorted((r.i, r.p) for r in regex_join(left, "t", right, "p", gram).collect())
    want = sorted((i, p) for i, t in enumerate(texts) for p in PATTERNS if re.search(p, t))
    assert got == want


def test_trapezoid(spark):
    df = spark.createDataFrame([("e", 4.0, 4.0), ("e", 1.0, 10.0), ("e", 2.0, 6.0), ("f", 1.0, 1.0)], "e string, x double, y double")
    assert {r.e: r.area for r in trapezoid(df, ["e"], "x", "y").collect()} == {"e": 18.0, "f": 0.0}
    upto = trapezoid(df, ["e"], "x", "y", {"to_2": 2.0}).where("e = 'e'").first()
    assert (upto.area, upto.to_2) == (18.0, 8.0)
    assert {r.e: r.spacing for r in mean_spacing(df, ["e"], "x").collect()} == {"e": 1.5, "f": None}


def test_segmented_trapezoid_equals_plain(spark):
    df = spark.range(500).select(
        (F.col("id") % 2).alias("e"), (F.col("id") * F.col("id") / 10.0).alias("x"), F.pmod(F.xxhash64("id"), F.lit(50)).cast("double").alias("y")
    )
    limits = {"a": 100.0, "b": 1400.0, "c": 10000.0}
    plain = {r.e: tuple(r) for r in trapezoid(df, ["e"], "x", "y", limits).collect()}
    cut = {r.e: tuple(r) for r in trapezoid(df, ["e"], "x", "y", limits, F.floor(F.col("x") / 700)).collect()}
    assert set(cut) == set(plain) and all(cut[e] == pytest.approx(plain[e]) for e in cut)


def test_prefix_over_segments(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("v"))
    got = prefix(df, F.floor(F.col("k") / 64), ["k"], sums={"run": "v"}).orderBy("k").collect()
    run = 0.0
    for i, r in enumerate(got):
        run += i % 7
        assert (r["index"], r.run) == (i, run)


def test_dense_index_is_a_permutation_and_repeatable(spark):
    df = spark.range(777).withColumnRenamed("id", "k")
    a = {r.k: r["index"] for r in dense_index(df.repartition(1), "k", 3).collect()}
    b = {r.k: r["index"] for r in dense_index(df.repartition(8), "k", 3).collect()}
    assert a == b and sorted(a.values()) == list(range(777))
