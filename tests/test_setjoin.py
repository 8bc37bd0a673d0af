"""Threshold joins of sets against all pairs in plain Python."""

from __future__ import annotations

import random

import pytest

from costweave.operators import setjoin
from costweave.operators.setjoin import SetClasses, bands_for, jaccard_minhash, jaccard_within, prefix_candidates


def table(spark, sets):
    cells = [(row, col) for row, cols in sets.items() for col in cols]
    return spark.createDataFrame(cells, "row long, col long")


def plain_pairs(sets, most_distance):
    """Pairs of the least rows of equal sets."""
    classes = {}
    for row in sorted(sets):
        if sets[row]:
            classes.setdefault(frozenset(sets[row]), row)
    named = sorted((row, cols) for cols, row in classes.items())
    out = {}
    for k, (i, a) in enumerate(named):
        for j, b in named[k + 1 :]:
            shared = len(a & b)
            if shared and shared / len(a | b) >= 1.0 - most_distance:
                out[i, j] = (shared, round(1.0 - shared / len(a | b), 12))
    return out


def clusters(draw, families=25, own=12, columns=4000):
    """Families of similar sets, copies, one column in all rows, and rows of that column alone."""
    sets, row = {}, 0
    for _ in range(families):
        base = set(draw.sample(range(1, columns), draw.randint(1, 40)))
        for _ in range(own):
            cols = set(base)
            for _ in range(draw.randint(0, 5)):
                cols ^= {draw.randrange(1, columns)}
            sets[row] = cols | {0}
            row += 1
    for _ in range(40):
        sets[row] = {0} if draw.random() < 0.5 else {0, draw.randrange(1, columns)}
        row += 1
    return sets


@pytest.mark.parametrize("most_distance", [0.0, 0.2, 0.5, 0.85])
def test_all_pairs_up_to_the_limit(most_distance, spark):
    sets = clusters(random.Random(1))
    pairs, members = jaccard_within(table(spark, sets), "row", "col", most_distance)
    got = {(r["row_i"], r["row_j"]): (r["shared"], round(r["distance"], 12)) for r in pairs.collect()}
    assert got == plain_pairs(sets, most_distance)
    first = {}
    for row in sorted(sets):
        first.setdefault(frozenset(sets[row]), row)
    assert {r["row"]: r["class_row"] for r in members.collect()} == {row: first[frozenset(c)] for row, c in sets.items()}


@pytest.mark.parametrize("large", [0, 10**9])
def test_either_prefix_is_exact(large, spark, monkeypatch):
    monkeypatch.setattr(setjoin, "LARGE", large)
    sets = clusters(random.Random(5), families=12)
    pairs, _ = jaccard_within(table(spark, sets), "row", "col", 0.4)
    assert {(r["row_i"], r["row_j"]) for r in pairs.collect()} == set(plain_pairs(sets, 0.4))


def test_candidates_are_far_fewer_than_pairs(spark):
    """One column stands in every row; by rarity it is in no prefix that would pair all of them."""
    sets = clusters(random.Random(2), families=60)
    classes = SetClasses(table(spark, sets), "row", "col")
    n, found = classes.sets.count(), prefix_candidates(classes.sets, 0.3).count()
    assert found < n * (n - 1) / 2 / 30
    assert len(plain_pairs(sets, 0.3)) <= found


def test_a_hot_column_of_small_sets_pairs_nothing(spark):
    sets = {i: {0, i + 1} for i in range(2000)}
    classes = SetClasses(table(spark, sets), "row", "col")
    assert prefix_candidates(classes.sets, 0.5).count() == 0


def test_equal_sets_are_one_class(spark):
    cells = spark.range(20_000).selectExpr("id AS row", "explode(sequence(1, 3)) AS col")
    classes = SetClasses(cells, "row", "col")
    assert [tuple(r) for r in classes.sets.collect()] == [(0, 3, [1, 2, 3])]
    assert classes.members.where("class_row = 0 AND members = 20000").count() == 20_000


@pytest.mark.parametrize("most_distance", [0.2, 0.5])
def test_minhash_recall(most_distance, spark):
    sets = clusters(random.Random(3), families=60)
    want = plain_pairs(sets, most_distance)
    pairs, _ = jaccard_minhash(table(spark, sets), "row", "col", most_distance)
    got = {(r["row_i"], r["row_j"]): (r["shared"], round(r["distance"], 12)) for r in pairs.collect()}
    assert got.items() <= want.items()
    assert len(got) / len(want) >= 0.9


def test_minhash_recall_on_orders(spark, sf_dir):
    from costweave.plans import ORACLES, QUERIES

    exact = {tuple(r) for r in QUERIES["jaccard_within"](spark, sf_dir).collect()}
    found = {tuple(r) for r in QUERIES["jaccard_minhash"](spark, sf_dir).collect()}
    assert found <= exact and len(found) / len(exact) >= 0.9
    assert "jaccard_minhash" in ORACLES


def test_bands_follow_the_limit():
    for distance in (0.0, 0.1, 0.2, 0.5, 0.7, 0.9):
        bands, rows = bands_for(distance)
        assert bands * rows <= setjoin.MOST_HASHES
        assert 1.0 - (1.0 - (1.0 - distance) ** rows) ** bands >= 0.95
    with pytest.raises(ValueError):
        bands_for(0.999)
    with pytest.raises(ValueError):
        bands_for(1.0)


def test_missing_rows_and_columns(spark):
    df = spark.createDataFrame([(1, 5), (None, 5), (1, None), (2, 5), (2, 5)], "row long, col long")
    pairs, members = jaccard_within(df, "row", "col", 0.5)
    assert pairs.collect() == []
    assert sorted(map(tuple, members.collect())) == [(1, 1, 2), (2, 1, 2)]
    none = spark.createDataFrame([], "row long, col long")
    assert jaccard_within(none, "row", "col", 0.5)[0].collect() == []
    assert jaccard_minhash(none, "row", "col", 0.5)[0].collect() == []


@pytest.mark.parametrize("most_distance", [0.5, 0.82])
def test_groups_of_columns_lose_no_pair(most_distance, spark, monkeypatch):
    """A pair needs its share of matches in one group only, and nearly no other pair travels."""
    monkeypatch.setattr(setjoin, "CELLS_OF_GROUP", 6000)
    monkeypatch.setattr(setjoin, "MATCHES_AT_ONCE", 512)
    draw = random.Random(6)
    sets = {row: set(draw.sample(range(3000), 150)) for row in range(120)}
    for row in range(120, 180):
        kept = draw.sample(sorted(sets[row - 120]), draw.randint(30, 140))
        sets[row] = set(kept) | set(draw.sample(range(3000), 60))
    cells = table(spark, sets)
    pairs, _ = jaccard_within(cells, "row", "col", most_distance)
    want = plain_pairs(sets, most_distance)
    assert want and {(r["row_i"], r["row_j"]) for r in pairs.collect()} == set(want)
    found = prefix_candidates(SetClasses(cells, "row", "col").sets, most_distance)
    assert "Exchange hashpartitioning(token" not in found._jdf.queryExecution().executedPlan().toString()
    assert len(want) <= found.count() < 180 * 179 / 2 / 30
