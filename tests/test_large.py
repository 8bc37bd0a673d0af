"""What must not grow with the tables: broadcasts, copies of cells, rows a task holds."""

from __future__ import annotations

import random

from costweave.operators import multinomial, setjoin
from costweave.operators.sampling import bootstrap_sums_poisson, digits_below, poisson_weight_bounds
from costweave.operators.similarity import shared_counts
from costweave.plans import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_conserved_presence_broadcasts_no_long_side(spark, sf_dir):
    """Spark sees the compressed size of a table, not that a generator multiplies its rows."""
    text = plan(QUERIES["conserved_presence"](spark, sf_dir))
    assert "SortMergeJoin [entity" in text and "BroadcastHashJoin [entity" not in text


def test_selection_coefficient_broadcasts_no_long_side(spark, sf_dir):
    text = plan(QUERIES["selection_coefficient"](spark, sf_dir))
    assert "SortMergeJoin [entity" in text and "BroadcastExchange" not in text


def test_small_sets_meet_by_two_columns(spark):
    """Sets of four that must share three are no candidates because of one common column."""
    draw = random.Random(4)
    sets = {row: set(draw.sample(range(300), 4)) for row in range(2000)}
    cells = spark.createDataFrame([(row, col) for row, cols in sets.items() for col in cols], "row long, col long")
    assert setjoin.prefix_candidates(setjoin.SetClasses(cells, "row", "col").sets, 0.5).count() < 3000


def test_minhash_keys_are_made_inside_the_row(spark):
    """No table of one column a hash is shuffled."""
    sets = spark.createDataFrame([(1, 2, [3, 4]), (2, 2, [3, 5])], "row long, size int, cols array<long>")
    assert "min(" not in plan(setjoin.band_candidates(sets, 0.5)).replace("array_min(", "")


def test_rare_columns_list_their_pairs(spark):
    """Cells of columns with few rows are not copied to every block of rows."""
    cells = spark.range(400).selectExpr("id AS row", "explode(array(id div 4, 1000 + id div 3)) AS col")
    counts = shared_counts(cells, "row", "col", row_block=8)
    assert "InPandas" not in plan(counts)
    got = {(r["row_i"], r["row_j"]): r["shared"] for r in counts.collect()}
    pairs = [(i, j) for i in range(400) for j in range(i + 1, min(i + 4, 400))]
    want = {(i, j): (i // 4 == j // 4) + (i // 3 == j // 3) for i, j in pairs}
    assert got == {pair: n for pair, n in want.items() if n}


def test_bootstrap_deals_its_draws_once(spark):
    """Full leaves and the last one share the tree of splits, and no pick is a row."""
    values = spark.range(20_000).selectExpr("id AS k", "double(id) AS v")
    text = plan(multinomial.bootstrap_sums(values, "k", "v", 50, 1))
    assert text.count("Range (1, ") == 1 and "posexplode" not in text


def test_dealing_out_words_changes_no_count(spark, monkeypatch):
    """The SQL knows no limit from which the words of a node are cut."""

    def counts():
        return sorted(map(tuple, multinomial.leaf_counts(spark, 1000, 20, 5, leaf=64).collect()))

    before = counts()
    monkeypatch.setattr(multinomial, "DRAWS_AT_ONCE", 120)
    assert counts() == before


def test_poisson_weight_takes_one_digest_and_no_number(spark):
    values = spark.range(300).selectExpr("id AS k", "double(id) AS v")
    text = plan(bootstrap_sums_poisson(values, "k", "v", 5, 1))
    assert text.count("md5(") == 1 and "conv(" not in text


def test_digits_part_uniforms_as_bounds_do():
    for bound, _ in poisson_weight_bounds()[:-1]:
        first = int(digits_below(bound), 16)
        assert (first - 1 + 0.5) / 2**52 < bound <= (first + 0.5) / 2**52


def test_even_levels_compare_no_digits(spark):
    """Only a level with a node that is not full, but more than half, needs the digits of its chance."""
    assert "aggregate(" not in plan(multinomial.leaf_counts(spark, 3 * 4096 + 4096, 5, 1))
    assert "aggregate(" in plan(multinomial.leaf_counts(spark, 3 * 4096, 5, 1))


def test_no_task_packs_a_block_of_pairs(spark, monkeypatch):
    """However many pairs a block of rows lists, they are packed piece by piece, in the order of their places."""
    from costweave.operators import scaling

    monkeypatch.setattr(scaling, "PIECE", 500)
    pairs = spark.range(150).selectExpr("id AS row_i", "explode(sequence(id + 1, 150)) AS row_j").selectExpr("*", "0.5D AS distance")
    kept = scaling.SparseScaling(pairs, spark.range(151)).entries
    longest, n = kept.selectExpr("max(size(s))", "sum(size(s))").first()
    assert longest <= 500 and n == 151 * 150


def test_listed_pairs_are_counted_before_they_travel(spark, monkeypatch):
    """Pieces of any size give the same counts, and no row of one pair is shuffled."""
    from costweave.operators import similarity

    cells = spark.range(900).selectExpr("id % 60 AS row", "id div 3 AS col").distinct()

    def counts():
        found = similarity._listed_counts(cells)
        assert "Exchange hashpartitioning(row_i" not in plan(found)
        return sorted(map(tuple, found.collect()))

    before = counts()
    monkeypatch.setattr(similarity, "PAIRS_AT_ONCE", 16)
    monkeypatch.setattr(similarity, "PAIRS_OF_TILE", 8)
    assert counts() == before and sum(n for _, _, n in before) == 900
