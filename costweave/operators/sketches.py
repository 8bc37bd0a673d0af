"""Quantile sketches that are stored once and merged upwards, without the fact they were made from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size parameter of the sketches; a sketch holds a few times as many values at most, however many it has seen.
SIZE = 800


def rank_error(size: int = SIZE) -> float:
    """Most that a rank is wrong by, as a share of the values, with 99 % confidence, at any level of merging.

    The published figure for these sketches (Karnin, Lang and Liberty 2016): 2.296 / size^0.9723.
    """
    return 2.296 / size**0.9723


def quantile_sketches(df: DataFrame, value: str, by: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """(by, sketch, n): a sketch of each group's values and their number, in one pass with partial sketches per task.

    Missing values are left out; a group without values has no row, and a table without values none at all.
    """
    held = df.select(*by, F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL AND NOT isnan(__v)")
    sketched = held.groupBy(*by).agg(
        F.kll_sketch_agg_double("__v", F.lit(size)).alias("sketch"), F.count(F.lit(1)).alias("n")
    )
    return sketched.where("n > 0")


def merged_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, sketch, n): the sketches of finer groups merged; only sketches are read and shuffled."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))
    return merged.where("n > 0")


def sketched_quantiles(sketches: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Quantiles ``q0, q1, ..`` read off the sketches; each is a value of its group."""
    quantiles = [
        F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(f"q{i}") for i, p in enumerate(probs)
    ]
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], *quantiles)
