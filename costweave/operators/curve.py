"""Asymptotic regression  y = A + (R0 - A) * exp(-exp(lrc) * x)  as aggregates.

For a fixed ``lrc`` the model is linear in exp(..), so sums over the points give A, R0 and the residual sum of squares
in closed form (variable projection, Golub and Pereyra 1973). ``lrc`` itself is found on a grid that is refined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costweave.functions.scalars import regular_grid
from costweave.operators.resolve import null_safe_join

COARSE_STEPS_PER_UNIT = 10
REFINEMENT = 20
#: Ends of the first grid, as exp(lrc) times the span and times the mean gap of x.
LEAST_BEND, MOST_BEND = 1e-4, 10.0


def fit_series(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Points reduced to sums per distinct x, which is all the fit reads, with y counted from its group's mean.

    Without the shift, sums of squares of large values would cancel to noise. ``__mean`` and ``__middle`` are the
    group's means of y and x; ``__span`` and ``__steps`` the reach of x and the number of its gaps.
    """
    held = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *by, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__v")
    )
    shape = F.struct(
        F.avg("__v").alias("mean"),
        F.avg("__x").alias("middle"),
        (F.max("__x") - F.min("__x")).alias("span"),
        (F.count_distinct("__x") - 1).cast("double").alias("steps"),
    ).alias("__shape")
    shapes = held.groupBy(*by).agg(shape)
    placed = null_safe_join(held, shapes, by) if by else held.withColumn("__shape", shapes.scalar())
    shifted = placed.withColumn("__y", F.col("__v") - F.col("__shape.mean"))
    positive = F.col("__v") > 0
    return shifted.groupBy(*by, "__x").agg(
        F.count(F.lit(1)).alias("__n"),
        F.first("__shape").alias("__shape"),
        F.sum("__y").alias("__y"),
        F.sum(F.col("__y") * F.col("__y")).alias("__yy"),
        F.sum(F.when(positive, F.log10("__v"))).alias("__l"),
        F.sum(F.when(positive, F.log10("__v") * F.log10("__v"))).alias("__ll"),
    )


def _fit_at(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Closed-form fit per (group, lrc) and the best lrc of each group.

    The exponential is counted from its value at the middle x, for the same reason as y.
    """
    rate = F.exp("__lrc")
    centre = F.exp(-rate * F.col("__shape.middle"))
    n = F.col("__n")
    sums = (
        points.withColumn("__e", F.exp(-rate * F.col("__x")) - centre)
        .groupBy(*by, "__lrc")
        .agg(
            F.first("__shape").alias("shape"),
            F.sum(n).alias("n"),
            F.sum(n * F.col("__e")).alias("se"),
            F.sum(n * F.col("__e") * F.col("__e")).alias("see"),
            F.sum("__y").alias("sy"),
            F.sum("__yy").alias("syy"),
            F.sum(F.col("__e") * F.col("__y")).alias("sey"),
            F.sum("__l").alias("sl"),
            F.sum("__ll").alias("sll"),
        )
    )
    n = F.col("n").cast("double")
    see = F.col("see") - F.col("se") * F.col("se") / n
    sey = F.col("sey") - F.col("se") * F.col("sy") / n
    syy = F.col("syy") - F.col("sy") * F.col("sy") / n
    slope = F.try_divide(F.when(see > 0, sey), see)
    mean = F.col("shape.mean")
    at_middle = F.exp(-F.exp("__lrc") * F.col("shape.middle"))
    fitted = sums.select(
        *by,
        F.col("__lrc").alias("lrc"),
        F.col("n"),
        (mean - slope * (F.col("se") / n + at_middle)).alias("asym"),
        slope.alias("__b"),
        (syy - slope * sey).alias("rss"),
        syy.alias("tss"),
        (F.col("sll") - F.lit(2.0) * mean * F.col("sl") + n * mean * mean).alias("mixed_tss"),
    )
    # residuals that agree to 13 digits are equal, so that noise does not choose among them
    order = F.struct(F.round(F.col("rss") / F.col("tss") * 1e13), F.col("lrc"))
    row = F.struct("lrc", "n", "asym", "__b", "tss", "mixed_tss")
    return fitted.where("rss is not null").groupBy(*by).agg(F.min_by(row, order).alias("f")).select(*by, "f.*")


def _residuals(series: DataFrame, best: DataFrame, by: Sequence[str]) -> DataFrame:
    """Residual sum of squares from the residuals themselves: it is never below zero.

    ``__yy`` less what the mean of equal x explains, plus the squared distances of those means from the curve.
    """
    placed = _attach(series, best.select(*by, F.struct("lrc", "asym", "__b").alias("__fit")), by, "__fit")
    curve = F.col("__fit.asym") + F.col("__fit.__b") * F.exp(-F.exp("__fit.lrc") * F.col("__x"))
    distance = F.col("__y") / F.col("__n") - (curve - F.col("__shape.mean"))
    within = F.greatest(F.lit(0.0), F.col("__yy") - F.col("__y") * F.col("__y") / F.col("__n"))
    squares = F.sum(within + F.col("__n") * distance * distance).alias("rss")
    found = placed.groupBy(*by).agg(squares)
    return null_safe_join(best, found, by) if by else best.withColumn("rss", found.scalar())


def asymptotic_fit(df: DataFrame, by: Sequence[str], x: str, y: str, rounds: int = 3) -> DataFrame:
    """Coefficients per group: asym, r0, lrc, rss, r2, and ``r2_mixed`` with its log-against-linear total.

    The first grid has steps of 0.1 and reaches from rates that bend the curve by a ten-thousandth over its whole
    span to rates that end it within a tenth of the mean gap of x, so it follows the data. Each further round divides the step by
    20 around the best value so far. A best value on either end of the grid is no curve but a line or a step: its
    coefficients are missing. Groups whose points determine no curve (a single x) give no row.
    """
    series = fit_series(df, by, x, y)
    span, steps = F.col("__shape.span"), F.col("__shape.steps")
    scale = F.lit(float(COARSE_STEPS_PER_UNIT))
    low = F.floor(F.log(F.lit(LEAST_BEND) / span) * scale)
    high = F.ceil(F.log(F.lit(MOST_BEND) * steps / span) * scale)
    # a lone x has no span and no curve
    ranged = series.where(span > 0).withColumns({"__low": low, "__high": high})
    grid = F.transform(F.sequence("__low", "__high"), lambda k: k.cast("double") / scale)
    best = _fit_at(ranged.withColumn("__lrc", F.explode(grid)), by)
    ends = F.struct(F.first("__low").alias("low"), F.first("__high").alias("high")).alias("__ends")
    edges = ranged.groupBy(*by).agg(ends)
    divisor = COARSE_STEPS_PER_UNIT
    for _ in range(rounds - 1):
        divisor *= REFINEMENT
        near = best.select(*by, F.col("lrc").alias("__near"))
        placed = _attach(ranged, near, by, "__near")
        offsets = f"transform(sequence(-{REFINEMENT}, {REFINEMENT}), k -> __near + k / {float(divisor)}D)"
        best = _fit_at(placed.withColumn("__lrc", F.explode(F.expr(offsets))), by)
    known = _residuals(ranged, best, by)
    bounded = null_safe_join(known, edges, by) if by else known.withColumn("__ends", edges.scalar())
    inside = (F.col("lrc") > F.col("__ends.low") / scale + 0.05) & (F.col("lrc") < F.col("__ends.high") / scale - 0.05)
    found = {
        "lrc": F.col("lrc"),
        "asym": F.col("asym"),
        "r0": F.col("asym") + F.col("__b"),
        "rss": F.col("rss"),
        "r2": F.lit(1.0) - F.try_divide(F.col("rss"), F.col("tss")),
        "r2_mixed": F.lit(1.0) - F.try_divide(F.col("rss"), F.col("mixed_tss")),
    }
    return bounded.select(*by, "n", *[F.when(inside, c).alias(name) for name, c in found.items()])


def _attach(series: DataFrame, near: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    if by:
        return null_safe_join(series, near, by)
    return series.withColumn(name, near.select(name).scalar())


def curve_value(x: Column) -> Column:
    return F.col("asym") + (F.col("r0") - F.col("asym")) * F.exp(-F.exp("lrc") * x)


def asymptotic_predict(fit: DataFrame, by: Sequence[str], first: int, last: int, per_unit: int) -> DataFrame:
    """Fitted values on the grid first, first + 1/per_unit, .., last."""
    return fit.withColumn("x", F.explode(regular_grid(first, last, per_unit))).select(
        *by, "x", curve_value(F.col("x")).alias("predicted")
    )
