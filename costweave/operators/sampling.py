"""Resampling with reproducible draws."""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costweave.functions.draws import pick, truncated_steps, uniform52
from costweave.operators.multinomial import bootstrap_sums, drawn_values  # noqa: F401
from costweave.operators.ordered import dense_index, prefix, shuffled_order
from costweave.operators.quantiles import exact_median
from costweave.operators.resolve import null_safe_join
from costweave.session import spread


def truncated_normal(
    df: DataFrame,
    mean: str,
    draw: str,
    seed: int,
    low: float | Column,
    high: float | Column,
    sd: float = 1.0,
    out: str = "x",
) -> DataFrame:
    """Adds a normal draw around ``mean`` inside [low, high], by the inverse of the distribution function.

    One uniform number is stretched over the part of the distribution between the bounds, so no draw is tried again,
    folded or put on a bound, however narrow they are or far from the mean.
    """
    named = {
        "__u": uniform52(seed, F.col(draw), "n"),
        "__za": (F.lit(low) - F.col(mean)) / F.lit(sd),
        "__zb": (F.lit(high) - F.col(mean)) / F.lit(sd),
    }
    placed = df.withColumns({"__row": F.struct(*df.columns)}).select("__row", *[c.alias(n) for n, c in named.items()])
    for step in truncated_steps("__u", "__za", "__zb"):
        placed = placed.withColumns({name: F.expr(text) for name, text in step.items()})
    x = F.col(f"__row.{mean}") + F.lit(sd) * F.col("tz")
    inside = F.greatest(F.lit(low), F.least(F.lit(high), x))  # beyond a bound by rounding only
    return placed.select("__row.*", inside.alias(out))


def resample_truncated(
    sample: DataFrame,
    key: str,
    value: str,
    draws: DataFrame,
    draw: str,
    seed: int,
    low: float | Column,
    high: float | Column,
) -> DataFrame:
    """For every row of ``draws``: a value of the sample picked with replacement, blurred, kept inside the bounds."""
    indexed = dense_index(sample.select(key, value), key, seed)
    n = sample.agg(F.count(F.lit(1))).scalar()
    picks = draws.select(draw).withColumn("index", pick(n, seed, F.col(draw)))
    joined = picks.join(indexed.select("index", F.col(value).alias("__center")), "index")
    return truncated_normal(joined, "__center", draw, seed, low, high).select(draw, "x")


def resample_truncated_many(
    sample: DataFrame,
    key: str,
    value: str,
    draws: int,
    seed: int,
    low: float | Column,
    high: float | Column,
    sd: float = 1.0,
) -> DataFrame:
    """(leaf, draw, x): ``draws`` values of the sample picked with replacement, blurred, kept inside the bounds.

    As ``resample_truncated``, but for a number of draws of its own. Missing values are not picked; without any value
    there are no draws.
    """
    picked = drawn_values(sample.where(F.col(value).isNotNull()), key, value, draws, seed)
    addressed = picked.withColumn("__draw", F.concat_ws(":", F.col("leaf").cast("string"), F.col("draw").cast("string")))
    return truncated_normal(addressed, "value", "__draw", seed, low, high, sd).select("leaf", "draw", "x")


def poisson_weight_bounds() -> list[tuple[float, int]]:
    """(upper bound of the uniform, count) of a Poisson(1) count, up to the bound that a double tells no more from 1."""
    bounds, cumulative, term, k = [], 0.0, math.exp(-1.0), 0
    while cumulative + term > cumulative:
        cumulative += term
        bounds.append((cumulative, k))
        k += 1
        term /= k
    return [*bounds[:-1], (1.0, bounds[-1][1])]


def digits_below(bound: float) -> str:
    """The 13 hexadecimal digits from which on ``uniform52`` is no longer below a bound under 1."""
    return f"{math.ceil(Fraction(bound) * 2**52 - Fraction(1, 2)):013x}"


def poisson_weight(digest: Column) -> Column:
    """Poisson(1) count by inversion of the uniform of a digest. Texts of digits are compared, no number is made."""
    *bounds, (_, last) = poisson_weight_bounds()
    steps = reduce(lambda when, step: when.when(digest < F.lit(digits_below(step[0])), F.lit(step[1])), bounds, F)
    return steps.otherwise(F.lit(last))


def bootstrap_sums_poisson(sample: DataFrame, key: str, value: str, replicates: int, seed: int) -> DataFrame:
    """Bootstrap sums by Poisson(1) weights: one pass, no index and no join. The number of draws varies around n."""
    address = F.concat_ws(":", F.lit(""), F.col(key).cast("string"))
    rows = spread(sample.select(address.alias("__key"), F.col(value).alias("__value")), "__key")
    prefixes = F.array(*[F.lit(f"{seed}:{replicate}") for replicate in range(1, replicates + 1)])
    repeated = rows.select("__key", "__value", F.posexplode(prefixes).alias("__at", "__prefix"))
    digests = repeated.select("__at", "__value", F.md5(F.concat("__prefix", "__key")).alias("__digest"))
    weighted = digests.select("__at", "__value", poisson_weight(F.col("__digest")).alias("__weight"))
    sums = weighted.groupBy("__at").agg(
        F.coalesce(F.sum(F.col("__value") * F.col("__weight")), F.lit(0.0)).alias("total"), F.sum("__weight").alias("draws")
    )
    return sums.select((F.col("__at") + 1).alias("replicate"), "total", "draws")


def subsample_curve(sample: DataFrame, key: str, value: str, seed: int) -> DataFrame:
    """Nested subsamples of size 1..n without replacement: their totals and means.

    One random order serves all sizes, so the sample of size s is contained in that of size s + 1 and every total is a
    prefix sum.
    """
    hashed, segment, order = shuffled_order(sample.select(key, value), key, seed)
    run = prefix(hashed, segment, order, index="__i", sums={"total": value})
    size = F.col("__i") + 1
    return run.select(size.alias("size"), "total", (F.col("total") / size).alias("mean"))


def median_interval(df: DataFrame, value: str, quantile: float, by: Sequence[str] = ()) -> DataFrame:
    """Median with bounds at ``quantile`` standard errors."""
    spread = df.groupBy(*by).agg(F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    middle = exact_median(df, value, by).select(*by, "median")
    if by:
        joined = null_safe_join(spread, middle, by)
    else:
        joined = spread.withColumn("median", middle.select("median").scalar())
    error = F.lit(quantile) * F.col("sd") / F.sqrt(F.col("n").cast("double"))
    return joined.withColumn("error", error).select(
        *by,
        "n",
        "sd",
        "median",
        (F.col("median") - F.col("error")).alias("lower"),
        (F.col("median") + F.col("error")).alias("upper"),
    )
