"""Densities, histograms and box summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costweave.operators.attach import attach, measure
from costweave.operators.quantiles import exact_quantiles
from costweave.operators.resolve import null_safe_join
from costweave.session import cut_lineage, spread


def rule_bandwidth(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """0.9 * min(sd, IQR / 1.34) * n^-0.2 per group; missing for a single value.

    A width of zero falls back to the standard deviation, then to the value itself, then to 1.
    """
    quarts = exact_quantiles(df, value, [0.25, 0.75], by)
    measured = F.struct(F.stddev_samp(value).alias("sd"), F.max(F.abs(value)).cast("double").alias("size")).alias("__of")
    spread = df.groupBy(*by).agg(measured)
    joined = null_safe_join(quarts, spread, by) if by else quarts.withColumn("__of", spread.scalar())
    iqr = (F.col("q1") - F.col("q0")) / F.lit(1.34)
    sd, size = F.col("__of.sd"), F.col("__of.size")
    either = F.least(sd, iqr)
    narrow = F.when(sd.isNull(), F.lit(None).cast("double")).when(either > 0, either)
    narrow = narrow.when(sd > 0, sd).when(size > 0, size).otherwise(F.lit(1.0))
    return joined.select(*by, (F.lit(0.9) * narrow * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bandwidth"))


#: Cells a bandwidth is cut into, terms of the expansion in each, and how many bandwidths a cell reaches.
CELLS_PER_WIDTH, TERMS, REACH = 8, 10, 9.0


def density_error_bound() -> float:
    """Most that ``_gauss_curve`` differs from the sum over all values, as a share of the kernel's peak, rounding aside.

    With u = distance from the middle of the cell in bandwidths, the term of order p is below 1.09 u^p / sqrt(p!); beyond
    the reach the kernel itself is left out.
    """
    u = 0.5 / CELLS_PER_WIDTH
    rest = sum(1.09 * u**p / math.sqrt(math.factorial(p)) for p in range(TERMS, TERMS + 20))
    return rest + math.exp(-((REACH - u) ** 2) / 2.0)


def hermite_rows(terms: int) -> list[list[int]]:
    """Coefficients, lowest power first, of the polynomials He_0 .. with He_{p+1}(s) = s He_p(s) - p He_{p-1}(s)."""
    rows = [[1], [0, 1]]
    for p in range(1, terms - 1):
        up = [0, *rows[p]]
        down = [*rows[p - 1], 0, 0]
        rows.append([a - p * b for a, b in zip(up, down)])
    return rows[:terms]


def _gauss_curve(held: DataFrame, shape: DataFrame, by: Sequence[str], points: int) -> DataFrame:
    """Gaussian density of the values ``__v`` at ``__start + point * __step``: (by, point, shape columns, density).

    ``shape`` has one row per group: ``__h``, ``__start``, ``__step`` and the number of values ``__n``. A bandwidth is cut into
    cells; a cell keeps its count and the power sums of its values' distances from its middle, which is all that is
    shuffled. Its share of each point in reach then is one polynomial times one exponential (the fast Gauss
    transform of Greengard and Strain 1991). The work at the points depends on the cells that hold values, not on the
    number of values, and the result is the sum over all values to ``density_error_bound()``.
    """
    shape = cut_lineage(shape.where("__h IS NOT NULL"))
    size = measure(shape).bytes
    placed = attach(held, shape, by, size=size).where("__h IS NOT NULL")
    scale = F.lit(float(CELLS_PER_WIDTH))
    place = (F.col("__v") - F.col("__start")) / F.col("__h")
    placed = placed.withColumn("__place", place).withColumn("__cell", F.floor(F.col("__place") * scale))
    middle = (F.col("__cell").cast("double") + F.lit(0.5)) / scale
    power, sums = F.lit(1.0), []
    for p in range(TERMS):
        sums.append(F.sum(power).alias(f"__m{p}"))
        power = power * F.col("__u")
    ruler = [F.max(c).alias(c) for c in ("__h", "__step")]
    cells = placed.withColumn("__u", F.col("__place") - middle).groupBy(*by, "__cell").agg(*sums, *ruler)
    rows = hermite_rows(TERMS)
    factors = []
    for q in range(TERMS):
        terms = [F.col(f"__m{p}") * F.lit(rows[p][q] / math.factorial(p)) for p in range(q, TERMS) if rows[p][q]]
        factors.append(sum(terms[1:], terms[0]).alias(f"__c{q}"))
    gap = (F.col("__step") / F.col("__h")).alias("__gap")
    known = spread(cells, *by, "__cell").select(*by, middle.alias("__middle"), gap, *factors)
    first = F.greatest(F.lit(0.0), F.ceil((F.col("__middle") - F.lit(REACH)) / F.col("__gap")).cast("double"))
    last = F.least(F.lit(float(points - 1)), F.floor((F.col("__middle") + F.lit(REACH)) / F.col("__gap")).cast("double"))
    near = (
        known.withColumns({"__first": first.cast("int"), "__last": last.cast("int")})
        .where("__first <= __last")
        .withColumn("point", F.explode(F.sequence("__first", "__last")))
        .withColumn("__s", F.col("point") * F.col("__gap") - F.col("__middle"))
    )
    polynomial = F.col(f"__c{TERMS - 1}")
    for q in range(TERMS - 2, -1, -1):
        polynomial = polynomial * F.col("__s") + F.col(f"__c{q}")
    shares = near.select(*by, "point", (F.exp(F.col("__s") * F.col("__s") / F.lit(-2.0)) * polynomial).alias("__share"))
    everywhere = shape.select(*by, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"), F.lit(0.0).alias("__share"))
    summed = shares.unionByName(everywhere).groupBy(*by, "point").agg(F.sum("__share").alias("__share"))
    peak = F.col("__n") * F.col("__h") * F.lit(math.sqrt(2 * math.pi))
    # an expansion ends a hair below zero where the density is none
    density = F.greatest(F.lit(0.0), F.col("__share") / peak)
    return attach(summed, shape, by, size=size).select(*by, "point", "__start", "__step", density.alias("density"))


def _held(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    v = F.col(value).cast("double")
    return df.select(*by, v.alias("__v")).where("__v IS NOT NULL AND NOT isnan(__v)")


def kernel_density(
    df: DataFrame,
    value: str,
    grid: tuple[int, int, int],
    bandwidth: float | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Gaussian kernel density on the grid (first, last, points per unit), per group.

    Without a bandwidth the rule of thumb is used, per group; a group without one has no rows. Missing values are left out.
    """
    by = list(by)
    first, last, per_unit = grid
    held = _held(df, value, by)
    shape = held.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    if bandwidth is not None:
        shape = shape.where("__n > 0").withColumn("__h", F.lit(float(bandwidth)))
    else:
        shape = _with_width(shape, held, by)
    shape = shape.withColumns({"__start": F.lit(float(first)), "__step": F.lit(1.0 / per_unit)})
    curve = _gauss_curve(held, shape, by, (last - first) * per_unit + 1)
    x = (F.lit(first * per_unit) + F.col("point")) / F.lit(float(per_unit))
    return curve.select(*by, x.alias("x"), "density")


def _with_width(shape: DataFrame, held: DataFrame, by: Sequence[str]) -> DataFrame:
    widths = rule_bandwidth(held, "__v", by).withColumnRenamed("bandwidth", "__h")
    if by:
        return null_safe_join(shape, widths, by)
    return shape.withColumn("__h", widths.scalar())


def density_curve(df: DataFrame, value: str, points: int = 512, by: Sequence[str] = (), cut: float = 3.0) -> DataFrame:
    """Gaussian density per group at ``points`` places from ``cut`` bandwidths below its least value to as many above
    its greatest: (by, point, x, density). A group of a single value has no bandwidth and no density.
    """
    if points < 2:
        raise ValueError("a curve has two points or more")
    by = list(by)
    held = _held(df, value, by)
    ends = held.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    low = F.col("__low") - F.lit(cut) * F.col("__h")
    step = (F.col("__high") + F.lit(cut) * F.col("__h") - low) / F.lit(float(points - 1))
    shape = _with_width(ends, held, by).select(*by, "__n", "__h", low.alias("__start"), step.alias("__step"))
    curve = _gauss_curve(held, shape, by, points)
    x = F.col("__start") + F.col("point") * F.col("__step")
    return curve.select(*by, "point", x.alias("x"), "density")


def histogram(df: DataFrame, value: str, low: float, width: float, by: Sequence[str] = ()) -> DataFrame:
    """Counts and density of equal bins, per group. Totals come from the counts, not from a second pass."""
    by = list(by)
    cell = F.floor((F.col(value) - F.lit(low)) / F.lit(width))
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*by, cell.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy(*by).agg(F.sum("n").alias("__total"))
    joined = null_safe_join(counts, totals, by) if by else counts.withColumn("__total", totals.scalar())
    return joined.select(
        *by,
        "bin",
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("bin_from"),
        "n",
        (F.col("n") / (F.col("__total") * F.lit(width))).alias("density"),
    )


def box_summary(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers (furthest points within 1.5 IQR of the box) and the number of points beyond."""
    quarts = exact_quantiles(df, value, [0.25, 0.5, 0.75], by)
    reach = F.lit(1.5) * (F.col("q2") - F.col("q0"))
    bounds = quarts.select(
        *by, "n", "q0", "q1", "q2", (F.col("q0") - reach).alias("__lo"), (F.col("q2") + reach).alias("__hi")
    )
    v = F.col(value)
    inside: Column = (v >= F.col("__lo")) & (v <= F.col("__hi"))
    counted = df.where(v.isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__k"))
    return (
        attach(counted, bounds, by)
        .groupBy(*by, "n", "q0", "q1", "q2")
        .agg(
            F.min(F.when(inside, v)).alias("whisker_low"),
            F.max(F.when(inside, v)).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~inside, F.col("__k"))), F.lit(0)).alias("outside"),
        )
    )
