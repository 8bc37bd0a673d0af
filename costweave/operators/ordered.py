"""Global order without a single-task sort: numbering, prefix sums, trapezoids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix(
    df: DataFrame,
    segment: Column,
    order: Sequence[str],
    index: str | None = "index",
    sums: Mapping[str, str] | None = None,
) -> DataFrame:
    """Row number (from 0) and running sums over the whole table in the order (segment, order).

    Two levels: inside a segment by window, between segments by an offset from the segment totals. ``segment`` must
    grow with the order and split it into many parts; only the table of segment totals meets in one task, and its
    size depends on the number of segments alone.
    """
    sums = dict(sums or {})
    base = df.withColumn("__seg", segment)
    names = list(sums)
    totals = base.groupBy("__seg").agg(
        F.count(F.lit(1)).alias("__n"), *[F.coalesce(F.sum(sums[s]), F.lit(0.0)).alias(f"__t_{s}") for s in names]
    )
    earlier = Window.partitionBy(F.lit(1)).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "__seg",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"),
        *[F.coalesce(F.sum(f"__t_{s}").over(earlier), F.lit(0.0)).alias(f"__start_{s}") for s in names],
    )
    within = Window.partitionBy("__seg").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = base.withColumn("__k", F.row_number().over(within) - 1)
    for s in names:
        placed = placed.withColumn(f"__in_{s}", F.coalesce(F.sum(sums[s]).over(upto), F.lit(0.0)))
    out = placed.join(offsets, "__seg")
    if index:
        out = out.withColumn(index, F.col("__start") + F.col("__k"))
    for s in names:
        out = out.withColumn(s, F.col(f"__start_{s}") + F.col(f"__in_{s}"))
    return out.drop("__seg", "__k", "__start", *[f"__in_{s}" for s in names], *[f"__start_{s}" for s in names])


def shuffled_order(df: DataFrame, key: str, seed: int, digits: int = 4) -> tuple[DataFrame, Column, list[str]]:
    """A reproducible random order: by digest of (seed, key), in 16^digits segments of equal expected size."""
    hashed = df.withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    return hashed, F.substring("__h", 1, digits), ["__h", key]


def dense_index(df: DataFrame, key: str, seed: int = 0, digits: int = 4, index: str = "index") -> DataFrame:
    """Numbers the rows 0..n-1 in a reproducible order of a unique key."""
    hashed, segment, order = shuffled_order(df, key, seed, digits)
    return prefix(hashed, segment, order, index=index).drop("__h")


def rank_slice(df: DataFrame, entity: Sequence[str], order: Sequence[str], first: int, last: int) -> DataFrame:
    """Rows ``first`` to ``last`` of each entity, counted from 1 in a declared order.

    Spark keeps only the leading ``last`` rows of an entity per task before the shuffle.
    """
    place = F.row_number().over(Window.partitionBy(*entity).orderBy(*order))
    return df.withColumn("__place", place).where(F.col("__place").between(first, last)).drop("__place")


def trapezoid(
    df: DataFrame,
    entity: Sequence[str],
    x: str,
    y: str,
    upto: Mapping[str, float] | None = None,
    segment: Column | None = None,
) -> DataFrame:
    """Area under each entity's points by the trapezoid rule, and areas up to the x values in ``upto``.

    ``df`` has one row per (entity, x). A long course is cut by ``segment``, which must grow with x: the area inside
    segments and the bridges between neighbouring segments are then summed. Without it a course is one group, right
    for courses with a bounded number of points.
    """
    keys = list(entity)
    bounds = {"area": None, **(upto or {})}

    def areas(step: Column, end: Column) -> list[Column]:
        return [
            F.coalesce(F.sum(step if limit is None else F.when(end <= F.lit(limit), step)), F.lit(0.0)).alias(name)
            for name, limit in bounds.items()
        ]

    def step(before_x, before_y, at_x, at_y) -> Column:
        return (at_x - before_x) * (at_y + before_y) / 2

    if segment is None:
        w = Window.partitionBy(*keys).orderBy(x)
        steps = df.withColumn("__a", step(F.lag(x).over(w), F.lag(y).over(w), F.col(x), F.col(y)))
        return steps.groupBy(*keys).agg(*areas(F.col("__a"), F.col(x)))

    w = Window.partitionBy(*keys, "__seg").orderBy(x)
    steps = df.withColumn("__seg", segment).withColumn(
        "__a", step(F.lag(x).over(w), F.lag(y).over(w), F.col(x), F.col(y))
    )
    parts = steps.groupBy(*keys, "__seg").agg(
        *areas(F.col("__a"), F.col(x)),
        F.min_by(F.struct(F.col(x).alias("x"), F.col(y).alias("y")), x).alias("__start"),
        F.max_by(F.struct(F.col(x).alias("x"), F.col(y).alias("y")), x).alias("__end"),
    )
    last = F.lag("__end").over(Window.partitionBy(*(keys or [F.lit(1)])).orderBy("__seg"))
    start = F.col("__start")
    bridged = parts.withColumn("__b", step(last["x"], last["y"], start["x"], start["y"])).withColumn("__x", start["x"])
    return bridged.groupBy(*keys).agg(
        *[
            (
                F.sum(name)
                + F.coalesce(
                    F.sum(F.col("__b") if limit is None else F.when(F.col("__x") <= F.lit(limit), F.col("__b"))),
                    F.lit(0.0),
                )
            ).alias(name)
            for name, limit in bounds.items()
        ]
    )


def mean_spacing(df: DataFrame, entity: Sequence[str], x: str) -> DataFrame:
    """Mean distance of neighbouring points: the span over the number of gaps, no ordering needed."""
    gaps = F.count(x) - 1
    return df.groupBy(*entity).agg(F.try_divide(F.max(x) - F.min(x), gaps.cast("double")).alias("spacing"))
