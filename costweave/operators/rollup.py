"""Aggregates with the two treatments of missing values, shares, breakdowns, budgets, bands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costweave.functions.scalars import percent, positive_log10
from costweave.operators.costs import COST_COLUMNS, KINDS, PROCESSES, cost_long, sum_costs


def loose_sum(c) -> Column:
    """Sum that skips missing values; nothing at all sums to 0."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def strict_sum(c) -> Column:
    """Sum that is missing as soon as one value is."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def strict_mean(c) -> Column:
    """Mean that is missing as soon as one value is."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def scaled_thresholds(df: DataFrame, score: str, of_mean: Mapping[str, float], of_max: Mapping[str, float]) -> DataFrame:
    """Thresholds as fractions of the mean and of the largest score, in one pass."""
    return df.agg(
        *[(F.avg(score) * F.lit(k)).alias(name) for name, k in of_mean.items()],
        *[(F.max(score) * F.lit(k)).alias(name) for name, k in of_max.items()],
    )


def share_of_total(df: DataFrame, value: str, out: str = "share") -> DataFrame:
    """Each value in percent of the column total, the total being a scalar subquery rather than a global window."""
    whole = df.agg(F.sum(value)).scalar()
    return df.withColumn(out, percent(F.col(value), whole))


def append_rows(df: DataFrame, rows: Sequence[tuple]) -> DataFrame:
    """Literal rows added below an aggregate."""
    extra = df.sparkSession.createDataFrame(list(rows), df.schema)
    return df.unionByName(extra)


def rollup_costs(costed: DataFrame, keys: Sequence[str], by: Sequence[str] = ("process", "kind")) -> DataFrame:
    """Cost per keys and, as asked, process and kind.

    Six partial sums per key cross the shuffle; the measures become rows only after the reduction.
    """
    return cost_long(sum_costs(costed, keys), keys, by)


def process_breakdown(
    costed: DataFrame,
    genome_total: float,
    membrane_total: float,
) -> DataFrame:
    """Cost and percent share of each process.

    Replication of the whole genome is split into the part of the entities at hand and the rest.
    """
    sums = sum_costs(costed)
    part = F.col("replication_opportunity") + F.col("replication_direct")
    rows = F.array(
        F.struct(F.lit("replication_partial").alias("process"), part.alias("cost")),
        F.struct(F.lit("replication_rest").alias("process"), (F.lit(genome_total) - part).alias("cost")),
        F.struct(
            F.lit("transcription").alias("process"),
            (F.col("transcription_opportunity") + F.col("transcription_direct")).alias("cost"),
        ),
        F.struct(
            F.lit("translation").alias("process"),
            (F.col("translation_opportunity") + F.col("translation_direct")).alias("cost"),
        ),
        F.struct(F.lit("membrane").alias("process"), F.lit(membrane_total).alias("cost")),
    )
    whole = F.aggregate(F.transform("rows", lambda r: r["cost"]), F.lit(0.0), lambda a, x: a + x)
    return (
        sums.select(rows.alias("rows"))
        .select(F.explode("rows").alias("r"), whole.alias("whole"))
        .select("r.process", "r.cost", percent(F.col("r.cost"), F.col("whole")).alias("share"))
    )


def kind_share(costed: DataFrame, constants: Mapping[str, float]) -> DataFrame:
    """Opportunity against direct, constants such as genome and septum included."""
    sums = sum_costs(costed)
    rows = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                (
                    F.col(f"replication_{kind}")
                    + F.col(f"transcription_{kind}")
                    + F.col(f"translation_{kind}")
                    + F.lit(float(constants[kind]))
                ).alias("cost"),
            )
            for kind in ("opportunity", "direct")
        ]
    )
    whole = F.aggregate(F.transform("rows", lambda r: r["cost"]), F.lit(0.0), lambda a, x: a + x)
    return (
        sums.select(rows.alias("rows"))
        .select(F.explode("rows").alias("r"), whole.alias("whole"))
        .select("r.kind", "r.cost", percent(F.col("r.cost"), F.col("whole")).alias("share"))
    )


def selected_rollup(costed: DataFrame, time: str, group: str, members: Sequence[str], value: Column) -> DataFrame:
    """Sum per (time, group), keep the listed groups, sum per group.

    The membership test is on a grouping key, so it is applied to the input rows.
    """
    return (
        costed.where(F.col(group).isin(*members))
        .groupBy(time, group)
        .agg(loose_sum(value).alias("cost"))
        .groupBy(group)
        .agg(F.sum("cost").alias("cost"))
    )


def band_costs(costed: DataFrame, band: str, leave_out: Sequence[str]) -> DataFrame:
    """Per band, process and kind: cost and its percent of all kept costs. A missing band is dropped with them."""
    sums = sum_costs(costed.where(~F.col(band).isin(*leave_out)), [band])
    return share_of_total(cost_long(sums, [band]), "cost", "ratio")


def budget_table(
    costs: DataFrame, category: str, reference_rows: Sequence[tuple[str, float]], budget: float
) -> DataFrame:
    """Category costs and literal reference rows, in percent of the cell budget and as log10."""
    return append_rows(costs.select(category, "cost"), reference_rows).select(
        category,
        "cost",
        percent(F.col("cost"), F.lit(budget)).alias("budget_share"),
        positive_log10(F.col("cost")).alias("log_cost"),
    )


def selection_long(costed: DataFrame, keys: Sequence[str], budget: float, factor: float) -> DataFrame:
    """Selection coefficient of every cost of an entity and its negative logarithm."""
    return _with_selection(cost_long(costed, keys), budget, factor)


def _with_selection(long: DataFrame, budget: float, factor: float) -> DataFrame:
    sc = F.col("cost") / F.lit(budget) * F.lit(factor)
    return long.withColumn("sc", sc).withColumn("ne", -positive_log10(F.col("sc")))


def selection_of_known(known: DataFrame, costed: DataFrame, key: str, budget: float, factor: float) -> DataFrame:
    """Rows of ``known`` with every selection coefficient of their entity; one row without costs where it has none.

    Joined while an entity is one row and made long afterwards. Spark sizes a table by its compressed files and does not
    see that a generator multiplies it, so a long side would be broadcast; the hint sends no side to the driver.
    """
    marked = costed.select(key, *COST_COLUMNS, F.lit(True).alias("__costed"))
    joined = known.join(marked.hint("merge"), key, "left")
    cells = [
        F.struct(F.lit(p).alias("process"), F.lit(k).alias("kind"), F.col(f"{p}_{k}").alias("cost"))
        for p in PROCESSES
        for k in KINDS
    ]
    long = joined.select(*known.columns, F.explode_outer(F.when(F.col("__costed"), F.array(*cells))).alias("__cell"))
    return _with_selection(long.select(*known.columns, "__cell.*"), budget, factor)


def presence_share(present: Column, places: Column) -> Column:
    """Percent of the places that an entity is present in."""
    return present.cast("double") / places.cast("double") * F.lit(100.0)


def phase_totals(costs: DataFrame, bucket: str, phases: Mapping[str, Sequence[str]], value: str = "cost") -> DataFrame:
    """Totals of named groups of intervals, chosen by interval label."""
    label = F.coalesce(*[F.when(F.col(bucket).isin(*members), F.lit(name)) for name, members in phases.items()])
    return (
        costs.withColumn("phase", label).where("phase is not null").groupBy("phase").agg(loose_sum(value).alias(value))
    )

