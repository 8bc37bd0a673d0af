"""Exact order statistics without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costweave.operators.attach import attach, measure
from costweave.operators.reshape import to_long
from costweave.session import cut_lineage

ACCURACY = 100000
#: Values of a bracket that one task may order; wider brackets are narrowed first.
ORDERED_MOST = 1_000_000
#: Cells into which a round of narrowing cuts a bracket.
CELLS = 256


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = ACCURACY,
    most: int = ORDERED_MOST,
) -> DataFrame:
    """Linearly interpolated quantiles ``q0, q1, ..`` of a column, per group, and the count ``n``.

    A sketch of bounded size, run at once and stored, first brackets every wanted rank between two values. Rows get
    their group's brackets by ``attach``, so they are not shuffled by group. In the second pass the values inside
    a bracket are counted one by one, all values below it collapse into one counted row and all values above it into
    another, both before the shuffle. While a bracket may hold more than ``most`` different values, rounds of
    counting by interval narrow it; the running count over what is left gives exact ranks. The neighbours
    just outside a bracket are kept as well. A rank outside all that would be an error and fails the query. Missing
    values are left out; a table without values has no groups.
    """
    by, probs = list(by), [float(p) for p in probs]
    v = F.col(value).cast("double")
    rows = df.select(*by, v.alias("__v")).where("__v is not null and not isnan(__v)")
    slack = 4.0 / accuracy
    edges = [edge for p in probs for edge in (max(p - slack, 0.0), min(p + slack, 1.0))]
    sketch = cut_lineage(
        rows.groupBy(*by).agg(
            F.struct(F.count(F.lit(1)).alias("n"), F.percentile_approx("__v", edges, accuracy).alias("e")).alias("__s")
        )
    )
    size = measure(sketch, F.max("__s.n").alias("largest"))
    known = attach(rows, sketch, by, size=size.bytes)
    brackets = ", ".join(
        f"named_struct('i', {i}, 'low', __s.e[{2 * i}], 'high', __s.e[{2 * i + 1}], 'place', (__s.n - 1) * {p!r}D)"
        for i, p in enumerate(probs)
    )
    slots = (
        known.select(*by, "__v", F.expr("__s.n").alias("__n"), F.explode(F.expr(f"array({brackets})")).alias("__b"))
        .withColumn("__side", F.expr("CASE WHEN __v < __b.low THEN -1 WHEN __v > __b.high THEN 1 ELSE 0 END"))
        .withColumn("__slot", F.expr("CASE WHEN __side = 0 THEN __v END"))
        .groupBy(*by, "__b.i", "__side", "__slot")
        .agg(
            F.count(F.lit(1)).alias("__k"),
            F.min("__v").alias("__min"),
            F.max("__v").alias("__max"),
            F.max("__n").alias("__n"),
            F.max("__b.place").alias("__place"),
        )
    )
    # the sketch errs by 1 / accuracy at either edge
    if (size.largest or 0) * (2.0 * slack + 2.0 / accuracy) > most:
        slots = _narrowed(cut_lineage(slots), by, most)
    w = Window.partitionBy(*by, "i").orderBy("__side", "__slot")
    placed = slots.withColumn("__before", F.sum("__k").over(w) - F.col("__k"))

    def at(rank: str) -> str:
        inside = f"{rank} >= __before AND {rank} < __before + __k"
        exact = f"""CASE WHEN __side = 0 THEN __slot
            WHEN __side = -1 AND {rank} = __before + __k - 1 THEN __max
            WHEN __side = 1 AND {rank} = __before THEN __min
            ELSE raise_error('quantile rank outside its bracket') END"""
        return f"max(CASE WHEN {inside} THEN {exact} END)"

    picked = placed.groupBy(*by, "i").agg(
        F.max("__n").alias("n"),
        F.max("__place").alias("__place"),
        F.expr(at("floor(__place)")).alias("__lo"),
        F.expr(at("ceil(__place)")).alias("__hi"),
    )
    quantile = F.expr("__lo + (__place - floor(__place)) * (__hi - __lo)")
    if len(probs) == 1:
        return picked.select(*by, "n", quantile.alias("q0"))
    return picked.groupBy(*by).agg(
        F.max("n").alias("n"), *[F.max(F.when(F.col("i") == i, quantile)).alias(f"q{i}") for i in range(len(probs))]
    )


def _narrowed(slots: DataFrame, by: Sequence[str], most: int) -> DataFrame:
    """Counted values of brackets, narrowed until none holds more than ``most`` different ones.

    A round cuts each bracket at ``CELLS`` values of about equal rank among its different values, counts the rows of
    the cells, and keeps the one or two cells that hold the wanted ranks; the others join the sides.
    """
    key = [*by, "i"]
    fractions = [k / CELLS for k in range(1, CELLS)]
    while True:
        inside = slots.where("__side = 0").groupBy(*key)
        cuts = inside.agg(F.percentile_approx("__slot", fractions, 10 * CELLS).alias("__cuts"), F.count(F.lit(1)).alias("__held"))
        cuts = cut_lineage(cuts)
        size = measure(cuts, F.max("__held").alias("held"))
        if (size.held or 0) <= most:
            return slots
        cell = F.expr(
            f"CASE WHEN __side = 0 THEN size(filter(__cuts, c -> c <= __slot)) WHEN __side < 0 THEN -1 ELSE {CELLS} END"
        )
        placed = attach(slots, cuts, key, "left", size=size.bytes).withColumn("__cell", cell).drop("__cuts", "__held")
        cells = placed.groupBy(*key, "__cell").agg(F.sum("__k").alias("__k"), F.max("__place").alias("__place"))
        before = F.sum("__k").over(Window.partitionBy(*key).orderBy("__cell")) - F.col("__k")  # at most CELLS + 2 rows
        wanted = cells.withColumn("__before", before).where(
            "__before <= ceil(__place) AND __before + __k > floor(__place)"
        )
        ends = wanted.groupBy(*key).agg(F.min("__cell").alias("__from"), F.max("__cell").alias("__to"))
        sides = F.expr("CASE WHEN __side <> 0 THEN __side WHEN __cell < __from THEN -1 WHEN __cell > __to THEN 1 ELSE 0 END")
        kept = attach(placed, ends, key).withColumn("__side", sides)
        slots = cut_lineage(
            kept.groupBy(*key, "__side", F.expr("CASE WHEN __side = 0 THEN __slot END").alias("__slot")).agg(
                F.sum("__k").alias("__k"),
                F.min("__min").alias("__min"),
                F.max("__max").alias("__max"),
                F.max("__n").alias("__n"),
                F.max("__place").alias("__place"),
            )
        )


def exact_median(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Median per group, missing values left out."""
    return exact_quantiles(df, value, [0.5], by).withColumnRenamed("q0", "median")


def exact_medians(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Medians of several columns at once, one row per group."""
    by = list(by)
    doubles = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    middles = exact_median(to_long(doubles, by, columns, "__c", "__value"), "__value", [*by, "__c"])
    return middles.groupBy(*by).agg(*[F.max(F.when(F.col("__c") == c, F.col("median"))).alias(c) for c in columns])


def approximate_median(df: DataFrame, value: str, by: Sequence[str] = (), accuracy: int = 10000) -> DataFrame:
    """Median to a rank error of 1/accuracy, in one pass."""
    return df.groupBy(*by).agg(F.percentile_approx(value, 0.5, accuracy).alias("median"))
