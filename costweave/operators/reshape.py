"""Wide to long and back, tagged unions, baseline correction, binning, differences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costweave.functions.scalars import clamp_negative


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def columns_between(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` in table order, both included."""
    names = df.columns
    return names[names.index(first) : names.index(last) + 1]


def columns_at(df: DataFrame, first: int, last: int) -> list[str]:
    """Names by place, counted from 1, both ends included."""
    return df.columns[first - 1 : last]


def columns_except(df: DataFrame, *names: str) -> list[str]:
    return [c for c in df.columns if c not in names]


def widen(
    df: DataFrame, entity: str | Sequence[str], key: Column, value: Column, labels: Mapping[str, object]
) -> DataFrame:
    """One row per entity, one summed column per label. One shuffle on the entity, with map-side combine.

    A key that no label lists fails the query: its values would be lost without a word.
    """
    entities = [entity] if isinstance(entity, str) else list(entity)
    unknown = F.raise_error(F.concat(F.lit("no label lists the key "), key.cast("string")))
    listed = F.when(key.isNull() | key.isin(list(labels.values())), value).otherwise(unknown.cast("double"))
    keyed = df.select(*entities, key.alias("__key"), listed.alias("__value"))
    return keyed.groupBy(*entities).agg(
        *[F.sum(F.when(F.col("__key") == F.lit(v), F.col("__value"))).alias(name) for name, v in labels.items()]
    )


def to_long(
    df: DataFrame,
    ids: Sequence[str],
    columns: Sequence[str],
    name: str = "time",
    value: str = "value",
    labels: Mapping[str, object] | None = None,
) -> DataFrame:
    """Columns to rows, labelled with their name or with ``labels``.

    Done with a generator rather than ``unpivot``, because a generator keeps the partitioning of its input: a window
    or join on the entity that follows needs no further shuffle.
    """
    pairs = ", ".join(f"{_literal(labels[c] if labels else c)}, `{c}`" for c in columns)
    return df.select(*ids, F.expr(f"stack({len(columns)}, {pairs}) AS (`{name}`, `{value}`)"))


def _literal(label) -> str:
    if isinstance(label, str):
        return "'" + label.replace("'", "\\'") + "'"
    return f"{label}L" if isinstance(label, int) else repr(label)


def first_positive(columns: Sequence[str], labels: Mapping[str, object]) -> Column:
    """Label of the first column, in the order given, whose value is above zero: first appearance in a wide row."""
    return F.coalesce(*[F.when(F.col(c) > 0, F.lit(labels[c])) for c in columns])


def tagged_union(frames: Mapping[str, DataFrame], tag: str = "source") -> DataFrame:
    """All rows of all frames, each with the name of its frame."""
    out = None
    for label, frame in frames.items():
        tagged = frame.withColumn(tag, F.lit(label))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def subtract_baseline(df: DataFrame, columns: Sequence[str], baseline: str, clamp: bool = True) -> DataFrame:
    """Every column minus the original baseline column; negatives to zero when ``clamp``."""
    base = F.coalesce(F.col(baseline), F.lit(0.0))
    out = {}
    for c in columns:
        shifted = F.coalesce(F.col(c), F.lit(0.0)) - base
        out[c] = clamp_negative(shifted) if clamp else shifted
    return df.withColumns(out)


def sum_bins(df: DataFrame, bins: Mapping[str, Sequence[str]], keep: Sequence[str]) -> DataFrame:
    """Each bin is the sum of its columns within the row."""
    sums = [sum((F.col(c) for c in members[1:]), F.col(members[0])).alias(name) for name, members in bins.items()]
    return df.select(*keep, *sums)


def column_steps(df: DataFrame, steps: Sequence[tuple[str, str, str]], keep: Sequence[str]) -> DataFrame:
    """Differences of column pairs: (label, later, earlier)."""
    return df.select(*keep, *[(F.col(b) - F.col(a)).alias(label) for label, b, a in steps])


def series_steps(df: DataFrame, entity: Sequence[str], order: str, value: str, out: str = "step") -> DataFrame:
    """Difference to the previous point of the same entity.

    ``df`` holds one row per (entity, order), so a group is as long as the course has points.
    """
    w = Window.partitionBy(*entity).orderBy(order)
    return df.withColumn(out, F.col(value) - F.lag(value).over(w))


def fold_bucket(df: DataFrame, bucket: str, first, into, keys: Sequence[str], value: str) -> DataFrame:
    """Move the rows of one bucket into another and sum again."""
    moved = F.when(F.col(bucket) == F.lit(first), F.lit(into)).otherwise(F.col(bucket))
    return df.withColumn(bucket, moved).groupBy(bucket, *keys).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(value))
