"""Small tables joined to large ones, whatever their size turns out to be."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from costweave.operators.resolve import null_safe_join
from costweave.session import cut_lineage

#: A table is sent to every task while its measured size is below this.
BROADCAST_BYTES = 32 << 20
#: A key with more than a thousandth of the rows is hot, so there are less than a thousand hot keys.
HOT_SHARE = 1000
#: Tasks among which the rows of a hot key are dealt out.
SALTS = 64


def measure(small: DataFrame, *more: Column) -> Row:
    """``bytes`` that the rows take as text, and further aggregates, in one job."""
    size = F.octet_length(F.to_json(F.struct(*small.columns))).cast("long")
    return small.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), *more).first()


def attach(
    df: DataFrame,
    small: DataFrame,
    by: Sequence[str],
    how: str = "inner",
    size: int | None = None,
    most: int = BROADCAST_BYTES,
) -> DataFrame:
    """Adds the columns of ``small``, which has one row per key, to the rows of ``df``; missing keys match.

    ``small`` is stored and measured first. Up to ``most`` bytes it is broadcast and no row of ``df`` moves. Beyond,
    both sides are shuffled, and the rows of hot keys are dealt out by a digest of the row, the key's row of ``small``
    being copied to each share. A caller that has stored and measured the table itself gives its ``size``. Without keys ``small`` is
    a single row, and its columns are missing if there is none.
    """
    by = list(by)
    if not by:
        row = small.select(F.struct(*small.columns)).scalar()
        return df.withColumn("__row", row).select(*df.columns, *[F.col(f"__row.{c}").alias(c) for c in small.columns])
    if size is None:
        small = cut_lineage(small)
        size = measure(small).bytes
    if size <= most:
        return null_safe_join(df, F.broadcast(small), by, how)
    return attach_salted(df, small, by, how)


def attach_salted(df: DataFrame, small: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """The shuffled form of ``attach``."""
    sizes = cut_lineage(df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")))
    total = sizes.agg(F.sum("__n")).scalar()
    # bounded by its condition: fewer than HOT_SHARE rows
    hot = sizes.where(F.col("__n") * HOT_SHARE > total).select(*by, F.lit(SALTS).alias("__salts"))
    digested = [f.name for f in df.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    salts = F.coalesce("__salts", F.lit(1))
    dealt = null_safe_join(df.withColumn("__digest", F.xxhash64(*digested)), F.broadcast(hot), by, "left")
    dealt = dealt.withColumn("__salt", F.pmod("__digest", salts).cast("int")).drop("__salts", "__digest")
    copies = null_safe_join(small, F.broadcast(hot), by, "left")
    copies = copies.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return null_safe_join(dealt, copies, [*by, "__salt"], how).drop("__salt")
