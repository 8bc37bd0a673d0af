"""Gap filling and group measures attached to rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costweave.functions.scalars import fill
from costweave.operators.attach import attach
from costweave.operators.quantiles import exact_medians
from costweave.params import CostParams


def fill_constants(df: DataFrame, values: Mapping[str, object], suffix: str = "_filled") -> DataFrame:
    """Adds ``<column>_filled`` with missing values replaced."""
    return df.withColumns({c + suffix: fill(F.col(c), v) for c, v in values.items()})


def attribute_fills(params: CostParams) -> dict[str, float]:
    return {
        "abundance": params.fill_abundance,
        "gene_length": params.fill_gene_length,
        "protein_length": params.fill_protein_length,
        "seq_opportunity": params.fill_seq_opportunity,
        "seq_direct": params.fill_seq_direct,
    }


def fill_attributes(df: DataFrame, params: CostParams) -> DataFrame:
    """Fills the attribute columns that are present with the constants of the model."""
    return fill_constants(df, {c: v for c, v in attribute_fills(params).items() if c in df.columns})


def fill_median(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), mode: str = "fill", suffix: str = "_filled"
) -> DataFrame:
    """Median of the column, over the table or per group, as the filler.

    ``mode='fill'`` fills the gaps; ``mode='replace'`` overwrites every value with the median.
    """
    if mode not in ("fill", "replace"):
        raise ValueError(mode)
    medians = exact_medians(df, columns, by)
    if by:
        known = medians.select(*by, F.struct(*columns).alias("__m"))
        df = attach(df, known, by, "left")
    else:
        df = df.withColumn("__m", medians.select(F.struct(*columns)).scalar())
    middles = {c: F.col(f"__m.{c}") for c in columns}
    return df.withColumns(
        {c + suffix: F.coalesce(F.col(c), m) if mode == "fill" else m for c, m in middles.items()}
    ).drop("__m")


def attach_group_size(df: DataFrame, by: Sequence[str], out: str = "group_size") -> DataFrame:
    """Rows of the group on every row of it.

    Counted with map-side combine and attached by measured size, so a hot group does not meet in one task.
    """
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias(out))
    return attach(df, sizes, by, "left")
