"""Straight lines by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def linear_fit(df: DataFrame, by: Sequence[str], x: str, y: str, digits: int = 2) -> DataFrame:
    """Slope, intercept, R2 and the equation as text. One aggregate, combined before the shuffle."""
    fitted = df.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )
    text = F.format_string(f"y = %.{digits}f + %.{digits}f x", F.col("intercept"), F.col("slope"))
    return fitted.withColumn("equation", F.when(F.col("slope").isNotNull(), text))
