"""Process-cost accounting on Spark DataFrames."""

from costweave.params import CostParams

__all__ = ["CostParams"]
