"""Registered queries. Importing this package registers them all."""

from costweave.plans import courses, entities, models, resampling, sets  # noqa: F401
from costweave.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
