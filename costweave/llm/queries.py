"""Imports every operator of this subpackage, which registers its query."""

from costweave.llm import bpe, conversations, decontamination, language, mixing, quality, sharding, simhash, substrings, tokencount, tokenfiles, urls, whitening  # noqa: F401
from costweave.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
