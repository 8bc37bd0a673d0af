"""Column builders for the scalar functions of the cost model. Everything stays in generated JVM code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def letter_count(text: Column, letter: str) -> Column:
    """How often one letter occurs in a text."""
    return F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))


def pattern_count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def strip_letters(text: Column, letters: str = "[A-Za-z]") -> Column:
    """``t4`` to ``4``, ``H2.5`` to ``2.5``."""
    return F.regexp_replace(text, letters, "")


def clamp_negative(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def fill(c: Column, value) -> Column:
    """Missing replaced by a constant or another column."""
    return F.coalesce(c, value if isinstance(value, Column) else F.lit(value))


def positive_log10(c: Column) -> Column:
    """log10 where it exists, else missing."""
    return F.when(c > 0, F.log10(c))


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100.0, whole)


def percent_label(name: Column, share: Column, digits: int = 1) -> Column:
    """``transcription 17.6 %``."""
    return F.concat(name, F.lit(" "), F.format_string(f"%.{digits}f", share), F.lit(" %"))


def scientific_label(c: Column, digits: int = 1) -> Column:
    """``1.2 x 10^+09``."""
    return F.replace(F.format_string(f"%.{digits}e", c), F.lit("e"), F.lit(" x 10^"))


def lookup(key: Column, pairs: Mapping[object, object] | Sequence[tuple[object, object]]) -> Column:
    """Label from a fixed list written in the program; keys not listed give missing."""
    pairs = list(pairs.items()) if isinstance(pairs, Mapping) else list(pairs)
    return F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in pairs])


def ordinal(key: Column, levels: Sequence[str]) -> Column:
    """Place of a category in its fixed level order, from 1."""
    return lookup(key, [(level, i + 1) for i, level in enumerate(levels)])


def band(c: Column, bands: Sequence[tuple[str, float | None, float | None]]) -> Column:
    """Name of the open interval a value lies in; a value in none has no band."""
    out = None
    for name, low, high in bands:
        inside = F.lit(True)
        if low is not None:
            inside = inside & (c > low)
        if high is not None:
            inside = inside & (c < high)
        out = F.when(inside & c.isNotNull(), name) if out is None else out.when(inside & c.isNotNull(), name)
    return out


def half_up(c: Column, digits: int) -> Column:
    """Round half up by plain double arithmetic, the same in every engine.

    From 2^53 on a double has no digits after the point to round, and a long could not hold it: it stays as it is.
    """
    scale = float(10**digits)
    scaled = c.cast("double") * F.lit(scale)
    rounded = F.floor(scaled + F.lit(0.5)).cast("double") / F.lit(scale)
    return F.when(F.abs(scaled) >= F.lit(float(2**53)), c.cast("double")).otherwise(rounded)


def regular_grid(first: int, last: int, per_unit: int) -> Column:
    """Array of the points first, first + 1/per_unit, .., last."""
    steps = F.sequence(F.lit(first * per_unit), F.lit(last * per_unit))
    return F.transform(steps, lambda k: k.cast("double") / F.lit(float(per_unit)))
