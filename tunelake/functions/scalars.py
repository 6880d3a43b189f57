"""Scalar rules shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, value))


def half_even(value: Column) -> Column:
    """Round to the nearest integer, ties to even."""
    return F.rint(value)


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def ratio(top: Column, bottom: Column, default: float | None = 0.0) -> Column:
    """Quotient with a default when the divisor is not positive."""
    return F.when(bottom > 0, top.cast("double") / bottom).otherwise(F.lit(default).cast("double"))


def nearly_equal(left: Column, right: Column) -> Column:
    """Equality up to one part in a thousand million."""
    return F.abs(left - right) <= F.lit(1e-9) * F.greatest(F.abs(left), F.abs(right))


def slug(text: Column) -> Column:
    """Lower-case text with runs of other characters folded to one underscore."""
    folded = F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_")
    return F.regexp_replace(folded, "^_+|_+$", "")


def seed_list(text: Column) -> Column:
    """Integers of a comma-separated list; blanks are dropped."""
    parts = F.filter(F.transform(F.split(text, ","), lambda part: F.trim(part)), lambda part: part != "")
    return F.transform(parts, lambda part: part.cast("int"))


def strict_number(text: Column) -> Column:
    """Number written in text, or null for anything else (``true`` and ``false`` included)."""
    return F.when(~F.lower(F.trim(text)).isin("true", "false"), text.try_cast("double"))
