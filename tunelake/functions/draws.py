"""Random draws that depend only on their key.

A draw hashes its key, so any partitioning, retry or replay yields the same value and another
SQL engine can compute it too. ``rand()`` and generated row ids are never used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: 13 hexadecimal digits are 52 random bits.
_SPAN = float(2**52)


def uniform(seed: int, purpose: str, *key: Column) -> Column:
    """Uniform number in [0, 1) for the key."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(_SPAN)


def integer(draw: Column, low: Column, high: Column) -> Column:
    """Uniform integer between both bounds, inclusive."""
    return low + F.floor(draw * (high - low + 1))


def normal(first: Column, second: Column) -> Column:
    """Standard normal number from two uniform draws."""
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - first)) * F.cos(F.lit(2.0 * math.pi) * second)


def choice(draw: Column, options: Column) -> Column:
    """Uniform element of a non-empty array."""
    return F.get(options, F.floor(draw * F.size(options)).cast("int"))


def distinct_positions(draws: list[Column], size: Column) -> list[Column]:
    """Pairwise different positions in [0, size): each draw skips the ones already taken.

    The k-th raw position is drawn from ``size - k`` free places and moved past every taken
    place at or below it, in ascending order.
    """
    taken: list[Column] = []
    for index, draw in enumerate(draws):
        place = F.floor(draw * (size - index)).cast("long")
        if taken:
            ordered = F.array_sort(F.array(*taken))
            place = F.aggregate(ordered, place, lambda spot, used: F.when(spot >= used, spot + 1).otherwise(spot))
        taken.append(place)
    return taken
