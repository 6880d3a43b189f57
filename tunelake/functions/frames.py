"""Small helpers on whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def table_union(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of tables with the same columns, in any order of columns."""
    return reduce(DataFrame.unionByName, frames)
