"""Connected components of a large graph by alternating stars; edges never leave the tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelake.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    """Size and hash sums that tell whether a round changed anything."""
    mark = F.xxhash64("a", "b")
    row = edges.agg(F.count("*"), F.sum(F.shiftright(mark, 24)), F.sum(mark.bitwiseAND(F.lit((1 << 24) - 1)))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``a``, ``b``: every node that has a link, except the smallest of its component, with that smallest node.

    ``edges`` has long columns ``a`` and ``b``; direction, repeats and loops do not matter. In each round all
    larger neighbours of a node, then all smaller ones, are linked to the smallest node around it.
    Minima are written before they are joined, so that large neighbourhoods can be split by the join.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = cut_lineage(edges.filter("a <> b").select(high.alias("a"), low.alias("b")).distinct())
    before = _state(edges)
    if before[0] == 0:
        return edges
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")))
        larger = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        edges = cut_lineage(larger.distinct())
        least = cut_lineage(edges.groupBy("a").agg(F.min("b").alias("least")))
        pairs = F.array(
            F.struct(F.col("a"), F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b"))
        )
        smaller = edges.join(least, "a").select(F.explode(pairs).alias("pair")).select("pair.a", "pair.b")
        edges = cut_lineage(smaller.filter("a <> b").distinct())
        after = _state(edges)
        if after == before:
            return edges
        before = after
