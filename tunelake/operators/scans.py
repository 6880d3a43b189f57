"""Exact running values, ranks and order statistics for groups of any size.

A plain window sends a whole group to one task. Here the ordering axis is cut into blocks by
a fixed monotone function, block totals are aggregated (map-side combined), carried over the
few blocks of a group, and only a block is ever sorted in one task. A run that holds a third
of all rows is therefore spread over many tasks, and the result is the plain window's result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 65536


@dataclass(frozen=True)
class Measure:
    """A running value: how it combines, what it reads, and whether the row itself counts."""

    kind: str
    value: Column
    inclusive: bool = True


def total(value: Column, inclusive: bool = True) -> Measure:
    return Measure("sum", value, inclusive)


def peak(value: Column, inclusive: bool = True) -> Measure:
    return Measure("max", value, inclusive)


def lowest(value: Column, inclusive: bool = True) -> Measure:
    return Measure("min", value, inclusive)


def latest(value: Column, inclusive: bool = True) -> Measure:
    """The last non-null value so far."""
    return Measure("last", value, inclusive)


def number_block(value: Column, size: int = BLOCK_ROWS) -> Column:
    """Block of a dense integer axis such as a position or a generation."""
    return F.floor(value / F.lit(size)).cast("long")


def value_block(value: Column) -> Column:
    """Monotone block of any finite number: 64 blocks per power of two of its magnitude."""
    number = value.cast("double")
    return F.floor(F.signum(number) * F.log2(F.lit(1.0) + F.abs(number) * F.lit(1048576.0)) * F.lit(64.0)).cast(
        "long"
    )


def running(
    frame: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    measures: dict[str, Measure],
) -> DataFrame:
    """Add running measures along ``order`` (ascending, a total order) within ``keys``.

    ``block`` must not decrease along ``order``.
    """
    keys, order = list(keys), list(order)
    names = list(measures)
    staged = frame.withColumn("_block", block)
    for name, measure in measures.items():
        staged = staged.withColumn(f"_in_{name}", measure.value)

    partials = []
    for name, measure in measures.items():
        value = F.col(f"_in_{name}")
        if measure.kind == "last":
            stamped = F.when(value.isNotNull(), F.struct(*order, value.alias("_v")))
            partials.append(F.max(stamped)["_v"].alias(f"_part_{name}"))
        else:
            partials.append(getattr(F, measure.kind)(value).alias(f"_part_{name}"))
    over_blocks = (
        Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = (
        staged.groupBy(*keys, "_block")
        .agg(*partials)
        .select(
            *keys,
            "_block",
            *[
                (
                    F.last(f"_part_{n}", ignorenulls=True)
                    if measures[n].kind == "last"
                    else getattr(F, measures[n].kind)(f"_part_{n}")
                )
                .over(over_blocks)
                .alias(f"_carry_{n}")
                for n in names
            ],
        )
    )

    in_block = Window.partitionBy(*keys, "_block").orderBy(*order)
    joined = staged.join(carry, [*keys, "_block"])
    columns = []
    for name, measure in measures.items():
        frame_end = 0 if measure.inclusive else -1
        window = in_block.rowsBetween(Window.unboundedPreceding, frame_end)
        before, value = F.col(f"_carry_{name}"), F.col(f"_in_{name}")
        if measure.kind == "sum":
            result = F.coalesce(before, F.lit(0)) + F.coalesce(F.sum(value).over(window), F.lit(0))
        elif measure.kind == "max":
            result = F.greatest(before, F.max(value).over(window))
        elif measure.kind == "min":
            first = F.min(value).over(window)
            result = F.coalesce(F.when(before <= first, before), first, before)
        else:
            result = F.coalesce(F.last(value, ignorenulls=True).over(window), before)
        columns.append(result.alias(name))
    kept = [F.col(c) for c in frame.columns if c not in measures]
    return joined.select(*kept, *columns)


def as_of(
    points: DataFrame,
    series: DataFrame,
    keys: Sequence[str],
    axis: str,
    payload: Sequence[str],
    block: Callable[[Column], Column],
    tie: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """Give each point the payload of the last series row at or before it on ``axis``.

    Both sides are merged on the axis and scanned once; no pairs are formed. ``tie`` orders
    series rows that share an axis value. Points without an earlier row get nulls. With
    ``strict`` only series rows before the point count.
    """
    keys = list(keys)
    order_tie = F.col(tie) if tie else F.lit(0).cast("long")
    left = series.select(
        *keys,
        axis,
        F.lit(0).alias("_side"),
        order_tie.cast("long").alias("_tie"),
        F.struct(*payload).alias("_payload"),
        *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns if c not in (*keys, axis)],
    )
    empty = F.lit(None).cast(left.schema["_payload"].dataType)
    right = points.select(
        *keys,
        F.col(axis).cast(series.schema[axis].dataType).alias(axis),
        F.lit(-1 if strict else 1).alias("_side"),
        F.lit(0).cast("long").alias("_tie"),
        empty.alias("_payload"),
        *[c for c in points.columns if c not in (*keys, axis)],
    )
    merged = running(
        left.unionByName(right),
        keys,
        [axis, "_side", "_tie"],
        block(F.col(axis)),
        {"_seen": latest(F.col("_payload"))},
    )
    return merged.filter("_side <> 0").select(
        *points.columns, *[F.col(f"_seen.{c}").alias(c) for c in payload]
    )


def order_statistics(
    frame: DataFrame,
    keys: Sequence[str],
    value: str,
    picks: dict[str, Callable[[Column], Column]],
) -> DataFrame:
    """Exact k-th smallest values per group from a map-side combined value histogram.

    ``picks`` maps an output name to a function from the group size to a 1-based position.
    Adds ``samples``. Nulls are not samples. No group is sorted in one task.
    """
    keys = list(keys)
    histogram = (
        frame.filter(F.col(value).isNotNull())
        .groupBy(*keys, value_block(F.col(value)).alias("_block"), F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    over_blocks = Window.partitionBy(*keys).orderBy("_block")
    blocks = (
        histogram.groupBy(*keys, "_block")
        .agg(F.sum("_n").alias("_rows"))
        .select(
            *keys,
            "_block",
            "_rows",
            F.coalesce(
                F.sum("_rows").over(over_blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("_before"),
            F.sum("_rows").over(Window.partitionBy(*keys)).alias("_size"),
        )
    )
    # Only blocks that hold a wanted position are looked into.
    wanted = F.lit(False)
    for position in picks.values():
        place = position(F.col("_size"))
        wanted = wanted | ((place > F.col("_before")) & (place <= F.col("_before") + F.col("_rows")))
    blocks = blocks.filter(wanted).drop("_rows")
    in_block = (
        Window.partitionBy(*keys, "_block").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    )
    cumulative = histogram.join(blocks, [*keys, "_block"]).select(
        *keys, "_v", "_size", (F.col("_before") + F.sum("_n").over(in_block)).alias("_upto")
    )
    size = F.col("_size")
    return cumulative.groupBy(*keys).agg(
        F.max("_size").alias("samples"),
        *[
            F.min(F.when(F.col("_upto") >= position(size), F.col("_v"))).alias(name)
            for name, position in picks.items()
        ],
    )


def floor_rank(share: float) -> Callable[[Column], Column]:
    """Floor nearest rank: element ``min(n - 1, int(n * share))`` counted from zero."""
    return lambda n: F.least(n, F.floor(n * F.lit(float(share))).cast("long") + 1)


def ceil_rank(share: float) -> Callable[[Column], Column]:
    """Ceil nearest rank: element ``ceil(n * share)`` counted from one."""
    return lambda n: F.greatest(F.lit(1), F.least(n, F.ceil(n * F.lit(float(share))).cast("long")))


def ranked(
    frame: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    tie: str,
    name: str = "rank",
) -> DataFrame:
    """Exact 1-based rank by numeric ``order`` columns, then by the integer column ``tie``.

    Rows with equal order values form one cell per block of ``tie``; cells are counted with
    map-side combine and scanned, so a group of identical scores is spread as well.
    """
    keys = list(keys)
    values = [f"_v{i}" for i in range(len(order))]
    staged = frame.select(
        *frame.columns,
        *[column.alias(v) for column, v in zip(order, values)],
        number_block(F.col(tie)).alias("_t"),
    )
    cell = [*values, "_t"]
    counts = staged.groupBy(*keys, *cell).agg(F.count(F.lit(1)).alias("_n"))
    starts = running(
        counts, keys, cell, value_block(F.col(values[0])), {"_before": total(F.col("_n"), inclusive=False)}
    ).select(*keys, *cell, "_before")
    in_cell = Window.partitionBy(*keys, *cell).orderBy(tie)
    return staged.join(starts, [*keys, *cell]).select(
        *frame.columns, (F.col("_before") + F.row_number().over(in_cell)).cast("long").alias(name)
    )


def numbered(
    frame: DataFrame, keys: Sequence[str], order: str, name: str = "ordinal", block: Column | None = None
) -> DataFrame:
    """0-based position along a unique integer column within ``keys``."""
    cut = number_block(F.col(order)) if block is None else block
    return running(
        frame, keys, [order], cut, {name: total(F.lit(1).cast("long"), inclusive=False)}
    )


def spread_hot(
    rows: DataFrame, keys: Sequence[str], seq: str, hot_rows: int = 1 << 20
) -> tuple[DataFrame, DataFrame]:
    """Salt the rows of heavy keys for a join: returns the salted rows and the key sizes.

    A key with more than ``hot_rows`` rows is split over as many salts as it has multiples of
    that size. There can be no more than ``rows / hot_rows`` such keys, which bounds what is
    broadcast. The other side is multiplied with :func:`meet_hot`.
    """
    keys = list(keys)
    sizes = rows.groupBy(*keys).agg((F.floor(F.count(F.lit(1)) / hot_rows) + 1).cast("long").alias("_salts"))
    heavy = F.broadcast(sizes.filter("_salts > 1"))
    salted = rows.join(heavy, keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(seq), F.coalesce("_salts", F.lit(1).cast("long")))
    )
    return salted.drop("_salts"), sizes


def meet_hot(side: DataFrame) -> DataFrame:
    """Repeat each row of a side carrying ``_salts`` once per salt of its key."""
    return side.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)))


def top_rows(
    frame: DataFrame, keys: Sequence[str], order: Sequence[Column], count: int, name: str | None = None
) -> DataFrame:
    """First ``count`` rows per group; the rank filter is applied before the shuffle as well."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    kept = frame.withColumn("_rank", rank).filter(F.col("_rank") <= count)
    return kept.withColumnRenamed("_rank", name) if name else kept.drop("_rank")


def slots(groups: DataFrame, count: Column, name: str = "slot", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows 0 .. count-1 for each group row, generated in blocks that are spread first."""
    last_block = F.floor((count - 1) / F.lit(block_rows)).cast("long")
    cut = groups.withColumn("_count", count.cast("long")).filter("_count > 0")
    spread = cut.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last_block)))
    spread = spread.repartition("_block", *groups.columns[:1])
    first = F.col("_block") * block_rows
    final = F.least(first + block_rows, F.col("_count")) - 1
    return spread.withColumn(name, F.explode(F.sequence(first, final))).drop("_block", "_count")
