"""Ranked and comparison reports as numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def fixed(value: Column, digits: int) -> Column:
    """Number with a fixed count of decimals; unknown stays ``unknown``.

    The stored binary number itself is rounded (ties to even), not its shortest decimal text:
    its fraction is scaled to whole 2^-52 units and divided in exact decimals.
    """
    size = F.abs(value.cast("double"))
    whole = F.floor(size)
    units = (size - whole) * F.lit(float(2**52))
    scaled = F.floor(units).cast("decimal(17,0)") * F.lit(10**digits).cast("decimal(8,0)")
    unit = F.lit(2**52).cast("decimal(17,0)")
    part = F.floor(scaled / unit).cast("long")
    rest = scaled - part.cast("decimal(17,0)") * unit
    half = F.lit(2**51).cast("decimal(17,0)")
    sticky = units > F.floor(units)
    up = (rest > half) | ((rest == half) & (sticky | (part % 2 == 1)))
    raised = part + F.when(up, 1).otherwise(0)
    carried = raised >= 10**digits
    integer = (whole + F.when(carried, 1).otherwise(0)).cast("string")
    tail = F.concat(F.lit("."), F.lpad((raised % 10**digits).cast("string"), digits, "0")) if digits else F.lit("")
    sign = F.when(value < 0, "-").otherwise("")
    return F.when(value.isNull(), "unknown").otherwise(F.concat(sign, integer, tail))


def table_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("unknown"))


def ranked_strategy_rows(ranking: DataFrame) -> DataFrame:
    """Report rows of the ranked strategies."""
    return ranking.select(
        F.lit(1).alias("section"),
        F.col("rank").alias("position"),
        table_row(
            _text(F.col("rank")),
            F.col("run_name"),
            fixed(F.col("median_best_fitness_peak"), 6),
            fixed(F.col("mean_best_fitness_peak"), 6),
            fixed(F.col("median_evals_completed"), 1),
            fixed(F.col("mean_evals_completed"), 1),
            fixed(F.col("median_wall_clock_s"), 3),
            fixed(F.col("mean_wall_clock_s"), 3),
        ).alias("line"),
    )


def reference_rows(reference: DataFrame) -> DataFrame:
    """Report rows of the unranked reference runs; they follow the ranked ones."""
    return reference.filter("reference_only").select(
        F.lit(2).alias("section"),
        F.xxhash64("run_name").alias("position"),
        table_row(
            F.col("run_name"),
            fixed(F.col("best_peak"), 6),
            fixed(F.col("wall_clock_total_s"), 6),
            fixed(F.col("observed_jobs_per_sec"), 6),
            fixed(F.col("modeled_jobs_per_sec"), 6),
        ).alias("line"),
    )


def seed_rows(listing: DataFrame) -> DataFrame:
    """Report rows of the single seeds in rank order."""
    return listing.select(
        F.lit(3).alias("section"),
        (F.col("rank") * (1 << 32) + F.col("seed")).alias("position"),
        table_row(
            F.col("run_name"),
            _text(F.col("seed")),
            _text(F.col("evals_completed")),
            fixed(F.col("best_fitness_peak"), 6),
            fixed(F.col("final_best_fitness"), 6),
            fixed(F.col("wall_clock_s"), 3),
        ).alias("line"),
    )


def ranked_run_rows(runs: DataFrame) -> DataFrame:
    """Report rows of ranked stored runs."""
    return runs.select(
        F.lit(1).alias("section"),
        F.col("rank").alias("position"),
        table_row(
            _text(F.col("rank")),
            _text(F.col("run_id")),
            fixed(F.col("observed_jobs_per_sec"), 3),
            F.concat(fixed(F.col("queue_overhead_p90_pct") * 100, 2), F.lit("%")),
            fixed(F.col("avg_job_ms"), 1),
            fixed(F.col("peak_fitness"), 4),
        ).alias("line"),
    )


def radar_rows(series: DataFrame) -> DataFrame:
    """Report rows of the raw comparison values."""
    return series.select(
        F.lit(1).alias("section"),
        F.col("display_order").cast("long").alias("position"),
        table_row(
            F.col("key"),
            fixed(F.col("peak_fitness"), 6),
            fixed(F.col("time_to_90_peak_s") / 60, 3),
            fixed(F.col("total_runtime_s") / 60, 3),
            fixed(F.col("total_evals"), 0),
            fixed(F.col("convergence_auc"), 6),
        ).alias("line"),
    )


def report_rows(*parts: DataFrame) -> DataFrame:
    """All report rows in section and position order."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.orderBy("section", "position")
