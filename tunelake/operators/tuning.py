"""Throughput-tuning analytics over one row per tuning run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.functions.scalars import ratio
from tunelake.operators.runs import tuning_failure_rate

# Tuning limits.
FAILURE_RATE_LIMIT = 0.10
REPEATABILITY_LIMIT = 0.15
MEDIUM_SHARE = 0.9
HANG_EXIT_CODE = 124


def repeatability(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, population deviation and their ratio of the rates of each group; passes at 15 percent."""
    stats = runs.groupBy(*keys).agg(
        F.avg("jobs_per_sec").alias("mean_rate"), F.stddev_pop("jobs_per_sec").alias("std_rate")
    )
    return stats.withColumn("cv", ratio(F.col("std_rate"), F.col("mean_rate"))).withColumn(
        "passed", F.col("cv") <= REPEATABILITY_LIMIT
    )


def _preference(limit: float) -> Column:
    return F.struct(
        (F.col("failure_rate") <= limit).cast("int").alias("feasible"),
        F.col("jobs_per_sec").alias("rate"),
        (-F.col("run_seq")).alias("first"),
    )


def best_candidate_run(runs: DataFrame, keys: Sequence[str], limit: float = FAILURE_RATE_LIMIT) -> DataFrame:
    """Best run of each group: feasible before infeasible, then the higher rate, then the earlier run."""
    best = runs.groupBy(*keys).agg(F.max_by(F.struct(*runs.columns), _preference(limit)).alias("_best"))
    return best.select(F.col("_best.*"), (F.col("_best.failure_rate") <= limit).alias("feasible"))


def sweep_winners(runs: DataFrame, limit: float = FAILURE_RATE_LIMIT) -> DataFrame:
    """Winning knob value of each recorded sweep stage."""
    return best_candidate_run(runs.filter(F.col("stage").startswith("sweep_")), ["stage"], limit).select(
        "stage", F.col("knob_value").alias("winning_value"), "run_seq", "jobs_per_sec", "failure_rate"
    )


def tuning_gates(medium: DataFrame, short_best: DataFrame, repeats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether the medium run holds 90 percent of the best short rate, and the repeat gate."""
    joined = medium.join(
        short_best.select(*keys, F.col("jobs_per_sec").alias("short_rate")), list(keys)
    ).join(repeats.select(*keys, "cv"), list(keys))
    floor = F.col("short_rate") * F.lit(MEDIUM_SHARE)
    passed = (
        (F.col("failure_rate") <= FAILURE_RATE_LIMIT)
        & (F.col("jobs_per_sec") >= floor)
        & ~F.col("hang_detected")
        & F.col("smoke_ok")
    )
    return (
        joined.withColumn("min_rate", floor)
        .withColumn("medium_passed", passed)
        .withColumn("repeat_passed", F.col("cv") <= REPEATABILITY_LIMIT)
    )


def run_case_metrics(cases: DataFrame, summaries: DataFrame) -> DataFrame:
    """Metrics of each launched case; without a summary every planned job timed out."""
    joined = cases.join(summaries.withColumn("_found", F.lit(True)), "run_seq", "left")
    found = F.coalesce(F.col("_found"), F.lit(False))
    planned = (F.col("pop_size") * F.col("num_gens")).cast("long")

    def number(name: str, kind: str = "double") -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast(kind)

    shaped = joined.select(
        *[c for c in cases.columns],
        F.when(found, number("jobs_total", "long")).otherwise(planned).alias("jobs_total"),
        number("wall_clock_s").alias("wall_clock_s"),
        number("jobs_per_sec").alias("jobs_per_sec"),
        F.when(found, number("timeouts", "long")).otherwise(planned).alias("timeouts"),
        number("failures", "long").alias("failures"),
        (F.col("exit_code") == HANG_EXIT_CODE).alias("hang_detected"),
    )
    return shaped.withColumn(
        "failure_rate", tuning_failure_rate(F.col("jobs_total"), F.col("timeouts"), F.col("failures"))
    )
