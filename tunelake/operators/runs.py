"""Run-level analytics over one row per (run, generation)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.functions.scalars import is_finite, ratio, strict_number
from tunelake.operators.scans import (
    as_of,
    floor_rank,
    latest,
    number_block,
    order_statistics,
    peak,
    ranked,
    running,
    total,
)
from tunelake.session import cut_lineage

GENERATION_BLOCK = 4096


def _along(frame: DataFrame, measures: dict, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    return running(
        frame, keys, ["generation"], number_block(F.col("generation"), GENERATION_BLOCK), measures
    )


def _reported_best(metrics: DataFrame) -> Column:
    best = F.col("best_fitness")
    return F.coalesce(F.col("best_so_far"), best) if "best_so_far" in metrics.columns else best


def best_so_far(metrics: DataFrame) -> DataFrame:
    """Running best of each run; a missing value counts as the generation's own best."""
    staged = metrics.withColumn("_best", _reported_best(metrics))
    return _along(staged.drop("best_so_far"), {"best_so_far": peak(F.col("_best"))}).drop("_best")


def run_totals(metrics: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Generations, wall time, final best and mean gain per step (over n - 1 steps)."""
    ends = metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_generations"),
        F.sum("wall_clock_ms").alias("total_wall_clock_ms"),
        F.max_by("best_fitness", "generation").alias("final_best_fitness"),
        F.min_by("best_fitness", "generation").alias("_first"),
    )
    steps = F.col("num_generations") - 1
    return ends.withColumn(
        "convergence_rate", ratio(F.col("final_best_fitness") - F.col("_first"), steps)
    ).drop("_first")


def plateau_events(
    metrics: DataFrame,
    planned: int,
    patience: int = 2,
    min_delta: float = 1.0 / 1024.0,
    any_new_best: bool = True,
    reheat_gens: int = 2,
) -> DataFrame:
    """Stale streak of each generation and the generations that trigger a reheat.

    A streak starts after the last meaningful gain; it triggers whenever it reaches a multiple
    of the patience, except on the last planned generation. With no patience every other
    generation triggers, and without reheat generations nothing does.
    """
    before = _along(
        metrics,
        {
            "position": total(F.lit(1).cast("long"), inclusive=False),
            "best_before": peak(F.col("best_fitness"), inclusive=False),
        },
    )
    best, prior = F.col("best_fitness"), F.col("best_before")
    gain = best > (prior + F.lit(min_delta))
    if any_new_best:
        gain = gain | (best > prior)
    fresh = prior.isNull() | gain
    # The second scan reads the first one twice; write it instead of computing it again.
    marked = cut_lineage(before.withColumn("_fresh", F.when(fresh, F.col("position"))))
    streak = _along(marked, {"_since": latest(F.col("_fresh"))}).withColumn(
        "_streak", F.col("position") - F.col("_since")
    )
    last = F.col("position") == planned - 1
    count = F.col("_streak")
    if reheat_gens <= 0:
        trigger, stale = F.lit(False), count
    elif patience <= 0:
        trigger, stale = ~last, F.when(last, F.least(count, F.lit(1).cast("long"))).otherwise(0)
    else:
        trigger = (count > 0) & (count % patience == 0) & ~last
        on_last = F.when(count == 0, 0).otherwise((count - 1) % patience + 1)
        stale = F.when(last, on_last).otherwise(count % patience)
    return streak.withColumn("triggered", trigger).withColumn("stale_generations", stale.cast("long")).drop(
        "_fresh", "_since", "_streak"
    )


def reheat_schedule(
    plateaus: DataFrame,
    planned: int,
    reheat_gens: int = 2,
    immigrant_rate: float = 0.35,
    mutation_floor: float = 0.30,
) -> DataFrame:
    """Overrides for the evolve step after each generation: on for ``reheat_gens`` steps after a trigger."""
    marked = cut_lineage(plateaus.withColumn("_at", F.when(F.col("triggered"), F.col("position"))))
    recent = _along(marked, {"_trigger": latest(F.col("_at"))})
    active = (
        F.col("_trigger").isNotNull()
        & (F.col("position") - F.col("_trigger") < reheat_gens)
        & (F.col("position") < planned - 1)
    )
    return (
        recent.withColumn("reheat", active)
        .withColumn("immigrant_rate_override", F.when(active, F.lit(immigrant_rate)))
        .withColumn("mutation_rate_floor_override", F.when(active, F.lit(mutation_floor)))
        .drop("_at", "_trigger")
    )


def wall_clock_guard(metrics: DataFrame, limit_ms: int) -> DataFrame:
    """First generation of each run that must not start under a wall-clock limit.

    A generation is skipped when elapsed time plus the upper median of the earlier positive
    durations exceeds the limit. With spare time s = limit - elapsed, that median exceeds s
    exactly when at most half (rounded down) of the earlier durations are within s. Since s
    only shrinks, a duration stops counting at one fixed position, so the counts are running
    sums and no earlier durations are gathered.
    """
    wall = F.greatest(F.col("wall_clock_ms"), F.lit(0).cast("long"))
    rows = cut_lineage(
        _along(
            metrics.select("run_id", "generation", wall.alias("wall_ms")),
            {
                "position": total(F.lit(1).cast("long"), inclusive=False),
                "elapsed_ms": total(F.col("wall_ms"), inclusive=False),
                "timed": total(F.when(F.col("wall_ms") > 0, 1).otherwise(0).cast("long"), inclusive=False),
            },
        )
    )
    timed = rows.filter("wall_ms > 0").select(
        "run_id", F.col("position").alias("own"), (F.lit(limit_ms) - F.col("wall_ms")).cast("long").alias("elapsed_ms")
    )
    # The last position whose elapsed time still leaves room for this duration.
    reach = as_of(
        timed,
        rows.select("run_id", "elapsed_ms", "position"),
        ["run_id"],
        "elapsed_ms",
        ["position"],
        lambda at: number_block(at, 1 << 22),
        tie="position",
    )
    enters = timed.select("run_id", (F.col("own") + 1).alias("position"), F.lit(1).cast("long").alias("step"))
    leaves = reach.select(
        "run_id",
        (F.greatest(F.col("own"), F.coalesce(F.col("position"), F.lit(-1).cast("long"))) + 1).alias("position"),
        F.lit(-1).cast("long").alias("step"),
    )
    steps = enters.unionByName(leaves).groupBy("run_id", "position").agg(F.sum("step").alias("step"))
    counted = running(
        rows.join(steps, ["run_id", "position"], "left").withColumn("step", F.coalesce("step", F.lit(0).cast("long"))),
        ["run_id"],
        ["position"],
        number_block(F.col("position"), GENERATION_BLOCK),
        {"within": total(F.col("step"))},
    )
    half = F.floor(F.col("timed") / 2).cast("long")
    over = (F.col("position") > 0) & (F.col("timed") > 0) & (F.col("within") <= half)
    return counted.filter(over).groupBy("run_id").agg(
        F.min("position").alias("stop_position"), F.min_by("generation", "position").alias("stop_generation")
    )


def worker_guard(kpis: DataFrame, expected_workers: int) -> DataFrame:
    """First generation of each run with fewer active workers than expected."""
    short = kpis.filter((F.lit(expected_workers) > 0) & (F.col("active_workers") < expected_workers))
    return short.groupBy("run_id").agg(F.min("generation_id").alias("stop_after_generation"))


def run_stats(
    kpis: DataFrame, population_size: int, planned: int, time_stop: DataFrame, worker_stop: DataFrame
) -> DataFrame:
    """Planned, submitted and returned jobs, generations done and the first stop reason of each run."""
    joined = kpis.join(time_stop.select("run_id", "stop_generation"), "run_id", "left").join(
        worker_stop, "run_id", "left"
    )
    before, after = F.col("stop_generation"), F.col("stop_after_generation")
    done = (before.isNull() | (F.col("generation_id") < before)) & (after.isNull() | (F.col("generation_id") <= after))
    stats = joined.filter(done).groupBy("run_id").agg(
        F.lit(population_size * planned).cast("long").alias("jobs_planned"),
        F.sum("jobs_count").alias("jobs_submitted"),
        F.sum("jobs_count").alias("jobs_returned"),
        F.count(F.lit(1)).alias("generations_completed"),
        F.max("stop_generation").alias("_before"),
        F.max("stop_after_generation").alias("_after"),
    )
    reason = (
        F.when(F.col("_after").isNotNull() & (F.col("_before").isNull() | (F.col("_after") < F.col("_before"))),
               "insufficient_workers")
        .when(F.col("_before").isNotNull(), "max_wall_clock_reached")
        .otherwise("completed")
    )
    return (
        stats.withColumn("stop_reason", reason)
        .withColumn("stopped_early", F.col("stop_reason") != "completed")
        .drop("_before", "_after")
    )


def metric_clock(source: Column, total_s: Column, submit_offset_s: Column, queue_wait_min_ms: Column) -> dict[str, Column]:
    """First-dispatch offset, the clock used for rates, and whether it fell back to the total."""
    offset = F.when(
        queue_wait_min_ms > 0, F.greatest(submit_offset_s + queue_wait_min_ms / F.lit(1000.0), F.lit(0.0))
    ).otherwise(F.lit(0.0))
    wanted = source == "first_dispatch"
    usable = (offset > 0) & (offset < total_s)
    chosen = F.when(wanted & usable, total_s - offset).otherwise(total_s)
    return {
        "first_dispatch_offset_s": offset,
        "wall_clock_s": F.greatest(chosen, F.lit(1e-6)),
        "fallback_to_total": wanted & ~usable,
    }


def wall_adjusted_throughput(wall_s: Column, submitted: Column, latency_ms: float) -> dict[str, Column]:
    """Mean job time, the same less network latency, and the latency-subtracted rate."""
    none = submitted <= 0
    count = F.greatest(submitted, F.lit(1)).cast("double")
    raw = F.when(none, F.lit(0.0)).otherwise(wall_s / count * F.lit(1000.0))
    adjusted_wall = F.greatest(wall_s - count * F.lit(float(latency_ms)) / F.lit(1000.0), F.lit(1e-3))
    return {
        "avg_job_ms_raw": raw,
        "avg_job_ms_adjusted": F.greatest(raw - F.lit(float(latency_ms)), F.lit(1.0)),
        "jobs_per_sec_wall_adjusted": F.when(none, F.lit(0.0)).otherwise(count / adjusted_wall),
    }


def modeled_throughput(avg_job_ms_raw: Column, workers: Column, latency_ms: float) -> dict[str, Column]:
    """Rate implied by the worker count; a model, not an observation."""
    adjusted = F.greatest(avg_job_ms_raw - F.lit(float(latency_ms)), F.lit(1.0))
    return {
        "avg_job_ms_adjusted": adjusted,
        "modeled_jobs_per_sec": F.when(workers > 0, workers * F.lit(1000.0) / adjusted).otherwise(F.lit(0.0)),
    }


def total_elapsed(text: Column) -> Column:
    """Positive finite clock written in a summary, else null."""
    clock = strict_number(text)
    return F.when(is_finite(clock) & (clock > 0), clock)


def observed_completed(text: Column) -> Column:
    """Whole, finite, non-negative completion count written in a summary, else null."""
    count = strict_number(text)
    return F.when(is_finite(count) & (count >= 0) & (count == F.floor(count)), count)


def observed_throughput(completed: Column, wall_clock_total_s: Column) -> Column:
    """Successful completions per observed second; unknown is null, never zero."""
    return observed_completed(completed) / total_elapsed(wall_clock_total_s)


def modeled_rate_by_schema(version: Column, legacy_rate: Column, plain_rate: Column) -> Column:
    """Modeled rate under the key its summary version uses; null when not a finite number >= 0."""
    rate = F.when(version == 2, legacy_rate).otherwise(plain_rate)
    return F.when(is_finite(rate) & (rate >= 0), rate)


def failure_rate(timeouts: Column, failures: Column, unknown: Column, submitted: Column, planned: Column) -> Column:
    base = F.when(submitted > 0, submitted).otherwise(planned)
    return ratio(timeouts + failures + unknown, base)


def tuning_failure_rate(jobs: Column, timeouts: Column, failures: Column) -> Column:
    """Failure share of a tuning run; a run without jobs counts as all failed."""
    return ratio(timeouts + failures, jobs, default=1.0)


# Which percentiles of which generation indicator a run summary reports.
SUMMARY_PERCENTILES = {
    "generation_wall_clock_p50_ms": ("wall_clock_ms", 0.50),
    "generation_wall_clock_p90_ms": ("wall_clock_ms", 0.90),
    "queue_overhead_p50_ms": ("queue_overhead_ms", 0.50),
    "queue_overhead_p90_ms": ("queue_overhead_ms", 0.90),
    "queue_overhead_p50_pct": ("queue_overhead_pct", 0.50),
    "queue_overhead_p90_pct": ("queue_overhead_pct", 0.90),
    "active_workers_p50": ("active_workers", 0.50),
    "active_workers_p90": ("active_workers", 0.90),
    "dispatch_latency_p50_ms": ("dispatch_latency_p50_ms", 0.50),
    "dispatch_latency_p90_ms": ("dispatch_latency_p90_ms", 0.90),
    "worker_idle_gap_p50_ms": ("worker_idle_gap_p50_ms", 0.50),
    "worker_idle_gap_p90_ms": ("worker_idle_gap_p90_ms", 0.90),
    "queue_wait_p50_ms": ("queue_wait_p50_ms", 0.50),
    "queue_wait_p90_ms": ("queue_wait_p90_ms", 0.90),
}


def run_summary(kpis: DataFrame) -> DataFrame:
    """One row per run: percentiles over its generations, extremes and totals."""
    # Small against the results it comes from, and read three times below.
    kpis = cut_lineage(kpis)
    present = [m for m in dict.fromkeys(m for m, _ in SUMMARY_PERCENTILES.values()) if m in kpis.columns]
    pairs = ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in present)
    long = kpis.selectExpr("run_id", f"stack({len(present)}, {pairs}) AS (metric, value)").withColumn(
        "value", F.coalesce("value", F.lit(0.0))
    )
    stats = order_statistics(long, ["run_id", "metric"], "value", {"p50": floor_rank(0.5), "p90": floor_rank(0.9)})
    wanted = {n: (m, "p50" if p == 0.5 else "p90") for n, (m, p) in SUMMARY_PERCENTILES.items() if m in present}
    percentiles = stats.groupBy("run_id").agg(
        *[F.max(F.when(F.col("metric") == m, F.col(p))).alias(name) for name, (m, p) in wanted.items()]
    )
    plain = [
        F.count(F.lit(1)).alias("generations_completed"),
        F.sum("jobs_count").alias("jobs_returned"),
        F.sum("completed").alias("completed"),
        F.sum("timed_out").alias("timeouts"),
        F.sum("failed").alias("failures"),
        F.avg("queue_overhead_ms").alias("queue_overhead_avg_ms"),
        F.avg("queue_overhead_pct").alias("queue_overhead_avg_pct"),
        F.min("active_workers").alias("active_workers_min"),
        F.max("active_workers").alias("active_workers_max"),
    ]
    for family, samples in (
        ("dispatch_latency", "dispatch_samples_total"),
        ("worker_idle_gap", "worker_idle_gap_samples_total"),
        ("queue_wait", "queue_wait_samples_total"),
    ):
        if f"{family}_max_ms" in kpis.columns:
            plain.append(F.coalesce(F.max(f"{family}_max_ms"), F.lit(0.0)).alias(f"{family}_max_ms"))
            plain.append(F.coalesce(F.sum(f"{family}_samples"), F.lit(0)).alias(samples))
    if "queue_wait_min_ms" in kpis.columns:
        plain.append(F.min(F.coalesce("queue_wait_min_ms", F.lit(0.0))).alias("queue_wait_min_ms"))
    return kpis.groupBy("run_id").agg(*plain).join(percentiles, "run_id")


def peak_fitness(summaries: DataFrame, metrics: DataFrame) -> DataFrame:
    """Best fitness of a run: reported peak, else final, else best, else from its generations, else 0."""
    from_generations = metrics.groupBy("run_id").agg(F.max("best_fitness").alias("_generations"))
    reported = [c for c in ("best_fitness_peak", "best_fitness_final", "best_fitness") if c in summaries.columns]
    return (
        summaries.join(from_generations, "run_id", "left")
        .withColumn("peak_fitness", F.coalesce(*reported, "_generations", F.lit(0.0)))
        .drop("_generations")
    )


def rank_runs(summaries: DataFrame, tie: str = "run_id") -> DataFrame:
    """Rank runs by observed rate, then overhead, job time (raw if known) and peak; unknown rates are left out."""
    job_time = [c for c in ("avg_job_ms_raw", "avg_job_ms") if c in summaries.columns]
    rate = observed_throughput(F.col("completed"), F.col("wall_clock_total_s"))
    known = summaries.withColumn("observed_jobs_per_sec", rate).filter("observed_jobs_per_sec IS NOT NULL")
    order = [
        -F.col("observed_jobs_per_sec"),
        F.coalesce("queue_overhead_p90_pct", F.lit(0.0)),
        F.coalesce(*job_time, F.lit(0.0)),
        -F.col("peak_fitness"),
    ]
    return ranked(known, [], order, tie, "rank")


def acceptance_checks(
    summaries: DataFrame, expected_jobs: int = 1440, min_workers: int = 10, max_failure_rate: float = 0.0
) -> DataFrame:
    """Five pass/fail checks per summary; a missing field fails."""
    tests = {
        f"jobs_submitted == {expected_jobs}": ("jobs_submitted", f"jobs_submitted = {expected_jobs}"),
        f"jobs_returned == {expected_jobs}": ("jobs_returned", f"jobs_returned = {expected_jobs}"),
        f"failure_rate <= {max_failure_rate}": ("failure_rate", f"failure_rate <= {max_failure_rate}D"),
        f"active_workers_min >= {min_workers}": ("active_workers_min", f"active_workers_min >= {min_workers}"),
        "stopped_early == false": ("stopped_early", "NOT stopped_early"),
    }
    rows = ", ".join(
        f"'{name}', coalesce({test}, false), coalesce(CAST({field} AS STRING), 'None')"
        for name, (field, test) in tests.items()
    )
    return summaries.selectExpr("run_id", f"stack({len(tests)}, {rows}) AS (check_name, passed, detail)")


def speedup(totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Baseline time (fewest workers) over time; 0 for a zero time, no rows for a zero baseline."""
    baseline = totals.groupBy(*keys).agg(F.min_by("total_ms", "workers").alias("baseline_ms"))
    return (
        totals.join(baseline.filter("baseline_ms > 0"), list(keys))
        .withColumn("speedup", ratio(F.col("baseline_ms"), F.col("total_ms")))
    )


def comparison_table(metrics: DataFrame) -> DataFrame:
    """Final best, seconds and number of convergence points per named run."""
    return run_totals(metrics, ["run_name", "seed"]).select(
        "run_name",
        "seed",
        "final_best_fitness",
        (F.col("total_wall_clock_ms") / F.lit(1000.0)).alias("total_time_s"),
        F.col("num_generations").alias("points"),
    )


def convergence_band(metrics: DataFrame) -> DataFrame:
    """Best, mean and worst fitness and seconds of every generation."""
    return metrics.select(
        "run_id",
        "generation",
        "best_fitness",
        "avg_fitness",
        "worst_fitness",
        (F.col("wall_clock_ms") / F.lit(1000.0)).alias("wall_clock_s"),
    )
