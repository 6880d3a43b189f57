"""Jobs, workers and generation telemetry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.functions.scalars import ratio
from tunelake.operators.scans import (
    as_of,
    floor_rank,
    latest,
    number_block,
    order_statistics,
    ranked,
    running,
    total,
)

GENERATION = ["run_id", "generation_id"]
HOUR_US = 3_600_000_000
# The three latency families of a generation.
FAMILIES = ["dispatch_latency", "worker_idle_gap", "queue_wait"]


def nearest_rank(frame: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Floor nearest-rank percentiles per group, with the number of samples."""
    return order_statistics(frame, keys, value, {name: floor_rank(p) for name, p in shares.items()})


def modeled_wall_clock(results: DataFrame, handover_ms: int = 10) -> DataFrame:
    """Wall clock of a generation from its busiest worker plus a hand-over per job."""
    per_worker = results.groupBy(*GENERATION, "worker_id").agg(
        F.sum("training_time_ms").alias("busy_ms"), F.count(F.lit(1)).alias("jobs")
    )
    return per_worker.groupBy(*GENERATION).agg(
        (F.max("busy_ms") + F.sum("jobs") * handover_ms).cast("long").alias("wall_clock_ms")
    )


def generation_kpi(
    results: DataFrame, wall_clock: DataFrame | None = None, runtime: DataFrame | None = None, handover_ms: int = 10
) -> DataFrame:
    """Counts, training-time percentiles, overhead and throughput of every generation.

    Without a recorded ``wall_clock`` it is modeled (:func:`modeled_wall_clock`) from the same
    pass. Rows are first combined per worker, so distinct workers are a plain count.
    """
    rows = results.withColumn("train_ms", F.greatest(F.lit(0).cast("long"), F.col("training_time_ms")))
    status = F.col("status")
    per_worker = rows.groupBy(*GENERATION, "worker_id").agg(
        F.count(F.lit(1)).alias("_jobs"),
        F.count_if(status == "COMPLETED").alias("_completed"),
        F.count_if(status == "FAILED").alias("_failed"),
        F.count_if(status == "TIMEOUT").alias("_timed_out"),
        F.sum("train_ms").alias("_train_ms"),
        F.sum("training_time_ms").alias("_busy_ms"),
    )
    counts = per_worker.groupBy(*GENERATION).agg(
        F.sum("_jobs").alias("jobs_count"),
        F.sum("_completed").alias("completed"),
        F.sum("_failed").alias("failed"),
        F.sum("_timed_out").alias("timed_out"),
        F.count_if(F.col("worker_id") != "").alias("active_workers"),
        F.sum("_train_ms").alias("train_total_ms"),
        (F.max("_busy_ms") + F.sum("_jobs") * handover_ms).cast("long").alias("_modeled_ms"),
    )
    shares = nearest_rank(rows, GENERATION, "train_ms", {"train_p50_ms": 0.5, "train_p90_ms": 0.9})
    joined = counts.join(shares.drop("samples"), GENERATION)
    if wall_clock is None:
        joined = joined.withColumn("wall_clock_ms", F.col("_modeled_ms"))
    else:
        joined = joined.join(wall_clock.select(*GENERATION, "wall_clock_ms"), GENERATION, "left")
    zero = F.lit(0).cast("long")
    wall = F.col("wall_clock_ms")
    joined = (
        joined.withColumn("wall_clock_ms", F.greatest(zero, F.coalesce(wall, zero)))
        .withColumn("ideal_wall_ms", F.col("train_total_ms") / F.greatest(F.col("active_workers"), F.lit(1)))
        .withColumn("queue_overhead_ms", F.greatest(wall - F.col("ideal_wall_ms"), F.lit(0.0)))
        .withColumn("queue_overhead_pct", ratio(F.col("queue_overhead_ms"), wall))
        .withColumn("gen_jobs_per_sec", ratio(F.col("jobs_count"), wall / F.lit(1000.0)))
        .drop("_modeled_ms")
    )
    return joined if runtime is None else joined.join(runtime, GENERATION, "left")


def latency_samples(events: DataFrame) -> DataFrame:
    """Dispatch events as one row per latency family and sample."""
    pairs = ", ".join(f"'{name}', {name}_ms" for name in FAMILIES)
    return events.selectExpr(*GENERATION, f"stack({len(FAMILIES)}, {pairs}) AS (family, sample_ms)").filter(
        "sample_ms IS NOT NULL"
    )


def runtime_summary(samples: DataFrame) -> DataFrame:
    """Median, p90, maximum and sample count per latency family; the queue wait also its minimum."""
    clamped = samples.withColumn("sample_ms", F.greatest(F.lit(0.0), "sample_ms"))
    stats = order_statistics(
        clamped,
        [*GENERATION, "family"],
        "sample_ms",
        {"p50": floor_rank(0.5), "p90": floor_rank(0.9), "max": lambda n: n, "min": lambda n: F.lit(1)},
    )

    def pick(family: str, stat: str) -> Column:
        kind = "long" if stat == "samples" else "double"
        value = F.max(F.when(F.col("family") == family, F.col(stat)))
        return F.coalesce(value, F.lit(0)).cast(kind)

    columns = [
        pick(family, stat).alias(f"{family}_samples" if stat == "samples" else f"{family}_{stat}_ms")
        for family in FAMILIES
        for stat in ("p50", "p90", "max", "samples")
    ]
    return stats.groupBy(*GENERATION).agg(*columns, pick("queue_wait", "min").alias("queue_wait_min_ms"))


def lifecycle_latency(jobs: DataFrame) -> DataFrame:
    """Queue wait and dispatch latency of each job from its lifecycle times in microseconds."""
    return jobs.withColumn("queue_wait_ms", (F.col("dispatched_us") - F.col("enqueued_us")) / F.lit(1000.0)).withColumn(
        "dispatch_latency_ms", (F.col("dispatched_us") - F.col("write_started_us")) / F.lit(1000.0)
    )


def worker_idle_gap(events: DataFrame, keys: Sequence[str] = ("worker_id",)) -> DataFrame:
    """Time from a worker's last processed result to each dispatch; null before its first result."""
    done = F.when(F.col("event").isin("completed", "failed"), F.col("at_us"))
    seen = running(
        events,
        keys,
        ["at_us", "event_seq"],
        number_block(F.col("at_us"), HOUR_US),
        {"last_result_us": latest(done, inclusive=False)},
    )
    return seen.filter("event = 'dispatch'").withColumn(
        "worker_idle_gap_ms", (F.col("at_us") - F.col("last_result_us")) / F.lit(1000.0)
    )


def resolve_jobs(results: DataFrame, order: Sequence[str], jobs: DataFrame | None = None) -> DataFrame:
    """First terminal delivery of each job; anything but a completion is a failure with zeros.

    With ``jobs`` (``run_id, job_id, generation_id``) deliveries of unknown jobs are left out and the
    generation is the job's own. A failure carries the delivered ``error_message`` if there is one.
    """
    if jobs is not None:
        known = jobs.select("run_id", "job_id", "generation_id")
        results = results.drop("generation_id").join(known, ["run_id", "job_id"])
    first = results.groupBy("run_id", "job_id").agg(
        F.min(
            F.struct(
                *order,
                *[c for c in results.columns if c not in (*order, "run_id", "job_id")],
            )
        ).alias("first"),
        (F.count(F.lit(1)) - 1).alias("ignored_deliveries"),
    )
    done = F.col("first.status") == "COMPLETED"
    return first.select(
        "run_id",
        "job_id",
        F.col("first.generation_id").alias("generation_id"),
        F.when(done, F.col("first.worker_id")).otherwise("").alias("worker_id"),
        F.when(done, F.col("first.validation_accuracy")).otherwise(0.0).alias("validation_accuracy"),
        F.when(done, F.col("first.training_loss")).otherwise(0.0).alias("training_loss"),
        F.when(done, F.col("first.training_time_ms")).otherwise(0).cast("long").alias("training_time_ms"),
        F.when(done, "COMPLETED").otherwise("FAILED").alias("status"),
        F.when(~done, F.col("first.error_message") if "error_message" in results.columns else F.lower("first.status")).alias("error_message"),
        "ignored_deliveries",
    )


def status_counts(results: DataFrame) -> DataFrame:
    """Completed, timed-out, failed and unknown results per run."""
    known = ["COMPLETED", "TIMEOUT", "FAILED"]
    status = F.coalesce(F.col("status"), F.lit("UNKNOWN"))
    return results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_results"),
        F.count_if(status == "COMPLETED").alias("completed"),
        F.count_if(status == "TIMEOUT").alias("timed_out"),
        F.count_if(status == "FAILED").alias("failed"),
        F.count_if(~status.isin(known)).alias("unknown"),
    )


def generation_complete(jobs: DataFrame, resolved: DataFrame) -> DataFrame:
    """Submitted and terminal jobs of each known generation; complete when they agree."""
    joined = jobs.join(resolved.select("run_id", "job_id", F.lit(True).alias("terminal")), ["run_id", "job_id"], "left")
    return (
        joined.groupBy(*GENERATION)
        .agg(F.count(F.lit(1)).alias("submitted"), F.count("terminal").alias("terminal"))
        .withColumn("complete", F.col("submitted") == F.col("terminal"))
    )


def results_in_submission_order(jobs: DataFrame, resolved: DataFrame) -> DataFrame:
    """Resolved results of complete generations with their submission sequence."""
    done = generation_complete(jobs, resolved).filter("complete").select(*GENERATION)
    return (
        jobs.select(*GENERATION, "job_id", "seq")
        .join(resolved.drop("generation_id"), ["run_id", "job_id"])
        .join(done, GENERATION, "left_semi")
    )


def generation_wall_clock(submitted: DataFrame, terminals: DataFrame) -> DataFrame:
    """Milliseconds from submission to the last *result* that finds the generation complete.

    ``terminals`` has one row per terminal message with ``source`` result, timeout or
    disconnect. A generation finished by something other than a result reads 0.
    """
    per_job = terminals.groupBy(*GENERATION, "job_id").agg(
        F.min("at_us").alias("first_us"),
        F.max(F.when(F.col("source") == "result", F.col("at_us"))).alias("last_result_us"),
    )
    per_generation = per_job.groupBy(*GENERATION).agg(
        F.count(F.lit(1)).alias("terminal"),
        F.max("first_us").alias("complete_us"),
        F.max("last_result_us").alias("last_result_us"),
    )
    ended = (F.col("terminal") >= F.col("jobs")) & (F.col("last_result_us") >= F.col("complete_us"))
    elapsed = F.floor((F.col("last_result_us") - F.col("submitted_us")) / 1000).cast("long")
    return submitted.join(per_generation, GENERATION, "left").select(
        *GENERATION, F.when(ended, elapsed).otherwise(0).cast("long").alias("wall_clock_ms")
    )


def enqueue_batch(candidates: DataFrame) -> DataFrame:
    """Job ids with one sequence per run, in submission order over all its generations."""
    block = F.col("generation_id").cast("long") * (1 << 20) + number_block(F.col("ordinal"))
    numbered = running(
        candidates,
        ["run_id"],
        ["generation_id", "ordinal"],
        block,
        {"seq": total(F.lit(1).cast("long"), inclusive=False)},
    )
    return numbered.withColumn(
        "job_id", F.concat(F.lit("gen"), F.col("generation_id"), F.lit("_job"), F.col("seq"))
    )


def estimated_cost(config: Column) -> Column:
    """Relative training cost: epochs x model size x batch factor, with defaults and clamps."""
    filters = F.when(
        F.size(config["conv_filters"]) > 0,
        F.aggregate(
            config["conv_filters"], F.lit(0).cast("long"), lambda acc, f: acc + F.greatest(F.lit(0), f).cast("long")
        ),
    ).otherwise(F.lit(32 + 64 + 128).cast("long"))
    dense = F.coalesce(F.greatest(F.lit(0), F.get(config["dense_units"], 0)), F.lit(128))
    epochs = F.greatest(F.lit(1), F.coalesce(config["epochs"], F.lit(0)))
    batch = F.greatest(F.lit(1), F.coalesce(config["batch_size"], F.lit(0)))
    return epochs.cast("double") * (filters.cast("double") + dense / F.lit(4.0)) * (F.lit(128.0) / batch)


def dispatch_order(jobs: DataFrame, keys: Sequence[str], strategy: str = "estimated_cost") -> DataFrame:
    """Position at which pending jobs leave the queue: first come first served or heaviest first."""
    costed = jobs.withColumn("cost", estimated_cost(F.col("config")))
    order = [-F.col("cost")] if strategy == "estimated_cost" else [F.lit(0.0)]
    return ranked(costed, keys, order, "seq", "dispatch_rank")


def scheduler_status(events: DataFrame, jobs: DataFrame, at_us: int) -> DataFrame:
    """Connected, idle and busy workers and pending jobs at one moment, from the event log."""
    changes = events.filter((F.col("at_us") <= at_us) & (F.col("event") != "heartbeat"))
    last = changes.groupBy("worker_id").agg(F.max(F.struct("at_us", "event_seq", "event"))["event"].alias("last_event"))
    connected = F.col("last_event") != "disconnect"
    busy = F.col("last_event") == "dispatch"
    workers = last.agg(
        F.count_if(connected).alias("connected_workers"),
        F.count_if(connected & ~busy).alias("idle_workers"),
        F.count_if(busy).alias("busy_workers"),
    )
    waiting = (F.col("enqueued_us") <= at_us) & (F.col("dequeued_us").isNull() | (F.col("dequeued_us") > at_us))
    pending = jobs.agg(F.count_if(waiting).alias("pending_jobs"))
    return workers.withColumn("pending_jobs", pending.scalar())


def heartbeat_timeouts(events: DataFrame, timeout_ms: int, horizon_us: int) -> DataFrame:
    """Moments at which a silent worker counts as dead, with the job it then held.

    Registration starts the clock and every heartbeat restarts it; the silence must be longer
    than the timeout. A worker's last signal is measured against the horizon.
    """
    hour = lambda at: number_block(at, HOUR_US)
    alive = events.filter(F.col("event").isin("heartbeat", "registration")).select("worker_id", "at_us", "event_seq")
    gaps = running(
        alive,
        ["worker_id"],
        ["at_us", "event_seq"],
        hour(F.col("at_us")),
        {"since_us": latest(F.col("at_us"), inclusive=False)},
    ).select("worker_id", "since_us", F.col("at_us").alias("until_us"))
    tail = (
        alive.groupBy("worker_id")
        .agg(F.max("at_us").alias("since_us"))
        .withColumn("until_us", F.lit(horizon_us).cast("long"))
    )
    silent = gaps.unionByName(tail).filter(
        F.floor((F.col("until_us") - F.col("since_us")) / 1000) > timeout_ms
    )
    dead = silent.select("worker_id", (F.col("since_us") + timeout_ms * 1000).alias("at_us"))
    held = events.filter(F.col("event").isin("dispatch", "completed", "failed"))
    placed = as_of(dead, held, ["worker_id"], "at_us", ["event", "job_id"], hour, tie="event_seq")
    return placed.select(
        "worker_id",
        F.col("at_us").alias("dead_us"),
        F.when(F.col("event") == "dispatch", F.col("job_id")).alias("failed_job_id"),
    )


def disconnect_failures(events: DataFrame) -> DataFrame:
    """Jobs failed because their busy worker disconnected."""
    held = F.when(
        F.col("event").isin("dispatch", "completed", "failed"),
        F.struct("event", "job_id"),
    )
    seen = running(
        events,
        ["worker_id"],
        ["at_us", "event_seq"],
        number_block(F.col("at_us"), HOUR_US),
        {"held": latest(held, inclusive=False)},
    )
    return seen.filter("event = 'disconnect' AND held.event = 'dispatch'").select(
        "worker_id", F.col("at_us").alias("dead_us"), F.col("held.job_id").alias("failed_job_id")
    )


def registration_audit(events: DataFrame) -> DataFrame:
    """Accept a registration when its worker id is not connected; flag the repeats."""
    link = F.when(F.col("event").isin("registration", "disconnect"), F.col("event"))
    seen = running(
        events,
        ["worker_id"],
        ["at_us", "event_seq"],
        number_block(F.col("at_us"), HOUR_US),
        {"last_link": latest(link, inclusive=False)},
    )
    return seen.filter("event = 'registration'").withColumn(
        "accepted", F.coalesce(F.col("last_link"), F.lit("disconnect")) == "disconnect"
    )
