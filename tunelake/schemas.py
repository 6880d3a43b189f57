"""Schemas of the stored files."""

from pyspark.sql import types as T

GENERATION = T.StructType(
    [
        T.StructField("generation", T.IntegerType()),
        T.StructField("best_fitness", T.DoubleType()),
        T.StructField("best_so_far", T.DoubleType()),
        T.StructField("avg_fitness", T.DoubleType()),
        T.StructField("worst_fitness", T.DoubleType()),
        T.StructField("wall_clock_ms", T.LongType()),
    ]
)
RUN_METRICS = T.StructType(
    [T.StructField("run_name", T.StringType()), T.StructField("generations", T.ArrayType(GENERATION))]
)
# Counts and clocks are read as text: a summary may hold anything there, and unknown is not 0.
RUN_SUMMARY = T.StructType(
    [
        T.StructField("run_name", T.StringType()),
        T.StructField("metric_schema_version", T.IntegerType()),
        T.StructField("completed", T.StringType()),
        T.StructField("wall_clock_total_s", T.StringType()),
        T.StructField("wall_clock_s", T.DoubleType()),
        T.StructField("jobs_total", T.LongType()),
        T.StructField("jobs_submitted", T.LongType()),
        T.StructField("jobs_returned", T.LongType()),
        T.StructField("timeouts", T.LongType()),
        T.StructField("failures", T.LongType()),
        T.StructField("failure_rate", T.DoubleType()),
        T.StructField("jobs_per_sec", T.DoubleType()),
        T.StructField("raw_jobs_per_sec", T.DoubleType()),
        T.StructField("legacy_modeled_jobs_per_sec", T.DoubleType()),
        T.StructField("avg_job_ms", T.DoubleType()),
        T.StructField("avg_job_ms_raw", T.DoubleType()),
        T.StructField("queue_overhead_p90_pct", T.DoubleType()),
        T.StructField("active_workers_min", T.LongType()),
        T.StructField("best_fitness_peak", T.DoubleType()),
        T.StructField("best_fitness_final", T.DoubleType()),
        T.StructField("best_fitness", T.DoubleType()),
        T.StructField("stopped_early", T.BooleanType()),
        T.StructField("stop_reason", T.StringType()),
        T.StructField("_corrupt", T.StringType()),
    ]
)
SCHEDULER_EVENT = (
    "run_id long, event_seq long, at_us long, event string, worker_id string, job_id string, generation_id int, "
    "dispatch_latency_ms double, queue_wait_ms double, worker_idle_gap_ms double, training_time_ms long, status int"
)
# Columns of the tuning sheet.
TUNING_COLUMNS = (
    "timestamp string, stage string, run_id string, num_workers int, gpu_memory_mb int, train_subset int, "
    "val_subset int, worker_timeout int, run_eagerly int, dispatch_interval_ms int, pop_size int, num_gens int, "
    "jobs_total long, wall_clock_s double, jobs_per_sec double, avg_job_ms double, timeouts long, failures long, "
    "failure_rate double, p50_generation_ms long, p90_generation_ms long, exit_code int, hang_detected int, "
    "smoke_ok int, log_path string, summary_path string"
)
EVIDENCE = {
    "load": "workers int, repeat int, offered long, admitted long, completed long, elapsed_s double, "
    "offered_admission_rate_per_s double, observed_completion_rate_per_s double, latency_p50_ms double, "
    "latency_p99_ms double, queue_wait_p99_ms double, scope string",
    "process_loss": "episode long, worker_exit_code int, attempts int, submit_to_recovery_ms double, "
    "lease_seconds double, state string",
    "faults": "episode string, kind string, state string, attempts int, stale_result string, task_correct boolean, "
    "evaluation_ms double, fault_clock string",
}
WORKER_MESSAGE = (
    "run_id long, at timestamp, seq long, "
    "registration struct<worker_id: string, hostname: string>, "
    "heartbeat struct<worker_id: string>, "
    "result struct<job_id: string, generation_id: int, worker_id: string, validation_accuracy: double, "
    "training_loss: double, training_time_ms: long, status: string, error_message: string>"
)
LEDGER_COMMAND = (
    "seq long, at timestamp, tenant string, command string, job_id string, worker string, fence int, "
    "payload string, ttl_us long, lease_us long, result string, effect string, error string, retryable boolean"
)
