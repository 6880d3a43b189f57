"""Source, sink and report queries: tables are written in the stored formats and read back."""

import uuid

from pyspark.sql import functions as F

from checks.base import check
from checks.runs import COMPARISON_SQL, GM, OBSERVED_SQL, PEAK_SQL, RANKING, aggregated, peaks, ranking, referenced, seeds
from tunelake.operators import compare
from tunelake.operators import runs as r
from tunelake.plans import reports as rp
from tunelake.session import scratch_folder
from tunelake.sources import files


def folder(s) -> str:
    return f"{scratch_folder(s.spark)}/files/{uuid.uuid4().hex}"


@check(
    "run_metrics_files",
    "run_name:str generation:int best_fitness:dbl best_so_far:dbl wall_clock_ms:long",
    f"SELECT concat(run_name, ' ', seed) AS run_name, generation, best_fitness, CASE WHEN generation % 2 = 0 THEN 1.5 ELSE best_fitness END AS best_so_far, wall_clock_ms FROM {GM}",
    GM,
)
def _(s):
    path = folder(s)
    rows = s.view(GM).withColumn("best_so_far", F.when(F.col("generation") % 2 == 0, 1.5))
    files.write_run_metrics(rows.withColumn("run_name", F.concat_ws(" ", "run_name", "seed")), path)
    return files.read_run_metrics(s.spark, path, one_per_file=False)


@check(
    "run_summary_files",
    "run_name:str completed:str wall_clock_total_s:str metric_schema_version:int jobs_per_sec:dbl run_id:str",
    """SELECT concat('run', run_id) AS run_name, completed, wall_clock_total_s, metric_schema_version, jobs_per_sec, 'r' || run_id % 3 AS run_id
         FROM run_summary_view""",
    "run_summary_view",
)
def _(s):
    # Files are named after their run; here each file holds the lines of one group of runs.
    path = folder(s)
    rows = s.view("run_summary_view").withColumn("run_name", F.concat(F.lit("run"), "run_id"))
    rows = rows.withColumn("group", F.concat(F.lit("r"), F.col("run_id") % 3)).drop("run_id")
    rows.write.partitionBy("group").json(path)
    read = (
        s.spark.read.schema(files.schemas.RUN_SUMMARY).option("recursiveFileLookup", True).json(path)
        .withColumn("run_id", F.regexp_extract("_metadata.file_path", "group=([^/]*)", 1))
    )
    return read


EVENT_SQL = """
    SELECT user_id % 10 AS run_id, event_seq, at_us, event, worker_id, job_id, generation_id, dispatch_latency_ms,
           CASE WHEN event_seq % 3 = 0 THEN dispatch_latency_ms * 2 END AS worker_idle_gap_ms FROM {worker_events_view} WHERE event IN ('dispatch', 'completed')
"""
EVENT_COLUMNS = "run_id:long event_seq:long at_us:long event:str worker_id:str job_id:str generation_id:int dispatch_latency_ms:dbl worker_idle_gap_ms:dbl"


@check("scheduler_event_files", EVENT_COLUMNS, EVENT_SQL.format(worker_events_view="worker_events_view"), "worker_events_view")
def _(s):
    path = folder(s)
    files.write_scheduler_events(s.sql(EVENT_SQL, worker_events_view=s.view("worker_events_view")), path)
    return files.read_scheduler_events(s.spark, path)


@check(
    "tuning_run_files",
    "stage:str run_id:str num_workers:int jobs_per_sec:dbl failure_rate:dbl jobs_total:long",
    "SELECT stage, concat('run ', run_seq, ', \"a\"') AS run_id, knob_value AS num_workers, jobs_per_sec, failure_rate, CAST(NULL AS BIGINT) AS jobs_total FROM tuning_view",
    "tuning_view",
)
def _(s):
    path = folder(s)
    names = [part.split() for part in files.schemas.TUNING_COLUMNS.split(", ")]
    known = {
        "stage": F.col("stage"), "run_id": F.concat(F.lit("run "), "run_seq", F.lit(', "a"')), "num_workers": F.col("knob_value"),
        "jobs_per_sec": F.col("jobs_per_sec"), "failure_rate": F.col("failure_rate"),
    }
    rows = s.view("tuning_view").select(*[known.get(n, F.lit(None)).cast(k).alias(n) for n, k in names])
    files.write_tuning_runs(rows, path)
    return files.read_tuning_runs(s.spark, path)


@check(
    "ledger_evidence_files",
    "episode:str kind:str state:str attempts:int task_correct:bool evaluation_ms:dbl",
    "SELECT concat('e', seq) AS episode, command AS kind, tenant AS state, CAST(seq % 4 AS INTEGER) AS attempts, CASE WHEN seq % 3 > 0 THEN seq % 3 = 1 END AS task_correct, seq / CAST(8 AS DOUBLE) AS evaluation_ms FROM ledger_view",
    "ledger_view",
)
def _(s):
    path = folder(s)
    seq = F.col("seq")
    rows = s.view("ledger_view").select(
        F.concat(F.lit("e"), seq).alias("episode"), F.col("command").alias("kind"), F.col("tenant").alias("state"),
        (seq % 4).alias("attempts"), F.when(seq % 3 > 0, seq % 3 == 1).alias("task_correct"), (seq / 8.0).alias("evaluation_ms"),
    )
    files.write_ledger_evidence(rows, path)
    return files.read_ledger_evidence(s.spark, path, "faults")


@check("artifact_manifest", "path:str length:long sha256:str")
def _(s):
    path = folder(s)
    files.write_ledger_evidence(s.view("ledger_view"), path)
    return files.artifact_manifest(s.spark, path, "*.json", text=True)


@check(
    "report_rows",
    "section:int line:str",
    f"""{RANKING}, o AS ({OBSERVED_SQL}), p AS ({PEAK_SQL}),
     rr AS (SELECT o.*, peak_fitness, row_number() OVER (ORDER BY rate DESC, o.queue_overhead_p90_pct, o.avg_job_ms, peak_fitness DESC, o.run_id) AS rank
              FROM o JOIN p ON p.run_id = o.run_id WHERE rate IS NOT NULL)
SELECT 1 AS section, concat('| ', rank, ' | ', run_name, ' | ', printf('%.6f', median_best_fitness_peak), ' | ', printf('%.6f', mean_best_fitness_peak), ' | ',
         printf('%.1f', median_evals_completed), ' | ', printf('%.1f', mean_evals_completed), ' | ', printf('%.3f', median_wall_clock_s), ' | ', printf('%.3f', mean_wall_clock_s), ' |') AS line FROM ranking
 UNION ALL SELECT 3, concat('| ', s.run_name, ' | ', s.seed, ' | ', s.evals_completed, ' | ', printf('%.6f', s.best_fitness_peak), ' | ', printf('%.6f', s.final_best_fitness), ' | ', printf('%.3f', s.wall_clock_s), ' |')
   FROM seeds s JOIN ranking USING (run_name)
 UNION ALL SELECT 1, concat('| ', rank, ' | ', run_id, ' | ', printf('%.3f', rate), ' | ', printf('%.2f', queue_overhead_p90_pct * 100), '% | ', printf('%.1f', avg_job_ms), ' | ', printf('%.4f', peak_fitness), ' |') FROM rr""",
    f"{GM} run_summary_view",
)
def _(s):
    from tunelake.operators.compare import per_seed_listing

    ranks = ranking(s)
    return rp.report_rows(
        rp.ranked_strategy_rows(ranks), rp.seed_rows(per_seed_listing(seeds(s), ranks)), rp.ranked_run_rows(r.rank_runs(peaks(s)))
    )


@check(
    "comparison_report",
    "section:int line:str",
    f"""WITH {COMPARISON_SQL}, o AS ({OBSERVED_SQL})
SELECT 1 AS section, concat('| ', key, ' | ', printf('%.6f', peak_fitness), ' | ', printf('%.3f', time_to_90_peak_s / 60), ' | ', printf('%.3f', total_runtime_s / 60), ' | ',
         printf('%.0f', total_evals), ' | ', printf('%.6f', convergence_auc), ' |') AS line FROM cs
 UNION ALL SELECT 2, concat('| run ', run_id, ' | ', printf('%.6f', coalesce(best_fitness_peak, 0)), ' | ', coalesce(printf('%.6f', nullif(TRY_CAST(wall_clock_total_s AS DOUBLE), 0)), 'unknown'), ' | ',
         coalesce(printf('%.6f', rate), 'unknown'), ' | ', coalesce(printf('%.6f', CASE WHEN jobs_per_sec >= 0 THEN jobs_per_sec END), 'unknown'), ' |') FROM o""",
    f"{GM} run_summary_view",
)
def _(s):
    summary = s.view("run_summary_view").select(
        "*", F.concat(F.lit("run "), "run_id").alias("name"), F.when(F.col("jobs_per_sec") >= 0, F.col("jobs_per_sec")).alias("modeled_jobs_per_sec")
    )
    series = compare.comparison_series(referenced(s), aggregated(s))
    # The unranked reference runs come last.
    return rp.report_rows(rp.radar_rows(series), rp.reference_rows(compare.reference_row(ranking(s), summary)))
