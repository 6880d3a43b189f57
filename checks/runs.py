"""Run-level, tuning and comparison queries."""

from pyspark.sql import functions as F

from checks.base import check
from checks.telemetry import KPI_SQL, RUNTIME_EVENTS_SQL, _family, kpis, runtime_events
from tunelake.operators import compare as c
from tunelake.operators import runs as r
from tunelake.operators import telemetry as t
from tunelake.operators import tuning as g

GM = "generation_metrics_view"
KPI_TABLE = KPI_SQL.strip()
PRIOR = "(PARTITION BY run_id ORDER BY generation ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
UPTO = "(PARTITION BY run_id ORDER BY generation ROWS UNBOUNDED PRECEDING)"


def nested(text: str) -> str:
    """A query with its own WITH list as one subquery."""
    return text.strip().replace("\nSELECT", "\n SELECT")


@check(
    "best_so_far",
    "run_id:long generation:int best_fitness:dbl best_so_far:dbl",
    f"SELECT *, max(best_fitness) OVER {UPTO} AS best_so_far FROM {GM}",
    GM,
)
def _(s):
    return r.best_so_far(s.view(GM))


TOTALS = "count(*) AS num_generations, sum(wall_clock_ms) AS total_wall_clock_ms, max_by(best_fitness, generation) AS final_best_fitness"


@check(
    "run_totals",
    "run_id:long num_generations:long total_wall_clock_ms:long final_best_fitness:dbl convergence_rate:dbl",
    f"""
SELECT run_id, {TOTALS}, CASE WHEN count(*) < 2 THEN 0
       ELSE (max_by(best_fitness, generation) - min_by(best_fitness, generation)) / (count(*) - 1) END AS convergence_rate
  FROM {GM} GROUP BY run_id
""",
    GM,
)
def _(s):
    return r.run_totals(s.view(GM))


# The view's best moves little, so the plateau queries use a spread-out score.
SCORED_SQL = f"SELECT *, floor(best_fitness * 100 - 90 + generation / 9) / 100 AS score FROM {GM}"
PLANNED = 84


def scored(s):
    frame = s.view(GM)
    score = F.floor(F.col("best_fitness") * 100 - 90 + F.col("generation") / 9) / 100
    return frame.withColumn("best_fitness", score)


PLATEAU_SQL = f"""
     s AS ({SCORED_SQL}),
     b AS (SELECT run_id, generation, score, row_number() OVER (PARTITION BY run_id ORDER BY generation) - 1 AS position,
                  max(score) OVER {PRIOR} AS prior FROM s),
     f AS (SELECT *, max(CASE WHEN prior IS NULL OR score > prior + CAST(0.015 AS DOUBLE) THEN position END) OVER {UPTO} AS since FROM b),
     n AS (SELECT *, position - since AS n FROM f),
     p AS (SELECT *, n > 0 AND n % 3 = 0 AND position <> {PLANNED - 1} AS triggered,
                  CASE WHEN position = {PLANNED - 1} THEN CASE WHEN n = 0 THEN 0 ELSE (n - 1) % 3 + 1 END ELSE n % 3 END AS stale_generations FROM n)
"""


def plateaus(s):
    return r.plateau_events(scored(s), PLANNED, patience=3, min_delta=0.015, any_new_best=False, reheat_gens=2)


@check(
    "plateau_events",
    "run_id:long generation:int position:long triggered:bool stale_generations:long",
    f"WITH {PLATEAU_SQL.strip()}\nSELECT * FROM p",
    GM,
)
def _(s):
    return plateaus(s)


@check(
    "reheat_schedule",
    "run_id:long generation:int reheat:bool immigrant_rate_override:dbl",
    f"""
WITH {PLATEAU_SQL.strip()},
     h AS (SELECT *, bool_or(triggered) OVER (PARTITION BY run_id ORDER BY generation ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)
                  AND position < {PLANNED - 1} AS reheat FROM p)
SELECT *, CASE WHEN reheat THEN 0.35 END AS immigrant_rate_override FROM h
""",
    GM,
)
def _(s):
    return r.reheat_schedule(plateaus(s), PLANNED, 2)


LIMIT_MS = 2_000_000
GUARD_SQL = f"""
SELECT run_id, min(position) AS stop_position, min_by(generation, position) AS stop_generation
  FROM (SELECT run_id, generation, row_number() OVER (PARTITION BY run_id ORDER BY generation) - 1 AS position,
               coalesce(sum(wall_clock_ms) OVER {PRIOR}, 0) AS elapsed, list_sort(list(wall_clock_ms) OVER {PRIOR}) AS v
          FROM {GM}) AS x
 WHERE position > 0 AND elapsed + v[CAST(floor(len(v) / CAST(2 AS DOUBLE)) AS BIGINT) + 1] > {LIMIT_MS} GROUP BY run_id
"""


@check("wall_clock_guard", "run_id:long stop_position:long stop_generation:int", GUARD_SQL, f"results_view {GM}")
def _(s):
    return r.wall_clock_guard(s.view(GM), LIMIT_MS)


@check(
    "worker_guard",
    "run_id:long stop_after_generation:int",
    "SELECT run_id, min(generation_id) AS stop_after_generation FROM (SELECT run_id, generation_id, "
    "count(DISTINCT worker_id) AS w FROM results_view GROUP BY ALL) AS x WHERE w < 4 GROUP BY run_id",
    "results_view",
)
def _(s):
    return r.worker_guard(kpis(s), 4)


@check(
    "run_stats",
    "run_id:long jobs_planned:long jobs_submitted:long jobs_returned:long generations_completed:long stop_reason:str stopped_early:bool",
    f"""
WITH tstop AS ({GUARD_SQL.replace(GM, 'all_metrics').replace(chr(10) + 'SELECT', chr(10) + ' SELECT')}),
     k AS (SELECT run_id, generation_id, count(*) AS jobs, count(DISTINCT worker_id) AS w FROM results_view GROUP BY ALL),
     wstop AS (SELECT run_id, min(generation_id) AS g FROM k WHERE w < 4 GROUP BY run_id),
     j AS (SELECT k.*, t.stop_generation AS b, wstop.g AS a FROM k LEFT JOIN tstop t USING (run_id) LEFT JOIN wstop USING (run_id)),
     d AS (SELECT run_id, sum(jobs) AS n, count(*) AS c, max(a) AS a, max(b) AS b FROM j
            WHERE (b IS NULL OR generation_id < b) AND (a IS NULL OR generation_id <= a) GROUP BY run_id),
     e AS (SELECT *, CASE WHEN a IS NOT NULL AND (b IS NULL OR a < b) THEN 'insufficient_workers'
                          WHEN b IS NOT NULL THEN 'max_wall_clock_reached' ELSE 'completed' END AS stop_reason FROM d)
SELECT run_id, 840 AS jobs_planned, n AS jobs_submitted, n AS jobs_returned, c AS generations_completed, stop_reason,
       stop_reason <> 'completed' AS stopped_early FROM e
""".replace("WITH tstop", "WITH all_metrics AS (SELECT run_id, generation_id AS generation, CAST(sum(training_time_ms) AS BIGINT) AS wall_clock_ms FROM results_view GROUP BY ALL),\n     tstop"),
    "results_view",
)
def _(s):
    metrics = s.view("results_view").groupBy("run_id", F.col("generation_id").alias("generation")).agg(
        F.sum("training_time_ms").alias("wall_clock_ms")
    )
    k = kpis(s)
    return r.run_stats(k, 10, PLANNED, r.wall_clock_guard(metrics, LIMIT_MS), r.worker_guard(k, 4))


RUN_NUMBERS_SQL = """
    SELECT run_id, sum(training_time_ms) / CAST(8000 AS DOUBLE) AS total_s, CAST(run_id % 7 AS DOUBLE) / 2 AS submit_s,
           CAST(min(training_time_ms) AS DOUBLE) * (run_id % 5) * (run_id % 4) * 50 AS wait_ms, count(*) AS submitted, count(DISTINCT worker_id) AS workers,
           CASE WHEN run_id % 3 = 0 THEN 'total' ELSE 'first_dispatch' END AS source,
           count(*) FILTER (status = 'TIMEOUT') AS timeouts, count(*) FILTER (status = 'FAILED') AS failures FROM {results} GROUP BY run_id
"""


def run_numbers(s):
    text = RUN_NUMBERS_SQL.replace("FILTER (status", "FILTER (WHERE status")
    return s.sql(text, results=s.view("results_view"))


NUMBERS = RUN_NUMBERS_SQL.format(results="results_view")
CLOCK_SQL = f"""n AS ({NUMBERS}),
     o AS (SELECT *, CASE WHEN wait_ms > 0 THEN submit_s + wait_ms / 1000 ELSE 0 END AS first_dispatch_offset_s FROM n),
     k AS (SELECT *, CASE WHEN source = 'first_dispatch' AND first_dispatch_offset_s > 0 AND first_dispatch_offset_s < total_s
                          THEN total_s - first_dispatch_offset_s ELSE total_s END AS wall_clock_s,
                  source = 'first_dispatch' AND NOT (first_dispatch_offset_s > 0 AND first_dispatch_offset_s < total_s) AS fallback_to_total FROM o)"""


def clocked(s):
    n = run_numbers(s)
    return n.withColumns(r.metric_clock(F.col("source"), F.col("total_s"), F.col("submit_s"), F.col("wait_ms")))


@check(
    "metric_clock",
    "run_id:long first_dispatch_offset_s:dbl wall_clock_s:dbl fallback_to_total:bool",
    f"WITH {CLOCK_SQL}\nSELECT * FROM k",
    "results_view",
)
def _(s):
    return clocked(s)


@check(
    "wall_adjusted_throughput",
    "run_id:long avg_job_ms_raw:dbl avg_job_ms_adjusted:dbl jobs_per_sec_wall_adjusted:dbl",
    f"""WITH {CLOCK_SQL}
SELECT run_id, wall_clock_s / submitted * 1000 AS avg_job_ms_raw,
       greatest(wall_clock_s / submitted * 1000 - 150, 1) AS avg_job_ms_adjusted,
       submitted / greatest(wall_clock_s - submitted * CAST(150 AS DOUBLE) / 1000, CAST(0.001 AS DOUBLE)) AS jobs_per_sec_wall_adjusted FROM k""",
    "results_view",
)
def _(s):
    k = clocked(s)
    return k.withColumns(r.wall_adjusted_throughput(F.col("wall_clock_s"), F.col("submitted"), 150.0))


@check(
    "modeled_throughput",
    "run_id:long avg_job_ms_adjusted:dbl modeled_jobs_per_sec:dbl",
    f"""WITH {CLOCK_SQL}
SELECT run_id, greatest(wall_clock_s / submitted * 1000 - 150, 1) AS avg_job_ms_adjusted,
       workers * 1000 / greatest(wall_clock_s / submitted * 1000 - 150, 1) AS modeled_jobs_per_sec FROM k""",
    "results_view",
)
def _(s):
    k = clocked(s).withColumn("raw", F.col("wall_clock_s") / F.col("submitted") * 1000)
    return k.withColumns(r.modeled_throughput(F.col("raw"), F.col("workers"), 150.0))


OBSERVED_SQL = """
    SELECT *, CASE WHEN completed IN ('true', 'NaN') OR TRY_CAST(completed AS DOUBLE) <> floor(TRY_CAST(completed AS DOUBLE)) THEN NULL
                   ELSE TRY_CAST(completed AS DOUBLE) END / nullif(TRY_CAST(wall_clock_total_s AS DOUBLE), 0) AS rate FROM run_summary_view
"""


@check("observed_throughput", "run_id:long rate:dbl", OBSERVED_SQL, "run_summary_view")
def _(s):
    rate = r.observed_throughput(F.col("completed"), F.col("wall_clock_total_s"))
    return s.view("run_summary_view").withColumn("rate", rate)


@check(
    "modeled_rate_by_schema",
    "run_id:long modeled:dbl",
    "SELECT run_id, CASE WHEN v >= 0 THEN v END AS modeled FROM (SELECT run_id, CASE WHEN metric_schema_version = 2 "
    "THEN legacy_modeled_jobs_per_sec ELSE jobs_per_sec END AS v FROM run_summary_view) AS x",
    "run_summary_view",
)
def _(s):
    rate = r.modeled_rate_by_schema(
        F.col("metric_schema_version"), F.col("legacy_modeled_jobs_per_sec"), F.col("jobs_per_sec")
    )
    return s.view("run_summary_view").withColumn("modeled", rate)


@check(
    "failure_rate",
    "run_id:long rate:dbl tuning_rate:dbl",
    "SELECT run_id, (count(*) FILTER (status <> 'COMPLETED')) / CAST(count(*) AS DOUBLE) AS rate, "
    "(count(*) FILTER (status <> 'COMPLETED')) / CAST(count(*) AS DOUBLE) AS tuning_rate FROM results_view GROUP BY run_id",
    "results_view",
)
def _(s):
    k = t.status_counts(s.view("results_view"))
    none = F.lit(0)
    rate = r.failure_rate(F.col("timed_out"), F.col("failed"), F.col("unknown"), F.col("total_results"), none)
    tuning = r.tuning_failure_rate(F.col("total_results"), F.col("timed_out"), F.col("failed"))
    return k.withColumn("rate", rate).withColumn("tuning_rate", tuning)


def _pick(metric: str, share: str) -> str:
    return f"list_sort(list({metric}))[least(count(*), CAST(floor(count(*) * CAST({share} AS DOUBLE)) AS BIGINT) + 1)]"


SUMMARY_COLUMNS = (
    "run_id:long generations_completed:long jobs_returned:long completed:long timeouts:long failures:long "
    "queue_overhead_avg_ms:dbl queue_overhead_avg_pct:dbl active_workers_min:long active_workers_max:long "
    "dispatch_samples_total:long dispatch_latency_max_ms:dbl queue_wait_min_ms:dbl "
    + " ".join(f"{n}:dbl" for n in r.SUMMARY_PERCENTILES)
)


@check(
    "run_summary",
    SUMMARY_COLUMNS,
    f"""
WITH kpi0 AS ({nested(KPI_TABLE)}),
     e AS ({RUNTIME_EVENTS_SQL}),
     rt AS (SELECT run_id, generation_id, {', '.join(_family(f) for f in t.FAMILIES)},
                   min(greatest(queue_wait_ms, 0)) AS queue_wait_min_ms FROM e GROUP BY run_id, generation_id),
     j AS (SELECT kpi0.*, {', '.join(f"coalesce(rt.{f}_{x}_ms, 0) AS {f}_{x}_ms" for f in t.FAMILIES for x in ('p50', 'p90', 'max'))},
                  coalesce(rt.dispatch_latency_samples, 0) AS dispatch_latency_samples, coalesce(rt.queue_wait_min_ms, 0) AS queue_wait_min_ms
             FROM kpi0 LEFT JOIN rt USING (run_id, generation_id))
SELECT run_id, count(*) AS generations_completed, sum(jobs_count) AS jobs_returned, sum(completed) AS completed,
       sum(timed_out) AS timeouts, sum(failed) AS failures, avg(queue_overhead_ms) AS queue_overhead_avg_ms,
       avg(queue_overhead_pct) AS queue_overhead_avg_pct, min(active_workers) AS active_workers_min,
       max(active_workers) AS active_workers_max, sum(dispatch_latency_samples) AS dispatch_samples_total,
       max(dispatch_latency_max_ms) AS dispatch_latency_max_ms, min(queue_wait_min_ms) AS queue_wait_min_ms,
       {', '.join(f"{_pick(m, str(p))} AS {n}" for n, (m, p) in r.SUMMARY_PERCENTILES.items())}
  FROM j GROUP BY run_id
""",
    "results_view worker_events_view",
)
def _(s):
    runtime = t.runtime_summary(t.latency_samples(runtime_events(s)))
    return r.run_summary(t.generation_kpi(s.view("results_view"), None, runtime)).withColumnRenamed(
        "dispatch_latency_samples", "dispatch_samples_total"
    )


PEAK_SQL = """
    SELECT s.*, coalesce(best_fitness_peak, best_fitness_final, g.b, 0) AS peak_fitness FROM run_summary_view s
      LEFT JOIN (SELECT run_id, max(best_fitness) AS b FROM generation_metrics_view GROUP BY run_id) g ON s.run_id = g.run_id
"""


def peaks(s):
    return r.peak_fitness(s.view("run_summary_view"), s.view(GM))


@check("peak_fitness", "run_id:long peak_fitness:dbl", PEAK_SQL, f"run_summary_view {GM}")
def _(s):
    return peaks(s)


RANK_SQL = f"""
WITH o AS ({OBSERVED_SQL}), p AS ({PEAK_SQL})
SELECT o.run_id, o.rate AS observed_jobs_per_sec, row_number() OVER (ORDER BY o.rate DESC, o.queue_overhead_p90_pct,
       o.avg_job_ms, p.peak_fitness DESC, o.run_id) AS rank FROM o JOIN p ON o.run_id = p.run_id WHERE o.rate IS NOT NULL
"""


@check("rank_runs", "run_id:long observed_jobs_per_sec:dbl rank:long", RANK_SQL, f"run_summary_view {GM}")
def _(s):
    return r.rank_runs(peaks(s))


@check(
    "acceptance_checks",
    "run_id:long check_name:str passed:bool detail:str",
    """
WITH k AS (SELECT run_id, count(*) AS jobs_submitted, count(*) FILTER (status = 'COMPLETED') AS jobs_returned,
                  CASE WHEN run_id % 4 <> 0 THEN count(DISTINCT worker_id) END AS active_workers_min,
                  CASE WHEN run_id % 3 = 0 THEN true WHEN run_id % 3 = 1 THEN false END AS stopped_early FROM results_view GROUP BY run_id)
SELECT run_id, 'jobs_submitted == 600' AS check_name, jobs_submitted = 600 AS passed, CAST(jobs_submitted AS VARCHAR) AS detail FROM k
 UNION ALL SELECT run_id, 'jobs_returned == 600', jobs_returned = 600, CAST(jobs_returned AS VARCHAR) FROM k
 UNION ALL SELECT run_id, 'failure_rate <= 0.0', false, 'None' FROM k
 UNION ALL SELECT run_id, 'active_workers_min >= 8', coalesce(active_workers_min >= 8, false), coalesce(CAST(active_workers_min AS VARCHAR), 'None') FROM k
 UNION ALL SELECT run_id, 'stopped_early == false', coalesce(NOT stopped_early, false), coalesce(CAST(stopped_early AS VARCHAR), 'None') FROM k
""",
    "results_view",
)
def _(s):
    k = s.view("results_view").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("jobs_submitted"),
        F.count_if(F.col("status") == "COMPLETED").alias("jobs_returned"),
        F.count_distinct("worker_id").alias("w"),
    )
    shaped = k.select(
        "run_id",
        "jobs_submitted",
        "jobs_returned",
        F.lit(None).cast("double").alias("failure_rate"),
        F.when(F.col("run_id") % 4 != 0, F.col("w")).alias("active_workers_min"),
        F.when(F.col("run_id") % 3 == 0, True).when(F.col("run_id") % 3 == 1, False).alias("stopped_early"),
    )
    return r.acceptance_checks(shaped, 600, 8, 0.0)


@check(
    "speedup",
    "run_id:long workers:long speedup:dbl",
    """
WITH x AS (SELECT run_id, CAST(substr(worker_id, 2) AS BIGINT) + 1 AS workers, sum(training_time_ms) AS total_ms FROM results_view GROUP BY ALL)
SELECT run_id, workers, CAST(first_value(total_ms) OVER (PARTITION BY run_id ORDER BY workers) AS DOUBLE) / total_ms AS speedup FROM x
""",
    "results_view",
)
def _(s):
    totals = s.view("results_view").groupBy(
        "run_id", (F.substring("worker_id", 2, 9).cast("long") + 1).alias("workers")
    ).agg(F.sum("training_time_ms").alias("total_ms"))
    return r.speedup(totals, ["run_id"])


@check(
    "comparison_table",
    "run_name:str seed:long final_best_fitness:dbl total_time_s:dbl points:long",
    f"SELECT run_name, seed, max_by(best_fitness, generation) AS final_best_fitness, sum(wall_clock_ms) / CAST(1000 AS DOUBLE) AS total_time_s, "
    f"count(*) AS points FROM {GM} GROUP BY run_name, seed",
    GM,
)
def _(s):
    return r.comparison_table(s.view(GM))


@check(
    "convergence_band",
    "run_id:long generation:int best_fitness:dbl avg_fitness:dbl worst_fitness:dbl wall_clock_s:dbl",
    f"SELECT *, wall_clock_ms / CAST(1000 AS DOUBLE) AS wall_clock_s FROM {GM}",
    GM,
)
def _(s):
    return r.convergence_band(s.view(GM))


# --- tuning -----------------------------------------------------------------


@check(
    "repeatability",
    "stage:str knob_value:long mean_rate:dbl std_rate:dbl cv:dbl passed:bool",
    """
SELECT stage, knob_value, avg(jobs_per_sec) AS mean_rate, stddev_pop(jobs_per_sec) AS std_rate,
       stddev_pop(jobs_per_sec) / avg(jobs_per_sec) AS cv, stddev_pop(jobs_per_sec) / avg(jobs_per_sec) <= 0.15 AS passed
  FROM tuning_view GROUP BY stage, knob_value
""",
    "tuning_view",
)
def _(s):
    return g.repeatability(s.view("tuning_view"), ["stage", "knob_value"])


BEST_SQL = "ORDER BY CASE WHEN failure_rate <= CAST(0.1 AS DOUBLE) THEN 0 ELSE 1 END, jobs_per_sec DESC, run_seq"


@check(
    "best_candidate_run",
    "stage:str knob_value:long run_seq:long jobs_per_sec:dbl failure_rate:dbl feasible:bool",
    f"""
WITH b AS (SELECT *, row_number() OVER (PARTITION BY stage, knob_value {BEST_SQL}) AS n FROM tuning_view)
SELECT *, failure_rate <= CAST(0.1 AS DOUBLE) AS feasible FROM b WHERE n = 1
""",
    "tuning_view",
)
def _(s):
    return g.best_candidate_run(s.view("tuning_view"), ["stage", "knob_value"])


@check(
    "sweep_winners",
    "stage:str winning_value:long run_seq:long jobs_per_sec:dbl failure_rate:dbl",
    f"""
WITH b AS (SELECT *, row_number() OVER (PARTITION BY stage {BEST_SQL}) AS n FROM tuning_view)
SELECT *, knob_value AS winning_value FROM b WHERE n = 1
""",
    "tuning_view",
)
def _(s):
    return g.sweep_winners(s.view("tuning_view"))


@check(
    "tuning_gates",
    "stage:str knob_value:long run_seq:long min_rate:dbl medium_passed:bool repeat_passed:bool",
    f"""
WITH b AS (SELECT *, row_number() OVER (PARTITION BY stage, knob_value {BEST_SQL}) AS n FROM tuning_view),
     v AS (SELECT stage, knob_value, stddev_pop(jobs_per_sec) / avg(jobs_per_sec) AS cv FROM tuning_view GROUP BY ALL)
SELECT m.stage, m.knob_value, m.run_seq, b.jobs_per_sec * CAST(0.9 AS DOUBLE) AS min_rate,
       m.failure_rate <= CAST(0.1 AS DOUBLE) AND m.jobs_per_sec >= b.jobs_per_sec * CAST(0.9 AS DOUBLE) AND m.run_seq % 7 <> 0
         AND m.run_seq % 5 <> 0 AS medium_passed, v.cv <= 0.15 AS repeat_passed
  FROM tuning_view m JOIN b ON m.stage = b.stage AND m.knob_value = b.knob_value AND b.n = 1
  JOIN v ON m.stage = v.stage AND m.knob_value = v.knob_value
""",
    "tuning_view",
)
def _(s):
    keys = ["stage", "knob_value"]
    runs = s.view("tuning_view")
    medium = runs.withColumn("hang_detected", F.col("run_seq") % 7 == 0).withColumn("smoke_ok", F.col("run_seq") % 5 != 0)
    return g.tuning_gates(medium, g.best_candidate_run(runs, keys), g.repeatability(runs, keys), keys)


@check(
    "run_case_metrics",
    "run_seq:long jobs_total:long timeouts:long failures:long jobs_per_sec:dbl hang_detected:bool failure_rate:dbl",
    """
WITH x AS (SELECT run_seq, run_seq % 4 = 0 AS gone, 10 + knob_value AS pop, jobs_per_sec, failure_rate, run_seq % 9 = 0 AS hang FROM tuning_view),
     y AS (SELECT *, CASE WHEN gone THEN pop * 5 ELSE pop * 4 END AS jobs_total,
                  CASE WHEN gone THEN pop * 5 ELSE CAST(floor(pop * failure_rate) AS BIGINT) END AS timeouts,
                  CASE WHEN gone THEN 0 ELSE 1 END AS failures FROM x)
SELECT run_seq, jobs_total, timeouts, failures, CASE WHEN gone THEN 0 ELSE jobs_per_sec END AS jobs_per_sec, hang AS hang_detected,
       (timeouts + failures) / CAST(jobs_total AS DOUBLE) AS failure_rate FROM y
""",
    "tuning_view",
)
def _(s):
    runs = s.view("tuning_view")
    cases = runs.select(
        "run_seq",
        (10 + F.col("knob_value")).alias("pop_size"),
        F.lit(5).alias("num_gens"),
        F.when(F.col("run_seq") % 9 == 0, 124).otherwise(0).alias("exit_code"),
    )
    summaries = runs.filter("run_seq % 4 <> 0").select(
        "run_seq",
        ((10 + F.col("knob_value")) * 4).alias("jobs_total"),
        F.lit(1.0).alias("wall_clock_s"),
        "jobs_per_sec",
        F.floor((10 + F.col("knob_value")) * F.col("failure_rate")).alias("timeouts"),
        F.lit(1).alias("failures"),
    )
    return g.run_case_metrics(cases, summaries)


# --- comparison ---------------------------------------------------------------

SEED_SQL = f"""
    SELECT run_name, seed, count(*) AS evals_completed, max(best_fitness) AS best_fitness_peak,
           max_by(best_fitness, generation) AS final_best_fitness, sum(wall_clock_ms) / CAST(1000 AS DOUBLE) AS wall_clock_s
      FROM {GM} GROUP BY run_name, seed
"""
STRATEGY_SQL = """
    SELECT run_name, avg(best_fitness_peak) AS mean_best_fitness_peak, median(best_fitness_peak) AS median_best_fitness_peak,
           avg(evals_completed) AS mean_evals_completed, median(evals_completed) AS median_evals_completed,
           avg(wall_clock_s) AS mean_wall_clock_s, median(wall_clock_s) AS median_wall_clock_s FROM seeds GROUP BY run_name
"""
RANKED_SQL = """
    SELECT *, row_number() OVER (ORDER BY median_best_fitness_peak DESC, median_evals_completed DESC, mean_best_fitness_peak DESC,
             run_name) AS rank FROM strategies
"""
RANKING = f"WITH seeds AS ({SEED_SQL}), strategies AS ({STRATEGY_SQL}), ranking AS ({RANKED_SQL})"


def seeds(s):
    return c.seed_summary(s.view(GM))


def ranking(s):
    return c.rank_strategies(c.strategy_summary(seeds(s)))


@check(
    "seed_summary",
    "run_name:str seed:long evals_completed:long best_fitness_peak:dbl final_best_fitness:dbl wall_clock_s:dbl",
    SEED_SQL,
    GM,
)
def _(s):
    return seeds(s)


STRATEGY_COLUMNS = "run_name:str " + " ".join(
    f"{k}_{m}:dbl" for m in ("best_fitness_peak", "evals_completed", "wall_clock_s") for k in ("mean", "median")
)


@check("strategy_summary", STRATEGY_COLUMNS, f"WITH seeds AS ({SEED_SQL})\nSELECT * FROM ({STRATEGY_SQL}) AS y", GM)
def _(s):
    return c.strategy_summary(seeds(s))


@check("rank_strategies", STRATEGY_COLUMNS + " rank:long", f"{RANKING}\nSELECT * FROM ranking", GM)
def _(s):
    return ranking(s)


@check(
    "per_seed_listing",
    "rank:long run_name:str seed:long best_fitness_peak:dbl",
    f"{RANKING}\nSELECT ranking.rank, seeds.* FROM seeds JOIN ranking USING (run_name)",
    GM,
)
def _(s):
    return c.per_seed_listing(seeds(s), ranking(s))


@check(
    "reference_row",
    "run_name:str reference_only:bool best_peak:dbl wall_clock_total_s:dbl completed:long observed_jobs_per_sec:dbl modeled_jobs_per_sec:dbl rank:long",
    f"""{RANKING}, o AS ({OBSERVED_SQL}),
     m AS (SELECT concat('run ', run_id) AS run_name, true AS reference_only, coalesce(best_fitness_peak, 0) AS best_peak,
                  nullif(TRY_CAST(wall_clock_total_s AS DOUBLE), 0) AS wall_clock_total_s,
                  CASE WHEN rate IS NOT NULL THEN TRY_CAST(completed AS BIGINT) END AS completed, rate AS observed_jobs_per_sec,
                  CASE WHEN jobs_per_sec >= 0 THEN jobs_per_sec END AS modeled_jobs_per_sec, NULL::BIGINT AS rank FROM o)
SELECT run_name, false AS reference_only, median_best_fitness_peak AS best_peak, NULL AS wall_clock_total_s, NULL AS completed,
       NULL AS observed_jobs_per_sec, NULL AS modeled_jobs_per_sec, rank FROM ranking UNION ALL SELECT * FROM m""",
    f"{GM} run_summary_view",
)
def _(s):
    summary = s.view("run_summary_view").select(
        "*",
        F.concat(F.lit("run "), "run_id").alias("name"),
        F.when(F.col("jobs_per_sec") >= 0, F.col("jobs_per_sec")).alias("modeled_jobs_per_sec"),
    )
    return c.reference_row(ranking(s), summary)


BINS = 12
BINS_SQL = f"""
     cm AS (SELECT run_name, seed, run_id, generation, sum(wall_clock_ms) OVER {UPTO} AS cum_ms,
                   max(best_fitness) OVER {UPTO} AS best, sum(wall_clock_ms) OVER (PARTITION BY run_id) AS total_ms FROM {GM}),
     bn AS (SELECT run_name, seed, run_id, i AS bin, min_by(best, generation) AS best, min(cum_ms) / CAST(1000 AS DOUBLE) AS runtime_s,
                   max(total_ms) / CAST(1000 AS DOUBLE) AS total_s
              FROM cm, range(1, {BINS + 1}) AS b(i) WHERE cum_ms * {BINS} >= total_ms * i GROUP BY ALL)
"""
T90 = "coalesce(min(CASE WHEN best >= CAST(0.9 AS DOUBLE) * pk THEN runtime_s END), max(total_runtime_s))"
RUNS_SQL = f"""{BINS_SQL.strip()},
     pk AS (SELECT *, max(best) OVER (PARTITION BY run_id) AS pk, total_s AS total_runtime_s FROM bn),
     ev AS (SELECT run_id, CAST(count(*) AS DOUBLE) AS total_evals FROM {GM} GROUP BY run_id),
     rs AS (SELECT run_name, seed, run_id, max(total_runtime_s) AS total_runtime_s, max(best) AS peak_fitness,
                   {T90} AS time_to_90_peak_s, (sum(best) + (min_by(best, bin) - max_by(best, bin)) / 2) / {BINS} AS convergence_auc
              FROM pk GROUP BY ALL),
     sr AS (SELECT rs.*, total_evals, total_evals / total_runtime_s AS throughput_jobs_per_s FROM rs JOIN ev USING (run_id))"""


@check(
    "progress_bins",
    "run_id:long bin:int best:dbl runtime_s:dbl total_s:dbl",
    f"WITH {BINS_SQL.strip()}\nSELECT * FROM bn",
    GM,
)
def _(s):
    return c.progress_bins(s.view(GM), ["run_id"], BINS)


@check("convergence_auc", "run_id:long convergence_auc:dbl", f"WITH {RUNS_SQL}\nSELECT * FROM sr", GM)
def _(s):
    return c.convergence_auc(c.progress_bins(s.view(GM), ["run_id"], BINS), ["run_id"])


@check(
    "time_to_fraction",
    "run_id:long time_to_fraction_s:dbl",
    f"WITH {RUNS_SQL}\nSELECT *, time_to_90_peak_s AS time_to_fraction_s FROM sr",
    GM,
)
def _(s):
    return c.time_to_fraction(c.progress_bins(s.view(GM), ["run_id"], BINS), ["run_id"])


SERIES = "total_runtime_s:dbl total_evals:dbl peak_fitness:dbl throughput_jobs_per_s:dbl time_to_90_peak_s:dbl convergence_auc:dbl"


@check("run_series", f"run_id:long {SERIES}", f"WITH {RUNS_SQL}\nSELECT * FROM sr", GM)
def _(s):
    return c.run_series(s.view(GM), ["run_id"], BINS)


KEY_SQL = (
    "CASE run_name WHEN 'Random Search' THEN 'random_search' WHEN 'Grid Search' THEN 'grid_search' WHEN 'Bayesian (Optuna TPE)' "
    "THEN 'optuna_tpe' WHEN 'Differential Evolution' THEN 'differential_evolution' ELSE 'simulated_annealing' END"
)
AGG_SQL = f"""{RUNS_SQL},
     pb AS (SELECT run_name, bin, avg(best) AS best, sum(runtime_s) AS runtime_s FROM bn GROUP BY ALL),
     tt AS (SELECT run_name, sum(total_runtime_s) AS total_runtime_s, sum(total_evals) AS total_evals, avg(peak_fitness) AS peak_fitness,
                   avg(convergence_auc) AS convergence_auc, count(*) AS n FROM sr GROUP BY ALL),
     q AS (SELECT pb.*, max(best) OVER (PARTITION BY run_name) AS pk, total_runtime_s FROM pb JOIN tt USING (run_name)),
     tn AS (SELECT run_name, {T90} AS time_to_90_peak_s FROM q GROUP BY ALL),
     ag AS (SELECT {KEY_SQL} AS key, tt.*, total_evals / total_runtime_s AS throughput_jobs_per_s, time_to_90_peak_s,
                   concat('local_aggregate_', n, '_seeds') AS source FROM tt JOIN tn USING (run_name))"""


def aggregated(s):
    return c.seed_aggregate_series(s.view(GM), BINS)


@check("seed_aggregate_series", f"key:str {SERIES} source:str", f"WITH {AGG_SQL}\nSELECT * FROM ag", GM)
def _(s):
    return aggregated(s)


REFERENCE_SQL = f"""
     rb AS (SELECT b.*, o.rate, CAST(o.completed AS DOUBLE) AS ev, CAST(o.wall_clock_total_s AS DOUBLE) AS rt, coalesce(o.best_fitness_peak, 0) AS pf
              FROM bn b JOIN ({OBSERVED_SQL}) o ON b.run_id = o.run_id WHERE o.rate IS NOT NULL),
     rq AS (SELECT run_id, bin, best, runtime_s * rt / total_s AS runtime_s, max(best) OVER (PARTITION BY run_id) AS pk, rt AS total_runtime_s, rate, ev, pf FROM rb),
     rf AS (SELECT run_id, max(total_runtime_s) AS total_runtime_s, max(ev) AS total_evals, max(pf) AS peak_fitness, max(rate) AS throughput_jobs_per_s,
                   {T90} AS time_to_90_peak_s, (sum(best) + (min_by(best, bin) - max_by(best, bin)) / 2) / {BINS} AS convergence_auc FROM rq GROUP BY run_id)
"""


def referenced(s):
    return c.reference_series(s.view(GM), s.view("run_summary_view"), ["run_id"], BINS)


@check(
    "reference_series",
    f"run_id:long {SERIES}",
    f"WITH {BINS_SQL.strip()},\n{REFERENCE_SQL.strip()}\nSELECT * FROM rf",
    f"{GM} run_summary_view",
)
def _(s):
    return referenced(s)


COMPARISON_SQL = f"""{AGG_SQL},
{REFERENCE_SQL.strip()},
     cs AS (SELECT 'reference' AS key, 0 AS display_order, total_runtime_s, total_evals, peak_fitness, throughput_jobs_per_s, time_to_90_peak_s, convergence_auc, 'single_run' AS source FROM rf
            UNION ALL SELECT key, CASE key WHEN 'optuna_tpe' THEN 1 WHEN 'random_search' THEN 2 WHEN 'grid_search' THEN 3 WHEN 'differential_evolution' THEN 4 ELSE 5 END,
                   total_runtime_s, total_evals, peak_fitness, throughput_jobs_per_s, time_to_90_peak_s, convergence_auc, source FROM ag)"""


@check(
    "comparison_series",
    f"key:str display_order:int {SERIES} source:str",
    f"WITH {COMPARISON_SQL}\nSELECT * FROM cs",
    f"{GM} run_summary_view",
)
def _(s):
    return c.comparison_series(referenced(s), aggregated(s))


@check(
    "radar_metrics",
    "key:str axis:str raw_value:dbl normalized:dbl",
    f"""WITH {AGG_SQL},
     ax AS (SELECT key, 'Peak Fitness' AS axis, peak_fitness AS raw_value, 'c' AS m FROM ag
            UNION ALL SELECT key, 'Time to 90% Peak (min)', time_to_90_peak_s * (1 / CAST(60 AS DOUBLE)), 'm' FROM ag
            UNION ALL SELECT key, 'Total Run Time (min)', total_runtime_s * (1 / CAST(60 AS DOUBLE)), 'm' FROM ag
            UNION ALL SELECT key, 'Total Evals Completed', total_evals, 'm' FROM ag
            UNION ALL SELECT key, 'Convergence AUC', convergence_auc, 'c' FROM ag)
SELECT *, CASE WHEN m = 'c' THEN least(1, greatest(0, raw_value)) ELSE raw_value / max(raw_value) OVER (PARTITION BY axis) END AS normalized FROM ax""",
    GM,
)
def _(s):
    return c.radar_metrics(aggregated(s))


@check(
    "normalize_run_names",
    "run_id:long run_name:str key:str slug:str seed_sum:long",
    f"""
SELECT DISTINCT run_id, run_name, {KEY_SQL} AS key,
       trim(regexp_replace(lower(run_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug, 2 * seed + 1 AS seed_sum FROM {GM}
""",
    GM,
)
def _(s):
    from tunelake.functions.scalars import seed_list, slug

    runs = s.view(GM).select("run_id", "run_name", "seed").distinct()
    listed = F.concat_ws(" , ", F.col("seed"), F.lit(""), F.col("seed") + 1)
    return c.normalize_run_names(runs).select(
        "*", slug(F.col("run_name")).alias("slug"),
        F.aggregate(seed_list(listed), F.lit(0).cast("long"), lambda a, v: a + v).alias("seed_sum"),
    )
