"""Telemetry queries."""

from pyspark.sql import functions as F

from checks.base import check
from tunelake.operators import telemetry as t

KPI_SQL = """
WITH w AS (SELECT run_id, generation_id, worker_id, sum(training_time_ms) AS busy, count(*) AS jobs
             FROM results_view GROUP BY ALL),
     clock AS (SELECT run_id, generation_id, max(busy) + sum(jobs) * 10 AS wall_clock_ms FROM w GROUP BY ALL),
     k AS (SELECT run_id, generation_id, count(*) AS jobs_count,
                  count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'FAILED') AS failed,
                  count(*) FILTER (status = 'TIMEOUT') AS timed_out, count(DISTINCT worker_id) AS active_workers,
                  sum(training_time_ms) AS train_total_ms,
                  list_sort(list(training_time_ms)) AS v
             FROM results_view GROUP BY ALL),
     kpi AS (SELECT k.*, wall_clock_ms, v[least(jobs_count, CAST(floor(jobs_count * CAST(0.5 AS DOUBLE)) AS BIGINT) + 1)] AS train_p50_ms,
                    v[least(jobs_count, CAST(floor(jobs_count * CAST(0.9 AS DOUBLE)) AS BIGINT) + 1)] AS train_p90_ms,
                    CAST(train_total_ms AS DOUBLE) / active_workers AS ideal_wall_ms,
                    greatest(wall_clock_ms - CAST(train_total_ms AS DOUBLE) / active_workers, 0) AS queue_overhead_ms
               FROM k JOIN clock USING (run_id, generation_id))
SELECT *, queue_overhead_ms / wall_clock_ms AS queue_overhead_pct,
       jobs_count / (CAST(wall_clock_ms AS DOUBLE) / 1000) AS gen_jobs_per_sec FROM kpi
"""
KPI_COLUMNS = (
    "run_id:long generation_id:int jobs_count:long completed:long failed:long timed_out:long active_workers:long "
    "wall_clock_ms:long train_total_ms:long train_p50_ms:long train_p90_ms:long ideal_wall_ms:dbl "
    "queue_overhead_ms:dbl queue_overhead_pct:dbl gen_jobs_per_sec:dbl"
)


def kpis(s):
    return t.generation_kpi(s.view("results_view"))


@check(
    "modeled_wall_clock",
    "run_id:long generation_id:int wall_clock_ms:long",
    f"SELECT * FROM ({KPI_SQL.strip()}) AS k",
    "results_view",
)
def _(s):
    return t.modeled_wall_clock(s.view("results_view"))


@check("generation_kpi", KPI_COLUMNS, KPI_SQL, "results_view")
def _(s):
    return kpis(s)


@check(
    "nearest_rank",
    "run_id:long samples:long p50:long p90:long p99:long",
    """
WITH k AS (SELECT run_id, count(*) AS n, list_sort(list(training_time_ms)) AS v FROM results_view GROUP BY run_id)
SELECT run_id, n AS samples, v[least(n, CAST(floor(n * CAST(0.5 AS DOUBLE)) AS BIGINT) + 1)] AS p50,
       v[least(n, CAST(floor(n * CAST(0.9 AS DOUBLE)) AS BIGINT) + 1)] AS p90,
       v[least(n, CAST(floor(n * CAST(0.99 AS DOUBLE)) AS BIGINT) + 1)] AS p99 FROM k
""",
    "results_view",
)
def _(s):
    shares = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    return t.nearest_rank(s.view("results_view"), ["run_id"], "training_time_ms", shares)


RUNTIME_EVENTS_SQL = """
    SELECT user_id % 10 AS run_id, generation_id, dispatch_latency_ms,
           dispatch_latency_ms * 7 - 50 AS queue_wait_ms,
           CASE WHEN event_seq % 3 = 0 THEN dispatch_latency_ms * 3 END AS worker_idle_gap_ms
      FROM worker_events_view WHERE event = 'dispatch'
"""


def runtime_events(s):
    return s.sql(RUNTIME_EVENTS_SQL.replace("worker_events_view", "{events}"), events=s.view("worker_events_view"))


def _family(name: str) -> str:
    v = f"list_sort(list(greatest({name}_ms, 0)) FILTER ({name}_ms IS NOT NULL))"
    n = f"count({name}_ms)"
    return f"""{n} AS {name}_samples,
      coalesce(({v})[least({n}, CAST(floor({n} * CAST(0.5 AS DOUBLE)) AS BIGINT) + 1)], 0) AS {name}_p50_ms,
      coalesce(({v})[least({n}, CAST(floor({n} * CAST(0.9 AS DOUBLE)) AS BIGINT) + 1)], 0) AS {name}_p90_ms,
      coalesce(max(greatest({name}_ms, 0)) FILTER ({name}_ms IS NOT NULL), 0) AS {name}_max_ms"""


RUNTIME_COLUMNS = "run_id:long generation_id:int " + " ".join(
    f"{f}_samples:long {f}_p50_ms:dbl {f}_p90_ms:dbl {f}_max_ms:dbl" for f in t.FAMILIES
) + " queue_wait_min_ms:dbl"


@check(
    "runtime_summary",
    RUNTIME_COLUMNS,
    f"""
WITH e AS ({RUNTIME_EVENTS_SQL})
SELECT run_id, generation_id, {', '.join(_family(f) for f in t.FAMILIES)},
       min(greatest(queue_wait_ms, 0)) AS queue_wait_min_ms
  FROM e GROUP BY run_id, generation_id
""",
    "worker_events_view",
)
def _(s):
    return t.runtime_summary(t.latency_samples(runtime_events(s)))


@check(
    "lifecycle_latency",
    "job_id:str queue_wait_ms:dbl dispatch_latency_ms:dbl",
    """
SELECT job_id, (at_us - (at_us - CAST(floor(dispatch_latency_ms * 100) AS BIGINT) * 1000)) / CAST(1000 AS DOUBLE) AS queue_wait_ms,
       (at_us - (at_us - CAST(floor(dispatch_latency_ms * 100) AS BIGINT))) / CAST(1000 AS DOUBLE) AS dispatch_latency_ms
  FROM worker_events_view WHERE event = 'dispatch'
""",
    "worker_events_view",
)
def _(s):
    back = F.floor(F.col("dispatch_latency_ms") * 100)
    jobs = s.view("worker_events_view").filter("event = 'dispatch'").select(
        "job_id",
        F.col("at_us").alias("dispatched_us"),
        (F.col("at_us") - back * 1000).alias("enqueued_us"),
        (F.col("at_us") - back).alias("write_started_us"),
    )
    return t.lifecycle_latency(jobs)


@check(
    "worker_idle_gap",
    "worker_id:str event_seq:long worker_idle_gap_ms:dbl",
    """
WITH g AS (SELECT *, last_value(CASE WHEN event IN ('completed', 'failed') THEN at_us END IGNORE NULLS)
                    OVER (PARTITION BY worker_id ORDER BY at_us, event_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p
             FROM worker_events_view)
SELECT worker_id, event_seq, (at_us - p) / CAST(1000 AS DOUBLE) AS worker_idle_gap_ms FROM g WHERE event = 'dispatch'
""",
    "worker_events_view",
)
def _(s):
    return t.worker_idle_gap(s.view("worker_events_view"))


RESOLVE_ORDER = ["received_at", "generation_id", "training_time_ms", "worker_id", "status", "validation_accuracy", "training_loss"]
JOBS_SQL = "SELECT run_id, job_id, min(generation_id) AS generation_id FROM results_view GROUP BY run_id, job_id"
RESOLVE_SQL = """
    SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY run_id, job_id) AS deliveries FROM results_view
    WINDOW w AS (PARTITION BY run_id, job_id ORDER BY received_at, generation_id, training_time_ms, worker_id, status,
                 validation_accuracy, training_loss)
"""


@check(
    "resolve_jobs",
    "run_id:long job_id:str generation_id:int worker_id:str validation_accuracy:dbl training_loss:dbl "
    "training_time_ms:long status:str error_message:str ignored_deliveries:long",
    f"""
WITH f AS ({RESOLVE_SQL}), jb AS (SELECT * FROM ({JOBS_SQL}) AS q WHERE generation_id % 5 <> 0)
SELECT f.run_id, f.job_id, jb.generation_id, CASE WHEN status = 'COMPLETED' THEN worker_id ELSE '' END AS worker_id,
       CASE WHEN status = 'COMPLETED' THEN validation_accuracy ELSE 0 END AS validation_accuracy,
       CASE WHEN status = 'COMPLETED' THEN training_loss ELSE 0 END AS training_loss,
       CASE WHEN status = 'COMPLETED' THEN training_time_ms ELSE 0 END AS training_time_ms,
       CASE WHEN status = 'COMPLETED' THEN status ELSE 'FAILED' END AS status,
       CASE WHEN status <> 'COMPLETED' THEN concat('lost by ', worker_id) END AS error_message, deliveries - 1 AS ignored_deliveries
  FROM f JOIN jb ON jb.run_id = f.run_id AND jb.job_id = f.job_id WHERE rn = 1
""",
    "results_view",
)
def _(s):
    delivered = s.view("results_view").withColumn("error_message", F.concat(F.lit("lost by "), "worker_id"))
    return t.resolve_jobs(delivered, RESOLVE_ORDER, job_table(s).filter("generation_id % 5 <> 0"))


@check(
    "status_counts",
    "run_id:long total_results:long completed:long timed_out:long failed:long unknown:long",
    """
SELECT run_id, count(*) AS total_results, count(*) FILTER (status = 'COMPLETED') AS completed,
       count(*) FILTER (status = 'TIMEOUT') AS timed_out, count(*) FILTER (status = 'FAILED') AS failed,
       count(*) FILTER (status NOT IN ('COMPLETED', 'TIMEOUT', 'FAILED')) AS unknown
  FROM results_view GROUP BY run_id
""",
    "results_view",
)
def _(s):
    return t.status_counts(s.view("results_view"))


def job_table(s):
    return s.view("results_view").groupBy("run_id", "job_id").agg(F.min("generation_id").alias("generation_id"))


HALF_SQL = "SELECT DISTINCT run_id, job_id FROM results_view WHERE received_at < DATE '2001-06-01' AND training_time_ms % 50 <> 0"


def half_resolved(s):
    seen = s.view("results_view").filter("received_at < DATE '2001-06-01' AND training_time_ms % 50 <> 0")
    return t.resolve_jobs(seen, RESOLVE_ORDER)


@check(
    "generation_complete",
    "run_id:long generation_id:int submitted:long terminal:long complete:bool",
    f"""
WITH j AS ({JOBS_SQL}), r AS ({HALF_SQL})
SELECT j.run_id, j.generation_id, count(*) AS submitted, count(r.job_id) AS terminal, count(*) = count(r.job_id) AS complete
  FROM j LEFT JOIN r ON j.run_id = r.run_id AND j.job_id = r.job_id GROUP BY j.run_id, j.generation_id
""",
    "results_view",
)
def _(s):
    return t.generation_complete(job_table(s), half_resolved(s))


@check(
    "generation_wall_clock",
    "run_id:long generation_id:int wall_clock_ms:long",
    """
WITH m AS (SELECT run_id, generation_id, job_id, training_time_ms * 1000 AS at_us,
                  CASE WHEN status = 'TIMEOUT' THEN 'timeout' ELSE 'result' END AS source FROM results_view),
     j AS (SELECT run_id, generation_id, job_id, min(at_us) AS f, max(at_us) FILTER (source = 'result') AS r FROM m GROUP BY ALL),
     g AS (SELECT run_id, generation_id, max(f) AS f, max(r) AS r FROM j GROUP BY ALL)
SELECT run_id, generation_id, CASE WHEN r >= f THEN CAST(floor((r - 500) / CAST(1000 AS DOUBLE)) AS BIGINT) ELSE 0 END AS wall_clock_ms FROM g
""",
    "results_view",
)
def _(s):
    messages = s.view("results_view").select(
        "run_id",
        "generation_id",
        "job_id",
        (F.col("training_time_ms") * 1000).alias("at_us"),
        F.when(F.col("status") == "TIMEOUT", "timeout").otherwise("result").alias("source"),
    )
    submitted = messages.groupBy("run_id", "generation_id").agg(
        F.count_distinct("job_id").alias("jobs"), F.lit(500).alias("submitted_us")
    )
    return t.generation_wall_clock(submitted, messages)


@check(
    "enqueue_batch",
    "run_id:long generation_id:int ordinal:long seq:long job_id:str",
    """
WITH q AS (SELECT run_id, CAST(y AS INTEGER) AS generation_id, ordinal,
                  row_number() OVER (PARTITION BY run_id ORDER BY y, ordinal) - 1 AS seq FROM population_view)
SELECT *, concat('gen', generation_id, '_job', seq) AS job_id FROM q
""",
    "population_view",
)
def _(s):
    return t.enqueue_batch(s.view("population_view").withColumn("generation_id", F.col("y").cast("int")))


def config_struct():
    return F.struct(
        F.array(*[F.col(f"conv_filters_{i}") for i in (1, 2, 3)]).alias("conv_filters"),
        F.array(F.col("dense_units_1")).alias("dense_units"),
        "epochs",
        "batch_size",
    )


COST_SQL = (
    "SELECT *, epochs * (conv_filters_1 + conv_filters_2 + conv_filters_3 + dense_units_1 / CAST(4 AS DOUBLE)) "
    "* (CAST(128 AS DOUBLE) / batch_size) AS cost FROM configs_view"
)


@check("estimated_cost", "seq:long cost:dbl", COST_SQL, "configs_view")
def _(s):
    configs = s.view("configs_view").withColumn("config", config_struct())
    return configs.withColumn("cost", t.estimated_cost(F.col("config")))


@check(
    "dispatch_order",
    "generation_id:long seq:long heaviest_rank:long fifo_rank:long",
    f"""
WITH c AS ({COST_SQL})
SELECT generation_id, seq, row_number() OVER (PARTITION BY generation_id ORDER BY cost DESC, seq) AS heaviest_rank,
       row_number() OVER (PARTITION BY generation_id ORDER BY seq) AS fifo_rank FROM c
""",
    "configs_view",
)
def _(s):
    configs = s.view("configs_view").withColumn("config", config_struct())
    heavy = t.dispatch_order(configs, ["generation_id"]).select("seq", F.col("dispatch_rank").alias("heaviest_rank"))
    fifo = t.dispatch_order(configs, ["generation_id"], "fifo").withColumnRenamed("dispatch_rank", "fifo_rank")
    return fifo.join(heavy, "seq")


MOMENT_US = 1_705_000_000_000_000


@check(
    "scheduler_status",
    "connected_workers:long idle_workers:long busy_workers:long pending_jobs:long",
    f"""
WITH c AS (SELECT worker_id, max_by(event, (at_us, event_seq)) AS e FROM worker_events_view
            WHERE at_us <= {MOMENT_US} AND event <> 'heartbeat' GROUP BY worker_id),
     j AS (SELECT at_us AS dequeued_us, at_us - CAST(floor(dispatch_latency_ms * 100000000) AS BIGINT) AS enqueued_us
             FROM worker_events_view WHERE event = 'dispatch')
SELECT (SELECT count(*) FROM c) AS connected_workers, (SELECT count(*) FROM c WHERE e <> 'dispatch') AS idle_workers,
       (SELECT count(*) FROM c WHERE e = 'dispatch') AS busy_workers,
       (SELECT count(*) FROM j WHERE enqueued_us <= {MOMENT_US} AND dequeued_us > {MOMENT_US}) AS pending_jobs
""",
    "worker_events_view",
)
def _(s):
    events = s.view("worker_events_view")
    jobs = events.filter("event = 'dispatch'").select(
        F.col("at_us").alias("dequeued_us"),
        (F.col("at_us") - F.floor(F.col("dispatch_latency_ms") * 100000000)).alias("enqueued_us"),
    )
    return t.scheduler_status(events, jobs, MOMENT_US)


TIMEOUT_MS = 86_400_000
HORIZON_US = 1_706_745_600_000_000


@check(
    "heartbeat_timeouts",
    "worker_id:str dead_us:long failed_job_id:str",
    f"""
WITH a AS (SELECT worker_id, at_us, lead(at_us, 1, {HORIZON_US}) OVER (PARTITION BY worker_id ORDER BY at_us, event_seq) AS nxt
             FROM worker_events_view WHERE event IN ('heartbeat', 'registration')),
     d AS (SELECT worker_id, at_us + {TIMEOUT_MS * 1000} AS dead_us FROM a WHERE floor((nxt - at_us) / CAST(1000 AS DOUBLE)) > {TIMEOUT_MS}),
     p AS (SELECT d.worker_id, d.dead_us, max_by(e.event, (e.at_us, e.event_seq)) AS event,
                  max_by(e.job_id, (e.at_us, e.event_seq)) AS job_id
             FROM d LEFT JOIN worker_events_view e ON e.worker_id = d.worker_id AND e.at_us <= d.dead_us
                  AND e.event IN ('dispatch', 'completed', 'failed') GROUP BY d.worker_id, d.dead_us)
SELECT worker_id, dead_us, CASE WHEN event = 'dispatch' THEN job_id END AS failed_job_id FROM p
""",
    "worker_events_view",
)
def _(s):
    return t.heartbeat_timeouts(s.view("worker_events_view"), TIMEOUT_MS, HORIZON_US)


@check(
    "registration_audit",
    "worker_id:str event_seq:long accepted:bool",
    """
WITH e AS (SELECT *, CASE WHEN event = 'failed' THEN 'disconnect' ELSE event END AS kind FROM worker_events_view),
     g AS (SELECT *, last_value(CASE WHEN kind IN ('registration', 'disconnect') THEN kind END IGNORE NULLS)
                    OVER (PARTITION BY worker_id ORDER BY at_us, event_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM e)
SELECT worker_id, event_seq, coalesce(p, 'disconnect') = 'disconnect' AS accepted FROM g WHERE kind = 'registration'
""",
    "worker_events_view",
)
def _(s):
    events = s.view("worker_events_view")
    event = F.when(F.col("event") == "failed", "disconnect").otherwise(F.col("event"))
    return t.registration_audit(events.withColumn("event", event))


@check(
    "disconnect_failures",
    "worker_id:str dead_us:long failed_job_id:str",
    """
WITH e AS (SELECT *, CASE WHEN event = 'registration' THEN 'disconnect' ELSE event END AS kind FROM worker_events_view),
     g AS (SELECT *, last_value(CASE WHEN kind IN ('dispatch', 'completed', 'failed') THEN kind END IGNORE NULLS) OVER w AS k,
                  last_value(CASE WHEN kind IN ('dispatch', 'completed', 'failed') THEN job_id END IGNORE NULLS) OVER w AS j FROM e
           WINDOW w AS (PARTITION BY worker_id ORDER BY at_us, event_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT worker_id, at_us AS dead_us, j AS failed_job_id FROM g WHERE kind = 'disconnect' AND k = 'dispatch'
""",
    "worker_events_view",
)
def _(s):
    events = s.view("worker_events_view")
    event = F.when(F.col("event") == "registration", "disconnect").otherwise(F.col("event"))
    return t.disconnect_failures(events.withColumn("event", event))
