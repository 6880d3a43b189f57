"""Streaming queries: the views are written as JSON slices in time order and replayed."""

import uuid

from pyspark.sql import functions as F

from checks.base import check
from checks.ledger import HORIZON, LV, POLICY, REPLAY_SQL, commands
from checks.telemetry import TIMEOUT_MS
from tunelake.session import scratch_folder
from tunelake.streaming import ledger as sl
from tunelake.streaming import telemetry as st

CUTS = [1_705_000_000_000_000, 1_706_000_000_000_000]


def folder(s) -> str:
    return f"{scratch_folder(s.spark)}/streams/{uuid.uuid4().hex}"


def replay(s, rows, stream, sink, cuts):
    """Write each time slice, then run the stream over it; the checkpoint carries it on."""
    base = folder(s)
    edges = [None, *cuts, None]
    # State partitions are fixed at the first start; these views need few. The session gets its values back.
    wanted = {"spark.sql.shuffle.partitions": "8", "spark.sql.streaming.stateStore.providerClass": st.ROCKSDB}
    before = {key: s.spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        s.spark.conf.set(key, value)
    try:
        _run_slices(rows, stream, sink, edges, base)
    finally:
        for key, value in before.items():
            s.spark.conf.set(key, value)
    return base


def _run_slices(rows, stream, sink, edges, base):
    for low, high in zip(edges, edges[1:]):
        part = rows
        if low is not None:
            part = part.filter(F.col("at_us") >= low)
        if high is not None:
            part = part.filter(F.col("at_us") < high)
        part.withColumn("at", F.timestamp_micros("at_us")).drop("at_us").write.mode("append").option(
            "timestampFormat", st.MICROSECONDS
        ).json(f"{base}/in")
        sink(stream(f"{base}/in"), base).awaitTermination()


def to_parquet(frame, base):
    return (
        frame.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp")
        .trigger(availableNow=True).start()
    )


def to_updates(frame, base):
    """Update mode: every batch's changed rows with the batch number."""

    def write(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/b={number}")

    return (
        frame.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/cp")
        .trigger(availableNow=True).start()
    )


RESULT_SQL = """
    SELECT user_id % 10 AS run_id, generation_id, job_id, worker_id, at_us, event_seq,
           CASE WHEN event = 'completed' THEN 'COMPLETED' WHEN event_seq % 4 = 0 THEN 'TIMEOUT' ELSE 'FAILED' END AS status,
           CAST(floor(dispatch_latency_ms * 100) AS BIGINT) AS training_time_ms
      FROM {worker_events_view} WHERE event IN ('completed', 'failed')
"""
RESULTS = RESULT_SQL.format(worker_events_view="worker_events_view")


def message_rows(s):
    results = s.sql(RESULT_SQL, worker_events_view=s.view("worker_events_view"))
    body = F.struct("job_id", "generation_id", "worker_id", "training_time_ms", "status")
    return results.select("run_id", "at_us", F.col("event_seq").alias("seq"), body.alias("result"))


def results_of(s):
    return lambda path: st.split_messages(st.worker_messages(s.spark, path))["result"]


@check(
    "stream_first_terminal",
    "run_id:long job_id:str",
    f"SELECT DISTINCT run_id, job_id FROM ({RESULTS}) AS r",
    "worker_events_view",
)
def _(s):
    stream = results_of(s)
    base = replay(s, message_rows(s), lambda p: st.first_terminal(stream(p), "40 days"), to_parquet, CUTS)
    return s.spark.read.parquet(f"{base}/out")


@check(
    "stream_generation_kpi",
    "run_id:long generation_id:int jobs_count:long completed:long failed:long timed_out:long active_workers:long train_total_ms:long",
    f"""SELECT run_id, generation_id, count(*) AS jobs_count, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'FAILED') AS failed,
       count(*) FILTER (status = 'TIMEOUT') AS timed_out, count(DISTINCT worker_id) AS active_workers, sum(training_time_ms) AS train_total_ms FROM ({RESULTS}) AS r GROUP BY ALL""",
    "worker_events_view",
)
def _(s):
    stream = results_of(s)
    base = replay(s, message_rows(s), lambda p: st.generation_kpi(stream(p)), to_updates, CUTS)
    newest = F.max_by(F.struct("jobs_count", "completed", "failed", "timed_out", "active_workers", "train_total_ms"), "batch")
    updates = s.spark.read.parquet(f"{base}/out")
    return updates.groupBy("run_id", "generation_id").agg(newest.alias("k")).select("run_id", "generation_id", "k.*")


EVENT_SCHEMA = "worker_id string, at timestamp, event_seq long, event string, job_id string"


def event_rows(s):
    return s.view("worker_events_view").select("worker_id", "at_us", "event_seq", "event", "job_id")


@check(
    "stream_dispatch_latency",
    "job_id:str turnaround_ms:dbl",
    """
SELECT d.job_id, (r.at_us - d.at_us) / CAST(1000 AS DOUBLE) AS turnaround_ms FROM worker_events_view d JOIN worker_events_view r ON d.job_id = r.job_id
 WHERE d.event = 'dispatch' AND r.event IN ('completed', 'failed') AND r.at_us >= d.at_us AND r.at_us <= d.at_us + 86400000000
""",
    "worker_events_view",
)
def _(s):
    def stream(path):
        events = s.spark.readStream.schema(EVENT_SCHEMA).json(path)
        return st.dispatch_latency(
            events.filter("event = 'dispatch'"), events.filter("event IN ('completed', 'failed')"), "40 days", "1 DAY"
        )

    base = replay(s, event_rows(s), stream, to_parquet, CUTS)
    return s.spark.read.parquet(f"{base}/out")


LAST_SQL = "(SELECT max(at_us) FROM worker_events_view)"


@check(
    "stream_heartbeat_timeouts",
    "worker_id:str dead_us:long failed_job_id:str",
    f"""
WITH a AS (SELECT worker_id, at_us, lead(at_us, 1) OVER (PARTITION BY worker_id ORDER BY at_us, event_seq) AS nxt
             FROM worker_events_view WHERE event IN ('heartbeat', 'registration')),
     d AS (SELECT worker_id, at_us + {TIMEOUT_MS * 1000} AS dead_us FROM a WHERE floor((coalesce(nxt, (floor({LAST_SQL} / 1000.0) - 1000) * 1000) - at_us) / CAST(1000 AS DOUBLE)) > {TIMEOUT_MS}),
     p AS (SELECT d.worker_id, d.dead_us, max_by(e.event, (e.at_us, e.event_seq)) AS event, max_by(e.job_id, (e.at_us, e.event_seq)) AS job_id
             FROM d LEFT JOIN worker_events_view e ON e.worker_id = d.worker_id AND e.at_us <= d.dead_us
                  AND e.event IN ('dispatch', 'completed', 'failed') GROUP BY d.worker_id, d.dead_us)
SELECT worker_id, dead_us, CASE WHEN event = 'dispatch' THEN job_id END AS failed_job_id FROM p
""",
    "worker_events_view",
)
def _(s):
    stream = lambda p: st.heartbeat_timeouts(s.spark.readStream.schema(EVENT_SCHEMA).json(p), TIMEOUT_MS, "1 second")
    base = replay(s, event_rows(s), stream, to_parquet, [])
    return s.spark.read.parquet(f"{base}/out")


@check(
    "stream_generation_complete",
    "run_id:long generation_id:int submitted:long terminal:long",
    f"""
WITH f AS (SELECT run_id, job_id, min(generation_id) AS generation_id FROM ({RESULTS}) AS r GROUP BY run_id, job_id)
SELECT run_id, generation_id, count(*) AS submitted, count(*) AS terminal FROM f WHERE (run_id + generation_id) % 3 <> 0 GROUP BY run_id, generation_id
""",
    "worker_events_view",
)
def _(s):
    results = s.sql(RESULT_SQL, worker_events_view=s.view("worker_events_view"))
    first = results.groupBy("run_id", "job_id").agg(F.min("generation_id").alias("generation_id"), F.min("at_us").alias("at_us"))
    sizes = first.groupBy("run_id", "generation_id").agg(F.count(F.lit(1)).alias("jobs"), F.min("at_us").alias("at_us"))
    short = (F.col("run_id") + F.col("generation_id")) % 3 == 0
    submitted = sizes.withColumn("jobs", F.when(short, F.col("jobs") + 1).otherwise(F.col("jobs")))
    rows = submitted.unionByName(first.drop("job_id").withColumn("jobs", F.lit(None).cast("long")))
    schema = "run_id long, generation_id int, at timestamp, jobs long"
    base = replay(
        s, rows, lambda p: st.generation_complete(s.spark.readStream.schema(schema).json(p)), to_updates, CUTS
    )
    return s.spark.read.parquet(f"{base}/out")


@check(
    "stream_ledger",
    "job_id:str state:str attempt:int fence:int finished_us:long error:str",
    f"WITH {REPLAY_SQL}\nSELECT * FROM fin",
    LV,
)
def _(s):
    base = folder(s)

    def sink(frame, _):
        return sl.stream_ledger(frame, f"{base}/ledger", f"{base}/cp", POLICY)

    rows = commands(s)
    last = CUTS[-1:]
    # The closing command of a job nobody knows moves time to the horizon.
    end = rows.limit(1).select(
        *[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in
          {**{c: None for c in rows.columns}, "job_id": "none", "tenant": "none", "at_us": HORIZON, "seq": 1 << 40, "command": "cancel"}.items()]
    )
    replay(s, rows.unionByName(end), lambda p: sl.ledger_commands(s.spark, p), sink, last)
    return sl.ledger_state(s.spark, f"{base}/ledger")


@check(
    "event_log_sink",
    "job_id:str event:str at_us:long",
    "SELECT job_id, event, at_us FROM worker_events_view WHERE event IN ('dispatch', 'completed', 'failed')",
    "worker_events_view",
)
def _(s):
    rows = event_rows(s).filter("event IN ('dispatch', 'completed', 'failed')")
    base = replay(
        s, rows, lambda p: s.spark.readStream.schema(EVENT_SCHEMA).json(p),
        lambda frame, b: st.event_log_sink(frame, f"{b}/out", f"{b}/cp"), CUTS,
    )
    return s.spark.read.schema(EVENT_SCHEMA).json(f"{base}/out").withColumn("at_us", F.unix_micros("at"))
