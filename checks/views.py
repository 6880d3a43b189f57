"""Shared views over the driver's tables: the SQL for the twin, and the same rows in Spark."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelake.operators.scans import number_block, numbered, running, total

HOUR_US = 3_600_000_000


@dataclass(frozen=True)
class View:
    sql: str
    frame: Callable[..., DataFrame]
    needs: tuple[str, ...] = field(default=())


def _shared(text: str, *tables: str) -> View:
    """One text for both engines; ``{name}`` marks a table."""
    plain = text.format(**{name: name for name in tables})

    def frame(source) -> DataFrame:
        return source.sql(text, **{name: source.table(name) for name in tables})

    return View(plain, frame)


RESULTS = _shared(
    """
    SELECT l_suppkey AS run_id,
           (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS generation_id,
           concat('j', l_orderkey, '-', l_linenumber) AS job_id,
           concat('w', l_partkey % 8) AS worker_id,
           floor(5000 + l_quantity * 100) / 10000 AS validation_accuracy,
           l_tax AS training_loss,
           CAST(floor(l_extendedprice) AS BIGINT) AS training_time_ms,
           CASE l_returnflag WHEN 'N' THEN 'COMPLETED' WHEN 'R' THEN 'FAILED' ELSE 'TIMEOUT' END AS status,
           CAST(l_shipdate AS DATE) AS received_at
      FROM {lineitem}
    """,
    "lineitem",
)

GENERATION_METRICS_SQL = """
    SELECT CASE run_id % 5 WHEN 0 THEN 'Random Search' WHEN 1 THEN 'Grid Search' WHEN 2 THEN 'Bayesian (Optuna TPE)'
                WHEN 3 THEN 'Differential Evolution' ELSE 'Simulated Annealing' END AS run_name,
           42 + CAST(floor(run_id / 5) AS BIGINT) AS seed,
           run_id,
           generation_id AS generation,
           max(validation_accuracy) AS best_fitness,
           CAST(sum(CAST(round(validation_accuracy * 10000) AS BIGINT)) AS DOUBLE) / count(*) / 10000 AS avg_fitness,
           min(validation_accuracy) AS worst_fitness,
           CAST(sum(training_time_ms) AS BIGINT) AS wall_clock_ms
      FROM {results_view}
     GROUP BY run_id, generation_id
"""

CONFIGS = _shared(
    """
    SELECT p_partkey AS seq,
           p_partkey % 20 AS generation_id,
           p_retailprice / 100000 AS learning_rate,
           16 * CAST(pow(2, p_size % 5) AS INT) AS batch_size,
           CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'adam' WHEN p_type = 'LARGE' THEN 'sgd'
                WHEN p_type = 'MEDIUM' THEN 'rmsprop' ELSE 'adamw' END AS optimizer,
           8 + p_size % 25 AS conv_filters_1,
           16 + p_size % 49 AS conv_filters_2,
           16 + p_partkey % 49 AS conv_filters_3,
           3 AS kernel_size,
           32 + p_size AS dense_units_1,
           CAST(p_partkey % 51 AS DOUBLE) / 100 AS dropout_rate,
           1 + p_partkey % 2 AS epochs
      FROM {part}
    """,
    "part",
)

EVAL_DATA = _shared(
    """
    SELECT d.doc_id, d.lang, d.n_chars, length(d.text) AS text_len, l.quality, l.toxic
      FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
    """,
    "documents",
    "labels",
)

TUNING = _shared(
    """
    SELECT o_orderkey AS run_seq,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'sweep_workers' WHEN '2-HIGH' THEN 'sweep_memory'
                WHEN '3-MEDIUM' THEN 'sweep_subset' WHEN '4-NOT SPECIFIED' THEN 'sweep_timeout'
                ELSE 'sweep_dispatch' END AS stage,
           o_custkey % 6 AS knob_value,
           o_totalprice AS jobs_per_sec,
           CASE o_orderstatus WHEN 'O' THEN 5 WHEN 'F' THEN 10 ELSE 20 END / CAST(100 AS DOUBLE) AS failure_rate
      FROM {orders}
    """,
    "orders",
)

RUN_SUMMARY = _shared(
    """
    SELECT c_custkey AS run_id,
           CASE WHEN c_custkey % 11 = 0 THEN 'true' WHEN c_custkey % 7 = 0 THEN 'NaN' WHEN c_custkey % 5 = 0 THEN NULL
                WHEN c_custkey % 3 = 0 THEN '12.5' ELSE CAST(c_custkey AS VARCHAR(20)) END AS completed,
           CASE WHEN c_acctbal < 0 THEN '0'
                ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) + 1 AS VARCHAR(20)) END AS wall_clock_total_s,
           CASE WHEN c_custkey % 2 = 0 THEN 2 END AS metric_schema_version,
           c_acctbal / 100 AS jobs_per_sec,
           c_acctbal / 200 AS legacy_modeled_jobs_per_sec,
           CAST(c_custkey % 40 AS DOUBLE) / 40 AS queue_overhead_p90_pct,
           CAST(100 + c_nationkey AS DOUBLE) AS avg_job_ms,
           CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 97 AS DOUBLE) / 97 END AS best_fitness_peak,
           CASE WHEN c_custkey % 8 <> 0 THEN CAST(c_custkey % 89 AS DOUBLE) / 89 END AS best_fitness_final
      FROM {customer}
    """,
    "customer",
)

PLANS = _shared(
    """
    SELECT l_orderkey AS plan_id,
           l_linenumber AS call_no,
           CASE l_linenumber % 4 WHEN 0 THEN 'lookup' WHEN 1 THEN 'add' WHEN 2 THEN 'multiply' ELSE 'unsupported' END AS tool,
           l_quantity AS a,
           l_discount AS b,
           CASE l_returnflag WHEN 'N' THEN 'lease' WHEN 'R' THEN 'fence' ELSE 'other' END AS lookup_key
      FROM {lineitem}
    """,
    "lineitem",
)


def _micros(frame: DataFrame, ts: str) -> DataFrame:
    """Microseconds of a zone-less timestamp, whatever the session's zone is."""
    day = f"datediff(CAST({ts} AS DATE), DATE'1970-01-01')"
    second = f"CAST(extract(SECOND FROM {ts}) * 1000000 AS BIGINT)"
    return frame.withColumn(
        "at_us", F.expr(f"({day} * 86400L + hour({ts}) * 3600L + minute({ts}) * 60L) * 1000000L + {second}")
    )


def _generation_metrics(source) -> DataFrame:
    return source.sql(GENERATION_METRICS_SQL, results_view=source.view("results_view"))


def _worker_events(source) -> DataFrame:
    kinds = {"view": "heartbeat", "click": "dispatch", "purchase": "completed", "error": "failed"}
    event = F.lit("registration")
    for kind, name in kinds.items():
        event = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(event)
    rows = _micros(source.table("events"), "ts").select(
        F.col("event_id").alias("event_seq"),
        "at_us",
        "user_id",
        F.concat(F.lit("w"), "user_id").alias("worker_id"),
        event.alias("event"),
        F.col("value").alias("dispatch_latency_ms"),
        (F.dayofmonth("ts") - 1).alias("generation_id"),
    )
    counted = running(
        rows,
        ["user_id"],
        ["at_us", "event_seq"],
        number_block(F.col("at_us"), HOUR_US),
        {"_n": total(F.when(F.col("event") == "dispatch", 1).otherwise(0).cast("long"))},
    )
    return counted.withColumn("job_id", F.concat(F.lit("w"), "user_id", F.lit("-"), "_n")).drop("_n")


WORKER_EVENTS_SQL = """
    SELECT event_id AS event_seq, date_diff('microsecond', TIMESTAMP '1970-01-01', ts) AS at_us, user_id,
           concat('w', user_id) AS worker_id,
           CASE event_type WHEN 'view' THEN 'heartbeat' WHEN 'click' THEN 'dispatch' WHEN 'purchase' THEN 'completed'
                WHEN 'error' THEN 'failed' ELSE 'registration' END AS event,
           value AS dispatch_latency_ms,
           day(ts) - 1 AS generation_id,
           concat('w', user_id, '-', sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)
                  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS job_id
      FROM events
"""


def _population(source) -> DataFrame:
    rows = source.table("customer").select(
        F.col("c_nationkey").cast("long").alias("run_id"),
        F.lit(0).alias("generation"),
        "c_custkey",
        F.col("c_acctbal").alias("x"),
        (1 + F.col("c_custkey") % 10).alias("y"),
        F.col("c_mktsegment").alias("z"),
        (F.floor((F.col("c_acctbal") + 1000) / 11000 * 10000) / 10000).alias("fitness"),
    )
    return numbered(rows, ["run_id"], "c_custkey").drop("c_custkey")


POPULATION_SQL = """
    SELECT CAST(c_nationkey AS BIGINT) AS run_id, 0 AS generation,
           row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS ordinal,
           c_acctbal AS x, 1 + c_custkey % 10 AS y, c_mktsegment AS z,
           floor((c_acctbal + 1000) / 11000 * 10000) / 10000 AS fitness
      FROM customer
"""


def _genes(source) -> DataFrame:
    return _population(source).selectExpr(
        "run_id",
        "generation",
        "ordinal",
        "stack(3, 'x', x, CAST(NULL AS STRING), 'y', CAST(y AS DOUBLE), NULL, 'z', NULL, z) AS (name, num, cat)",
    )


GENES_SQL = """
    SELECT run_id, generation, ordinal, 'x' AS name, x AS num, NULL::VARCHAR AS cat FROM population_view
    UNION ALL SELECT run_id, generation, ordinal, 'y', CAST(y AS DOUBLE), NULL FROM population_view
    UNION ALL SELECT run_id, generation, ordinal, 'z', NULL, z FROM population_view
"""


def _ledger(source) -> DataFrame:
    kinds = {"view": "submit", "click": "claim", "purchase": "commit", "error": "fail"}
    command = F.lit("cancel")
    for kind, name in kinds.items():
        command = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(command)
    return _micros(source.table("events"), "ts").select(
        F.col("event_id").alias("seq"),
        "at_us",
        F.concat(F.lit("t"), F.col("user_id") % 5).alias("tenant"),
        command.alias("command"),
        F.concat(F.lit("k"), "user_id").alias("request_key"),
        F.col("props").alias("payload"),
        F.concat(F.lit("worker"), F.col("user_id") % 3).alias("worker"),
    )


LEDGER_SQL = """
    SELECT event_id AS seq, date_diff('microsecond', TIMESTAMP '1970-01-01', ts) AS at_us,
           concat('t', user_id % 5) AS tenant,
           CASE event_type WHEN 'view' THEN 'submit' WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'commit'
                WHEN 'error' THEN 'fail' ELSE 'cancel' END AS command,
           concat('k', user_id) AS request_key,
           props AS payload,
           concat('worker', user_id % 3) AS worker
      FROM events
"""

VIEWS: dict[str, View] = {
    "results_view": RESULTS,
    "generation_metrics_view": View(
        GENERATION_METRICS_SQL.format(results_view="results_view"), _generation_metrics, ("results_view",)
    ),
    "configs_view": CONFIGS,
    "eval_data_view": EVAL_DATA,
    "tuning_view": TUNING,
    "run_summary_view": RUN_SUMMARY,
    "plans_view": PLANS,
    "worker_events_view": View(WORKER_EVENTS_SQL, _worker_events),
    "population_view": View(POPULATION_SQL, _population),
    "genes_view": View(GENES_SQL, _genes, ("population_view",)),
    "ledger_view": View(LEDGER_SQL, _ledger),
}
