"""Streaming twins of the telemetry operators.

Watermarks bound the state; the batch operators define the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tunelake import schemas

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Format that keeps microseconds when times are written as JSON.
MICROSECONDS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def worker_messages(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Worker messages from a growing folder of JSON lines."""
    return (
        spark.readStream.schema(schemas.WORKER_MESSAGE).option("maxFilesPerTrigger", files_per_trigger).json(path)
    )


def split_messages(messages: DataFrame) -> dict[str, DataFrame]:
    """The message union as one stream per arm."""
    return {
        arm: messages.filter(F.col(arm).isNotNull()).select("run_id", "at", "seq", f"{arm}.*")
        for arm in ("registration", "heartbeat", "result")
    }


def first_terminal(results: DataFrame, delay: str) -> DataFrame:
    """First arrival per job; later and duplicate deliveries within the watermark are dropped."""
    return results.withWatermark("at", delay).dropDuplicatesWithinWatermark(["run_id", "job_id"])


def generation_kpi(results: DataFrame) -> DataFrame:
    """Running counts of every generation for update mode; workers per generation are few."""
    return results.groupBy("run_id", "generation_id").agg(
        F.count(F.lit(1)).alias("jobs_count"),
        F.count_if(F.col("status") == "COMPLETED").alias("completed"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.count_if(F.col("status") == "TIMEOUT").alias("timed_out"),
        F.size(F.collect_set(F.when(F.col("worker_id") != "", F.col("worker_id")))).alias("active_workers"),
        F.sum(F.greatest(F.lit(0).cast("long"), "training_time_ms")).alias("train_total_ms"),
    )


def dispatch_latency(dispatches: DataFrame, results: DataFrame, delay: str, bound: str) -> DataFrame:
    """Dispatches matched with the result of their job within a time bound."""
    left = dispatches.withWatermark("at", delay).select("job_id", F.col("at").alias("dispatched_at"))
    right = results.withWatermark("at", delay).select(F.col("job_id").alias("result_job"), F.col("at").alias("result_at"))
    condition = (
        (F.col("job_id") == F.col("result_job"))
        & (F.col("result_at") >= F.col("dispatched_at"))
        & (F.col("result_at") <= F.col("dispatched_at") + F.expr(f"INTERVAL {bound}"))
    )
    return left.join(right, condition).select(
        "job_id",
        "dispatched_at",
        "result_at",
        ((F.unix_micros("result_at") - F.unix_micros("dispatched_at")) / F.lit(1000.0)).alias("turnaround_ms"),
    )


def generation_complete(progress: DataFrame) -> DataFrame:
    """Generations whose first-terminal count has reached their submissions, for update mode.

    ``progress`` unites submission rows (``jobs`` set) and first-terminal rows (``jobs`` null).
    A generation's last terminal is its last update, so it is reported once.
    """
    counts = progress.groupBy("run_id", "generation_id").agg(
        F.sum("jobs").alias("submitted"), F.count_if(F.col("jobs").isNull()).alias("terminal")
    )
    return counts.filter("submitted IS NOT NULL AND terminal >= submitted")


class HeartbeatProcessor(StatefulProcessor):
    """Emit a worker as dead after silence, with the job it then holds."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alive = handle.getValueState("alive", "last_us long, dead boolean")
        self.held = handle.getValueState("held", "job_id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, dead = self.alive.get() if self.alive.exists() else (None, True)
        job = self.held.get()[0] if self.held.exists() else None
        ordered = pd.concat(list(rows)).sort_values(["at_us", "event_seq"])
        found = []
        for row in ordered.itertuples(index=False):
            if not dead and (row.at_us - last) // 1000 > self.timeout_ms:
                found.append((key[0], last + self.timeout_ms * 1000, job))
                dead = True
            if row.event in ("heartbeat", "registration"):
                last, dead = row.at_us, False
            elif row.event == "dispatch":
                job = row.job_id
            elif row.event in ("completed", "failed"):
                job = None
        if last is not None:
            self.alive.update((int(last), bool(dead)))
            if not dead:
                self.handle.registerTimer(int(last) // 1000 + self.timeout_ms + 1)
        self.held.update((job,))
        yield self._frame(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = []
        if self.alive.exists():
            last, dead = self.alive.get()
            due = last // 1000 + self.timeout_ms + 1
            if not dead and expiredTimerInfo.getExpiryTimeInMs() >= due:
                found.append((key[0], last + self.timeout_ms * 1000, self.held.get()[0] if self.held.exists() else None))
                self.alive.update((last, True))
        yield self._frame(found)

    @staticmethod
    def _frame(found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(found, columns=["worker_id", "dead_us", "failed_job_id"])

    def close(self) -> None:
        pass


def heartbeat_timeouts(events: DataFrame, timeout_ms: int, delay: str) -> DataFrame:
    """Workers that fell silent, from a stream of ``worker_id, at, event_seq, event, job_id``.

    The session that starts the query must name ``ROCKSDB`` as its state store; this function does
    not change it.
    """
    timed = events.withWatermark("at", delay).withColumn("at_us", F.unix_micros("at"))
    return timed.groupBy("worker_id").transformWithStateInPandas(
        HeartbeatProcessor(timeout_ms),
        outputStructType="worker_id string, dead_us long, failed_job_id string",
        outputMode="Append",
        timeMode="EventTime",
    )


def event_log_sink(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's events as JSON lines, exactly once, until the input is used up."""
    return (
        events.writeStream.format("json")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .option("timestampFormat", MICROSECONDS)
        .trigger(availableNow=True)
        .start()
    )
