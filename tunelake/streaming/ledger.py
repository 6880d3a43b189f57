"""The ledger replay over a stream of commands.

Each micro-batch is folded into a versioned job-state table with the batch operator, so heavy
jobs are spread over tasks as there. State and events of a batch are written under its number;
repeating a batch after a failure overwrites its own output only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tunelake import schemas
from tunelake.operators.ledger import ReplayPolicy, fold_commands, job_events

STATE = "state/batch={}"
EVENTS = "events/batch={}"


def ledger_commands(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schemas.LEDGER_COMMAND)
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(path)
        .withColumn("at_us", F.unix_micros("at"))
    )


def stream_ledger(
    commands: DataFrame, folder: str, checkpoint: str, policy: ReplayPolicy | None = None, horizon_us: int | None = None
) -> StreamingQuery:
    """Fold the stream until its input is used up; batches must arrive in time order.

    Lapses are applied up to the newest command of a batch, or ``horizon_us`` if that is later.
    """
    rules = policy or ReplayPolicy()

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        newest = rows.agg(F.max("at_us")).first()[0]
        if newest is None:
            rows.unpersist()
            return
        prior = _before(spark, folder, number)
        state = fold_commands(rows, rules, max(newest, horizon_us or newest), prior)
        state.write.mode("overwrite").parquet(f"{folder}/{STATE.format(number)}")
        job_events(state).write.mode("overwrite").parquet(f"{folder}/{EVENTS.format(number)}")
        rows.unpersist()

    return (
        commands.writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches whose state is complete."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{folder}/state")
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    names = [status.getPath() for status in system.listStatus(root)]
    done = [p for p in names if system.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def _before(spark: SparkSession, folder: str, number: int) -> DataFrame | None:
    earlier = [n for n in _batches(spark, folder) if n < number]
    return spark.read.parquet(f"{folder}/{STATE.format(earlier[-1])}") if earlier else None


def ledger_state(spark: SparkSession, folder: str) -> DataFrame:
    """Newest state of every job."""
    return spark.read.parquet(f"{folder}/{STATE.format(_batches(spark, folder)[-1])}")


def ledger_history(spark: SparkSession, folder: str) -> DataFrame:
    """Lifecycle events of all batches."""
    return spark.read.parquet(f"{folder}/events")
