"""Session defaults and the lineage cut used by iterative searches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tunelake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tunelake-steps-"))
        .getOrCreate()
    )


def scratch_folder(spark: SparkSession) -> str:
    """Shared folder for written steps: the session's ``spark.checkpoint.dir``."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return shared


def with_scratch_folder(spark: SparkSession) -> SparkSession:
    """Give a session on this one machine a folder if it names none; clusters must name theirs."""
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tunelake-steps-"))
    return spark


#: Spark's setting that removes the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go when each of them ends, and do not wait until the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut_lineage(frame: DataFrame, tidy: bool = False) -> DataFrame:
    """Write one step's rows to the shared folder and go on from the written table.

    The plan does not grow with the steps, a lost executor costs one step at most, and the
    written size tells the optimizer which later joins may broadcast. ``tidy``: as in ``tidy_shuffles``.
    """
    spark = frame.sparkSession
    path = f"{scratch_folder(spark)}/tunelake/{uuid.uuid4().hex}"
    with tidy_shuffles(spark) if tidy else nullcontext():
        frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def hold(frame: DataFrame) -> DataFrame:
    """Persist a partitioned frame that a loop joins in place; lost blocks are recomputed."""
    return frame.persist(StorageLevel.MEMORY_AND_DISK)
