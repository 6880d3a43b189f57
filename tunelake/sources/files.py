"""Readers and writers of run metrics, summaries, event logs, tuning sheets and evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake import schemas


def _stem() -> Column:
    return F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"\.[^.]*$", "")


def read_run_metrics(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Generations of stored runs; a missing running best falls back to the generation's best.

    Files hold one document each, or one document per line as written by
    :func:`write_run_metrics`.
    """
    documents = spark.read.schema(schemas.RUN_METRICS).option("multiLine", one_per_file).json(path)
    return documents.select("run_name", _stem().alias("run_file"), F.inline("generations")).withColumn(
        "best_so_far", F.coalesce("best_so_far", "best_fitness")
    )


def write_run_metrics(metrics: DataFrame, path: str, keys: Sequence[str] = ("run_name",)) -> None:
    """One JSON document per line and run with its generations in order.

    The format puts a whole run into one document. The telemetry itself belongs in Parquet; this
    export is for runs of report size.
    """
    fields = schemas.GENERATION.fieldNames()
    ordered = F.array_sort(F.collect_list(F.struct(*fields)))
    metrics.groupBy(*keys).agg(ordered.alias("generations")).write.mode("overwrite").json(path)


def read_run_summaries(spark: SparkSession, path: str, pattern: str = "*_summary.json") -> DataFrame:
    """Summaries below a folder, both schema versions; unreadable files are left out."""
    documents = (
        spark.read.schema(schemas.RUN_SUMMARY)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
    )
    return (
        documents.withColumn("run_id", F.regexp_replace(_stem(), "_summary", ""))
        .filter("_corrupt IS NULL")
        .drop("_corrupt")
    )


def read_scheduler_events(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch and result events, one JSON object per line."""
    return spark.read.schema(schemas.SCHEDULER_EVENT).json(path)


def write_scheduler_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def read_tuning_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schemas.TUNING_COLUMNS)


def write_tuning_runs(runs: DataFrame, path: str) -> None:
    names = [part.split()[0] for part in schemas.TUNING_COLUMNS.split(", ")]
    runs.select(*names).write.mode("append").csv(path, header=True)


def read_ledger_evidence(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Records of load trials, process losses or fault episodes, one JSON object per line."""
    return spark.read.schema(schemas.EVIDENCE[kind]).json(path)


def write_ledger_evidence(records: DataFrame, path: str) -> None:
    """One JSON object per line with sorted keys."""
    records.select(*sorted(records.columns)).write.mode("overwrite").json(path)


def artifact_manifest(spark: SparkSession, path: str, pattern: str = "*", text: bool = False) -> DataFrame:
    """SHA-256 of every file below a folder; text files are hashed with normalised line ends."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    )
    content = F.col("content")
    if text:
        content = F.encode(F.replace(F.decode(content, "UTF-8"), F.lit("\r\n"), F.lit("\n")), "UTF-8")
    return files.select("path", "length", F.sha2(content, 256).alias("sha256"))


def write_report(lines: DataFrame, path: str) -> None:
    """Numbered report lines, section by section, as one ordered text file per partition."""
    lines.orderBy(*[c for c in ("section", "position") if c in lines.columns]).select("line").write.mode("overwrite").text(path)
