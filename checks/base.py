"""Registration of a query with its output shape and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import VIEWS

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KINDS = {
    "long": ("bigint", "BIGINT"),
    "int": ("int", "INTEGER"),
    "str": ("string", "VARCHAR"),
    "bool": ("boolean", "BOOLEAN"),
    "dbl": ("double", "DOUBLE"),
}


class Source:
    """The driver's tables and the shared views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        return VIEWS[name].frame(self)

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        return self.spark.sql(text, **frames)


@dataclass(frozen=True)
class Check:
    columns: list[tuple[str, str]]
    run: Callable[[Source], DataFrame]
    views: list[str]
    sql: str | None

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = self.run(Source(spark, sf_dir))
        return frame.select(*[self._column(name, kind) for name, kind in self.columns])

    @staticmethod
    def _column(name: str, kind: str):
        column = F.col(name).cast(KINDS[kind][0])
        if kind == "dbl":
            # Six decimals; the extra 0.00037 keeps exact ties away from the cut.
            column = F.floor(column * F.lit(1e6) + F.lit(0.50037)) / F.lit(1e6)
        return column.alias(name)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        parts = []
        for name, kind in self.columns:
            cast = f"CAST({name} AS {KINDS[kind][1]})"
            if kind == "dbl":
                cast = f"floor({cast} * 1e6 + 0.50037) / 1e6"
            parts.append(f"{cast} AS {name}")
        ctes, seen = [], set()

        def add(view: str) -> None:
            if view in seen:
                return
            seen.add(view)
            for need in VIEWS[view].needs:
                add(need)
            ctes.append(f"{view} AS ({VIEWS[view].sql})")

        for view in self.views:
            add(view)
        head = "WITH RECURSIVE " if "_rec AS" in self.sql or any("_rec AS" in c for c in ctes) else "WITH "
        body = self.sql.strip()
        if body.upper().startswith("WITH "):
            inner = body[5:]
            cut = inner.rindex("\nSELECT")
            ctes.append(inner[:cut].strip())
            body = inner[cut:].strip()
        prefix = head + ",\n".join(ctes) + "\n" if ctes else ""
        return f"{prefix}SELECT {', '.join(parts)} FROM ({body}) AS answer"


CHECKS: dict[str, Check] = {}


def check(name: str, columns: str, sql: str | None = None, views: str = ""):
    """Register the decorated function as query ``name``; ``columns`` is ``name:kind ...``."""

    def register(function: Callable[[Source], DataFrame]):
        shape = [tuple(part.split(":")) for part in columns.split()]
        assert name not in CHECKS, name
        CHECKS[name] = Check(shape, function, views.split(), sql)
        return function

    return register
