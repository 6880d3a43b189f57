"""Scoring candidates against data, budgets, and resuming an evaluation.

A scorer is a Column expression over the genome, an exact threshold rule, or a Python function
over batches of rows and blocks of candidates. None of them forms candidate-row pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunelake.functions.scalars import is_finite
from tunelake.operators.scans import as_of, number_block, running, total, value_block
from tunelake.operators.space import CANDIDATE, Space, genome_keys
from tunelake.session import cut_lineage

CANDIDATE_BLOCK = 4096


def wide_genomes(genes: DataFrame, space: Space) -> DataFrame:
    """One row per candidate with a column per parameter, and the data set and epochs that every genome may carry."""
    columns = {param.name: "cat" if param.choices else "num" for param in space.params}
    columns = {"dataset": "cat", "epochs": "num"} | columns
    columns = [F.max(F.when(F.col("name") == name, F.col(source))).alias(name) for name, source in columns.items()]
    return genes.groupBy(*CANDIDATE).agg(*columns)


@dataclass(frozen=True)
class ExpressionScorer:
    """Score computed from the genome alone by a Column expression over its parameters."""

    score: Callable[[], Column]

    def scores(self, genes: DataFrame, space: Space, data: DataFrame | None) -> DataFrame:
        return wide_genomes(genes, space).select(*CANDIDATE, self.score().cast("double").alias("score"))


@dataclass(frozen=True)
class ThresholdScorer:
    """Accuracy of the rule ``feature >= threshold`` for a 0/1 label, exact for any data size.

    The data are reduced to cumulative label counts per feature value; each distinct threshold
    looks up the counts below it. Work grows with the data plus the candidates.
    """

    param: str
    feature: str
    label: str

    def scores(self, genes: DataFrame, space: Space, data: DataFrame) -> DataFrame:
        points = data.filter(F.col(self.feature).isNotNull() & F.col(self.label).isNotNull())
        value, label = F.col(self.feature).cast("double"), F.col(self.label)
        counts = points.groupBy(value.alias("at")).agg(
            F.count_if(label == 1).alias("ones"), F.count_if(label != 1).alias("zeros")
        )
        totals = points.agg(F.count(F.lit(1)).alias("rows"), F.count_if(label == 1).alias("all_ones"))
        below = running(
            counts,
            [],
            ["at"],
            value_block(F.col("at")),
            {"ones_below": total(F.col("ones")), "zeros_below": total(F.col("zeros"))},
        )
        thresholds = genes.filter(F.col("name") == self.param).select(*CANDIDATE, F.col("num").alias("at"))
        looked = as_of(
            thresholds.select("at").distinct(), below, [], "at", ["ones_below", "zeros_below"], value_block, strict=True
        )
        zero = F.lit(0).cast("long")
        all_ones, rows = totals.select("all_ones").scalar(), totals.select("rows").scalar()
        right = all_ones - F.coalesce("ones_below", zero) + F.coalesce("zeros_below", zero)
        scored = looked.select("at", (right / rows).alias("score"))
        return thresholds.join(scored, "at", "left").select(*CANDIDATE, "score")


def candidate_blocks(wide: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Candidates with their ``_block``, written once, and the number of blocks; every block but the last has exactly ``size`` candidates.

    Positions come from the sizes of hash buckets, of which there are as many as blocks.
    """
    buckets = max(1, -(-wide.count() // size))
    dealt = wide.withColumn("_bucket", F.pmod(F.xxhash64(*CANDIDATE), F.lit(buckets)))
    sizes = dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    starts = running(sizes, [], ["_bucket"], number_block(F.col("_bucket")), {"_start": total(F.col("_n"), inclusive=False)})
    place = F.col("_start") + F.row_number().over(Window.partitionBy("_bucket").orderBy(*CANDIDATE)) - 1
    placed = dealt.join(starts.select("_bucket", "_start"), "_bucket").withColumn("_block", F.floor(place / size).cast("long"))
    return cut_lineage(placed.drop("_bucket", "_start")), buckets


@dataclass(frozen=True)
class BatchScorer:
    """Score by a Python function over data batches, averaged over all rows.

    ``function(batch, candidates)`` returns one partial sum per candidate row. Blocks of candidates are a written table; data rows are
    sent to every block and met there by mates of their input partition, so a block's rows are spread over as many tasks as the
    shuffle has to give. A task holds one block and one batch of rows, and partial sums are all that leaves it. Neither candidates nor
    data pass through the driver, and nothing is broadcast.
    """

    columns: tuple[str, ...]
    function: Callable[[pd.DataFrame, pd.DataFrame], pd.Series]
    block: int = CANDIDATE_BLOCK

    def scores(self, genes: DataFrame, space: Space, data: DataFrame) -> DataFrame:
        spark = genes.sparkSession
        wide, blocks = candidate_blocks(wide_genomes(genes, space), self.block)
        names = [c for c in wide.columns if c != "_block"]
        salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks)
        # The columns of both sides go under numbers: a name may be on both.
        held = [F.col(c).alias(f"c{n}") for n, c in enumerate(names)]
        rows = [F.col(c).alias(f"d{n}") for n, c in enumerate(self.columns)]
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
        candidates = wide.select(F.col("_block").alias("block"), every.alias("salt"), F.lit(0).alias("kind"), *held)
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
        salted = data.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)).cast("long"))
        points = salted.select(each.alias("block"), F.col("_salt").alias("salt"), F.lit(1).alias("kind"), *rows)
        cells = candidates.unionByName(points, allowMissingColumns=True)
        dealt = cells.repartition("block", "salt").sortWithinPartitions("block", "salt", "kind")
        parts = dealt.mapInPandas(self._fold(names), "run_id long, generation int, ordinal long, hits double, seen long")
        sums = parts.groupBy(*CANDIDATE).agg((F.sum("hits") / F.sum("seen")).alias("score"))
        return wide.select(*CANDIDATE).join(sums, CANDIDATE, "left")

    def _fold(self, names: list[str]):
        function, columns = self.function, list(self.columns)

        def fold(cells: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            place, blocks, candidates, hits, seen = None, [], None, None, 0

            def sums() -> Iterator[pd.DataFrame]:
                if hits is not None:
                    yield candidates[CANDIDATE].assign(hits=hits, seen=seen)

            for table in cells:
                for (block, salt, kind), part in table.groupby(["block", "salt", "kind"], sort=False):
                    if place != (block, salt):
                        yield from sums()
                        place, blocks, candidates, hits, seen = (block, salt), [], None, None, 0
                    if kind == 0:
                        blocks.append(part[[f"c{n}" for n in range(len(names))]].set_axis(names, axis=1))
                        continue
                    if candidates is None:
                        candidates = pd.concat(blocks, ignore_index=True)
                    batch = part[[f"d{n}" for n in range(len(columns))]].set_axis(columns, axis=1).reset_index(drop=True)
                    found = function(batch, candidates).to_numpy(dtype="float64")
                    hits = found if hits is None else hits + found
                    seen += len(batch)
            yield from sums()

        return fold


def evaluate_candidates(genes: DataFrame, space: Space, scorer, data: DataFrame | None = None) -> DataFrame:
    """Results of every candidate; a missing or non-finite score is a failure with accuracy 0."""
    scored = scorer.scores(genes, space, data)
    fine = is_finite(F.col("score"))
    return scored.select(
        *CANDIDATE,
        F.when(fine, F.col("score")).otherwise(0.0).alias("validation_accuracy"),
        F.when(fine, "COMPLETED").otherwise("FAILED").alias("status"),
    )


def apply_budget(
    history: DataFrame, keys: list[str], order: str, budget: int | None = None, limit_ms: int | None = None
) -> DataFrame:
    """Evaluations allowed by a count limit, a time limit checked before each one, or both."""
    budget = budget if budget is not None and budget > 0 else None
    limit_ms = limit_ms if limit_ms is not None and limit_ms > 0 else None
    if budget is None and limit_ms is None:
        raise ValueError("at least one of budget and limit_ms must be > 0")
    scanned = running(
        history,
        keys,
        [order],
        number_block(F.col(order)),
        {
            "_done": total(F.lit(1).cast("long"), inclusive=False),
            "_spent": total(F.col("wall_clock_ms"), inclusive=False),
        },
    )
    keep_row = F.lit(True)
    if budget is not None:
        keep_row = keep_row & (F.col("_done") < budget)
    if limit_ms is not None:
        keep_row = keep_row & (F.col("_spent") < limit_ms)
    return scanned.filter(keep_row).drop("_done", "_spent")


def prefix_subset(rows: DataFrame, keys: list[str], order: str, limits: DataFrame) -> DataFrame:
    """First ``limit`` rows of each data set by key; a limit of 0 keeps all."""
    placed = running(
        rows, keys, [order], number_block(F.col(order)), {"_place": total(F.lit(1).cast("long"))}
    )
    return placed.join(limits, keys).filter((F.col("limit") <= 0) | (F.col("_place") <= F.col("limit"))).drop(
        "_place", "limit"
    )


def resume_evaluation(
    genes: DataFrame, space: Space, scorer, data: DataFrame | None, committed: DataFrame
) -> DataFrame:
    """Evaluate only candidates without a stored result; stored failures read 0.

    ``committed`` holds ``request_key`` (run/generation/index), ``genome_key`` and
    ``fitness`` (null when it failed). A stored result under another genome is a conflict.
    """
    keyed = genome_keys(genes).withColumn("request_key", F.concat_ws("/", *CANDIDATE))
    known = keyed.join(
        committed.select("request_key", F.col("genome_key").alias("stored_key"), F.col("fitness").alias("stored")),
        "request_key",
    )
    conflict = F.col("stored_key") != F.col("genome_key")
    reused = known.select(
        *CANDIDATE,
        F.when(conflict, 0.0).otherwise(F.coalesce("stored", F.lit(0.0))).alias("fitness"),
        F.when(conflict, "conflict").otherwise("stored").alias("source"),
    )
    todo = genes.join(known.select(*CANDIDATE), CANDIDATE, "left_anti")
    fresh = evaluate_candidates(todo, space, scorer, data).select(
        *CANDIDATE, F.col("validation_accuracy").alias("fitness"), F.lit("evaluated").alias("source")
    )
    return reused.unionByName(fresh)
