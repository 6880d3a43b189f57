"""Search strategies as objects, and the loop that runs any of them for many runs at once.

A strategy suggests a batch of candidates for every run from what was evaluated so far; the loop scores the batch,
lets the strategy add what it has to remember, and writes one table per step. The loop knows nothing else of it:
built-in strategies and a user's own are run alike. A user's sampler in Python is a table function
over the histories, partitioned by run, so that runs are sampled side by side and no history passes the driver.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tunelake.functions.frames import table_union
from tunelake.operators import strategies as st
from tunelake.operators.evaluation import evaluate_candidates
from tunelake.operators.runs import best_so_far
from tunelake.operators.space import CANDIDATE, CATEGORICAL, Space, grid_candidates, random_candidates
from tunelake.session import cut_lineage

GENOME = "array<struct<name:string,num:double,cat:string>>"


@dataclass(frozen=True)
class History:
    """What a strategy may look at when it suggests the candidates of a step.

    ``steps`` are the written steps: a row per evaluated candidate with ``genome``, ``turn`` (its number
    within the run), ``validation_accuracy``, ``status`` and what the strategy added in ``advance``.
    """

    runs: DataFrame
    space: Space
    steps: tuple[DataFrame, ...] = ()

    @property
    def step(self) -> int:
        return len(self.steps)

    @property
    def last(self) -> DataFrame:
        return self.steps[-1]

    def evaluated(self) -> DataFrame:
        """All evaluations of all steps, numbered through by ``turn`` as their ordinal."""
        rows = [s.select("run_id", "generation", F.col("turn").alias("ordinal"), "genome", "validation_accuracy") for s in self.steps]
        return table_union(rows)


class Strategy:
    """Base of a strategy; a subclass needs ``suggest`` only."""

    #: Name in reports.
    name = "strategy"

    def suggest(self, history: History) -> DataFrame | None:
        """Genes (``run_id, generation, ordinal, name, num, cat``) of the next batch, or None at the end.

        Ordinals of a batch start at 0 in every run. A run without candidates is finished.
        """
        raise NotImplementedError

    def advance(self, scored: DataFrame, history: History) -> DataFrame:
        """The scored batch with columns that the next step needs; it is written as one table."""
        return scored


def packed(genes: DataFrame) -> DataFrame:
    """One row per candidate with its genes as an array."""
    return genes.groupBy(*CANDIDATE).agg(F.array_sort(F.collect_list(F.struct("name", "num", "cat"))).alias("genome"))


def unpacked(rows: DataFrame, genome: str = "genome") -> DataFrame:
    """Genes of candidates packed in a column."""
    return rows.select(*CANDIDATE, F.explode(genome).alias("g")).select(*CANDIDATE, "g.*")


def run_strategy(
    strategy: Strategy,
    runs: DataFrame,
    space: Space,
    scorer,
    data: DataFrame | None = None,
    budget: int | None = None,
    limit_ms: int | None = None,
    clock: Callable[[], float] = time.monotonic,
) -> DataFrame:
    """Every evaluation of every run: ``run_id, turn, step, genome, validation_accuracy, status, wall_clock_ms``.

    ``budget`` bounds the evaluations of a run. ``limit_ms`` is checked before each step. The clock of an evaluation is its share of
    the time that its step took, as all of a step are scored together.
    """
    steps: list[DataFrame] = []
    costs: list[float] = []
    start = clock()
    while limit_ms is None or (clock() - start) * 1000 < limit_ms:
        history = History(runs, space, tuple(steps))
        began = clock()
        genes = strategy.suggest(history)
        if genes is None:
            break
        if steps:
            done = steps[-1].groupBy("run_id").agg((F.max("turn") + 1).alias("_done"))
            genes = genes.join(done, "run_id")
        else:
            genes = genes.withColumn("_done", F.lit(0).cast("long"))
        turn = F.col("_done") + F.col("ordinal")
        if budget is not None:
            genes = genes.filter(turn < budget)
        scored = evaluate_candidates(genes.drop("_done"), space, scorer, data)
        placed = genes.select(*CANDIDATE, turn.alias("turn")).distinct()
        batch = packed(genes).join(placed, CANDIDATE).join(scored, CANDIDATE)
        written = cut_lineage(strategy.advance(batch, history))
        count = written.count()
        if not count:
            break
        steps.append(written)
        costs.append((clock() - began) * 1000 / count)
    rows = [
        s.select("run_id", "turn", F.lit(n).alias("step"), "genome", "validation_accuracy", "status", F.lit(cost).alias("wall_clock_ms"))
        for n, (s, cost) in enumerate(zip(steps, costs))
    ]
    if not rows:
        shape = f"run_id long, turn long, step int, genome {GENOME}, validation_accuracy double, status string, wall_clock_ms double"
        return runs.sparkSession.createDataFrame([], shape)
    return table_union(rows)


def progress(evaluations: DataFrame) -> DataFrame:
    """One row per evaluation in order, with the running best of its run."""
    value = F.col("validation_accuracy")
    steps = evaluations.select(
        "run_id", F.col("turn").alias("generation"), value.alias("best_fitness"), value.alias("avg_fitness"), "status", "wall_clock_ms"
    )
    return best_so_far(steps).withColumn("best_fitness", F.col("best_so_far"))


@dataclass
class RandomSearch(Strategy):
    """Independent candidates, all in one batch."""

    seed: int
    candidates: int
    name: str = "random_search"

    def suggest(self, history: History) -> DataFrame | None:
        if history.step:
            return None
        return random_candidates(history.runs.select("run_id", F.lit(self.candidates).alias("n")), history.space, self.seed)


@dataclass
class GridSearch(Strategy):
    """The first points of the grid for every run, in one batch."""

    points: int
    candidates: int
    name: str = "grid_search"

    def suggest(self, history: History) -> DataFrame | None:
        if history.step:
            return None
        return grid_candidates(history.runs.sparkSession, history.space, self.points, self.candidates, runs=history.runs)


@dataclass
class DifferentialEvolution(Strategy):
    """Sweeps of trials against all members of a run's population; a trial that is not worse takes the member's place."""

    seed: int
    population_size: int
    sweeps: int
    weight: float = 0.8
    crossover_rate: float = 0.9
    name: str = "differential_evolution"

    def suggest(self, history: History) -> DataFrame | None:
        if history.step > self.sweeps:
            return None
        if not history.step:
            size = F.lit(max(4, self.population_size))
            return random_candidates(history.runs.select("run_id", size.alias("n")), history.space, self.seed)
        seed, members = self.seed + history.step, history.last
        population = members.select(*CANDIDATE, F.col("kept_fitness").alias("fitness"))
        mutants = st.de_mutant(population, unpacked(members, "kept"), history.space, self.weight, seed)
        return st.de_trial(mutants, history.space, self.crossover_rate, seed)

    def advance(self, scored: DataFrame, history: History) -> DataFrame:
        score = F.col("validation_accuracy")
        if not history.step:
            return scored.withColumn("kept", F.col("genome")).withColumn("kept_fitness", score)
        before = history.last.select(*CANDIDATE, F.col("kept").alias("_kept"), F.col("kept_fitness").alias("fitness"))
        met = st.de_replace(before, scored).drop("fitness").join(scored, CANDIDATE).join(before.select(*CANDIDATE, "fitness"), CANDIDATE)
        return met.select(
            *scored.columns,
            F.when(F.col("replaced"), F.col("genome")).otherwise(F.col("_kept")).alias("kept"),
            F.when(F.col("replaced"), score).otherwise(F.col("fitness")).alias("kept_fitness"),
        )


@dataclass
class SimulatedAnnealing(Strategy):
    """One chain per run; a neighbour that is worse is taken with a chance that cools down."""

    seed: int
    length: int
    initial: float = 1.0
    cooling: float = 0.995
    minimum: float = 0.01
    scale: float = 0.2
    name: str = "simulated_annealing"

    def _heat(self, step: int):
        return st.temperature(F.lit(step - 1), self.initial, self.cooling, self.minimum)

    def suggest(self, history: History) -> DataFrame | None:
        if history.step >= self.length:
            return None
        if not history.step:
            return random_candidates(history.runs.select("run_id", F.lit(1).alias("n")), history.space, self.seed)
        here = unpacked(history.last, "kept")
        return st.sa_neighbor(here, history.space, self._heat(history.step), self.scale, self.seed, F.lit(history.step))

    def advance(self, scored: DataFrame, history: History) -> DataFrame:
        score = F.col("validation_accuracy")
        if not history.step:
            return scored.withColumn("kept", F.col("genome")).withColumn("kept_fitness", score).withColumn("best", score)
        before = history.last.select(*CANDIDATE, F.col("kept").alias("_kept"), F.col("kept_fitness").alias("fitness"), F.col("best").alias("best_before"))
        met = before.join(scored, CANDIDATE).withColumn("candidate_fitness", score).withColumn("best_fitness", F.col("best_before"))
        moved = st.sa_accept(met, self._heat(history.step), self.seed, F.lit(history.step))
        kept = F.when(F.col("accepted"), F.col("genome")).otherwise(F.col("_kept"))
        return moved.select(*scored.columns, kept.alias("kept"), F.col("fitness").alias("kept_fitness"), F.col("best_fitness").alias("best"))


@dataclass
class ParzenSearch(Strategy):
    """Batches drawn where good candidates are denser than bad ones; the first is random."""

    seed: int
    batch: int
    batches: int
    name: str = "optuna_tpe"

    def suggest(self, history: History) -> DataFrame | None:
        if history.step >= self.batches:
            return None
        if not history.step:
            return random_candidates(history.runs.select("run_id", F.lit(self.batch).alias("n")), history.space, self.seed)
        seen = history.evaluated()
        population = seen.select(*CANDIDATE, F.col("validation_accuracy").alias("fitness"))
        return st.tpe_suggest(population, unpacked(seen), history.space, self.batch, self.seed + history.step)


class Sampler(Protocol):
    """A user's sampler of one run: told of every evaluation in order, then asked for candidates.

    It is built anew for each step with the run, the number of the step and the parameters (``name``, ``type``, ``low``,
    ``high``, ``choices``). A genome is a dictionary by parameter name; a missing name becomes a null gene.
    """

    def __init__(self, run_id: int, step: int, params: list[dict]): ...

    def observe(self, genome: dict, fitness: float) -> None: ...

    def draw(self) -> Iterable[dict]: ...


def _table_function(sampler: type):
    """The table function of a sampler. Its output has a column per parameter, as its arguments say."""

    class Draws:
        @staticmethod
        def analyze(history: AnalyzeArgument, step: AnalyzeArgument, params: AnalyzeArgument) -> AnalyzeResult:
            shape = StructType().add("run_id", LongType()).add("ordinal", LongType())
            for param in json.loads(params.value):
                shape = shape.add(param["name"], StringType() if param["type"] == CATEGORICAL else DoubleType())
            return AnalyzeResult(schema=shape)

        def __init__(self):
            self.one = None

        def eval(self, history, step, params):
            if self.one is None:
                self.run_id, self.params = history["run_id"], json.loads(params)
                self.one = sampler(self.run_id, step, self.params)
            if history["genome"] is not None:
                genome = {g["name"]: g["cat"] if g["num"] is None else g["num"] for g in history["genome"]}
                self.one.observe(genome, history["fitness"])

        def terminate(self):
            if self.one is None:
                return
            for ordinal, genome in enumerate(self.one.draw()):
                values = [genome.get(p["name"]) for p in self.params]
                yield (self.run_id, ordinal, *[v if v is None or p["type"] == CATEGORICAL else float(v) for p, v in zip(self.params, values)])

    return F.udtf(Draws)


@dataclass
class SampledSearch(Strategy):
    """A strategy whose batches a user's ``Sampler`` class draws in Python, run by run, for ``batches`` steps.

    The histories of different runs are sampled by different tasks; a sampler sees its own run only, row by row, and holds no more of it than
    it chooses to.
    """

    sampler: type
    batches: int
    name: str = "sampled_search"
    _function: object = field(init=False, repr=False, default=None)

    def suggest(self, history: History) -> DataFrame | None:
        if history.step >= self.batches:
            return None
        self._function = self._function or _table_function(self.sampler)
        fields = ["name", "low", "high", "choices"]
        params = [{f: getattr(p, f) for f in fields} | {"type": p.param_type} for p in history.space.params]
        # A row without a genome stands for a run of which nothing is known yet.
        seen = history.runs.select("run_id", F.lit(-1).cast("long").alias("turn"), F.lit(None).cast(GENOME).alias("genome"), F.lit(None).cast("double").alias("fitness"))
        if history.step:
            known = history.evaluated().select("run_id", F.col("ordinal").alias("turn"), "genome", F.col("validation_accuracy").alias("fitness"))
            seen = seen.unionByName(known)
        drawn = self._function(seen.asTable().partitionBy("run_id").orderBy("turn"), F.lit(history.step), F.lit(json.dumps(params)))
        genes = [
            F.struct(
                F.lit(p["name"]).alias("name"),
                (F.lit(None) if p["type"] == CATEGORICAL else F.col(p["name"])).cast("double").alias("num"),
                (F.col(p["name"]) if p["type"] == CATEGORICAL else F.lit(None)).cast("string").alias("cat"),
            )
            for p in params
        ]
        rows = drawn.select("run_id", F.lit(0).alias("generation"), "ordinal", F.explode(F.array(*genes)).alias("g"))
        return rows.select(*CANDIDATE, "g.*")
