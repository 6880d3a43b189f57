"""Whole searches over many runs at once. Only loop control runs on the driver."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.functions.frames import table_union
from tunelake.operators import evolution as ev
from tunelake.operators.compare import RUN_NAME_TO_KEY
from tunelake.operators.evaluation import evaluate_candidates
from tunelake.operators.scans import value_block
from tunelake.operators.space import CANDIDATE, Space, random_candidates, with_defaults
from tunelake.plans.protocol import (
    DifferentialEvolution,
    GridSearch,
    ParzenSearch,
    RandomSearch,
    SimulatedAnnealing,
    Strategy,
    progress,
    run_strategy,
)
from tunelake.session import cut_lineage


@dataclass(frozen=True)
class Operators:
    """Replaceable steps of the genetic search: ``(frame, ..., config) -> frame`` callables."""

    select: Callable = lambda population, parents, config: ev.elitist_select(
        population, parents, config.elite_count, config.tournament_size, config.seed
    )
    cross: Callable = lambda genes, pairs, space, config: ev.uniform_crossover(
        genes, pairs, config.swap_prob, config.seed
    )
    mutate: Callable = lambda genes, space, config, floor: ev.adaptive_mutation(genes, space, config, floor)


def no_constraints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [], "run_id long, name string, low double, high double, preferred array<string>"
    )


def _completed(genes: DataFrame, space: Space, config: ev.EvolutionConfig) -> DataFrame:
    """Genomes with the genes that do not evolve."""
    return genes if config.dataset is None else with_defaults(genes, space, config.dataset, config.epochs)


def initialize_population(runs: DataFrame, space: Space, config: ev.EvolutionConfig) -> tuple[DataFrame, DataFrame]:
    """Generation 0: random genomes with fitness 0 for every run."""
    sized = runs.select("run_id", F.lit(config.population_size).alias("n"))
    genes = _completed(random_candidates(sized, space, config.seed), space, config)
    population = (
        genes.filter(F.col("name") == space.params[0].name)
        .select(*CANDIDATE)
        .withColumn("fitness", F.lit(0.0))
        .withColumn("origin", F.lit("initial"))
    )
    return population, genes


def evolve(
    population: DataFrame,
    genes: DataFrame,
    space: Space,
    config: ev.EvolutionConfig,
    overrides: DataFrame | None = None,
    steps: Operators | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Next generation of every run.

    ``overrides`` may give ``immigrant_rate_override``, ``mutation_rate_floor_override`` and
    ``reheat`` per run; reheated runs drop their narrowed bounds for this step.
    """
    steps = steps or Operators()
    spark = population.sparkSession
    genes = genes.filter(F.col("name").isin(space.names()))
    offspring_count = config.population_size - config.elite_count
    if overrides is None:
        overrides = population.select("run_id").distinct().select(
            "run_id",
            F.lit(False).alias("reheat"),
            F.lit(None).cast("double").alias("immigrant_rate_override"),
            F.lit(None).cast("double").alias("mutation_rate_floor_override"),
        )
    if config.narrowing:
        grown = population.filter(F.col("generation") >= config.narrowing_start).join(
            overrides.filter(~F.col("reheat")).select("run_id"), "run_id", "left_semi"
        )
        constraints = ev.narrow_constraints(grown, genes, space, config).drop("generation")
        constraints = cut_lineage(constraints)
    else:
        constraints = no_constraints(spark)

    kept = ev.elites(population, config.elite_count)
    parents = steps.select(population, offspring_count, config)
    crossed = steps.cross(genes, ev.pair_parents(parents), space, config).filter(
        F.col("ordinal") < offspring_count
    )
    rates = overrides.select("run_id", "immigrant_rate_override", "mutation_rate_floor_override")
    aged = crossed.withColumn("generation", F.col("generation") + 1).join(rates, "run_id", "left")
    floor = F.coalesce("mutation_rate_floor_override", F.lit(0.0))
    mutated = steps.mutate(aged, space, config, floor).drop("mutation_rate_floor_override")
    rate_by_run = mutated.select(*CANDIDATE, "name", "num", "cat")
    limited = ev.apply_constraints(rate_by_run, constraints, space, config.categorical_bias, config.seed)
    biased = ev.late_training_bias(limited, space, config).join(rates, "run_id", "left")
    rate = F.coalesce("immigrant_rate_override", F.lit(config.immigrant_rate))
    mixed = ev.inject_immigrants(biased, offspring_count, rate, space, constraints, config)

    elite_genes = (
        genes.join(kept.select(*ev.POPULATION, "slot", F.col("parent").alias("ordinal")), CANDIDATE)
        .select("run_id", (F.col("generation") + 1).alias("generation"), F.col("slot").alias("ordinal"), "name", "num", "cat")
    )
    shifted = mixed.withColumn("ordinal", F.col("ordinal") + config.elite_count)
    merged = cut_lineage(elite_genes.unionByName(shifted))
    next_genes = cut_lineage(_completed(ev.dedupe_genomes(merged, space, constraints, config), space, config))
    elite_rows = kept.select(
        "run_id", (F.col("generation") + 1).alias("generation"), F.col("slot").alias("ordinal"), F.col("fitness").alias("_kept")
    )
    # An elite whose genome de-duplication replaced is a new candidate without a score.
    elite_keys = ev.genome_keys(merged.filter(F.col("ordinal") < config.elite_count)).select(*CANDIDATE, "genome_key")
    same = elite_keys.join(ev.genome_keys(next_genes.filter(F.col("name").isin(space.names()))).select(*CANDIDATE, "genome_key"), [*CANDIDATE, "genome_key"], "left_semi")
    elite_rows = elite_rows.join(same, CANDIDATE, "left_semi")
    next_population = (
        next_genes.filter(F.col("name") == space.params[0].name)
        .select(*CANDIDATE)
        .join(elite_rows, CANDIDATE, "left")
        .select(
            *CANDIDATE,
            F.coalesce("_kept", F.lit(0.0)).alias("fitness"),
            F.when(F.col("_kept").isNotNull(), "elite").otherwise("offspring").alias("origin"),
        )
    )
    return next_population, next_genes


def _reheat_state(state: DataFrame, stats: DataFrame, config: ev.EvolutionConfig, last: bool) -> DataFrame:
    """Plateau bookkeeping of each run after one more generation."""
    joined = state.join(stats.select("run_id", F.col("best_fitness").alias("_best")), "run_id", "left")
    gain = F.col("_best") > F.col("peak") + F.lit(config.plateau_min_delta)
    if config.plateau_any_new_best:
        gain = gain | (F.col("_best") > F.col("peak"))
    stale = F.when(F.col("peak").isNull() | gain, 0).otherwise(F.col("stale") + 1)
    fires = (stale >= config.plateau_patience) & F.lit(config.plateau_reheat_gens > 0) & F.lit(not last)
    return joined.select(
        "run_id",
        F.greatest("peak", "_best").alias("peak"),
        F.when(fires, 0).otherwise(stale).alias("stale"),
        F.when(fires, F.greatest(F.col("remaining"), F.lit(config.plateau_reheat_gens)))
        .otherwise(F.col("remaining"))
        .alias("remaining"),
        (F.col("events") + fires.cast("int")).alias("events"),
    )


@dataclass(frozen=True)
class StopRules:
    """When runs leave a search before their last generation; 0 switches a rule off.

    ``telemetry(results, generation)`` gives ``run_id, wall_clock_ms, active_workers`` of a generation that was scored. Without it the clock is the
    time that scoring took here, for all runs alike, and workers are unknown.
    """

    max_wall_clock_ms: int = 0
    expected_workers: int = 0
    telemetry: Callable[[DataFrame, int], DataFrame] | None = None


@dataclass(frozen=True)
class SearchResult:
    """``history``: one row per run and generation; ``outcomes``: one row per run."""

    history: DataFrame
    outcomes: DataFrame


class _Durations:
    """Durations of the earlier generations of every run, counted by blocks of values.

    Whether the upper median is above a bound follows from the number of durations up to it: whole blocks are counted, and only the
    durations in the block of the bound are looked at one by one.
    """

    def __init__(self):
        self.counts: DataFrame | None = None
        self.rounds: list[DataFrame] = []

    def add(self, walls: DataFrame) -> None:
        """``run_id, wall_clock_ms`` of a generation; durations of 0 are not timed."""
        timed = walls.filter("wall_clock_ms > 0").select("run_id", "wall_clock_ms", value_block(F.col("wall_clock_ms")).alias("block"))
        timed = cut_lineage(timed)
        self.rounds.append(timed)
        fresh = timed.select("run_id", "block", F.lit(1).cast("long").alias("n"))
        both = fresh if self.counts is None else self.counts.unionByName(fresh)
        self.counts = cut_lineage(both.groupBy("run_id", "block").agg(F.sum("n").alias("n")))

    def median_above(self, bounds: DataFrame) -> DataFrame:
        """Runs of ``bounds`` (``run_id, bound``) whose upper median is above their bound."""
        marked = bounds.withColumn("at", value_block(F.col("bound")))
        whole = marked.join(self.counts, "run_id").groupBy("run_id").agg(
            F.sum("n").alias("timed"), F.sum(F.when(F.col("block") < F.col("at"), F.col("n")).otherwise(0)).alias("below")
        )
        near = table_union(self.rounds).join(marked.withColumnRenamed("at", "block"), ["run_id", "block"])
        near = near.filter(F.col("wall_clock_ms") <= F.col("bound")).groupBy("run_id").agg(F.count(F.lit(1)).alias("near"))
        within = F.col("below") + F.coalesce("near", F.lit(0).cast("long"))
        return whole.join(near, "run_id", "left").filter(within <= F.floor(F.col("timed") / 2)).select("run_id")


def guarded_search(
    runs: DataFrame,
    space: Space,
    config: ev.EvolutionConfig,
    scorer,
    data: DataFrame | None = None,
    steps: Operators | None = None,
    rules: StopRules = StopRules(),
) -> SearchResult:
    """Generational search of every run until its last generation or a stop rule.

    A run is stopped before a generation when the time it has taken and the upper median of its generations exceed the limit, and
    after one that had too few workers. Stopped runs leave the working set: later generations are neither bred nor scored for them.
    Each generation is written to the checkpoint folder, which keeps the plan short and lets a
    lost executor recompute one generation only.
    """
    population, genes = initialize_population(runs, space, config)
    population, genes = cut_lineage(population), cut_lineage(genes)
    zero = F.lit(0).cast("long")
    state = runs.select(
        "run_id",
        F.lit(None).cast("double").alias("peak"),
        F.lit(0).alias("stale"),
        F.lit(0).alias("remaining"),
        F.lit(0).alias("events"),
        zero.alias("elapsed_ms"),
        F.lit(0).alias("done"),
        F.lit(0).alias("reheats"),
        F.lit(None).cast("string").alias("reason"),
    )
    durations, history, finished = _Durations(), [], []
    for generation in range(config.num_generations):
        last = generation == config.num_generations - 1
        if generation and rules.max_wall_clock_ms > 0:
            spare = state.select("run_id", (F.lit(rules.max_wall_clock_ms) - F.col("elapsed_ms")).alias("bound"))
            late = cut_lineage(durations.median_above(spare))
            finished.append(state.join(late, "run_id", "left_semi").withColumn("reason", F.lit("max_wall_clock_reached")))
            state = cut_lineage(state.join(late, "run_id", "left_anti"))
            population, genes = population.join(late, "run_id", "left_anti"), genes.join(late, "run_id", "left_anti")
        if generation and state.isEmpty():
            break
        began = time.monotonic()
        results = cut_lineage(evaluate_candidates(genes, space, scorer, data))
        spent = int((time.monotonic() - began) * 1000)
        population = cut_lineage(ev.assign_fitness(population, results))
        stats = ev.population_stats(population)
        if rules.telemetry is None:
            clock = state.select("run_id", F.lit(spent).cast("long").alias("wall_clock_ms"), F.lit(None).cast("long").alias("active_workers"))
        else:
            clock = rules.telemetry(results, generation)
        seen = clock.select("run_id", F.greatest(F.col("wall_clock_ms").cast("long"), zero).alias("wall_clock_ms"), F.col("active_workers").cast("long").alias("active_workers"))
        advanced = _reheat_state(state, stats, config, last).join(state.select("run_id", "elapsed_ms", "done", "reheats", "reason"), "run_id")
        short = (F.lit(rules.expected_workers) > 0) & (F.col("active_workers") < rules.expected_workers)
        advanced = (
            advanced.join(seen, "run_id", "left")
            .withColumn("wall_clock_ms", F.coalesce("wall_clock_ms", zero))
            .withColumn("elapsed_ms", F.col("elapsed_ms") + F.col("wall_clock_ms"))
            .withColumn("done", F.col("done") + 1)
            .withColumn("reason", F.when(short, "insufficient_workers"))
        )
        advanced = cut_lineage(advanced)
        metrics = stats.join(advanced, "run_id").select(
            "run_id",
            "generation",
            "size",
            "best_fitness",
            "avg_fitness",
            "worst_fitness",
            F.col("peak").alias("best_so_far"),
            (F.col("remaining") > 0).alias("reheated"),
            F.col("events").alias("plateau_events"),
            "wall_clock_ms",
        )
        history.append(cut_lineage(metrics))
        if rules.max_wall_clock_ms > 0:
            durations.add(advanced.select("run_id", "wall_clock_ms"))
        advanced = advanced.drop("wall_clock_ms", "active_workers")
        if rules.expected_workers > 0:
            gone = advanced.filter(F.col("reason").isNotNull())
            finished.append(gone)
            advanced = advanced.filter(F.col("reason").isNull())
            left = gone.select("run_id")
            population, genes = population.join(left, "run_id", "left_anti"), genes.join(left, "run_id", "left_anti")
        state = advanced
        if last:
            break
        hot = F.col("remaining") > 0
        overrides = state.select(
            "run_id",
            hot.alias("reheat"),
            F.when(hot, F.lit(config.plateau_immigrant_rate)).alias("immigrant_rate_override"),
            F.when(hot, F.lit(config.plateau_mutation_floor)).alias("mutation_rate_floor_override"),
        )
        state = state.withColumn("reheats", F.col("reheats") + hot.cast("int")).withColumn("remaining", F.greatest(F.col("remaining") - 1, F.lit(0)))
        next_population, next_genes = evolve(population, genes, space, config, overrides, steps)
        population, genes = cut_lineage(next_population), next_genes
    ends = table_union([*finished, state.withColumn("reason", F.lit("completed"))])
    outcomes = ends.select(
        "run_id",
        F.lit(config.num_generations).alias("generations_planned"),
        F.col("done").alias("generations_completed"),
        F.lit(config.population_size * config.num_generations).cast("long").alias("jobs_planned"),
        (F.col("done") * F.lit(config.population_size)).cast("long").alias("jobs_submitted"),
        F.col("reason").alias("stop_reason"),
        (F.col("reason") != "completed").alias("stopped_early"),
        F.col("events").alias("plateau_events"),
        F.col("reheats").alias("reheat_generations_applied"),
        F.col("stale").alias("stale_generations_final"),
    )
    return SearchResult(table_union(history), outcomes)


def run_search(
    runs: DataFrame,
    space: Space,
    config: ev.EvolutionConfig,
    scorer,
    data: DataFrame | None = None,
    steps: Operators | None = None,
) -> DataFrame:
    """Generational search of every run to its last generation; one metrics row per (run, generation)."""
    return guarded_search(runs, space, config, scorer, data, steps).history


def random_search(runs: DataFrame, space: Space, seed: int, budget: int, scorer, data: DataFrame | None = None) -> DataFrame:
    """Independent random candidates under an evaluation budget, as one step."""
    return progress(run_strategy(RandomSearch(seed, budget), runs, space, scorer, data, budget))


def grid_search(
    spark: SparkSession, space: Space, points: int, budget: int, scorer, data: DataFrame | None = None, run_id: int = 0
) -> DataFrame:
    """Grid candidates of one run under an evaluation budget, as one step."""
    runs = spark.createDataFrame([(run_id,)], "run_id long")
    return progress(run_strategy(GridSearch(points, budget), runs, space, scorer, data, budget))


def differential_evolution(
    runs: DataFrame,
    space: Space,
    seed: int,
    population_size: int,
    sweeps: int,
    scorer,
    data: DataFrame | None = None,
    weight: float = 0.8,
    crossover_rate: float = 0.9,
) -> DataFrame:
    """Differential evolution of every run; a sweep replaces all its members together."""
    strategy = DifferentialEvolution(seed, population_size, sweeps, weight, crossover_rate)
    return progress(run_strategy(strategy, runs, space, scorer, data))


def simulated_annealing(
    runs: DataFrame,
    space: Space,
    seed: int,
    steps: int,
    scorer,
    data: DataFrame | None = None,
    initial: float = 1.0,
    cooling: float = 0.995,
    minimum: float = 0.01,
    scale: float = 0.2,
) -> DataFrame:
    """One annealing chain per run, all chains advancing together."""
    strategy = SimulatedAnnealing(seed, steps, initial, cooling, minimum, scale)
    return progress(run_strategy(strategy, runs, space, scorer, data))


def parzen_search(
    runs: DataFrame, space: Space, seed: int, batch: int, batches: int, scorer, data: DataFrame | None = None
) -> DataFrame:
    """Model-based search of every run in batches; the first batch is random."""
    return progress(run_strategy(ParzenSearch(seed, batch, batches), runs, space, scorer, data))


#: Name of a strategy in stored runs by its key.
STRATEGY_NAMES = {key: name for name, key in RUN_NAME_TO_KEY.items()}


def default_strategies(budget: int) -> list[Strategy]:
    """The strategies of the benchmark under an evaluation budget."""
    size = max(4, min(20, budget // 4))
    return [
        RandomSearch(1, budget),
        GridSearch(4, budget),
        ParzenSearch(2, size, -(-budget // size)),
        DifferentialEvolution(3, size, -(-budget // size) - 1),
        SimulatedAnnealing(4, budget),
    ]


def benchmark_matrix(
    spark: SparkSession,
    space: Space,
    seeds: list[int],
    budget: int,
    scorer,
    data: DataFrame | None = None,
    strategies: list[Strategy] | None = None,
) -> DataFrame:
    """Every strategy with every seed under one evaluation budget; one row per evaluation.

    Seeds are runs of one job; only the strategies differ in their plans. Any ``Strategy`` can take part.
    """
    runs = spark.createDataFrame([(s,) for s in seeds], "run_id long")
    parts = []
    for strategy in strategies or default_strategies(budget):
        history = progress(run_strategy(strategy, runs, space, scorer, data, budget))
        name = STRATEGY_NAMES.get(strategy.name, strategy.name)
        parts.append(
            history.select(F.lit(name).alias("run_name"), F.col("run_id").alias("seed"), "generation", "avg_fitness", "best_so_far", "wall_clock_ms")
        )
    return table_union(parts)


def _unit(strategy: Strategy, budget: int) -> str:
    """Name of a strategy with its settings and budget: the same work has the same name."""
    settings = sorted((k, repr(v)) for k, v in vars(strategy).items() if not k.startswith("_"))
    text = json.dumps([type(strategy).__qualname__, settings, budget])
    return f"{strategy.name}-{hashlib.sha256(text.encode()).hexdigest()[:12]}"


def _committed(spark: SparkSession, path: str) -> set[tuple[str, int]]:
    """Units whose rows are complete: one row per strategy and seed that was ever asked for."""
    try:
        rows = spark.read.schema("unit string, seed long, evaluations long").parquet(f"{path}/manifest")
        return {(r["unit"], r["seed"]) for r in rows.select("unit", "seed").distinct().collect()}
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()


def stored_matrix(
    spark: SparkSession,
    path: str,
    space: Space,
    seeds: list[int],
    budget: int,
    scorer,
    data: DataFrame | None = None,
    strategies: list[Strategy] | None = None,
) -> DataFrame:
    """The benchmark matrix, kept below ``path``: every (strategy, seed) is computed once and then read.

    The missing seeds of a strategy run together. Their rows replace whatever an interrupted call left of them, and only then the
    manifest names them, so a unit that it names is complete. Rows have what ``compare.seed_summary`` reads.
    """
    chosen = strategies or default_strategies(budget)
    units = {_unit(strategy, budget): strategy for strategy in chosen}
    known = _committed(spark, path)
    for unit, strategy in units.items():
        missing = [seed for seed in seeds if (unit, seed) not in known]
        if not missing:
            continue
        runs = spark.createDataFrame([(seed,) for seed in missing], "run_id long")
        history = progress(run_strategy(strategy, runs, space, scorer, data, budget))
        name = STRATEGY_NAMES.get(strategy.name, strategy.name)
        rows = history.select(
            F.lit(unit).alias("unit"),
            F.col("run_id").alias("seed"),
            F.lit(name).alias("run_name"),
            F.col("generation").cast("int").alias("generation"),
            F.col("best_so_far").alias("best_fitness"),
            "best_so_far",
            "avg_fitness",
            F.col("avg_fitness").alias("worst_fitness"),
            F.ceil("wall_clock_ms").cast("long").alias("wall_clock_ms"),
        )
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("unit", "seed").parquet(f"{path}/runs")
        # Seeds without an evaluation are complete as well.
        counts = runs.join(rows.groupBy("seed").agg(F.count(F.lit(1)).alias("n")), F.col("run_id") == F.col("seed"), "left")
        manifest = counts.select(F.lit(unit).alias("unit"), F.col("run_id").alias("seed"), F.coalesce("n", F.lit(0).cast("long")).alias("evaluations"))
        manifest.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    shape = "run_name string, generation int, best_fitness double, best_so_far double, avg_fitness double, worst_fitness double, wall_clock_ms long, unit string, seed long"
    stored = spark.read.schema(shape).parquet(f"{path}/runs")
    return stored.filter(F.col("unit").isin(list(units)) & F.col("seed").isin(list(seeds)))
