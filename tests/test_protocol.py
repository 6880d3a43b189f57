"""Strategies as objects: built-in ones, a user's own, and samplers in Python."""

import hashlib
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from test_search import SPACE, rows, runs
from tunelake.operators import compare
from tunelake.operators import evaluation as e
from tunelake.operators import space as sp
from tunelake.plans import protocol as pr
from tunelake.plans import searches as ps

# Workers cannot import the tests: what they need of them travels with the sampler.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCORER = e.ExpressionScorer(lambda: F.col("x") * F.col("y") + F.when(F.col("z") == "b", 1.0).otherwise(0.0))


class OwnRandom(pr.Strategy):
    """Draws like the built-in random search, in two batches."""

    name = "own"

    def suggest(self, history):
        if history.step > 1:
            return None
        genes = sp.random_candidates(history.runs.withColumn("n", F.lit(10)), history.space, 4)
        low = 6 * history.step
        return genes.filter(F.col("ordinal").between(low, low + 5)).withColumn("ordinal", F.col("ordinal") - low)


def test_own_strategy_gives_the_rows_of_random_search(spark):
    own = pr.progress(pr.run_strategy(OwnRandom(), runs(spark), SPACE, SCORER, budget=10))
    want = ps.random_search(runs(spark), SPACE, 4, 10, SCORER)
    names = ["run_id", "generation", "avg_fitness", "best_so_far"]
    assert rows(own.select(names)) == rows(want.select(names))


def uniform(seed, purpose, *key):
    text = "|".join([str(seed), purpose, *map(str, key)])
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52


class HashSampler:
    """Draws by the same hash as the library, then near the best that it was told of."""

    def __init__(self, run_id, step, params):
        self.run_id, self.step, self.params, self.seen = run_id, step, params, []

    def observe(self, genome, fitness):
        self.seen.append((fitness, -len(self.seen), genome))

    def draw(self):
        if not self.seen:
            for ordinal in range(6):
                yield {p["name"]: self.value(p, ordinal) for p in self.params}
            return
        best = max(self.seen, key=lambda row: row[:2])[2]
        for hop in (1, 2):
            yield best | {"y": min(10, best["y"] + hop), "x": None if hop == 2 else best["x"]}

    def value(self, param, ordinal):
        draw = uniform(4, "sample", self.run_id, 0, ordinal, param["name"])
        if param["type"] == "categorical":
            return param["choices"][int(draw * len(param["choices"]))]
        whole = param["type"] == "discrete"
        return param["low"] + (int(draw * (param["high"] - param["low"] + 1)) if whole else draw * (param["high"] - param["low"]))


def test_python_sampler(spark):
    found = pr.run_strategy(pr.SampledSearch(HashSampler, 2), runs(spark), SPACE, SCORER)
    first = found.filter("step = 0").orderBy("run_id", "turn").collect()
    want = pr.run_strategy(pr.RandomSearch(4, 6), runs(spark), SPACE, SCORER).orderBy("run_id", "turn").collect()
    assert [(r.run_id, r.turn, r.genome, r.validation_accuracy) for r in first] == [(r.run_id, r.turn, r.genome, r.validation_accuracy) for r in want]
    for run in range(3):
        mine = [r for r in first if r.run_id == run]
        best = {g.name: g.num if g.cat is None else g.cat for g in max(mine, key=lambda r: (r.validation_accuracy, -r.turn)).genome}
        later = sorted((r for r in found.filter("step = 1").collect() if r.run_id == run), key=lambda r: r.turn)
        assert [r.turn for r in later] == [6, 7] and [r.status for r in later] == ["COMPLETED", "FAILED"]
        assert {g.name: g.num if g.cat is None else g.cat for g in later[0].genome} == best | {"y": min(10, best["y"] + 1)}


@pytest.mark.parametrize("strategy", [pr.DifferentialEvolution(1, 5, 2), pr.SimulatedAnnealing(1, 4), pr.ParzenSearch(1, 5, 2), pr.GridSearch(3, 7)])
def test_budget_and_turns(spark, strategy):
    found = pr.run_strategy(strategy, runs(spark, 2), SPACE, SCORER, budget=7).collect()
    for run in (0, 1):
        turns = sorted(r.turn for r in found if r.run_id == run)
        assert turns == list(range(min(7, 4 if strategy.name == "simulated_annealing" else 7)))
    assert all(r.wall_clock_ms > 0 and len(r.genome) == 3 for r in found)


def test_time_limit_is_checked_before_each_step(spark):
    ticks = iter(range(1000))
    found = pr.run_strategy(pr.SimulatedAnnealing(1, 50), runs(spark, 1), SPACE, SCORER, limit_ms=9_000, clock=lambda: float(next(ticks)))
    # Start, then three readings per step: the fourth check reads 10 s.
    assert sorted(r.turn for r in found.collect()) == [0, 1, 2]


def test_matrix_takes_any_strategy(spark):
    found = ps.benchmark_matrix(spark, SPACE, [3, 4], 6, SCORER, strategies=[OwnRandom(), pr.GridSearch(2, 6)])
    counts = {(r.run_name, r.seed): r["count"] for r in found.groupBy("run_name", "seed").count().collect()}
    assert counts == {(name, seed): 6 for name in ("own", "Grid Search") for seed in (3, 4)}


def test_no_runs(spark):
    none = runs(spark).filter("run_id < 0")
    assert pr.progress(pr.run_strategy(pr.SimulatedAnnealing(1, 3), none, SPACE, SCORER)).count() == 0
    assert pr.run_strategy(pr.SampledSearch(HashSampler, 2), none, SPACE, SCORER).count() == 0


def test_stored_matrix_computes_nothing_twice(spark, tmp_path):
    path = str(tmp_path / "matrix")
    strategies = [pr.RandomSearch(1, 5), pr.SimulatedAnnealing(2, 4)]
    first = rows(ps.stored_matrix(spark, path, SPACE, [1, 2], 5, SCORER, strategies=strategies))
    broken = e.ExpressionScorer(lambda: F.raise_error(F.lit("scored again")).cast("double"))
    assert rows(ps.stored_matrix(spark, path, SPACE, [1, 2], 5, broken, strategies=strategies)) == first
    # A further seed and changed settings are new work; the others are not.
    more = ps.stored_matrix(spark, path, SPACE, [1, 2, 3], 5, SCORER, strategies=strategies)
    assert {(r.run_name, r.seed): r["count"] for r in more.groupBy("run_name", "seed").count().collect()} == {
        (name, seed): n for name, n in (("Random Search", 5), ("Simulated Annealing", 4)) for seed in (1, 2, 3)
    }
    assert set(first) < set(rows(more))
    with pytest.raises(Exception, match="scored again"):
        ps.stored_matrix(spark, path, SPACE, [1], 5, broken, strategies=[pr.RandomSearch(9, 5)])
    # What an interrupted call left is replaced.
    unit = more.filter("run_name = 'Random Search'").select("unit").first().unit
    left = more.filter(f"unit = '{unit}' and seed = 1").limit(2).withColumn("seed", F.lit(8))
    left.write.mode("append").partitionBy("unit", "seed").parquet(f"{path}/runs")
    again = ps.stored_matrix(spark, path, SPACE, [8], 5, SCORER, strategies=strategies[:1])
    assert sorted(r.generation for r in again.collect()) == [0, 1, 2, 3, 4]
    summary = compare.seed_summary(more).collect()
    assert len(summary) == 6 and all(r.evals_completed in (4, 5) and r.wall_clock_s > 0 for r in summary)
