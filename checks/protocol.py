"""Whole searches next to SQL that walks through the same steps."""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from checks.base import check
from checks.search import BEST, POP, RULE_SPACE, SCORE_SQL, SCORER, SEED, fl, normal_sql, search_runs, u
from tunelake.operators import evaluation as e
from tunelake.operators import evolution as ev
from tunelake.operators import space as sp
from tunelake.plans import protocol as pr
from tunelake.plans import searches as ps

HISTORY = "run_id:long generation:long avg_fitness:dbl best_so_far:dbl"
RUNS_SQL = "r AS (SELECT DISTINCT run_id FROM population_view)"


def scored(name: str, source: str, columns: str) -> str:
    """A table with the score ``f`` of every candidate ``x`` of a source."""
    return f"{name} AS (SELECT {columns}, {SCORE_SQL} AS f FROM {source} c, eval_data_view d GROUP BY ALL)"


def clipped(value: str) -> str:
    return f"greatest(CAST(0 AS DOUBLE), least(CAST(20000 AS DOUBLE), {value}))"


def sample_sql(count: int, runs: str = "r", seed: int = SEED) -> str:
    return f"SELECT run_id, i AS ordinal, 20000 * {u(seed, 'sample', 'run_id', '0', 'i', chr(39) + 'x' + chr(39))} AS x FROM {runs}, range(0, {count}) AS g(i)"


def sweep_sql(sweep: int, size: int) -> str:
    """One sweep of differential evolution: trials ``t``, their scores ``q`` and the members ``m`` after it."""
    seed, k, before = SEED + sweep, sweep, f"m{sweep - 1}"
    draws = ", ".join(f"{u(seed, f'donor{i}', 'run_id', '0', 'ordinal')} AS u{i}" for i in range(3))
    return f"""
     d{k} AS (SELECT *, {draws} FROM {before}),
     e{k} AS (SELECT *, {fl(f'u0 * ({size} - 1)')} AS a, {fl(f'u1 * ({size} - 2)')} AS b0, {fl(f'u2 * ({size} - 3)')} AS c0 FROM d{k}),
     f{k} AS (SELECT *, b0 + CASE WHEN b0 >= a THEN 1 ELSE 0 END AS b FROM e{k}),
     g{k} AS (SELECT *, c0 + CASE WHEN c0 >= least(a, b) THEN 1 ELSE 0 END AS c1 FROM f{k}),
     h{k} AS (SELECT *, c1 + CASE WHEN c1 >= greatest(a, b) THEN 1 ELSE 0 END AS c2 FROM g{k}),
     o{k} AS (SELECT run_id, ordinal, x, f AS was, a + CASE WHEN a >= ordinal THEN 1 ELSE 0 END AS a, b + CASE WHEN b >= ordinal THEN 1 ELSE 0 END AS b, c2 + CASE WHEN c2 >= ordinal THEN 1 ELSE 0 END AS c FROM h{k}),
     t{k} AS (SELECT o.run_id, o.ordinal, o.x AS old, o.was,
                     CASE WHEN floor({u(seed, 'forced', 'o.run_id', '0', 'o.ordinal')} * 2) = 0 OR {u(seed, 'cross', 'o.run_id', '0', 'o.ordinal', chr(39) + 'x' + chr(39))} < CAST(0.9 AS DOUBLE)
                          THEN {clipped('pa.x + CAST(0.8 AS DOUBLE) * (pb.x - pc.x)')} ELSE o.x END AS x
                FROM o{k} o JOIN {before} pa ON pa.run_id = o.run_id AND pa.ordinal = a JOIN {before} pb ON pb.run_id = o.run_id AND pb.ordinal = b
                     JOIN {before} pc ON pc.run_id = o.run_id AND pc.ordinal = c),
     {scored(f'q{k}', f't{k}', 'c.run_id, c.ordinal, c.old, c.was, c.x')},
     m{k} AS (SELECT run_id, ordinal, CASE WHEN f >= was THEN x ELSE old END AS x, CASE WHEN f >= was THEN f ELSE was END AS f FROM q{k})"""


@check(
    "differential_evolution",
    HISTORY,
    f"""
WITH {RUNS_SQL}, s AS ({sample_sql(8)}), {scored('m0', 's', 'c.run_id, c.ordinal, c.x')}, {sweep_sql(1, 8)}, {sweep_sql(2, 8)},
     v AS (SELECT run_id, ordinal AS generation, f FROM m0 UNION ALL SELECT run_id, 8 + ordinal, f FROM q1 UNION ALL SELECT run_id, 16 + ordinal, f FROM q2)
SELECT run_id, generation, f AS avg_fitness, {BEST} AS best_so_far FROM v
""",
    f"{POP} eval_data_view",
)
def _(s):
    return ps.differential_evolution(search_runs(s), RULE_SPACE, SEED, 8, 2, SCORER, s.view("eval_data_view"))


def step_sql(step: int) -> str:
    """One step of all chains: neighbours ``n``, their scores ``q`` and the chains ``m`` after it."""
    key = ("run_id", "0", "0", str(step))
    heat = f"greatest(CAST(0.01 AS DOUBLE), pow(CAST(0.995 AS DOUBLE), CAST({step - 1} AS DOUBLE)))"
    move = normal_sql(u(SEED, "move-1", *key), u(SEED, "move-2", *key))
    return f"""
     n{step} AS (SELECT run_id, x AS old, f AS was, CASE WHEN floor({u(SEED, 'which', *key)} * 2) = 0
                        THEN {clipped(f'x + {move} * (CAST(20000 AS DOUBLE) * CAST(0.2 AS DOUBLE) * greatest({heat}, CAST(0.05 AS DOUBLE)))')} ELSE x END AS x FROM m{step - 1}),
     {scored(f'q{step}', f'n{step}', 'c.run_id, c.old, c.was, c.x')},
     w{step} AS (SELECT *, f >= was OR {u(SEED, 'accept', *key)} < exp((f - was) / {heat}) AS taken FROM q{step}),
     m{step} AS (SELECT run_id, CASE WHEN taken THEN x ELSE old END AS x, CASE WHEN taken THEN f ELSE was END AS f FROM w{step})"""


@check(
    "simulated_annealing",
    HISTORY,
    f"""
WITH {RUNS_SQL}, s AS ({sample_sql(1)}), {scored('m0', 's', 'c.run_id, c.x')}, {step_sql(1)}, {step_sql(2)}, {step_sql(3)},
     v AS (SELECT run_id, 0 AS generation, f FROM m0 UNION ALL SELECT run_id, 1, f FROM q1 UNION ALL SELECT run_id, 2, f FROM q2 UNION ALL SELECT run_id, 3, f FROM q3)
SELECT run_id, generation, f AS avg_fitness, {BEST} AS best_so_far FROM v
""",
    f"{POP} eval_data_view",
)
def _(s):
    return ps.simulated_annealing(search_runs(s), RULE_SPACE, SEED, 4, SCORER, s.view("eval_data_view"))


class ClimbingSampler:
    """A sampler as a user writes it: first draws by hash, then three steps up from the best it was told of."""

    def __init__(self, run_id, step, params):
        self.run_id, self.best = run_id, None

    def observe(self, genome, fitness):
        if self.best is None or fitness > self.best[0]:
            self.best = fitness, genome["x"]

    def draw(self):
        if self.best is None:
            for ordinal in range(6):
                text = f"{SEED}|sample|{self.run_id}|0|{ordinal}|x"
                yield {"x": 20000 * (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52), "z": "a"}
        else:
            for hop in (1, 2, 3):
                yield {"x": min(20000.0, self.best[1] + 500.0 * hop), "z": "b"}


def climbing_sql(runs: str = "r") -> str:
    """Tables ``c0`` and ``c2`` of the scores of both batches."""
    return f"""s0 AS ({sample_sql(6, runs)}), {scored('c0', 's0', 'c.run_id, c.ordinal, c.x')},
     top AS (SELECT * FROM c0 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY f DESC, ordinal) = 1),
     c1 AS (SELECT run_id, 5 + i AS ordinal, least(CAST(20000 AS DOUBLE), x + CAST(500 AS DOUBLE) * i) AS x FROM top, range(1, 4) AS g(i)),
     {scored('c2', 'c1', 'c.run_id, c.ordinal, c.x')},
     climbed AS (SELECT run_id, ordinal AS generation, f FROM c0 UNION ALL SELECT run_id, ordinal, f FROM c2)"""


@check(
    "sampled_search",
    HISTORY,
    f"WITH {RUNS_SQL}, {climbing_sql()}\nSELECT run_id, generation, f AS avg_fitness, {BEST} AS best_so_far FROM climbed",
    f"{POP} eval_data_view",
)
def _(s):
    found = pr.run_strategy(pr.SampledSearch(ClimbingSampler, 2), search_runs(s), RULE_SPACE, SCORER, s.view("eval_data_view"))
    return pr.progress(found)


@check(
    "strategy_matrix",
    "run_name:str seed:long generation:long avg_fitness:dbl best_so_far:dbl",
    f"""
WITH seeds AS (SELECT 42 + i AS run_id FROM range(0, 3) AS g(i)), {climbing_sql('seeds')}, k AS ({sample_sql(8, 'seeds')}), {scored('drawn', 'k', 'c.run_id, c.ordinal, c.x')},
     v AS (SELECT 'Random Search' AS run_name, run_id, ordinal AS generation, f FROM drawn UNION ALL SELECT 'sampled_search', run_id, generation, f FROM climbed WHERE generation < 8)
SELECT run_name, run_id AS seed, generation, f AS avg_fitness, max(f) OVER (PARTITION BY run_name, run_id ORDER BY generation ROWS UNBOUNDED PRECEDING) AS best_so_far FROM v
""",
    "eval_data_view",
)
def _(s):
    strategies = [pr.RandomSearch(SEED, 8), pr.SampledSearch(ClimbingSampler, 2)]
    return ps.benchmark_matrix(s.spark, RULE_SPACE, [42, 43, 44], 8, SCORER, s.view("eval_data_view"), strategies)


PLANE_SPACE = sp.Space((sp.Param("axis", sp.DISCRETE, 1.0, 64.0), sp.Param("bound", sp.CONTINUOUS, -0.3, 0.3)))


def plane_hits(batch: pd.DataFrame, candidates: pd.DataFrame) -> pd.Series:
    """Rows of a batch that a half-space tells right, per candidate."""
    vectors, odd = np.stack(batch["embedding"].to_numpy()).astype("float64"), batch["label"].to_numpy() % 2 == 1
    sides = vectors[:, candidates["axis"].to_numpy(dtype="int64") - 1] >= candidates["bound"].to_numpy()[None, :]
    return pd.Series((sides == odd[:, None]).sum(axis=0))


@check(
    "python_scores",
    "run_id:long ordinal:long validation_accuracy:dbl status:str",
    f"""
WITH {RUNS_SQL}, c AS (SELECT run_id, i AS ordinal, CAST(1 + floor({u(SEED, 'sample', 'run_id', '0', 'i', "'axis'")} * 64) AS BIGINT) AS axis,
                              CAST(-0.3 AS DOUBLE) + {u(SEED, 'sample', 'run_id', '0', 'i', "'bound'")} * (CAST(0.3 AS DOUBLE) - CAST(-0.3 AS DOUBLE)) AS bound
                         FROM r, range(0, 30) AS g(i))
SELECT c.run_id, c.ordinal, sum(CASE WHEN (CAST(v.embedding[c.axis] AS DOUBLE) >= c.bound) = (v.label % 2 = 1) THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS validation_accuracy,
       'COMPLETED' AS status FROM c, embeddings v GROUP BY c.run_id, c.ordinal
""",
    POP,
)
def _(s):
    genes = sp.random_candidates(search_runs(s).withColumn("n", F.lit(30)), PLANE_SPACE, SEED)
    scorer = e.BatchScorer(("embedding", "label"), plane_hits, 200)
    return e.evaluate_candidates(genes, PLANE_SPACE, scorer, s.table("embeddings"))


LIMIT_MS, EXPECTED = 1_500_000, 4


@check(
    "search_stops",
    "run_id:long generations_completed:int jobs_planned:long jobs_submitted:long stop_reason:str stopped_early:bool",
    f"""
WITH {RUNS_SQL}, k AS (SELECT run_id, generation_id AS g, count(DISTINCT worker_id) AS workers, sum(training_time_ms) AS wall FROM results_view WHERE generation_id < 3 GROUP BY ALL),
     w AS (SELECT r.run_id, coalesce(max(CASE WHEN g = 0 THEN wall END), 0) AS w0, coalesce(max(CASE WHEN g = 1 THEN wall END), 0) AS w1,
                  max(CASE WHEN g = 0 THEN workers END) < {EXPECTED} AS s0, max(CASE WHEN g = 1 THEN workers END) < {EXPECTED} AS s1, max(CASE WHEN g = 2 THEN workers END) < {EXPECTED} AS s2
             FROM r LEFT JOIN k ON k.run_id = r.run_id GROUP BY r.run_id),
     o AS (SELECT run_id, CASE WHEN s0 THEN 1 WHEN w0 > 0 AND 2 * w0 > {LIMIT_MS} THEN 1 WHEN s1 THEN 2 WHEN greatest(w0, w1) > 0 AND w0 + w1 + greatest(w0, w1) > {LIMIT_MS} THEN 2 ELSE 3 END AS done,
                  CASE WHEN s0 THEN 'insufficient_workers' WHEN w0 > 0 AND 2 * w0 > {LIMIT_MS} THEN 'max_wall_clock_reached' WHEN s1 THEN 'insufficient_workers'
                       WHEN greatest(w0, w1) > 0 AND w0 + w1 + greatest(w0, w1) > {LIMIT_MS} THEN 'max_wall_clock_reached' WHEN s2 THEN 'insufficient_workers' ELSE 'completed' END AS reason FROM w)
SELECT run_id, done AS generations_completed, 12 AS jobs_planned, 4 * done AS jobs_submitted, reason AS stop_reason, reason <> 'completed' AS stopped_early FROM o
""",
    f"{POP} results_view",
)
def _(s):
    seen = s.view("results_view").groupBy("run_id", "generation_id").agg(
        F.sum("training_time_ms").alias("wall_clock_ms"), F.count_distinct("worker_id").alias("active_workers")
    )

    def telemetry(results, generation):
        mine = seen.filter(F.col("generation_id") == generation)
        return results.select("run_id").distinct().join(mine, "run_id", "left").select("run_id", F.coalesce("wall_clock_ms", F.lit(0)).alias("wall_clock_ms"), "active_workers")

    config = ev.EvolutionConfig(population_size=4, num_generations=3, elite_count=1, narrowing=False, seed=SEED)
    rules = ps.StopRules(LIMIT_MS, EXPECTED, telemetry)
    scorer = e.ExpressionScorer(lambda: F.col("x") / 20000)
    return ps.guarded_search(search_runs(s), RULE_SPACE, config, scorer, rules=rules).outcomes
