"""Invariants of the random operators, and independence of the partitioning."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tunelake.functions import draws
from tunelake.operators import evaluation as e
from tunelake.operators import evolution as ev
from tunelake.operators import space as sp
from tunelake.operators import strategies as st
from tunelake.plans import searches as ps
from tunelake.sources import files

SPACE = sp.Space(
    (
        sp.Param("x", sp.CONTINUOUS, 0.0, 1.0),
        sp.Param("y", sp.DISCRETE, 1.0, 10.0),
        sp.Param("z", sp.CATEGORICAL, choices=("a", "b", "c")),
    )
)
CONFIG = ev.EvolutionConfig(population_size=10, num_generations=3, narrowing_start=0, seed=5)


def runs(spark, count=3):
    return spark.range(count).select(F.col("id").alias("run_id"))


def population(spark):
    pop, genes = ps.initialize_population(runs(spark), SPACE, CONFIG)
    return pop.withColumn("fitness", F.col("ordinal") / 10.0), genes


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_draws_are_uniform(spark):
    frame = spark.range(20000).select(draws.uniform(1, "p", F.col("id")).alias("u"))
    r = frame.agg(F.avg("u"), F.min("u"), F.max("u")).collect()[0]
    assert abs(r[0] - 0.5) < 0.01 and 0 <= r[1] < 0.001 and 0.999 < r[2] < 1


def test_distinct_positions(spark):
    picks = [draws.uniform(1, f"d{i}", F.col("id")) for i in range(4)]
    frame = spark.range(3000).select(F.array(*draws.distinct_positions(picks, F.lit(5))).alias("p"))
    got = frame.select(F.size(F.array_distinct("p")).alias("n"), F.array_min("p").alias("a"), F.array_max("p").alias("b"))
    assert got.agg(F.min("n"), F.min("a"), F.max("b")).collect()[0] == (4, 0, 4)


@pytest.mark.parametrize("parts", [1, 32])
def test_selection_does_not_depend_on_partitions(spark, parts):
    pop, genes = population(spark)
    base = rows(ev.elitist_select(pop, 8, 2, 3, 1))
    assert rows(ev.elitist_select(pop.repartition(parts), 8, 2, 3, 1)) == base
    pairs = ev.pair_parents(ev.elitist_select(pop, 8, 2, 3, 1))
    assert rows(ev.uniform_crossover(genes.repartition(parts), pairs, 0.5, 1)) == rows(ev.uniform_crossover(genes, pairs, 0.5, 1))


def test_small_population_tournament(spark):
    pop = spark.createDataFrame([(0, 0, 0, 0.1), (0, 0, 1, 0.9)], "run_id long, generation int, ordinal long, fitness double")
    got = ev.elitist_select(pop, 5, 3, 3, 1).collect()
    assert sorted(r.slot for r in got) == [0, 1, 2, 3, 4] and all(r.parent == 1 for r in got if r.slot != 1)


def test_odd_parent_passes_through(spark):
    pop, genes = population(spark)
    pairs = ev.pair_parents(ev.elitist_select(pop, 5, 2, 3, 1))
    children = ev.uniform_crossover(genes, pairs, 0.5, 1)
    assert {r[0] for r in children.groupBy("run_id").agg(F.count_distinct("ordinal")).select("count(DISTINCT ordinal)").collect()} == {5}


def test_mutation_stays_inside(spark):
    _, genes = population(spark)
    moved = ev.gaussian_mutation(genes, SPACE, 1.0, 5.0, 3)
    assert rows(sp.clip_to_domain(moved, SPACE).select(*moved.columns)) == rows(moved)
    assert rows(ev.gaussian_mutation(genes, SPACE, 0.0, 5.0, 3).select(*genes.columns)) == rows(genes)


def test_narrowing(spark):
    pop, genes = population(spark)
    # Elites (the two best) all near the top of both ranges.
    good = F.col("ordinal") >= 8
    number = F.when(F.col("name") == "x", F.lit(0.85)).when(F.col("name") == "y", F.lit(9.0))
    genes = genes.withColumn("num", F.when(good, number).otherwise(F.col("num"))).withColumn(
        "cat", F.when(good & (F.col("name") == "z"), "c").otherwise(F.col("cat"))
    )
    got = {r.name: r for r in ev.narrow_constraints(pop, genes, SPACE, CONFIG).filter("run_id = 0").collect()}
    assert got["x"].low == pytest.approx(0.675) and got["x"].high == 1.0
    assert (got["y"].low, got["y"].high, got["z"].preferred) == (7.0, 10.0, ["c"])


def test_dedupe_small_domain_keeps_size(spark):
    tiny = sp.Space((sp.Param("z", sp.CATEGORICAL, choices=("a", "b", "c")),))
    rows_ = [(0, 0, i, "z", None, "a") for i in range(5)]
    genes = spark.createDataFrame(rows_, "run_id long, generation int, ordinal long, name string, num double, cat string")
    got = ev.dedupe_genomes(genes, tiny, ps.no_constraints(spark), CONFIG).collect()
    assert len(got) == 5 and {r.cat for r in got} == {"a", "b", "c"}
    assert next(r.cat for r in got if r.ordinal == 0) == "a"


def test_dedupe_uses_every_free_attempt(spark):
    """Few attempts and many clones: as long as an attempt is free, nobody is left with a clash."""
    from dataclasses import replace

    tight = sp.Space((sp.Param("z", sp.DISCRETE, 0.0, 3000.0),))
    rows_ = [(0, 0, i, "z", 5.0, None) for i in range(2000)]
    genes = spark.createDataFrame(rows_, "run_id long, generation int, ordinal long, name string, num double, cat string")
    config = replace(CONFIG, dedupe_retries=2)
    got = ev.dedupe_genomes(genes, tight, ps.no_constraints(spark), config)
    keep = {r.ordinal: r.num for r in got.collect()}
    assert len(keep) == 2000 and keep[0] == 5.0
    assert len(set(keep.values())) > 1200


def test_grid_decodes_large_products(spark):
    big = sp.Space(tuple(sp.Param(f"p{i}", sp.CONTINUOUS, 0.0, 1.0) for i in range(40)))
    wide = e.wide_genomes(sp.grid_candidates(spark, big, 10, 25), big).orderBy("ordinal").collect()
    assert len(wide) == 25 and wide[24].p39 == pytest.approx(4 / 9) and wide[24].p38 == pytest.approx(2 / 9) and wide[24].p0 == 0.0


def test_space_round_trip_and_lookup(spark):
    table = sp.search_space_table(spark)
    assert sp.Space.from_table(table.filter("space_id = 'stress'")) == sp.STRESS_SPACE
    assert sp.validate_space(table).count() == 0 and table.count() == 22
    with pytest.raises(KeyError):
        SPACE.get("w")
    with pytest.raises(ValueError):
        sp.Param("w", sp.CATEGORICAL)


def test_batch_scorer_equals_expression(spark):
    _, genes = population(spark)
    data = spark.range(500).select((F.col("id") / 500.0).alias("v"), (F.col("id") % 2).alias("label"))

    def hits(batch: pd.DataFrame, candidates: pd.DataFrame) -> pd.Series:
        inside = batch["v"].to_numpy()[None, :] >= candidates["x"].to_numpy()[:, None]
        return pd.Series((inside == (batch["label"].to_numpy()[None, :] == 1)).sum(axis=1))

    exact = e.evaluate_candidates(genes, SPACE, e.ThresholdScorer("x", "v", "label"), data)
    python = e.evaluate_candidates(genes, SPACE, e.BatchScorer(("v", "label"), hits), data)
    assert rows(exact) == rows(python)


def test_non_finite_score_is_a_failure(spark):
    _, genes = population(spark)
    scorer = e.ExpressionScorer(lambda: F.when(F.col("y") > 5, float("nan")).otherwise(F.col("x")))
    got = e.evaluate_candidates(genes, SPACE, scorer).collect()
    assert {r.status for r in got} == {"COMPLETED", "FAILED"}
    assert all(r.validation_accuracy == 0.0 for r in got if r.status == "FAILED")


def test_budget_needs_a_limit(spark):
    with pytest.raises(ValueError):
        e.apply_budget(spark.range(1), [], "id")


def test_search_improves_and_is_repeatable(spark):
    scorer = e.ExpressionScorer(lambda: F.col("x") * F.col("y") / 10)
    first = ps.run_search(runs(spark, 2), SPACE, CONFIG, scorer)
    history = first.orderBy("run_id", "generation").collect()
    assert len(history) == 6 and all(r.size == 10 for r in history)
    for a, b in zip(history, history[1:]):
        assert a.run_id != b.run_id or b.best_so_far >= a.best_so_far
        assert a.run_id != b.run_id or b.best_fitness >= a.best_fitness


def test_strategies_cover_their_budget(spark):
    scorer = e.ExpressionScorer(lambda: F.col("x"))
    de = ps.differential_evolution(runs(spark, 2), SPACE, 1, 5, 1, scorer)
    sa = ps.simulated_annealing(runs(spark, 2), SPACE, 1, 3, scorer)
    for frame, count in ((de, 10), (sa, 3)):
        got = frame.orderBy("run_id", "generation").collect()
        assert [r.generation for r in got] == list(range(count)) * 2
        assert all(b.best_so_far >= a.best_so_far for a, b in zip(got, got[1:]) if a.run_id == b.run_id)


def test_parzen_prefers_good_region(spark):
    base = spark.range(200).select(F.lit(0).cast("long").alias("run_id"), F.lit(0).alias("generation"), F.col("id").alias("ordinal"))
    pop = base.withColumn("fitness", -F.abs(F.col("ordinal") / 200.0 - 0.8))
    genes = base.select(*sp.CANDIDATE, F.lit("x").alias("name"), (F.col("ordinal") / 200.0).alias("num"), F.lit(None).cast("string").alias("cat"))
    only = sp.Space((SPACE.get("x"),))
    got = [r.num for r in st.tpe_suggest(pop, genes, only, 20, 3).collect()]
    assert len(got) == 20 and all(0.6 < v <= 1.0 for v in got)


def test_resume_evaluates_nothing_twice(spark):
    pop, genes = population(spark)
    scorer = e.ExpressionScorer(lambda: F.col("x"))
    first = e.resume_evaluation(genes, SPACE, scorer, None, spark.createDataFrame([], "request_key string, genome_key string, fitness double"))
    stored = first.join(sp.genome_keys(genes), sp.CANDIDATE).select(
        F.concat_ws("/", *sp.CANDIDATE).alias("request_key"), "genome_key", "fitness"
    )
    again = e.resume_evaluation(genes, SPACE, scorer, None, stored)
    assert again.filter("source <> 'stored'").count() == 0 and rows(again.drop("source")) == rows(first.drop("source"))


def test_summary_files(spark, tmp_path):
    good = {"completed": 270, "wall_clock_total_s": 100.0, "jobs_per_sec": 46.1, "best_fitness_peak": 0.9}
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "old_summary.json").write_text(json.dumps(good, indent=2))
    (tmp_path / "new_summary.json").write_text(json.dumps({**good, "completed": 300, "metric_schema_version": 2}, indent=2))
    (tmp_path / "bad_summary.json").write_text("{broken")
    (tmp_path / "other.json").write_text(json.dumps(good))
    got = files.read_run_summaries(spark, str(tmp_path)).collect()
    assert {(r.run_id, r.completed, r.metric_schema_version) for r in got} == {("old", "270", None), ("new", "300", 2)}


def test_metrics_file_falls_back_to_best(spark, tmp_path):
    doc = {"run_name": "r", "generations": [{"generation": 0, "best_fitness": 0.5, "avg_fitness": 0.4, "worst_fitness": 0.1, "wall_clock_ms": 3}]}
    (tmp_path / "r.json").write_text(json.dumps(doc, indent=2))
    got = files.read_run_metrics(spark, str(tmp_path)).collect()
    assert [(r.run_name, r.run_file, r.best_so_far) for r in got] == [("r", "r", 0.5)]


def test_batch_scorer_blocks(spark):
    _, genes = population(spark)
    wide, blocks = e.candidate_blocks(e.wide_genomes(genes, SPACE), 7)
    sizes = sorted(r["count"] for r in wide.groupBy("_block").count().collect())
    assert blocks == 5 and sizes == [2, 7, 7, 7, 7]
    data = spark.range(300, numPartitions=6).select((F.col("id") / 300.0).alias("x"), (F.col("id") % 2).alias("ordinal"))

    # Names of data columns may be names of parameters and keys.
    def hits(batch: pd.DataFrame, candidates: pd.DataFrame) -> pd.Series:
        return pd.Series(((batch["x"].to_numpy()[None, :] >= candidates["x"].to_numpy()[:, None]) == (batch["ordinal"].to_numpy() == 1)).sum(axis=1))

    exact = e.evaluate_candidates(genes, SPACE, e.ThresholdScorer("x", "x", "ordinal"), data)
    assert rows(e.evaluate_candidates(genes, SPACE, e.BatchScorer(("x", "ordinal"), hits, 7), data)) == rows(exact)
    none = e.evaluate_candidates(genes, SPACE, e.BatchScorer(("x", "ordinal"), hits, 7), data.filter("x < 0")).collect()
    assert len(none) == 30 and {r.status for r in none} == {"FAILED"}


def guarded(spark, walls, workers, planned, limit=0, expected=0):
    """Outcomes for given clocks and workers per (run, generation)."""
    table = [(run, g, walls[run][g], workers[run][g]) for run in range(len(walls)) for g in range(planned)]
    clock = spark.createDataFrame(table, "run_id long, generation int, wall_clock_ms long, active_workers long")
    config = ev.EvolutionConfig(population_size=4, num_generations=planned, elite_count=1, narrowing=False, seed=5)
    rules = ps.StopRules(limit, expected, lambda results, g: clock.filter(F.col("generation") == g).drop("generation"))
    scorer = e.ExpressionScorer(lambda: F.col("x"))
    found = ps.guarded_search(runs(spark, len(walls)), SPACE, config, scorer, rules=rules)
    done = {r.run_id: r.n for r in found.history.groupBy("run_id").agg(F.count("*").alias("n")).collect()}
    outcomes = {r.run_id: r for r in found.outcomes.collect()}
    assert {run: r.generations_completed for run, r in outcomes.items()} == done
    assert all(r.jobs_submitted == 4 * r.generations_completed and r.jobs_planned == 4 * planned for r in outcomes.values())
    return [(outcomes[run].generations_completed, outcomes[run].stop_reason) for run in range(len(walls))]


def stopped(walls, workers, planned, limit, expected):
    """The rules walked through one run."""
    done = []
    for g in range(planned):
        timed = sorted(w for w in done if w > 0)
        if g and limit and timed and sum(done) + timed[len(timed) // 2] > limit:
            return g, "max_wall_clock_reached"
        done.append(max(walls[g], 0))
        if expected and workers[g] < expected:
            return g + 1, "insufficient_workers"
    return planned, "completed"


def test_stop_rules(spark):
    walls = [[100, 100, 100, 100], [100, 300, 10, 10], [0, 0, 500, 0], [400, 1, 1, 1], [-5, 250, 200, 10], [90, 110, 110, 90]]
    workers = [[4, 4, 4, 4], [4, 4, 4, 4], [4, 4, 4, 4], [1, 4, 4, 4], [4, 4, 3, 1], [4, 4, 4, 2]]
    for limit, expected in ((400, 0), (0, 3), (310, 4)):
        want = [stopped(walls[run], workers[run], 4, limit, expected) for run in range(len(walls))]
        assert guarded(spark, walls, workers, 4, limit, expected) == want
        assert {reason for _, reason in want} > {"completed"} or limit == 310


def test_search_ends_when_no_run_is_left(spark):
    assert guarded(spark, [[10, 10, 10]] * 2, [[0, 9, 9]] * 2, 3, expected=1) == [(1, "insufficient_workers")] * 2


def test_default_genes_in_every_generation(spark):
    config = ev.EvolutionConfig(population_size=6, num_generations=3, narrowing_start=0, seed=5, dataset="digits", epochs=3)
    pop, genes = ps.initialize_population(runs(spark, 2), SPACE, config)
    for _ in range(2):
        pop, genes = ps.evolve(pop.withColumn("fitness", F.col("ordinal") / 10.0), genes, SPACE, config)
        counts = {(r["name"], r["num"], r["cat"]): r["count"] for r in genes.filter("name in ('dataset', 'epochs')").groupBy("name", "num", "cat").count().collect()}
        assert counts == {("dataset", None, "digits"): 12, ("epochs", 3.0, None): 12}
        assert genes.groupBy("run_id", "ordinal").count().filter("count <> 5").isEmpty()
    assert pop.filter("origin = 'elite'").count() == 4


def test_genes_are_moved_before_they_are_sorted(spark):
    # A task that reads few bytes may hold very many genes: nothing is sorted or grouped before the shuffle.
    schema = "run_id long, generation int, ordinal long, name string, num double, cat string"
    genes = spark.createDataFrame(
        [(1, 0, 0, "epochs", 9.0, None), (1, 0, 0, "epochs", 10.0, None), (1, 0, 0, "dataset", None, "x"), (None, 0, 0, "batch_size", None, "64"), (None, 0, 0, "epochs", 2.0, None)],
        schema,
    )
    found = sp.genome_to_config(genes)
    scans = found._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning")
    assert len(scans) == 2 and "Aggregate" not in scans[1] and "Sort" not in scans[1]
    # Of repeated genes the largest as text counts; candidates without a key are one.
    got = {r["run_id"]: (r["config"]["epochs"], r["config"]["batch_size"], r["config"]["dataset"]) for r in found.collect()}
    assert got == {1: (9, 32, "x"), None: (2, 64, "mnist")}
