"""Known numbers for telemetry, run analytics, comparison and tuning."""

import pytest
from pyspark.sql import functions as F

from tunelake.operators import compare, runs, telemetry, tuning


def one(frame):
    rows = frame.collect()
    assert len(rows) == 1
    return rows[0]


def results(spark, times, workers):
    rows = [(1, 0, f"j{i}", w, 0.5, 0.1, t, "COMPLETED") for i, (t, w) in enumerate(zip(times, workers))]
    return spark.createDataFrame(
        rows,
        "run_id long, generation_id int, job_id string, worker_id string, validation_accuracy double, "
        "training_loss double, training_time_ms long, status string",
    )


def clock(spark, ms):
    return spark.createDataFrame([(1, 0, ms)], "run_id long, generation_id int, wall_clock_ms long")


def test_generation_kpi(spark):
    k = one(telemetry.generation_kpi(results(spark, [100, 200, 300, 400, 500], [f"w{i}" for i in range(5)]), clock(spark, 450)))
    assert (k.train_total_ms, k.train_p50_ms, k.train_p90_ms, k.ideal_wall_ms, k.queue_overhead_ms) == (1500, 300, 500, 300.0, 150.0)
    assert k.queue_overhead_pct == pytest.approx(150 / 450) and k.gen_jobs_per_sec == pytest.approx(5 / 0.45)


def test_overhead_never_negative(spark):
    k = one(telemetry.generation_kpi(results(spark, [100, 300], ["w0", "w1"]), clock(spark, 150)))
    assert (k.ideal_wall_ms, k.queue_overhead_ms) == (200.0, 0.0)


@pytest.mark.parametrize(
    "samples, expected", [([1, 5, 3, 9, 2], (3, 9, 9, 5, 1)), ([15, 1, 8, 6], (8, 15, 15, 4, 1)), ([-4.0], (0, 0, 0, 1, 0))]
)
def test_runtime_summary(spark, samples, expected):
    rows = spark.createDataFrame(
        [(1, 0, "queue_wait", float(x)) for x in samples], "run_id long, generation_id int, family string, sample_ms double"
    )
    r = one(telemetry.runtime_summary(rows))
    assert (r.queue_wait_p50_ms, r.queue_wait_p90_ms, r.queue_wait_max_ms, r.queue_wait_samples, r.queue_wait_min_ms) == expected
    assert r.dispatch_latency_samples == 0 and r.dispatch_latency_p50_ms == 0.0


def test_dispatch_order_takes_heavy_jobs_first(spark):
    rows = [(1, 0, ([8, 16, 16], [32], 1, 256)), (1, 1, ([32, 64, 64], [128], 2, 32))]
    jobs = spark.createDataFrame(
        rows, "g long, seq long, config struct<conv_filters: array<int>, dense_units: array<int>, epochs: int, batch_size: int>"
    )
    assert {r.seq: r.dispatch_rank for r in telemetry.dispatch_order(jobs, ["g"]).collect()} == {1: 1, 0: 2}


def metrics(spark, best, wall=None):
    wall = wall or [1] * len(best)
    return spark.createDataFrame(
        [(1, g, float(b), w) for g, (b, w) in enumerate(zip(best, wall))],
        "run_id long, generation int, best_fitness double, wall_clock_ms long",
    )


def test_convergence_rate(spark):
    assert one(runs.run_totals(metrics(spark, [0.5, 0.7, 0.9]))).convergence_rate == pytest.approx(0.2)
    assert one(runs.run_totals(metrics(spark, [0.5]))).convergence_rate == 0.0


def plateau_loop(best, planned, patience, delta, any_best, reheat):
    peak, stale, remaining, out = None, 0, 0, []
    for g, b in enumerate(best):
        fresh = peak is None or b > peak + delta or (any_best and b > peak)
        stale = 0 if fresh else stale + 1
        peak = b if peak is None else max(peak, b)
        trigger = stale >= patience and reheat > 0 and g < planned - 1
        if trigger:
            remaining, stale = max(remaining, reheat), 0
        hot = g < planned - 1 and remaining > 0
        remaining -= hot
        out.append((trigger, stale, hot))
    return out


@pytest.mark.parametrize(
    "best, patience, delta, any_best, reheat",
    [
        ([0.801] * 6, 3, 0.01, False, 2),
        ([0.8, 0.8005, 0.8008, 0.801], 1, 0.01, True, 2),
        ([0.5, 0.5, 0.6, 0.6, 0.6, 0.6, 0.7, 0.7], 2, 0.0, True, 3),
        ([0.5, 0.5, 0.5, 0.5], 0, 0.0, True, 1),
        ([0.5, 0.5, 0.5, 0.5], 2, 0.0, True, 0),
    ],
)
def test_plateau_and_reheat(spark, best, patience, delta, any_best, reheat):
    n = len(best)
    events = runs.plateau_events(metrics(spark, best), n, patience, delta, any_best, reheat)
    got = runs.reheat_schedule(events, n, reheat).orderBy("generation").collect()
    assert [(r.triggered, r.stale_generations, r.reheat) for r in got] == plateau_loop(best, n, patience, delta, any_best, reheat)


def test_wall_clock_guard_matches_loop(spark):
    import random

    rng = random.Random(5)
    rows, want = [], {}
    for run in range(30):
        walls = [rng.choice([0, 5, 10, rng.randrange(1, 60)]) for _ in range(12)]
        rows += [(run, g, w) for g, w in enumerate(walls)]
        for g in range(1, 12):
            prior = sorted(w for w in walls[:g] if w > 0)
            if prior and sum(walls[:g]) + prior[len(prior) // 2] > 120:
                want[run] = g
                break
    frame = spark.createDataFrame(rows, "run_id long, generation int, wall_clock_ms long")
    got = runs.wall_clock_guard(frame, 120).collect()
    assert {r.run_id: r.stop_generation for r in got} == want and want


def test_throughput_formulas(spark):
    row = one(
        spark.range(1).select(
            *[c.alias(n) for n, c in runs.wall_adjusted_throughput(F.lit(3.786), F.lit(6), 150.0).items()],
            runs.modeled_throughput(F.lit(631.0), F.lit(8), 150.0)["modeled_jobs_per_sec"].alias("modeled"),
            runs.metric_clock(F.lit("first_dispatch"), F.lit(10.0), F.lit(1.0), F.lit(123.0))["first_dispatch_offset_s"].alias("offset"),
        )
    )
    assert row.avg_job_ms_raw == pytest.approx(631) and row.avg_job_ms_adjusted == pytest.approx(481)
    assert row.jobs_per_sec_wall_adjusted == pytest.approx(6 / (3.786 - 0.9))
    assert row.modeled == pytest.approx(8000 / 481) and row.offset == pytest.approx(1.123)


@pytest.mark.parametrize(
    "completed, clock_s, expected",
    [("270", "100", 2.7), ("300", "100", 3.0), ("NaN", "100", None), ("-1", "100", None), (None, "100", None),
     ("5", "0", None), ("true", "100", None), ("1.5", "100", None), ("5", "inf", None)],
)
def test_observed_throughput(spark, completed, clock_s, expected):
    row = one(spark.range(1).select(runs.observed_throughput(F.lit(completed), F.lit(clock_s)).alias("r")))
    assert row.r == (pytest.approx(expected) if expected is not None else None)


def test_rank_strategies(spark):
    rows = [("A", 1, 0, 0.8, 1), ("A", 2, 0, 0.82, 1), ("B", 1, 0, 0.65, 1), ("B", 2, 0, 0.66, 1)]
    frame = spark.createDataFrame(rows, "run_name string, seed int, generation int, best_fitness double, wall_clock_ms long")
    got = compare.rank_strategies(compare.strategy_summary(compare.seed_summary(frame))).collect()
    assert {r.run_name: r["rank"] for r in got} == {"A": 1, "B": 2}
    assert {r.run_name: r.median_best_fitness_peak for r in got} == {"A": pytest.approx(0.81), "B": pytest.approx(0.655)}


def test_progress_bins(spark):
    bins = compare.progress_bins(metrics(spark, [0.1, 0.3, 0.2, 0.4], [1000, 2000, 1000, 1000]), ["run_id"], 6)
    got = bins.orderBy("bin").collect()
    assert [r.bin for r in got] == [1, 2, 3, 4, 5, 6] and got[-1].total_s == 5.0
    assert [r.runtime_s for r in got] == [1.0, 3.0, 3.0, 4.0, 5.0, 5.0]
    assert [r.best for r in got] == [0.1, 0.3, 0.3, 0.3, 0.4, 0.4]
    flat = compare.progress_bins(metrics(spark, [0.1, 0.3], [0, 0]), ["run_id"], 3).orderBy("bin").collect()
    assert [(r.bin, r.best, r.runtime_s) for r in flat] == [(1, 0.3, 0.0), (2, 0.3, 0.0), (3, 0.3, 0.0)]


def test_time_to_fraction(spark):
    rows = [(1, i + 1, b, 10.0 * (i + 1), 55.0) for i, b in enumerate([0.2, 0.5, 0.7, 0.9])]
    frame = spark.createDataFrame(rows, "k int, bin int, best double, runtime_s double, total_s double")
    assert one(compare.time_to_fraction(frame, ["k"])).time_to_fraction_s == 40.0


def test_missing_strategies_raise(spark):
    frame = metrics(spark, [0.1]).withColumn("run_name", F.lit("Random Search")).withColumn("seed", F.lit(1))
    with pytest.raises(ValueError):
        compare.seed_aggregate_series(frame, 3)


def test_best_candidate_prefers_feasible_runs(spark):
    rows = [(1, "sweep_x", 1, 9.0, 0.5), (2, "sweep_x", 2, 5.0, 0.0), (3, "sweep_x", 3, 5.0, 0.1)]
    frame = spark.createDataFrame(rows, "run_seq long, stage string, knob_value int, jobs_per_sec double, failure_rate double")
    assert one(tuning.sweep_winners(frame)).winning_value == 2


def test_repeatability_uses_population_deviation(spark):
    frame = spark.createDataFrame([(1, 1.0), (1, 3.0)], "k int, jobs_per_sec double")
    r = one(tuning.repeatability(frame, ["k"]))
    assert r.std_rate == 1.0 and r.cv == 0.5 and not r.passed
