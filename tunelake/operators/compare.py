"""Strategy benchmark summaries and comparison series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.functions.scalars import clamp, nearly_equal, ratio
from tunelake.operators.runs import observed_completed, observed_throughput, total_elapsed
from tunelake.operators.scans import number_block, order_statistics, peak, ranked, running, total
from tunelake.session import cut_lineage

# Names of the strategies as they appear in stored runs, with their keys.
RUN_NAME_TO_KEY = {
    "Bayesian (Optuna TPE)": "optuna_tpe",
    "Random Search": "random_search",
    "Grid Search": "grid_search",
    "Differential Evolution": "differential_evolution",
    "Simulated Annealing": "simulated_annealing",
}
# Order of the series in comparisons; the reference run comes first.
DISPLAY_ORDER = [
    "reference",
    "optuna_tpe",
    "random_search",
    "grid_search",
    "differential_evolution",
    "simulated_annealing",
]
# Comparison axes as (axis, column, normalisation, unit factor).
RADAR_AXES = [
    ("Peak Fitness", "peak_fitness", "clip01", 1.0),
    ("Time to 90% Peak (min)", "time_to_90_peak_s", "max_ratio", 1.0 / 60.0),
    ("Total Run Time (min)", "total_runtime_s", "max_ratio", 1.0 / 60.0),
    ("Total Evals Completed", "total_evals", "max_ratio", 1.0),
    ("Convergence AUC", "convergence_auc", "clip01", 1.0),
]
SERIES_COLUMNS = [
    "key",
    "total_runtime_s",
    "total_evals",
    "peak_fitness",
    "throughput_jobs_per_s",
    "time_to_90_peak_s",
    "convergence_auc",
    "source",
]


def seed_summary(metrics: DataFrame) -> DataFrame:
    """Evaluations, peak, final best and seconds per (strategy, seed)."""
    best = F.coalesce(F.col("best_so_far"), F.col("best_fitness")) if "best_so_far" in metrics.columns else F.col("best_fitness")
    return metrics.groupBy("run_name", "seed").agg(
        F.count(F.lit(1)).alias("evals_completed"),
        F.max(best).alias("best_fitness_peak"),
        F.max_by("best_fitness", "generation").alias("final_best_fitness"),
        (F.sum("wall_clock_ms") / F.lit(1000.0)).alias("wall_clock_s"),
    )


def strategy_summary(seeds: DataFrame) -> DataFrame:
    """Mean and median (middle pair averaged) of peak, evaluations and seconds per strategy."""
    measures = {"best_fitness_peak": "best_fitness_peak", "evals_completed": "evals_completed", "wall_clock_s": "wall_clock_s"}
    pairs = ", ".join(f"'{m}', CAST({c} AS DOUBLE)" for m, c in measures.items())
    long = seeds.selectExpr("run_name", f"stack({len(measures)}, {pairs}) AS (measure, value)")
    middles = order_statistics(
        long,
        ["run_name", "measure"],
        "value",
        {"low": lambda n: F.floor((n + 1) / 2).cast("long"), "high": lambda n: F.floor(n / 2).cast("long") + 1},
    ).withColumn("median", (F.col("low") + F.col("high")) / F.lit(2.0))
    medians = middles.groupBy("run_name").agg(
        *[F.max(F.when(F.col("measure") == m, F.col("median"))).alias(f"median_{m}") for m in measures]
    )
    means = seeds.groupBy("run_name").agg(*[F.avg(c).alias(f"mean_{m}") for m, c in measures.items()])
    return means.join(medians, "run_name")


def rank_strategies(strategies: DataFrame) -> DataFrame:
    """Rank by median peak, then median evaluations, then mean peak; ties by the bytes of the strategy name.

    Names are compared by their first 24 bytes as numbers, then by a hash.
    """
    named = strategies.withColumn("_name_order", F.conv(F.substring(F.md5("run_name"), 1, 13), 16, 10).cast("long"))
    letters = [F.rpad(F.hex(F.substring(F.encode("run_name", "UTF-8"), 6 * n + 1, 6)), 12, "0") for n in range(4)]
    order = [
        -F.col("median_best_fitness_peak"),
        -F.col("median_evals_completed"),
        -F.col("mean_best_fitness_peak"),
        *[F.conv(part, 16, 10).cast("double") for part in letters],
    ]
    return ranked(named, [], order, "_name_order", "rank").drop("_name_order")


def reference_row(ranking: DataFrame, summary: DataFrame) -> DataFrame:
    """Append the unranked reference run with its observed and modeled rates."""
    rate = observed_throughput(F.col("completed"), F.col("wall_clock_total_s"))
    reference = summary.select(
        F.col("name").alias("run_name"),
        F.lit(True).alias("reference_only"),
        F.coalesce("best_fitness_peak", F.lit(0.0)).alias("best_peak"),
        total_elapsed(F.col("wall_clock_total_s")).alias("wall_clock_total_s"),
        F.when(rate.isNotNull(), observed_completed(F.col("completed"))).cast("long").alias("completed"),
        rate.alias("observed_jobs_per_sec"),
        F.col("modeled_jobs_per_sec"),
    )
    local = ranking.select(
        "run_name",
        F.lit(False).alias("reference_only"),
        F.col("median_best_fitness_peak").alias("best_peak"),
        "rank",
    )
    return local.unionByName(reference, allowMissingColumns=True)


def per_seed_listing(seeds: DataFrame, ranking: DataFrame) -> DataFrame:
    """Seed rows under their strategy's rank, in rank and seed order."""
    return seeds.join(ranking.select("run_name", "rank"), "run_name").orderBy("rank", "seed")


def progress_bins(metrics: DataFrame, keys: Sequence[str], bins: int = 12) -> DataFrame:
    """Best value and runtime at equal shares of each run's time.

    Bin i belongs to the first generation whose cumulative time reaches i / bins of the total.
    Each generation emits the bins it is first to reach, so nothing is joined to the bins. A run
    without time repeats its last best.
    """
    if bins <= 0:
        raise ValueError("bins must be > 0")
    keys = list(keys)
    best = F.coalesce(F.col("best_so_far"), F.col("best_fitness")) if "best_so_far" in metrics.columns else F.col("best_fitness")
    steps = metrics.select(
        *keys,
        "generation",
        F.greatest(F.lit(0).cast("long"), F.col("wall_clock_ms")).alias("step_ms"),
        best.alias("step_best"),
    )
    totals = steps.groupBy(*keys).agg(F.sum("step_ms").alias("total_ms"), F.max("generation").alias("_last"))
    scanned = running(
        steps,
        keys,
        ["generation"],
        number_block(F.col("generation"), 4096),
        {"cum_ms": total(F.col("step_ms")), "best": peak(F.greatest(F.col("step_best"), F.lit(0.0)))},
    ).join(totals, keys)
    exact = lambda at: F.expr(f"({at} * {bins}) DIV greatest(total_ms, 1)")
    timed = F.col("total_ms") > 0
    low = F.when(timed, exact("(cum_ms - step_ms)") + 1).otherwise(F.lit(1).cast("long"))
    high = F.when(timed, exact("cum_ms")).otherwise(
        F.when(F.col("generation") == F.col("_last"), F.lit(bins)).otherwise(0).cast("long")
    )
    emitted = scanned.withColumn("_low", low).withColumn("_high", high).filter("_low <= _high")
    return emitted.select(
        *keys,
        F.explode(F.sequence(F.col("_low").cast("int"), F.col("_high").cast("int"))).alias("bin"),
        "best",
        F.when(timed, F.col("cum_ms") / F.lit(1000.0)).otherwise(0.0).alias("runtime_s"),
        (F.col("total_ms") / F.lit(1000.0)).alias("total_s"),
    )


def convergence_auc(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trapezoid area under the best curve over [0, 1], the first bin standing for the start as well."""
    return bins.groupBy(*keys).agg(
        (
            (F.sum("best") + (F.min_by("best", "bin") - F.max_by("best", "bin")) / F.lit(2.0)) / F.count(F.lit(1))
        ).alias("convergence_auc")
    )


def _curve(keys: Sequence[str], bins: DataFrame, *extra: Column) -> DataFrame:
    """Each series as one bounded array of bins."""
    return bins.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("bin", "best", "runtime_s"))).alias("curve"), *extra
    )


def _first_reach(curve: Column, total_s: Column, fraction: float) -> Column:
    target = F.array_max(F.transform(curve, lambda b: b["best"])) * F.lit(float(fraction))
    hits = F.filter(curve, lambda b: b["best"] >= target)
    return F.coalesce(F.get(hits, 0)["runtime_s"], total_s)


def _area(curve: Column) -> Column:
    total_best = F.aggregate(curve, F.lit(0.0), lambda acc, b: acc + b["best"])
    ends = (F.element_at(curve, 1)["best"] - F.element_at(curve, -1)["best"]) / F.lit(2.0)
    return (total_best + ends) / F.size(curve)


def time_to_fraction(bins: DataFrame, keys: Sequence[str], fraction: float = 0.9) -> DataFrame:
    """Runtime of the first bin whose best reaches a share of the series' peak."""
    curves = _curve(keys, bins, F.max("total_s").alias("total_s"))
    return curves.select(
        *keys, _first_reach(F.col("curve"), F.col("total_s"), fraction).alias("time_to_fraction_s")
    )


def run_series(
    metrics: DataFrame, keys: Sequence[str], bins: int = 12, reported: DataFrame | None = None
) -> DataFrame:
    """One series row per run: its curve, runtime, rate, area, time to 90 percent and peak.

    ``reported`` may give ``reported_runtime_s``, ``reported_evals``, ``reported_peak`` and
    ``reported_rate`` per key; the bins are then rescaled to the reported runtime.
    """
    keys = list(keys)
    counted = metrics.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("_evals"))
    series = _curve(keys, progress_bins(metrics, keys, bins), F.max("total_s").alias("_observed")).join(counted, keys)
    names = ["reported_runtime_s", "reported_evals", "reported_peak", "reported_rate"]
    if reported is None:
        for name in names:
            series = series.withColumn(name, F.lit(None).cast("double"))
    else:
        series = series.join(reported.select(*keys, *names), keys)
    observed = F.col("_observed")
    shaped = series.withColumn("total_runtime_s", F.coalesce("reported_runtime_s", observed)).withColumn(
        "total_evals", F.coalesce("reported_evals", "_evals")
    )
    runtime = F.col("total_runtime_s")
    rescale = (observed > 0) & (runtime > 0) & ~nearly_equal(observed, runtime)
    factor = F.when(rescale, runtime / observed).otherwise(F.lit(1.0))
    shaped = shaped.withColumn("_factor", factor).withColumn(
        "curve",
        F.transform(
            "curve",
            lambda b: F.struct(b["bin"].alias("bin"), b["best"].alias("best"), (b["runtime_s"] * F.col("_factor")).alias("runtime_s")),
        ),
    )
    return shaped.select(
        *keys,
        "curve",
        "total_runtime_s",
        "total_evals",
        F.coalesce("reported_peak", F.element_at("curve", -1)["best"]).alias("peak_fitness"),
        F.coalesce("reported_rate", ratio(F.col("total_evals"), runtime)).alias("throughput_jobs_per_s"),
        _first_reach(F.col("curve"), runtime, 0.9).alias("time_to_90_peak_s"),
        _area(F.col("curve")).alias("convergence_auc"),
    )


def normalize_run_names(runs: DataFrame) -> DataFrame:
    """Key of each known strategy name; other names get null."""
    pairs = [F.lit(text) for item in RUN_NAME_TO_KEY.items() for text in item]
    return runs.withColumn("key", F.try_element_at(F.create_map(*pairs), F.col("run_name")))


def missing_strategies(runs: DataFrame) -> DataFrame:
    """Strategy keys without any run."""
    wanted = runs.sparkSession.createDataFrame([(k,) for k in DISPLAY_ORDER if k != "reference"], "key string")
    return wanted.join(normalize_run_names(runs).select("key").distinct(), "key", "left_anti")


def seed_aggregate_series(metrics: DataFrame, bins: int = 12, require_all: bool = True) -> DataFrame:
    """One series per strategy: fitness averaged over its seeds, runtime and evaluations summed."""
    if require_all:
        missing = sorted(row.key for row in missing_strategies(metrics.select("run_name").distinct()).collect())
        if missing:
            raise ValueError(f"no runs for strategies: {missing}")
    runs = cut_lineage(run_series(normalize_run_names(metrics).filter("key IS NOT NULL"), ["key", "seed"], bins))
    per_bin = runs.select("key", F.explode("curve").alias("b")).groupBy("key", F.col("b.bin").alias("bin")).agg(
        F.avg("b.best").alias("best"), F.sum("b.runtime_s").alias("runtime_s")
    )
    curves = _curve(["key"], per_bin)
    sums = runs.groupBy("key").agg(
        F.sum("total_runtime_s").alias("total_runtime_s"),
        F.sum("total_evals").alias("total_evals"),
        F.avg("peak_fitness").alias("peak_fitness"),
        F.avg("convergence_auc").alias("convergence_auc"),
        F.count(F.lit(1)).alias("_seeds"),
    )
    return curves.join(sums, "key").select(
        "key",
        "curve",
        "total_runtime_s",
        "total_evals",
        "peak_fitness",
        ratio(F.col("total_evals"), F.col("total_runtime_s")).alias("throughput_jobs_per_s"),
        _first_reach(F.col("curve"), F.col("total_runtime_s"), 0.9).alias("time_to_90_peak_s"),
        "convergence_auc",
        # Fixed value: the source label of aggregated series.
        F.concat(F.lit("local_aggregate_"), F.col("_seeds"), F.lit("_seeds")).alias("source"),
    )


def reference_series(metrics: DataFrame, summary: DataFrame, keys: Sequence[str], bins: int = 12) -> DataFrame:
    """Series of reference runs on their observed completions and total clock; others are dropped."""
    known = summary.withColumn("_evals", observed_completed(F.col("completed"))).withColumn(
        "_clock", total_elapsed(F.col("wall_clock_total_s"))
    ).filter("_evals IS NOT NULL AND _clock IS NOT NULL")
    reported = known.select(
        *keys,
        F.col("_clock").alias("reported_runtime_s"),
        F.col("_evals").alias("reported_evals"),
        F.coalesce("best_fitness_peak", F.lit(0.0)).alias("reported_peak"),
        (F.col("_evals") / F.col("_clock")).alias("reported_rate"),
    )
    return run_series(metrics, keys, bins, reported)


def comparison_series(reference: DataFrame, strategies: DataFrame) -> DataFrame:
    """Reference series and strategy series with their display position."""
    pairs = [item for i, key in enumerate(DISPLAY_ORDER) for item in (F.lit(key), F.lit(i))]
    first = reference.withColumn("key", F.lit("reference")).withColumn("source", F.lit("single_run"))
    columns = [*SERIES_COLUMNS, "curve"]
    merged = first.select(*columns).unionByName(strategies.select(*columns))
    return merged.withColumn("display_order", F.try_element_at(F.create_map(*pairs), F.col("key"))).filter(
        "display_order IS NOT NULL"
    )


def radar_metrics(series: DataFrame, keys: Sequence[str] = (), axes: Sequence[tuple] = tuple(RADAR_AXES)) -> DataFrame:
    """Raw and normalised value of every axis for every series of a comparison.

    Normalisations: ``clip01``, ``max_ratio`` (share of the largest) and ``inverse_min_ratio``
    (smallest positive over value).
    """
    keys = list(keys)
    rows = ", ".join(f"'{axis}', '{mode}', CAST({field} AS DOUBLE) * {unit!r}D" for axis, field, mode, unit in axes)
    long = series.selectExpr(*keys, "key", f"stack({len(axes)}, {rows}) AS (axis, mode, raw_value)")
    limits = long.groupBy(*keys, "axis").agg(
        F.max("raw_value").alias("_max"), F.min(F.when(F.col("raw_value") > 0, F.col("raw_value"))).alias("_min")
    )
    raw = F.col("raw_value")
    normal = (
        F.when(F.col("mode") == "clip01", clamp(raw, F.lit(0.0), F.lit(1.0)))
        .when(F.col("mode") == "max_ratio", ratio(raw, F.col("_max")))
        .otherwise(F.when(raw > 0, F.col("_min") / raw).otherwise(0.0))
    )
    return long.join(limits, [*keys, "axis"]).withColumn("normalized", normal).drop("_max", "_min", "mode")
