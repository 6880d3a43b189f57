"""Steps of the other search strategies: differential evolution, annealing and model-based search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.functions import draws
from tunelake.functions.scalars import clamp, half_even
from tunelake.operators.evolution import POPULATION, ranked
from tunelake.operators.scans import slots
from tunelake.operators.space import (
    CANDIDATE,
    CATEGORICAL,
    CONTINUOUS,
    DISCRETE,
    Space,
    clip_category,
    clip_number,
)

GENE = [*CANDIDATE, "name"]


def de_mutant(population: DataFrame, genes: DataFrame, space: Space, weight: float, seed: int) -> DataFrame:
    """Mutant genes ``a + weight x (b - c)`` from three distinct members other than the target.

    Categories take one of the four members' values. The target's own genes come along as
    ``target_num`` and ``target_cat``.
    """
    sizes = population.groupBy(*POPULATION).agg(F.count(F.lit(1)).alias("_n"))
    # At least four members are needed for three distinct donors.
    rows = slots(sizes.filter("_n >= 4"), F.col("_n"), "target")
    key = [F.col("run_id"), F.col("generation"), F.col("target")]
    places = draws.distinct_positions([draws.uniform(seed, f"donor{i}", *key) for i in range(3)], F.col("_n") - 1)
    others = [F.when(p >= F.col("target"), p + 1).otherwise(p) for p in places]
    roles = rows.select(
        *POPULATION, "target", F.posexplode(F.array(*others, F.col("target"))).alias("_role", "ordinal")
    )
    met = roles.join(genes, CANDIDATE)
    role = F.col("_role")
    gathered = met.groupBy(*POPULATION, F.col("target").alias("ordinal"), "name").agg(
        *[F.max(F.when(role == i, F.col("num"))).alias(f"n{i}") for i in range(4)],
        *[F.max(F.when(role == i, F.col("cat"))).alias(f"c{i}") for i in range(4)],
    )
    param = space.of(F.col("name"))
    numeric = param["param_type"] != CATEGORICAL
    pick = draws.uniform(seed, "donor-category", *[F.col(c) for c in GENE])
    donor = F.col("n0") + F.lit(weight) * (F.col("n1") - F.col("n2"))
    chosen = draws.choice(pick, F.array("c0", "c1", "c2", "c3"))
    return gathered.filter(param.isNotNull()).select(
        *GENE,
        F.when(numeric, clip_number(donor, param)).alias("num"),
        F.when(~numeric, clip_category(chosen, param)).alias("cat"),
        F.col("n3").alias("target_num"),
        F.col("c3").alias("target_cat"),
    )


def de_trial(mutants: DataFrame, space: Space, crossover_rate: float, seed: int) -> DataFrame:
    """Binomial crossover of mutant and target with one forced mutant gene, clipped."""
    forced = F.floor(draws.uniform(seed, "forced", *[F.col(c) for c in CANDIDATE]) * len(space.params))
    param = space.of(F.col("name"))
    take = (param["position"] == forced) | (
        draws.uniform(seed, "cross", *[F.col(c) for c in GENE]) < F.lit(crossover_rate)
    )
    numeric = param["param_type"] != CATEGORICAL
    number = F.when(take, F.col("num")).otherwise(F.col("target_num"))
    category = F.when(take, F.col("cat")).otherwise(F.col("target_cat"))
    return mutants.select(
        *GENE,
        F.when(numeric, clip_number(number, param)).alias("num"),
        F.when(~numeric, clip_category(category, param)).alias("cat"),
    )


def de_replace(population: DataFrame, trial_results: DataFrame) -> DataFrame:
    """Trials replace targets of equal or lower fitness; ``replaced`` marks them."""
    trials = trial_results.select(*CANDIDATE, F.col("validation_accuracy").alias("_trial"))
    better = F.col("_trial").isNotNull() & (F.col("_trial") >= F.col("fitness"))
    return (
        population.join(trials, CANDIDATE, "left")
        .withColumn("replaced", better)
        .withColumn("fitness", F.when(better, F.col("_trial")).otherwise(F.col("fitness")))
        .drop("_trial")
    )


def temperature(step: Column, initial: float, cooling: float, minimum: float) -> Column:
    """Annealing temperature after ``step`` coolings."""
    return F.greatest(F.lit(float(minimum)), F.lit(float(max(initial, minimum))) * F.pow(F.lit(float(cooling)), step))


def sa_neighbor(genes: DataFrame, space: Space, temp: Column, scale: float, seed: int, step: Column | None = None) -> DataFrame:
    """Change one random parameter of each chain; the step shrinks with the temperature."""
    key = [F.col(c) for c in CANDIDATE] + ([] if step is None else [step])
    drawn = lambda purpose: draws.uniform(seed, purpose, *key)
    param = space.of(F.col("name"))
    chosen = param["position"] == F.floor(drawn("which") * len(space.params))
    heat = F.greatest(temp, F.lit(0.05))
    sigma = F.greatest((param["high"] - param["low"]) * F.lit(scale) * heat, F.lit(1e-12))
    smooth = F.col("num") + draws.normal(drawn("move-1"), drawn("move-2")) * sigma
    span = F.floor(param["high"] - param["low"])
    reach = F.greatest(F.lit(1.0), half_even(F.greatest(span, F.lit(1)) * F.lit(scale) * heat))
    hop = draws.integer(drawn("move-1"), -reach, reach)
    hop = F.when(hop == 0, F.when(drawn("move-2") < 0.5, 1).otherwise(-1)).otherwise(hop)
    moved = F.when(param["param_type"] == CONTINUOUS, smooth).otherwise(F.col("num") + hop)
    others = F.filter(param["choices"], lambda c: c != F.col("cat"))
    switched = F.when(F.size(others) > 0, draws.choice(drawn("move-1"), others)).otherwise(F.col("cat"))
    numeric = param["param_type"] != CATEGORICAL
    return genes.withColumn("_chosen", F.coalesce(chosen, F.lit(False))).select(
        *GENE,
        F.when(F.col("_chosen") & numeric, clip_number(moved, param)).otherwise(F.col("num")).alias("num"),
        F.when(F.col("_chosen") & ~numeric, switched).otherwise(F.col("cat")).alias("cat"),
    )


def sa_accept(chains: DataFrame, temp: Column, seed: int, step: Column | None = None) -> DataFrame:
    """Metropolis rule on ``fitness`` and ``candidate_fitness``; the best is kept on strict gain only."""
    key = [F.col(c) for c in CANDIDATE] + ([] if step is None else [step])
    delta = F.col("candidate_fitness") - F.col("fitness")
    chance = F.when(delta < 0, F.exp(delta / F.greatest(temp, F.lit(1e-9)))).otherwise(1.0)
    accepted = (delta >= 0) | (draws.uniform(seed, "accept", *key) < chance)
    return (
        chains.withColumn("accepted", accepted)
        .withColumn("best_fitness", F.greatest("best_fitness", "candidate_fitness"))
        .withColumn("improved", F.col("candidate_fitness") > F.col("best_before"))
        .withColumn("fitness", F.when(F.col("accepted"), F.col("candidate_fitness")).otherwise(F.col("fitness")))
    )


def tpe_suggest(
    population: DataFrame,
    genes: DataFrame,
    space: Space,
    suggestions: int,
    seed: int,
    good_share: float = 0.25,
    pool: int = 24,
    bins: int = 64,
) -> DataFrame:
    """Next candidates of a tree-structured Parzen search, a batch for every run at once.

    The history is split into its best share and the rest. Each parameter gets two densities,
    Parzen estimates on a fixed number of bins over its (log) range for numbers and smoothed
    frequencies for categories. Pool values are drawn from the good density and the value with
    the highest ratio of good to bad density wins, parameter by parameter. The history is only
    counted per bin, so no candidate meets an observation.
    """
    sizes = population.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"))
    flat = population.select("run_id", "ordinal", "generation", "fitness").withColumn(
        "_tie", F.col("generation").cast("long") * (1 << 32) + F.col("ordinal")
    )
    cut = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("_n") * F.lit(good_share)).cast("long"))
    split = (
        ranked(flat, ["run_id"], [-F.col("fitness")], "_tie", "_rank")
        .join(sizes, "run_id")
        .select("run_id", "generation", "ordinal", (F.col("_rank") <= cut).alias("good"))
    )
    param = space.of(F.col("name"))
    scaled = lambda v: F.when(param["log_scale"], F.log(F.greatest(v, F.lit(1e-12)))).otherwise(v)
    low, high = scaled(param["low"]), scaled(param["high"])
    unit = clamp((scaled(F.col("num")) - low) / F.greatest(high - low, F.lit(1e-12)), F.lit(0.0), F.lit(1.0))
    is_text = param["param_type"] == CATEGORICAL
    width = F.when(is_text, F.size(param["choices"])).otherwise(F.lit(bins))
    bin_of = F.when(is_text, F.array_position(param["choices"], F.col("cat")) - 1).otherwise(
        F.least(F.floor(unit * bins), F.lit(bins - 1))
    )
    counts = (
        genes.join(split, CANDIDATE)
        .filter(param.isNotNull())
        .groupBy("run_id", "name", width.cast("int").alias("width"), bin_of.cast("int").alias("bin"))
        .agg(F.count_if("good").alias("good_rows"), F.count_if(~F.col("good")).alias("bad_rows"))
        .filter("bin >= 0")
    )
    # At most `bins` (or the number of choices) entries per run and parameter.
    held = counts.groupBy("run_id", "name", "width").agg(
        F.collect_list(F.struct("bin", "good_rows", "bad_rows")).alias("cells"),
        F.sum("good_rows").alias("good_total"),
        F.sum("bad_rows").alias("bad_total"),
    )
    text_param = space.of(F.col("name"))["param_type"] == CATEGORICAL
    bandwidth = F.greatest(F.lit(1.0), F.col("width") * F.lit(1.06) / F.pow(F.col("good_total") + 1, F.lit(0.2)) * 0.25)

    def density(rows: str, total_rows: str) -> Column:
        def at(place: Column) -> Column:
            def kernel(cell: Column) -> Column:
                distance = (cell["bin"] - place) / F.col("_h")
                near = F.exp(F.lit(-0.5) * distance * distance) / (F.col("_h") * F.lit(2.5066282746310002))
                same = F.when(cell["bin"] == place, 1.0).otherwise(0.0)
                return cell[rows] * F.when(F.col("_text"), same).otherwise(near)

            mass = F.aggregate("cells", F.lit(0.0), lambda acc, cell: acc + kernel(cell))
            # One pseudo-observation spread evenly is the prior.
            return (mass + F.lit(1.0) / F.col("width")) / (F.col(total_rows) + 1)

        return F.transform(F.sequence(F.lit(0), F.col("width") - 1), at)

    modeled = (
        held.withColumn("_h", bandwidth)
        .withColumn("_text", text_param)
        .withColumn("good_density", density("good_rows", "good_total"))
        .withColumn("bad_density", density("bad_rows", "bad_total"))
        .withColumn("_mass", F.aggregate("good_density", F.lit(0.0), lambda acc, d: acc + d))
        .select("run_id", "name", "good_density", "bad_density", "_mass")
    )
    wanted = slots(sizes.withColumn("generation", F.lit(0)), F.lit(suggestions), "ordinal")
    drawn = wanted.select("run_id", "ordinal", space.expand().alias("p")).select(
        "run_id", "ordinal", F.col("p.name").alias("name")
    ).join(modeled, ["run_id", "name"])
    key = [F.col("run_id"), F.col("ordinal"), F.col("name")]

    def pick(draw: Column) -> Column:
        """First bin whose cumulative good density passes the draw."""
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("bin"))
        walked = F.aggregate(
            "good_density",
            start,
            lambda acc, d: F.struct(
                (acc["sum"] + d).alias("sum"),
                F.when(acc["sum"] + d <= draw * F.col("_mass"), acc["bin"] + 1).otherwise(acc["bin"]).alias("bin"),
            ),
        )["bin"]
        return F.least(walked, F.size("good_density") - 1)

    tries = drawn.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(pool - 1)))).withColumn(
        "bin", pick(draws.uniform(seed, "tpe", *key, F.col("turn")))
    )
    gain = F.get("good_density", F.col("bin")) / F.get("bad_density", F.col("bin"))
    best = tries.groupBy("run_id", "ordinal", "name").agg(
        F.max_by("bin", F.struct(gain.alias("g"), -F.col("turn"))).alias("bin")
    )
    inside = (F.col("bin") + draws.uniform(seed, "tpe-inside", *key)) / F.lit(float(bins))
    spot = low + inside * (high - low)
    number = F.when(param["log_scale"], F.exp(spot)).otherwise(spot)
    return best.select(
        "run_id",
        F.lit(0).alias("generation"),
        "ordinal",
        "name",
        F.when(~is_text, clip_number(number, param)).alias("num"),
        F.when(is_text, F.get(param["choices"], F.col("bin"))).alias("cat"),
    )
