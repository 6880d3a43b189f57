"""Selection, crossover, mutation, narrowing and de-duplication, for many runs at once.

A population is ``(run_id, generation, ordinal, fitness)`` with ordinals 0 .. n-1; its genes are
a long table. Draws are keyed by run, generation and slot, so results do not depend on the
partitioning. Joins use candidate-level keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.functions import draws
from tunelake.functions.scalars import clamp, half_even
from tunelake.operators.scans import order_statistics, ranked, slots, top_rows
from tunelake.operators.space import (
    CANDIDATE,
    CATEGORICAL,
    CONTINUOUS,
    DISCRETE,
    Space,
    clip_category,
    clip_number,
    constraint_map,
    genome_keys,
    random_genes,
)
from tunelake.session import cut_lineage

POPULATION = ["run_id", "generation"]
GENE = [*CANDIDATE, "name"]


@dataclass(frozen=True)
class EvolutionConfig:
    """Knobs of one evolve step."""

    # The defaults.
    population_size: int = 20
    num_generations: int = 10
    elite_count: int = 2
    tournament_size: int = 3
    swap_prob: float = 0.5
    immigrant_rate: float = 0.15
    initial_mutation: float = 0.3
    final_mutation: float = 0.05
    sigma: float = 0.2
    plateau_patience: int = 2
    plateau_min_delta: float = 1.0 / 1024.0
    plateau_immigrant_rate: float = 0.35
    plateau_mutation_floor: float = 0.30
    plateau_reheat_gens: int = 2
    plateau_any_new_best: bool = True
    dedupe_retries: int = 8
    narrowing: bool = True
    narrowing_start: int = 4
    elite_fraction: float = 0.25
    quantile: float = 0.20
    min_span_ratio: float = 0.35
    categorical_bias: float = 0.60
    late_training_bias: float = 0.0
    epochs: int = 10
    #: Data set that every genome names, with the epochs where the space has none; None leaves both out.
    dataset: str | None = None
    seed: int = 0


def population_stats(population: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Size, best, worst and mean fitness; runs without rows read 0."""
    stats = population.groupBy(*POPULATION).agg(
        F.count(F.lit(1)).alias("size"),
        F.max("fitness").alias("best_fitness"),
        F.min("fitness").alias("worst_fitness"),
        F.avg("fitness").alias("avg_fitness"),
    )
    return stats if runs is None else runs.join(stats, POPULATION, "left").fillna(0)


def rank_population(population: DataFrame) -> DataFrame:
    """Fitness rank within a population; equal fitness keeps population order."""
    return ranked(population, POPULATION, [-F.col("fitness")], "ordinal", "rank")


def elites(population: DataFrame, count: int) -> DataFrame:
    """The best ``count`` members as copies with their fitness, a new id and their rank as slot."""
    best = top_rows(population, POPULATION, [F.col("fitness").desc(), F.col("ordinal")], count, "rank")
    return best.select(
        *POPULATION,
        (F.col("rank") - 1).cast("long").alias("slot"),
        F.col("ordinal").alias("parent"),
        "fitness",
        F.substring(F.md5(F.concat_ws("|", F.lit("elite"), *POPULATION, "rank")), 1, 12).alias("id"),
    )


def best_candidate(population: DataFrame) -> DataFrame:
    """First member with the highest fitness of each run."""
    order = F.struct("fitness", -F.col("generation"), -F.col("ordinal"))
    best = population.groupBy("run_id").agg(F.max_by(F.struct("generation", "ordinal", "fitness"), order).alias("b"))
    return best.select("run_id", "b.*")


def tournament_select(population: DataFrame, parents: int | Column, size: int, seed: int, first_slot: int = 0) -> DataFrame:
    """One winner per slot among ``size`` distinct members; of equal ones the first drawn wins."""
    sizes = population.groupBy(*POPULATION).agg(F.count(F.lit(1)).alias("_n"))
    wanted = F.lit(parents) if isinstance(parents, int) else parents
    start = F.least(F.lit(first_slot).cast("long"), F.col("_n"))
    rows = slots(sizes, wanted - start, "slot").withColumn("slot", F.col("slot") + start)
    picks = [draws.uniform(seed, f"tournament{i}", F.col("run_id"), F.col("generation"), F.col("slot")) for i in range(size)]
    places = F.slice(F.array(*draws.distinct_positions(picks, F.col("_n"))), F.lit(1), F.least(F.lit(size), F.col("_n").cast("int")))
    drawn = rows.select(*POPULATION, "slot", F.posexplode(places).alias("_turn", "ordinal"))
    met = drawn.join(population.select(*CANDIDATE, "fitness"), CANDIDATE)
    return met.groupBy(*POPULATION, "slot").agg(
        F.max_by("ordinal", F.struct("fitness", -F.col("_turn"))).alias("parent")
    )


def elitist_select(population: DataFrame, parents: int, elite_count: int, size: int, seed: int) -> DataFrame:
    """The best members first, then tournaments for the remaining slots."""
    head = min(elite_count, parents)
    top = elites(population, head).select(*POPULATION, "slot", "parent")
    if head >= parents:
        return top
    return top.unionByName(tournament_select(population, parents, size, seed, head))


def pair_parents(parents: DataFrame) -> DataFrame:
    """Consecutive parents as pairs; the second of an odd last pair is null."""
    even = F.pmod("slot", F.lit(2)) == 0
    return parents.groupBy(*POPULATION, F.floor(F.col("slot") / 2).cast("long").alias("pair")).agg(
        F.max(F.when(even, F.col("parent"))).alias("first"), F.max(F.when(~even, F.col("parent"))).alias("second")
    )


def _parent_genes(genes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both parents' values of every gene of every pair, from one join."""
    sides = pairs.select(
        *POPULATION, "pair", F.posexplode(F.array("first", "second")).alias("_side", "ordinal")
    ).filter("ordinal IS NOT NULL")
    met = sides.join(genes, CANDIDATE)
    side = F.col("_side")
    return met.groupBy(*POPULATION, "pair", "name").agg(
        F.max(F.when(side == 0, F.col("num"))).alias("a_num"),
        F.max(F.when(side == 0, F.col("cat"))).alias("a_cat"),
        F.max(F.when(side == 1, F.col("num"))).alias("b_num"),
        F.max(F.when(side == 1, F.col("cat"))).alias("b_cat"),
        (F.max(side) == 1).alias("paired"),
    )


def _children(both: DataFrame, first: tuple[Column, Column], second: tuple[Column, Column]) -> DataFrame:
    """Child rows at slots 2 x pair and 2 x pair + 1; an unpaired parent passes through."""

    def child(offset: int, values: tuple[Column, Column]) -> Column:
        return F.struct(
            (F.col("pair") * 2 + offset).alias("ordinal"),
            F.when(F.col("paired"), values[0]).otherwise(F.col("a_num")).alias("num"),
            F.when(F.col("paired"), values[1]).otherwise(F.col("a_cat")).alias("cat"),
        )

    made = F.when(F.col("paired"), F.array(child(0, first), child(1, second))).otherwise(F.array(child(0, first)))
    return both.select(*POPULATION, "name", F.explode(made).alias("c")).select(
        *POPULATION, "c.ordinal", "name", "c.num", "c.cat"
    )


def uniform_crossover(genes: DataFrame, pairs: DataFrame, swap_prob: float, seed: int) -> DataFrame:
    """Swap each gene between the two children with the given probability."""
    both = _parent_genes(genes, pairs)
    key = [F.col(c) for c in (*POPULATION, "pair", "name")]
    swap = draws.uniform(seed, "swap", *key) < F.lit(swap_prob)
    num_a, num_b, cat_a, cat_b = (F.col(c) for c in ("a_num", "b_num", "a_cat", "b_cat"))
    first = (F.when(swap, num_b).otherwise(num_a), F.when(swap, cat_b).otherwise(cat_a))
    second = (F.when(swap, num_a).otherwise(num_b), F.when(swap, cat_a).otherwise(cat_b))
    return _children(both, first, second)


def blx_alpha_crossover(genes: DataFrame, pairs: DataFrame, space: Space, alpha: float, seed: int) -> DataFrame:
    """Blend continuous genes over the widened parent interval, draw discrete ones between the
    parents and take either parent's category."""
    both = _parent_genes(genes, pairs)
    param = space.of(F.col("name"))
    low, high = F.least("a_num", "b_num"), F.greatest("a_num", "b_num")
    margin = F.lit(alpha) * (high - low)

    def child(side: str) -> tuple[Column, Column]:
        draw = draws.uniform(seed, f"blend-{side}", *[F.col(c) for c in (*POPULATION, "pair", "name")])
        blended = (low - margin) + draw * ((high + margin) - (low - margin))
        number = F.when(param["param_type"] == DISCRETE, draws.integer(draw, low, high)).otherwise(blended)
        return clip_number(number, param), F.when(draw < 0.5, F.col("a_cat")).otherwise(F.col("b_cat"))

    return _children(both, child("a"), child("b"))


def adaptive_rate(
    generation: Column,
    max_generations: int,
    initial: float = 0.3,
    final: float = 0.05,
    floor: Column | float | None = None,
) -> Column:
    """Mutation rate falling linearly over the generations, never below an optional floor."""
    if max_generations <= 1:
        rate = F.lit(float(initial))
    else:
        rate = F.lit(float(initial)) + generation / F.lit(float(max_generations - 1)) * F.lit(float(final - initial))
    if floor is None:
        return rate
    return F.greatest(rate, F.lit(floor) if isinstance(floor, float) else floor)


def gaussian_mutation(
    genes: DataFrame, space: Space, rate: Column | float, sigma: float, seed: int, purpose: str = "mutate"
) -> DataFrame:
    """Add noise to numbers (sigma is a share of the linear range) and redraw categories."""
    key = [F.col(c) for c in GENE]
    param = space.of(F.col("name"))
    chance = F.lit(rate) if isinstance(rate, float) else rate
    hit = (draws.uniform(seed, f"{purpose}-gate", *key) < chance) & param.isNotNull()
    first, second = draws.uniform(seed, f"{purpose}-1", *key), draws.uniform(seed, f"{purpose}-2", *key)
    noise = draws.normal(first, second) * F.lit(sigma) * (param["high"] - param["low"])
    moved = clip_number(F.col("num") + noise, param)
    numeric = param["param_type"] != CATEGORICAL
    return genes.withColumn("_hit", hit).select(
        *[c for c in genes.columns if c not in ("num", "cat")],
        F.when(F.col("_hit") & numeric, moved).otherwise(F.col("num")).alias("num"),
        F.when(F.col("_hit") & ~numeric, draws.choice(first, param["choices"])).otherwise(F.col("cat")).alias("cat"),
    )


def adaptive_mutation(
    genes: DataFrame, space: Space, config: EvolutionConfig, floor: Column | float | None = None, purpose: str = "mutate"
) -> DataFrame:
    """Gaussian mutation at the rate of the genes' generation."""
    rate = adaptive_rate(
        F.col("generation"), config.num_generations, config.initial_mutation, config.final_mutation, floor
    )
    return gaussian_mutation(genes, space, rate, config.sigma, config.seed, purpose)


def narrow_constraints(population: DataFrame, genes: DataFrame, space: Space, config: EvolutionConfig) -> DataFrame:
    """Bounds and preferred categories around each population's elites.

    Numbers: interpolated quantiles of the elites, widened to the minimum span and clipped to
    the domain. Categories: those the elites hold, most frequent first, then by first holder.
    """
    fraction = min(max(config.elite_fraction, 0.05), 1.0)
    q = min(max(config.quantile, 0.0), 0.49)
    span_ratio = min(max(config.min_span_ratio, 0.0), 1.0)
    sizes = population.groupBy(*POPULATION).agg(F.count(F.lit(1)).alias("_n"))
    wanted = F.least(F.col("_n"), F.greatest(F.lit(2), half_even(F.col("_n") * F.lit(fraction)).cast("long")))
    chosen = (
        rank_population(population)
        .join(sizes, POPULATION)
        .filter(F.col("rank") <= wanted)
        .select(*CANDIDATE, "rank")
    )
    held = genes.join(chosen, CANDIDATE)

    def share(p: float) -> dict:
        place = lambda n: (n - 1) * F.lit(p)
        return {
            "below": lambda n: F.floor(place(n)).cast("long") + 1,
            "above": lambda n: F.ceil(place(n)).cast("long") + 1,
        }

    picks = {f"{side}_{name}": f for side, p in (("lo", q), ("hi", 1.0 - q)) for name, f in share(p).items()}
    stats = order_statistics(held.filter("num IS NOT NULL"), [*POPULATION, "name"], "num", picks)

    def between(side: str, p: float) -> Column:
        position = (F.col("samples") - 1) * F.lit(p)
        weight = position - F.floor(position)
        return F.col(f"{side}_below") * (F.lit(1.0) - weight) + F.col(f"{side}_above") * weight

    param = space.of(F.col("name"))
    base_low, base_high = param["low"], param["high"]
    base_span = F.greatest(base_high - base_low, F.lit(1e-12))
    ranged = stats.filter(param.isNotNull()).select(
        *POPULATION, "name", between("lo", q).alias("_a"), between("hi", 1.0 - q).alias("_b")
    ).select(*POPULATION, "name", F.least("_a", "_b").alias("_lo"), F.greatest("_a", "_b").alias("_hi"))
    span = F.greatest(F.col("_hi") - F.col("_lo"), base_span * F.lit(span_ratio))
    center = F.lit(0.5) * (F.col("_lo") + F.col("_hi"))
    low = F.greatest(base_low, center - F.lit(0.5) * span)
    high = F.least(base_high, center + F.lit(0.5) * span)
    whole = param["param_type"] == DISCRETE
    numbers = ranged.select(
        *POPULATION,
        "name",
        F.when(whole, clip_number(low, param)).otherwise(low).alias("low"),
        F.when(whole, clip_number(high, param)).otherwise(high).alias("high"),
        F.lit(None).cast("array<string>").alias("preferred"),
    )
    counts = held.filter("cat IS NOT NULL").groupBy(*POPULATION, "name", "cat").agg(
        F.count(F.lit(1)).alias("_count"), F.min("rank").alias("_first")
    ).filter(F.array_contains(param["choices"], F.col("cat")))
    # At most one entry per choice of the parameter.
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("_count")).alias("c"), F.col("_first").alias("f"), "cat")))
    categories = counts.groupBy(*POPULATION, "name").agg(ordered.alias("o")).select(
        *POPULATION,
        "name",
        F.lit(None).cast("double").alias("low"),
        F.lit(None).cast("double").alias("high"),
        F.transform("o", lambda x: x["cat"]).alias("preferred"),
    )
    return numbers.unionByName(categories)


def apply_constraints(genes: DataFrame, constraints: DataFrame, space: Space, bias: float, seed: int) -> DataFrame:
    """Move numbers into the narrowed bounds; replace unsupported categories with probability ``bias``."""
    param = space.of(F.col("name"))
    joined = genes.join(constraints.select("run_id", "name", "low", "high", "preferred"), ["run_id", "name"], "left")
    known = (F.col("low").isNotNull() | F.col("preferred").isNotNull()) & param.isNotNull()
    low = F.least(F.coalesce("low", param["low"]), F.coalesce("high", param["high"]))
    high = F.greatest(F.coalesce("low", param["low"]), F.coalesce("high", param["high"]))
    supported = F.filter("preferred", lambda c: F.array_contains(param["choices"], c))
    key = [F.col(c) for c in GENE]
    replace = (
        (F.size(supported) > 0)
        & ~F.array_contains(supported, F.col("cat"))
        & (draws.uniform(seed, "constrain-gate", *key) < F.lit(min(max(bias, 0.0), 1.0)))
    )
    category = F.when(replace, draws.choice(draws.uniform(seed, "constrain", *key), supported)).otherwise(
        clip_category(F.col("cat"), param)
    )
    numeric = param["param_type"] != CATEGORICAL
    return joined.select(
        *GENE,
        F.when(known & numeric, clip_number(clamp(F.col("num"), low, high), param)).otherwise(F.col("num")).alias("num"),
        F.when(known & ~numeric, category).otherwise(F.col("cat")).alias("cat"),
    )


def late_training_bias(genes: DataFrame, space: Space, config: EvolutionConfig) -> DataFrame:
    """Redraw ``epochs`` upwards with a chance that grows over the generations."""
    if config.late_training_bias <= 0 or "epochs" not in space.names():
        return genes
    param = space.get("epochs")
    progress = clamp(F.col("generation") / F.lit(float(max(config.num_generations - 1, 1))), F.lit(0.0), F.lit(1.0))
    key = [F.col(c) for c in CANDIDATE]
    chance = F.lit(min(max(config.late_training_bias, 0.0), 1.0)) * progress
    hit = (F.col("name") == "epochs") & (draws.uniform(config.seed, "epochs-gate", *key) < chance)
    draw = draws.uniform(config.seed, "epochs", *key)
    if param.param_type == CATEGORICAL:
        numbers = F.array(*[F.lit(c) for c in param.choices if c.lstrip("-").isdigit()])
        current = F.col("cat").try_cast("int")
        higher = F.filter(numbers, lambda c: c.cast("int") >= current)
        redrawn = draws.choice(draw, F.when(F.size(higher) > 0, higher).otherwise(numbers))
        return genes.withColumn("cat", F.when(hit, redrawn).otherwise(F.col("cat")))
    if param.param_type == CONTINUOUS:
        return genes
    low = F.greatest(F.lit(float(int(param.low))), F.floor("num").cast("double"))
    high = F.lit(float(int(param.high)))
    redrawn = draws.integer(draw, low, high).cast("double")
    return genes.withColumn("num", F.when(hit & (low <= high), redrawn).otherwise(F.col("num")))


def inject_immigrants(
    genes: DataFrame, offspring: Column | int, rate: Column | float, space: Space, constraints: DataFrame, config: EvolutionConfig
) -> DataFrame:
    """Replace the last share of each run's offspring by fresh (narrowed) draws.

    ``offspring`` is the number per run: one for all, or a column of ``genes``.
    """
    offspring = F.lit(offspring) if isinstance(offspring, int) else offspring
    share = clamp(F.lit(rate) if isinstance(rate, float) else rate, F.lit(0.0), F.lit(1.0))
    limit = offspring - F.least(offspring, half_even(offspring * share).cast("long"))
    marked = genes.withColumn("_replace", F.col("ordinal") >= limit)
    gone = marked.filter("_replace").select(*CANDIDATE).distinct().join(constraint_map(constraints), "run_id", "left")
    fresh = random_genes(gone, space, config.seed, "immigrant", config.categorical_bias)
    carried = marked.filter("_replace").join(fresh.select(*GENE), GENE, "left_anti").select(*GENE, "num", "cat")
    return (
        marked.filter(~F.col("_replace"))
        .select(*GENE, "num", "cat")
        .unionByName(fresh)
        .unionByName(carried.filter(~F.col("name").isin(space.names())))
    )


def _clashes(keys: DataFrame) -> DataFrame:
    """Candidates whose genome an earlier candidate of the same population already holds."""
    holders = keys.groupBy(*POPULATION, "genome_key").agg(F.min("ordinal").alias("_holder"))
    return keys.join(holders, [*POPULATION, "genome_key"]).filter(F.col("ordinal") > F.col("_holder"))


def dedupe_genomes(
    genes: DataFrame, space: Space, constraints: DataFrame, config: EvolutionConfig, rounds: int | None = None
) -> DataFrame:
    """Give later holders of a genome a fresh one; the population keeps its size.

    Every clash draws all its attempts at once. Attempts equal to a genome in use are dropped,
    equal attempts go to the earliest candidate, and each clash takes its lowest attempt left.
    This repeats among those left without one while genomes remain. Clashes that lost all attempts are mutated; a mutation that clashes as well is undone.
    """
    retries = config.dedupe_retries if rounds is None else rounds
    used = cut_lineage(genome_keys(genes).select(*CANDIDATE, "genome_key"))
    clash = cut_lineage(_clashes(used).select(*CANDIDATE))
    if clash.isEmpty():
        return genes.select(*GENE, "num", "cat")
    replacements = None
    if retries > 0:
        turns = F.explode(F.sequence(F.lit(0), F.lit(retries - 1)))
        tries = clash.join(constraint_map(constraints), "run_id", "left").withColumn("attempt", turns)
        drawn = random_genes(tries, space, config.seed, "dedupe", config.categorical_bias, ("attempt",))
        # Fixed genes such as the data set are part of the genome's identity.
        fixed = genes.filter(~F.col("name").isin(space.names())).join(clash, CANDIDATE, "left_semi")
        spread = fixed.withColumn("attempt", turns).select(*CANDIDATE, "attempt", "name", "num", "cat")
        whole = cut_lineage(drawn.unionByName(spread))
        keys = genome_keys(whole, [*CANDIDATE, "attempt"])
        free = keys.join(used.select(*POPULATION, "genome_key"), [*POPULATION, "genome_key"], "left_anti")
        free = cut_lineage(free.select(*CANDIDATE, "attempt", "genome_key"))
        owned = None
        # Whoever loses all its attempts to earlier candidates tries the genomes they left.
        # Every turn settles at least the first candidate of each genome, so this ends.
        while not free.isEmpty():
            owner = free.groupBy(*POPULATION, "genome_key").agg(F.min(F.struct("ordinal", "attempt")).alias("o"))
            picked = owner.groupBy(*POPULATION, F.col("o.ordinal").alias("ordinal")).agg(
                F.min(F.struct("o.attempt", "genome_key")).alias("p")
            )
            picked = cut_lineage(picked.select(*CANDIDATE, "p.attempt", "p.genome_key"))
            owned = picked if owned is None else owned.unionByName(picked)
            free = cut_lineage(
                free.join(picked.select(*CANDIDATE), CANDIDATE, "left_anti").join(
                    picked.select(*POPULATION, "genome_key"), [*POPULATION, "genome_key"], "left_anti"
                )
            )
        if owned is not None:
            owned = owned.select(*CANDIDATE, "attempt")
            replacements = whole.join(owned, [*CANDIDATE, "attempt"]).select(*GENE, "num", "cat")
            clash = clash.join(owned, CANDIDATE, "left_anti")
    changed = replacements
    if not clash.isEmpty():
        stuck = genes.join(clash, CANDIDATE, "left_semi")
        mutated = adaptive_mutation(stuck, space, config, None, "dedupe-mutate")
        mutated = cut_lineage(apply_constraints(mutated, constraints, space, config.categorical_bias, config.seed))
        taken = used.select(*POPULATION, "genome_key")
        if replacements is not None:
            taken = taken.unionByName(genome_keys(replacements).select(*POPULATION, "genome_key"))
        fine = genome_keys(mutated).join(taken, [*POPULATION, "genome_key"], "left_anti")
        fine = fine.groupBy(*POPULATION, "genome_key").agg(F.min("ordinal").alias("ordinal")).select(*CANDIDATE)
        moved = mutated.join(fine, CANDIDATE, "left_semi").select(*GENE, "num", "cat")
        changed = moved if changed is None else changed.unionByName(moved)
    if changed is None:
        return genes.select(*GENE, "num", "cat")
    kept = genes.join(changed.select(*CANDIDATE).distinct(), CANDIDATE, "left_anti").select(*GENE, "num", "cat")
    return kept.unionByName(changed)


def assign_fitness(population: DataFrame, results: DataFrame) -> DataFrame:
    """Fitness by submission position: completed results score, others 0, missing ones keep the old."""
    got = results.select(*CANDIDATE, "status", "validation_accuracy")
    score = F.when(F.col("status") == "COMPLETED", F.col("validation_accuracy")).otherwise(0.0)
    return population.join(got, CANDIDATE, "left").withColumn(
        "fitness", F.when(F.col("status").isNotNull(), score).otherwise(F.col("fitness"))
    ).drop("status", "validation_accuracy")
