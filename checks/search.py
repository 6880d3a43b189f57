"""Search-space, evolution, evaluation and strategy queries."""

from pyspark.sql import functions as F

from checks.base import check
from tunelake.operators import evaluation as e
from tunelake.operators import evolution as ev
from tunelake.operators import space as sp
from tunelake.operators import strategies as st
from tunelake.plans import searches as ps
from tunelake.session import cut_lineage

SEED = 7
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
SPACE = sp.Space(
    (
        sp.Param("x", sp.CONTINUOUS, -1000.0, 10000.0),
        sp.Param("y", sp.DISCRETE, 1.0, 10.0),
        sp.Param("z", sp.CATEGORICAL, choices=SEGMENTS),
    )
)
CONFIG = ev.EvolutionConfig(population_size=40, num_generations=10, seed=SEED, narrowing_start=0)
CH = "[" + ", ".join(f"'{c}'" for c in SEGMENTS) + "]"
SPACE_SQL = f"""space AS (SELECT * FROM (VALUES (0, 'x', 'continuous', -1000.0::DOUBLE, 10000.0::DOUBLE, NULL::VARCHAR[]),
                 (1, 'y', 'discrete', 1.0::DOUBLE, 10.0::DOUBLE, NULL), (2, 'z', 'categorical', NULL, NULL, {CH}))
                 AS v(position, name, param_type, low, high, choices))"""
GENE = "run_id:long generation:int ordinal:long name:str num:dbl cat:str"
POP, GENES = "population_view", "genes_view"


def u(seed: int, purpose: str, *key: str) -> str:
    """Uniform draw in SQL."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', '{purpose}', {', '.join(key)})), 1, 13))::BIGINT / CAST(4503599627370496 AS DOUBLE))"


def fl(text: str) -> str:
    return f"CAST(floor({text}) AS BIGINT)"


def pick(draw: str, options: str) -> str:
    return f"{options}[CAST(floor({draw} * len({options})) AS BIGINT) + 1]"


def clip_sql(value: str, p: str = "p") -> str:
    return (
        f"CASE {p}.param_type WHEN 'discrete' THEN greatest({p}.low, least({p}.high, round_even({value}, 0))) "
        f"ELSE greatest({p}.low, least({p}.high, {value})) END"
    )


def normal_sql(a: str, b: str) -> str:
    return f"(sqrt(-2 * ln(1 - {a})) * cos(CAST(6.283185307179586 AS DOUBLE) * {b}))"


@check(
    "validate_space",
    "name:str problem:str",
    """
SELECT p_name AS name, CASE WHEN p_size % 3 < 2 AND (p_size % 4 = 0 OR p_size % 5 = 0) THEN 'a numeric parameter lacks a bound'
       WHEN p_size % 3 = 2 AND p_size % 7 = 0 THEN 'a categorical parameter lacks choices' END AS problem
  FROM part WHERE (p_size % 3 < 2 AND (p_size % 4 = 0 OR p_size % 5 = 0)) OR (p_size % 3 = 2 AND p_size % 7 = 0)
""",
)
def _(s):
    size = F.col("p_size")
    table = s.table("part").select(
        F.col("p_name").alias("name"),
        F.when(size % 3 == 0, "continuous").when(size % 3 == 1, "discrete").otherwise("categorical").alias("param_type"),
        F.when(size % 4 != 0, 0.0).alias("low"),
        F.when(size % 5 != 0, 1.0).alias("high"),
        F.when(size % 7 != 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("choices"),
    )
    return sp.validate_space(table)


@check(
    "unknown_names",
    "name:str",
    f"WITH {SPACE_SQL}\nSELECT DISTINCT p_type AS name FROM part WHERE p_type NOT IN (SELECT name FROM space)",
)
def _(s):
    return sp.unknown_names(s.table("part").select(F.col("p_type").alias("name")).distinct(), SPACE.table(s.spark))


@check(
    "random_candidates",
    GENE,
    f"""
WITH {SPACE_SQL}, n AS (SELECT run_id, count(*) AS n FROM population_view GROUP BY run_id),
     c AS (SELECT run_id, 0 AS generation, i AS ordinal FROM n, range(0, n) AS r(i)),
     d AS (SELECT c.*, p.*, {u(SEED, 'sample', 'c.run_id', 'c.generation', 'c.ordinal', 'p.name')} AS u FROM c, space p)
SELECT run_id, generation, ordinal, name,
       CASE param_type WHEN 'continuous' THEN low + u * (high - low) WHEN 'discrete' THEN low + floor(u * (high - low + 1)) END AS num,
       CASE WHEN param_type = 'categorical' THEN {pick('u', 'choices')} END AS cat FROM d
""",
    POP,
)
def _(s):
    runs = s.view(POP).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    return sp.random_candidates(runs, SPACE, SEED)


@check(
    "log_scale_candidates",
    GENE,
    f"""
WITH n AS (SELECT run_id, count(*) AS n FROM population_view GROUP BY run_id),
     c AS (SELECT run_id, 0 AS generation, i AS ordinal, 'rate' AS name FROM n, range(0, n) AS r(i))
SELECT *, exp(ln(CAST(0.0001 AS DOUBLE)) + {u(SEED, 'sample', 'run_id', 'generation', 'ordinal', 'name')}
       * (ln(CAST(0.1 AS DOUBLE)) - ln(CAST(0.0001 AS DOUBLE)))) AS num, NULL AS cat FROM c
""",
    POP,
)
def _(s):
    runs = s.view(POP).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    return sp.random_candidates(runs, sp.Space((sp.Param("rate", sp.CONTINUOUS, 1e-4, 1e-1, log_scale=True),)), SEED)


LIMITS_SQL = """lim AS (SELECT run_id, 'x' AS name, min(x) + 500 AS low, max(x) - 500 AS high, NULL::VARCHAR[] AS preferred FROM population_view GROUP BY run_id
            UNION ALL SELECT run_id, 'y', CAST(2 + run_id % 3 AS DOUBLE), CAST(8 - run_id % 2 AS DOUBLE), NULL FROM population_view GROUP BY run_id
            UNION ALL SELECT run_id, 'z', NULL, NULL, ['MACHINERY', 'BUILDING'] FROM population_view GROUP BY run_id HAVING run_id % 2 = 0)"""


def limits(s):
    pop = s.view(POP)
    none = F.lit(None)
    x = pop.groupBy("run_id").agg((F.min("x") + 500).alias("low"), (F.max("x") - 500).alias("high"))
    runs = x.select("run_id")
    preferred = F.array(F.lit("MACHINERY"), F.lit("BUILDING"))
    return (
        x.select("run_id", F.lit("x").alias("name"), "low", "high", none.cast("array<string>").alias("preferred"))
        .unionByName(
            runs.select(
                "run_id", F.lit("y").alias("name"), (2 + F.col("run_id") % 3).cast("double").alias("low"),
                (8 - F.col("run_id") % 2).cast("double").alias("high"), none.cast("array<string>").alias("preferred"),
            )
        )
        .unionByName(
            runs.filter("run_id % 2 = 0").select(
                "run_id", F.lit("z").alias("name"), none.cast("double").alias("low"), none.cast("double").alias("high"),
                preferred.alias("preferred"),
            )
        )
    )


@check(
    "constrained_candidates",
    GENE,
    f"""
WITH {SPACE_SQL}, {LIMITS_SQL}, n AS (SELECT run_id, count(*) AS n FROM population_view GROUP BY run_id),
     c AS (SELECT run_id, 0 AS generation, i AS ordinal FROM n, range(0, n) AS r(i)),
     d AS (SELECT c.*, p.name, p.param_type, p.choices, coalesce(l.low, p.low) AS low, coalesce(l.high, p.high) AS high, l.preferred,
                  {u(SEED, 'sample', 'c.run_id', 'c.generation', 'c.ordinal', 'p.name')} AS u,
                  {u(SEED, 'sample-gate', 'c.run_id', 'c.generation', 'c.ordinal', 'p.name')} AS g
             FROM c CROSS JOIN space p LEFT JOIN lim l ON l.run_id = c.run_id AND l.name = p.name)
SELECT run_id, generation, ordinal, name,
       CASE param_type WHEN 'continuous' THEN low + u * (high - low) WHEN 'discrete' THEN low + floor(u * (high - low + 1)) END AS num,
       CASE WHEN param_type = 'categorical' THEN CASE WHEN preferred IS NOT NULL AND g < 0.6 THEN {pick('u', 'preferred')} ELSE {pick('u', 'choices')} END END AS cat FROM d
""",
    POP,
)
def _(s):
    runs = s.view(POP).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    return sp.constrained_candidates(runs, SPACE, limits(s), SEED)


@check(
    "clip_to_domain",
    GENE,
    f"""
WITH {SPACE_SQL}, w AS (SELECT run_id, generation, ordinal, name, num * CAST(1.75 AS DOUBLE) AS num,
                               CASE WHEN ordinal % 3 = 0 THEN lower(cat) ELSE cat END AS cat FROM genes_view)
SELECT w.run_id, w.generation, w.ordinal, w.name, CASE WHEN p.param_type <> 'categorical' THEN {clip_sql('w.num')} END AS num,
       CASE WHEN p.param_type = 'categorical' THEN CASE WHEN list_contains(p.choices, w.cat) THEN w.cat ELSE p.choices[1] END END AS cat
  FROM w JOIN space p ON w.name = p.name
""",
    GENES,
)
def _(s):
    cat = F.when(F.col("ordinal") % 3 == 0, F.lower("cat")).otherwise(F.col("cat"))
    return sp.clip_to_domain(s.view(GENES).withColumn("num", F.col("num") * 1.75).withColumn("cat", cat), SPACE)


@check(
    "grid_candidates",
    "ordinal:long x:dbl y:dbl z:str rows_at_least:long",
    f"""
WITH g AS (SELECT x, y, z, row_number() OVER (ORDER BY xi, yi, zi) - 1 AS ordinal
             FROM (SELECT -1000 + i * CAST(11000 AS DOUBLE) / 3 AS x, i AS xi FROM range(0, 4) AS a(i)),
                  (SELECT CAST(1 + 3 * i AS DOUBLE) AS y, i AS yi FROM range(0, 4) AS b(i)),
                  (SELECT {CH}[i + 1] AS z, i AS zi FROM range(0, 5) AS c(i)))
SELECT ordinal, x, y, z, (SELECT count(*) FROM genes_view WHERE name = 'x' AND num >= g.x) AS rows_at_least FROM g
 WHERE ordinal < (SELECT count(*) FROM region) * 12
""",
    GENES,
)
def _(s):
    budget = s.table("region").count() * 12
    grid = e.wide_genomes(sp.grid_candidates(s.spark, SPACE, 4, budget), SPACE)
    values = s.view(GENES).filter("name = 'x'").select(F.col("num").alias("at"), F.lit(0).alias("one"))
    scorer = e.ThresholdScorer("x", "at", "one")
    genes = sp.grid_candidates(s.spark, SPACE, 4, budget)
    rows = values.count()
    below = scorer.scores(genes, SPACE, values).select("ordinal", F.round((1 - F.col("score")) * rows).alias("rows_at_least"))
    return grid.join(below, "ordinal")


@check(
    "genome_keys",
    "run_id:long ordinal:long genome_text:str genome_key:str genome_seed:long",
    """
WITH t AS (SELECT run_id, generation, ordinal, name || '=' || coalesce(CASE WHEN num = floor(num) THEN CAST(CAST(num AS BIGINT) AS VARCHAR) ELSE CAST(num AS VARCHAR) END, cat) AS g FROM genes_view),
     k AS (SELECT run_id, ordinal, string_agg(g, ',' ORDER BY g) AS genome_text FROM t GROUP BY ALL)
SELECT *, sha256(genome_text) AS genome_key, greatest(1, (('0x' || substr(sha256(genome_text), 1, 16))::UBIGINT % 2147483647 + 11) % 2147483647) AS genome_seed FROM k
""",
    GENES,
)
def _(s):
    return sp.genome_keys(s.view(GENES), seed_offset=11)


CONFIG_NAMES = (
    "learning_rate:dbl batch_size:int optimizer:int conv_filters_1:int conv_filters_2:int conv_filters_3:int "
    "kernel_size:int dense_units_1:int dropout_rate:dbl activation:int epochs:int dataset:str"
)
CONFIG_SQL = """
    SELECT seq, learning_rate, batch_size, CASE optimizer WHEN 'sgd' THEN 1 WHEN 'adam' THEN 2 WHEN 'rmsprop' THEN 3 ELSE 4 END AS optimizer,
           conv_filters_1, conv_filters_2, conv_filters_3, CASE WHEN seq % 3 = 0 THEN 3 ELSE 5 END AS kernel_size,
           CASE WHEN seq % 4 = 0 THEN 128 ELSE dense_units_1 END AS dense_units_1, dropout_rate, 1 AS activation, epochs, 'mnist' AS dataset FROM configs_view
"""


def config_genes(s):
    numbers = ["learning_rate", "conv_filters_1", "conv_filters_2", "conv_filters_3", "dense_units_1", "dropout_rate", "epochs"]
    texts = ["batch_size", "optimizer", "kernel_size"]
    parts = [f"'{n}', CAST({n} AS DOUBLE), CAST(NULL AS STRING)" for n in numbers]
    parts += [f"'{n}', CAST(NULL AS DOUBLE), CAST({n} AS STRING)" for n in texts]
    rows = s.view("configs_view").withColumn("kernel_size", F.lit(5)).selectExpr(
        "CAST(generation_id AS BIGINT) AS run_id", "0 AS generation", "seq AS ordinal",
        f"stack({len(parts)}, {', '.join(parts)}) AS (name, num, cat)",
    )
    dropped = ((F.col("name") == "kernel_size") & (F.col("ordinal") % 3 == 0)) | (
        (F.col("name") == "dense_units_1") & (F.col("ordinal") % 4 == 0)
    )
    return rows.filter(~dropped)


def flat_config(frame):
    c = F.col("config")
    return frame.select(
        F.col("ordinal").alias("seq"),
        *[c[n].alias(n) for n in ("learning_rate", "batch_size", "optimizer", "kernel_size", "dropout_rate", "activation", "epochs", "dataset")],
        *[F.get(c["conv_filters"], i).alias(f"conv_filters_{i + 1}") for i in range(3)],
        F.get(c["dense_units"], 0).alias("dense_units_1"),
    )


@check("genome_to_config", f"seq:long {CONFIG_NAMES}", CONFIG_SQL, "configs_view")
def _(s):
    return flat_config(sp.genome_to_config(config_genes(s)))


@check("config_to_genome", f"seq:long {CONFIG_NAMES}", CONFIG_SQL, "configs_view")
def _(s):
    configs = sp.genome_to_config(config_genes(s))
    return flat_config(sp.genome_to_config(sp.config_to_genome(configs)))


@check(
    "initialize_population",
    "run_id:long generation:int ordinal:long fitness:dbl origin:str x:dbl",
    f"""
WITH c AS (SELECT DISTINCT run_id, 0 AS generation, i AS ordinal FROM population_view, range(0, 40) AS r(i))
SELECT *, 0.0 AS fitness, 'initial' AS origin, -1000 + {u(SEED, 'sample', 'run_id', 'generation', 'ordinal', "'x'")} * 11000 AS x FROM c
""",
    POP,
)
def _(s):
    population, genes = ps.initialize_population(s.view(POP).select("run_id").distinct(), SPACE, CONFIG)
    return population.join(genes.filter("name = 'x'").withColumnRenamed("num", "x"), sp.CANDIDATE)


@check(
    "population_stats",
    "run_id:long size:long best_fitness:dbl worst_fitness:dbl avg_fitness:dbl",
    "SELECT run_id, count(*) AS size, max(fitness) AS best_fitness, min(fitness) AS worst_fitness, avg(fitness) AS avg_fitness FROM population_view GROUP BY run_id",
    POP,
)
def _(s):
    return ev.population_stats(s.view(POP))


RANK = "row_number() OVER (PARTITION BY run_id ORDER BY fitness DESC, ordinal)"


@check("rank_population", "run_id:long ordinal:long fitness:dbl rank:long", f"SELECT *, {RANK} AS rank FROM population_view", POP)
def _(s):
    return ev.rank_population(s.view(POP))


@check(
    "elites",
    "run_id:long slot:long parent:long fitness:dbl",
    f"SELECT run_id, n - 1 AS slot, ordinal AS parent, fitness FROM (SELECT *, {RANK} AS n FROM population_view) AS x WHERE n <= 5",
    POP,
)
def _(s):
    return ev.elites(s.view(POP), 5)


@check(
    "best_candidate",
    "run_id:long ordinal:long fitness:dbl",
    f"SELECT run_id, ordinal, fitness FROM (SELECT *, {RANK} AS n FROM population_view) AS x WHERE n = 1",
    POP,
)
def _(s):
    return ev.best_candidate(s.view(POP))


def tournament_sql(first: int = 0) -> str:
    draws = ", ".join(f"{u(SEED, f'tournament{i}', 'run_id', '0', 'slot')} AS u{i}" for i in range(3))
    return f"""n AS (SELECT run_id, count(*) AS n FROM population_view GROUP BY run_id),
     d AS (SELECT run_id, n, i AS slot FROM n, range({first}, 30) AS r(i)),
     d0 AS (SELECT *, {draws} FROM d),
     d1 AS (SELECT *, {fl('u0 * n')} AS a, {fl('u1 * (n - 1)')} AS b0, {fl('u2 * (n - 2)')} AS c0 FROM d0),
     d2 AS (SELECT *, b0 + CASE WHEN b0 >= a THEN 1 ELSE 0 END AS b FROM d1),
     d3 AS (SELECT *, c0 + CASE WHEN c0 >= least(a, b) THEN 1 ELSE 0 END AS c1 FROM d2),
     d4 AS (SELECT run_id, slot, unnest([a, b, c1 + CASE WHEN c1 >= greatest(a, b) THEN 1 ELSE 0 END]) AS ordinal, unnest([0, 1, 2]) AS turn FROM d3),
     tw AS (SELECT d4.run_id, d4.slot, max_by(d4.ordinal, (p.fitness, -turn)) AS parent FROM d4 JOIN population_view p USING (run_id, ordinal) GROUP BY d4.run_id, d4.slot)"""


PARENTS_SQL = f"""{tournament_sql(2)},
     pr AS (SELECT run_id, n - 1 AS slot, ordinal AS parent FROM (SELECT *, {RANK} AS n FROM population_view) AS x WHERE n <= 2
            UNION ALL SELECT * FROM tw)"""


@check("tournament_select", "run_id:long slot:long parent:long", f"WITH {tournament_sql()}\nSELECT * FROM tw", POP)
def _(s):
    return ev.tournament_select(s.view(POP), 30, 3, SEED)


def parents(s):
    return ev.elitist_select(s.view(POP), 30, 2, 3, SEED)


@check("elitist_select", "run_id:long slot:long parent:long", f"WITH {PARENTS_SQL}\nSELECT * FROM pr", POP)
def _(s):
    return parents(s)


PAIRS_SQL = "pq AS (SELECT a.run_id, a.slot // 2 AS pair, a.parent AS first, b.parent AS second FROM pr a LEFT JOIN pr b ON a.run_id = b.run_id AND b.slot = a.slot + 1 WHERE a.slot % 2 = 0)"


@check(
    "pair_parents",
    "run_id:long pair:long first:long second:long",
    f"WITH {PARENTS_SQL.replace('range(2, 30)', 'range(2, 29)')}, {PAIRS_SQL}\nSELECT * FROM pq",
    POP,
)
def _(s):
    return ev.pair_parents(ev.elitist_select(s.view(POP), 29, 2, 3, SEED))


BOTH_SQL = f"""{PARENTS_SQL}, {PAIRS_SQL},
     bo AS (SELECT pq.run_id, 0 AS generation, pq.pair, a.name, a.num AS an, a.cat AS ac, b.num AS bn, b.cat AS bc
              FROM pq JOIN genes_view a ON a.run_id = pq.run_id AND a.ordinal = pq.first
                   JOIN genes_view b ON b.run_id = pq.run_id AND b.ordinal = pq.second AND b.name = a.name)"""


@check(
    "uniform_crossover",
    GENE,
    f"""
WITH {BOTH_SQL}, sw AS (SELECT *, {u(SEED, 'swap', 'run_id', 'generation', 'pair', 'name')} < 0.5 AS s FROM bo)
SELECT run_id, generation, 2 * pair AS ordinal, name, CASE WHEN s THEN bn ELSE an END AS num, CASE WHEN s THEN bc ELSE ac END AS cat FROM sw
 UNION ALL SELECT run_id, generation, 2 * pair + 1, name, CASE WHEN s THEN an ELSE bn END, CASE WHEN s THEN ac ELSE bc END FROM sw
""",
    f"{POP} {GENES}",
)
def _(s):
    return ev.uniform_crossover(s.view(GENES), ev.pair_parents(parents(s)), 0.5, SEED)


@check(
    "blx_alpha_crossover",
    GENE,
    f"""
WITH {SPACE_SQL}, {BOTH_SQL},
     k AS (SELECT bo.*, 0 AS side, {u(SEED, 'blend-a', 'run_id', 'generation', 'pair', 'bo.name')} AS u FROM bo
           UNION ALL SELECT bo.*, 1, {u(SEED, 'blend-b', 'run_id', 'generation', 'pair', 'bo.name')} FROM bo),
     m AS (SELECT k.*, least(an, bn) AS lo, greatest(an, bn) AS hi, p.param_type, p.low, p.high FROM k JOIN space p ON p.name = k.name),
     v AS (SELECT *, CASE param_type WHEN 'discrete' THEN lo + floor(u * (hi - lo + 1)) ELSE lo - 0.5 * (hi - lo) + u * 2 * (hi - lo) END AS raw FROM m)
SELECT run_id, generation, 2 * pair + side AS ordinal, name, {clip_sql('raw', 'v')} AS num,
       CASE WHEN u < 0.5 THEN ac ELSE bc END AS cat FROM v
""",
    f"{POP} {GENES}",
)
def _(s):
    return ev.blx_alpha_crossover(s.view(GENES), ev.pair_parents(parents(s)), SPACE, 0.5, SEED)


def mutate_sql(rate: str, source: str) -> str:
    k = ("m.run_id", "m.generation", "m.ordinal", "m.name")
    return f"""
     mu AS (SELECT m.*, p.param_type, p.low, p.high, p.choices, {u(SEED, 'mutate-gate', *k)} < {rate} AS hit,
                   {u(SEED, 'mutate-1', *k)} AS a, {u(SEED, 'mutate-2', *k)} AS b FROM {source} m JOIN space p ON p.name = m.name)
SELECT run_id, generation, ordinal, name,
       CASE WHEN hit AND param_type <> 'categorical' THEN {clip_sql(f"num + {normal_sql('a', 'b')} * CAST(0.2 AS DOUBLE) * (high - low)", 'mu')} ELSE num END AS num,
       CASE WHEN hit AND param_type = 'categorical' THEN {pick('a', 'choices')} ELSE cat END AS cat FROM mu"""


@check("gaussian_mutation", GENE, f"WITH {SPACE_SQL},{mutate_sql('0.5', 'genes_view')}", GENES)
def _(s):
    return ev.gaussian_mutation(s.view(GENES), SPACE, 0.5, 0.2, SEED)


@check(
    "adaptive_rate",
    "run_id:long generation:int rate:dbl floored:dbl single:dbl",
    "SELECT run_id, generation, CAST(0.3 AS DOUBLE) + generation / CAST(83 AS DOUBLE) * CAST(-0.25 AS DOUBLE) AS rate, "
    "greatest(CAST(0.2 AS DOUBLE), CAST(0.3 AS DOUBLE) + generation / CAST(83 AS DOUBLE) * CAST(-0.25 AS DOUBLE)) AS floored, 0.3 AS single "
    "FROM generation_metrics_view",
    "generation_metrics_view",
)
def _(s):
    g = F.col("generation")
    return s.view("generation_metrics_view").select(
        "run_id", "generation", ev.adaptive_rate(g, 84).alias("rate"), ev.adaptive_rate(g, 84, floor=0.2).alias("floored"),
        ev.adaptive_rate(g, 1).alias("single"),
    )


@check(
    "adaptive_mutation",
    GENE,
    f"WITH {SPACE_SQL}, ag AS (SELECT run_id, CAST(ordinal % 10 AS INTEGER) AS generation, ordinal, name, num, cat FROM genes_view),"
    + mutate_sql("CAST(0.3 AS DOUBLE) + m.generation / CAST(9 AS DOUBLE) * CAST(-0.25 AS DOUBLE)", "ag"),
    GENES,
)
def _(s):
    aged = s.view(GENES).withColumn("generation", (F.col("ordinal") % 10).cast("int"))
    return ev.adaptive_mutation(aged, SPACE, CONFIG)


NARROW_SQL = f"""rk AS (SELECT *, {RANK} AS rank, count(*) OVER (PARTITION BY run_id) AS n FROM population_view),
     el AS (SELECT run_id, ordinal, rank FROM rk WHERE rank <= least(n, greatest(2, CAST(round_even(n * 0.25, 0) AS BIGINT)))),
     hg AS (SELECT g.*, el.rank FROM genes_view g JOIN el USING (run_id, ordinal)),
     qn AS (SELECT run_id, name, quantile_cont(num, CAST(0.2 AS DOUBLE)) AS lo, quantile_cont(num, CAST(0.8 AS DOUBLE)) AS hi FROM hg WHERE num IS NOT NULL GROUP BY ALL),
     qs AS (SELECT qn.*, p.param_type, p.low AS base_low, p.high AS base_high, greatest(hi - lo, (p.high - p.low) * CAST(0.35 AS DOUBLE)) AS span FROM qn JOIN space p USING (name)),
     qb AS (SELECT run_id, name, param_type, greatest(base_low, 0.5 * (lo + hi) - 0.5 * span) AS low, least(base_high, 0.5 * (lo + hi) + 0.5 * span) AS high FROM qs),
     qc AS (SELECT run_id, name, cat, count(*) AS c, min(rank) AS f FROM hg WHERE cat IS NOT NULL GROUP BY ALL),
     nc AS (SELECT run_id, name, CASE WHEN param_type = 'discrete' THEN round_even(low, 0) ELSE low END AS low,
                   CASE WHEN param_type = 'discrete' THEN round_even(high, 0) ELSE high END AS high, NULL AS preferred FROM qb
            UNION ALL SELECT run_id, name, NULL, NULL, string_agg(cat, ',' ORDER BY c DESC, f) FROM qc GROUP BY run_id, name)"""


@check(
    "narrow_constraints",
    "run_id:long name:str low:dbl high:dbl preferred:str",
    f"WITH {SPACE_SQL}, {NARROW_SQL}\nSELECT * FROM nc",
    f"{POP} {GENES}",
)
def _(s):
    narrowed = ev.narrow_constraints(s.view(POP), s.view(GENES), SPACE, CONFIG)
    return narrowed.withColumn("preferred", F.array_join("preferred", ","))


@check(
    "apply_constraints",
    GENE,
    f"""
WITH {SPACE_SQL}, {LIMITS_SQL},
     j AS (SELECT g.*, l.low, l.high, l.preferred, p.param_type, p.low AS pl, p.high AS ph, p.choices, l.run_id IS NOT NULL AS known,
                  {u(SEED, 'constrain-gate', 'g.run_id', 'g.generation', 'g.ordinal', 'g.name')} AS gate,
                  {u(SEED, 'constrain', 'g.run_id', 'g.generation', 'g.ordinal', 'g.name')} AS u
             FROM genes_view g JOIN space p ON p.name = g.name LEFT JOIN lim l ON l.run_id = g.run_id AND l.name = g.name)
SELECT run_id, generation, ordinal, name,
       CASE WHEN known AND param_type = 'continuous' THEN greatest(low, least(high, num)) WHEN known AND param_type = 'discrete' THEN greatest(low, least(high, num)) ELSE num END AS num,
       CASE WHEN known AND param_type = 'categorical' AND NOT list_contains(preferred, cat) AND gate < 0.6 THEN {pick('u', 'preferred')} ELSE cat END AS cat FROM j
""",
    f"{POP} {GENES}",
)
def _(s):
    return ev.apply_constraints(s.view(GENES), limits(s), SPACE, 0.6, SEED)


TRAINING_SPACE = sp.Space((sp.Param("epochs", sp.DISCRETE, 1.0, 30.0),))
TRAINING_CONFIG = ev.EvolutionConfig(num_generations=10, late_training_bias=0.8, seed=SEED)


@check(
    "late_training_bias",
    "run_id:long generation:int ordinal:long num:dbl",
    f"""
WITH a AS (SELECT run_id, CAST(ordinal % 10 AS INTEGER) AS generation, ordinal, CAST(y AS DOUBLE) AS num FROM population_view),
     d AS (SELECT *, {u(SEED, 'epochs-gate', 'run_id', 'generation', 'ordinal')} < 0.8 * (generation / CAST(9 AS DOUBLE)) AS hit,
                  {u(SEED, 'epochs', 'run_id', 'generation', 'ordinal')} AS u FROM a)
SELECT *, CASE WHEN hit THEN num + floor(u * (30 - num + 1)) ELSE num END AS num FROM (SELECT run_id, generation, ordinal, hit, u, num FROM d) AS e
""".replace("SELECT *, CASE", "SELECT run_id, generation, ordinal, CASE"),
    POP,
)
def _(s):
    genes = s.view(POP).select(
        "run_id", (F.col("ordinal") % 10).cast("int").alias("generation"), "ordinal", F.lit("epochs").alias("name"),
        F.col("y").cast("double").alias("num"), F.lit(None).cast("string").alias("cat"),
    )
    return ev.late_training_bias(genes, TRAINING_SPACE, TRAINING_CONFIG)


@check(
    "inject_immigrants",
    GENE,
    f"""
WITH {SPACE_SQL}, {LIMITS_SQL},
     n AS (SELECT run_id, count(DISTINCT ordinal) AS size FROM genes_view GROUP BY run_id),
     k AS (SELECT genes_view.*, size - least(size, CAST(round_even(size * CAST(0.15 AS DOUBLE), 0) AS BIGINT)) AS first FROM genes_view JOIN n USING (run_id)),
     j AS (SELECT k.run_id, k.generation, k.ordinal, k.first, k.name, k.num, k.cat, p.param_type, p.choices, coalesce(l.low, p.low) AS low, coalesce(l.high, p.high) AS high, l.preferred,
                  {u(SEED, 'immigrant', 'k.run_id', 'k.generation', 'k.ordinal', 'k.name')} AS u,
                  {u(SEED, 'immigrant-gate', 'k.run_id', 'k.generation', 'k.ordinal', 'k.name')} AS g
             FROM k JOIN space p ON p.name = k.name LEFT JOIN lim l ON l.run_id = k.run_id AND l.name = k.name)
SELECT run_id, generation, ordinal, name, CASE WHEN ordinal < first THEN num WHEN param_type = 'continuous' THEN low + u * (high - low)
            WHEN param_type = 'discrete' THEN low + floor(u * (high - low + 1)) END AS num,
       CASE WHEN ordinal < first THEN cat WHEN param_type = 'categorical' THEN CASE WHEN preferred IS NOT NULL AND g < 0.6 THEN {pick('u', 'preferred')} ELSE {pick('u', 'choices')} END END AS cat FROM j
""",
    f"{POP} {GENES}",
)
def _(s):
    genes = s.view(GENES)
    sizes = genes.groupBy("run_id").agg(F.count_distinct("ordinal").alias("size"))
    return ev.inject_immigrants(genes.join(sizes, "run_id"), F.col("size"), 0.15, SPACE, limits(s), CONFIG)


@check(
    "dedupe_genomes",
    "run_id:long size:long distinct_genomes:long kept_first:long",
    """
WITH c AS (SELECT run_id, ordinal, floor(x / 4000) AS x, y % 3 AS y, z FROM population_view)
SELECT run_id, count(*) AS size, count(*) AS distinct_genomes, count(DISTINCT (x, y, z)) AS kept_first FROM c GROUP BY run_id
""",
    POP,
)
def _(s):
    coarse = s.view(GENES).withColumn(
        "num", F.when(F.col("name") == "x", F.floor(F.col("num") / 4000).cast("double")).otherwise(F.col("num") % 3)
    )
    unique = ev.dedupe_genomes(coarse, SPACE, limits(s), CONFIG)
    before = sp.genome_keys(coarse).select(*sp.CANDIDATE, F.col("genome_key").alias("old_key"))
    keys = sp.genome_keys(unique).join(before, sp.CANDIDATE)
    return keys.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("size"), F.count_distinct("genome_key").alias("distinct_genomes"),
        F.count_if(F.col("genome_key") == F.col("old_key")).alias("kept_first"),
    )


@check(
    "evolve",
    "run_id:long generation:int size:long distinct_genomes:long elites:long best_kept:dbl inside:long",
    "SELECT run_id, 1 AS generation, 40 AS size, 40 AS distinct_genomes, 2 AS elites, max(fitness) AS best_kept, 120 AS inside FROM population_view GROUP BY run_id",
    POP,
)
def _(s):
    first = cut_lineage(s.view(POP)).withColumn("origin", F.lit("initial"))
    population, genes = ps.evolve(first, cut_lineage(s.view(GENES)), SPACE, CONFIG)
    keys = sp.genome_keys(genes).join(population, sp.CANDIDATE)
    inside = genes.join(sp.clip_to_domain(genes, SPACE), [*sp.CANDIDATE, "name"]).groupBy("run_id").agg(F.count(F.lit(1)).alias("inside"))
    return keys.groupBy("run_id", "generation").agg(
        F.count(F.lit(1)).alias("size"), F.count_distinct("genome_key").alias("distinct_genomes"),
        F.count_if(F.col("origin") == "elite").alias("elites"), F.max("fitness").alias("best_kept"),
    ).join(inside, "run_id")


DONOR_SQL = f"""n AS (SELECT run_id, count(*) AS n FROM population_view GROUP BY run_id),
     t0 AS (SELECT p.run_id, p.ordinal AS target, n, {', '.join(f"{u(SEED, f'donor{i}', 'p.run_id', '0', 'p.ordinal')} AS u{i}" for i in range(3))}
              FROM population_view p JOIN n USING (run_id) WHERE n >= 4),
     t1 AS (SELECT *, {fl('u0 * (n - 1)')} AS a, {fl('u1 * (n - 2)')} AS b0, {fl('u2 * (n - 3)')} AS c0 FROM t0),
     t2 AS (SELECT *, b0 + CASE WHEN b0 >= a THEN 1 ELSE 0 END AS b FROM t1),
     t3 AS (SELECT *, c0 + CASE WHEN c0 >= least(a, b) THEN 1 ELSE 0 END AS c1 FROM t2),
     t4 AS (SELECT *, c1 + CASE WHEN c1 >= greatest(a, b) THEN 1 ELSE 0 END AS c FROM t3),
     t5 AS (SELECT run_id, target, a + CASE WHEN a >= target THEN 1 ELSE 0 END AS a, b + CASE WHEN b >= target THEN 1 ELSE 0 END AS b, c + CASE WHEN c >= target THEN 1 ELSE 0 END AS c FROM t4),
     t6 AS (SELECT t5.run_id, 0 AS generation, target AS ordinal, g.name, p.param_type, p.low, p.high, p.choices, p.position, ga.num AS na, gb.num AS nb, gc.num AS nc, g.num AS target_num, g.cat AS target_cat,
                   [ga.cat, gb.cat, gc.cat, g.cat] AS cats
              FROM t5 JOIN genes_view g ON g.run_id = t5.run_id AND g.ordinal = target JOIN space p ON p.name = g.name
                   JOIN genes_view ga ON ga.run_id = t5.run_id AND ga.ordinal = a AND ga.name = g.name
                   JOIN genes_view gb ON gb.run_id = t5.run_id AND gb.ordinal = b AND gb.name = g.name
                   JOIN genes_view gc ON gc.run_id = t5.run_id AND gc.ordinal = c AND gc.name = g.name),
     mt AS (SELECT run_id, generation, ordinal, name, param_type, low, high, position, target_num, target_cat, CASE WHEN param_type <> 'categorical' THEN {clip_sql('na + CAST(0.8 AS DOUBLE) * (nb - nc)', 't6')} END AS num,
                   CASE WHEN param_type = 'categorical' THEN {pick(u(SEED, 'donor-category', 'run_id', 'generation', 'ordinal', 'name'), 'cats')} END AS cat FROM t6)"""


def mutants(s):
    return st.de_mutant(s.view(POP), s.view(GENES), SPACE, 0.8, SEED)


@check("de_mutant", GENE, f"WITH {SPACE_SQL}, {DONOR_SQL}\nSELECT * FROM mt", f"{POP} {GENES}")
def _(s):
    return mutants(s)


@check(
    "de_trial",
    GENE,
    f"""WITH {SPACE_SQL}, {DONOR_SQL},
     tr AS (SELECT *, position = floor({u(SEED, 'forced', 'run_id', 'generation', 'ordinal')} * 3) OR {u(SEED, 'cross', 'run_id', 'generation', 'ordinal', 'name')} < CAST(0.9 AS DOUBLE) AS take FROM mt)
SELECT run_id, generation, ordinal, name, CASE WHEN take THEN num ELSE target_num END AS num, CASE WHEN take THEN cat ELSE target_cat END AS cat FROM tr""",
    f"{POP} {GENES}",
)
def _(s):
    return st.de_trial(mutants(s), SPACE, 0.9, SEED)


TRIAL_SQL = "SELECT *, floor(fitness * 100 + (ordinal * 7) % 5 - 2) / 100 AS trial FROM population_view"


def trials(s):
    trial = F.floor(F.col("fitness") * 100 + (F.col("ordinal") * 7) % 5 - 2) / 100
    return s.view(POP).withColumn("trial", trial)


@check(
    "de_replace",
    "run_id:long ordinal:long fitness:dbl replaced:bool",
    f"SELECT run_id, ordinal, CASE WHEN trial >= fitness THEN trial ELSE fitness END AS fitness, trial >= fitness AS replaced FROM ({TRIAL_SQL}) AS x",
    POP,
)
def _(s):
    results = trials(s).select(*sp.CANDIDATE, F.col("trial").alias("validation_accuracy"))
    return st.de_replace(s.view(POP), results)


TEMP_SQL = "greatest(CAST(0.01 AS DOUBLE), pow(CAST(0.995 AS DOUBLE), CAST(ordinal AS DOUBLE)))"


@check(
    "sa_neighbor",
    GENE,
    f"""
WITH {SPACE_SQL},
     d AS (SELECT g.*, p.param_type, p.low, p.high, p.choices, p.position = floor({u(SEED, 'which', 'g.run_id', 'g.generation', 'g.ordinal')} * 3) AS chosen,
                  {u(SEED, 'move-1', 'g.run_id', 'g.generation', 'g.ordinal')} AS a, {u(SEED, 'move-2', 'g.run_id', 'g.generation', 'g.ordinal')} AS b,
                  greatest({TEMP_SQL.replace('ordinal', 'g.ordinal')}, CAST(0.05 AS DOUBLE)) AS heat FROM genes_view g JOIN space p ON p.name = g.name),
     r AS (SELECT *, greatest(1, round_even(greatest(floor(high - low), 1) * CAST(0.2 AS DOUBLE) * heat, 0)) AS reach, list_filter(choices, lambda c: c <> cat) AS others FROM d),
     h AS (SELECT *, -reach + floor(a * (2 * reach + 1)) AS hop0 FROM r),
     k AS (SELECT *, CASE WHEN hop0 = 0 THEN CASE WHEN b < 0.5 THEN 1 ELSE -1 END ELSE hop0 END AS hop FROM h),
     v AS (SELECT *, CASE param_type WHEN 'continuous' THEN num + {normal_sql('a', 'b')} * ((high - low) * CAST(0.2 AS DOUBLE) * heat) ELSE num + hop END AS moved FROM k)
SELECT run_id, generation, ordinal, name, CASE WHEN chosen AND param_type <> 'categorical' THEN {clip_sql('moved', 'v')} ELSE num END AS num,
       CASE WHEN chosen AND param_type = 'categorical' THEN {pick('a', 'others')} ELSE cat END AS cat FROM v
""",
    GENES,
)
def _(s):
    return st.sa_neighbor(s.view(GENES), SPACE, st.temperature(F.col("ordinal"), 1.0, 0.995, 0.01), 0.2, SEED)


@check(
    "sa_accept",
    "run_id:long ordinal:long accepted:bool fitness:dbl best_fitness:dbl improved:bool",
    f"""
WITH d AS (SELECT *, trial - fitness AS delta, {TEMP_SQL} / 50 AS temp, fitness + CAST(0.005 AS DOUBLE) AS best FROM ({TRIAL_SQL}) AS x),
     a AS (SELECT *, delta >= 0 OR {u(SEED, 'accept', 'run_id', 'generation', 'ordinal')} < exp(delta / greatest(temp, CAST(1e-9 AS DOUBLE))) AS accepted FROM d)
SELECT run_id, ordinal, accepted, CASE WHEN accepted THEN trial ELSE fitness END AS fitness, greatest(best, trial) AS best_fitness, trial > best AS improved FROM a
""",
    POP,
)
def _(s):
    chains = trials(s).withColumnRenamed("trial", "candidate_fitness").withColumn("best_fitness", F.col("fitness") + 0.005)
    chains = chains.withColumn("best_before", F.col("best_fitness"))
    return st.sa_accept(chains, st.temperature(F.col("ordinal"), 1.0, 0.995, 0.01) / 50, SEED)


@check(
    "tpe_suggest",
    "run_id:long suggestions:long inside:long",
    "SELECT run_id, 8 AS suggestions, 24 AS inside FROM population_view GROUP BY run_id",
    POP,
)
def _(s):
    drawn = st.tpe_suggest(s.view(POP), s.view(GENES), SPACE, 8, SEED)
    fine = ((F.col("name") == "x") & F.col("num").between(-1000, 10000)) | (
        (F.col("name") == "y") & F.col("num").between(1, 10)
    ) | ((F.col("name") == "z") & F.col("cat").isin(*SEGMENTS))
    return drawn.groupBy("run_id").agg(F.count_distinct("ordinal").alias("suggestions"), F.count_if(fine).alias("inside"))


SCORER = e.ThresholdScorer("x", "text_len", "quality")
SCORE_SQL = "sum(CASE WHEN (d.text_len >= c.x) = (d.quality = 1) THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE)"


@check(
    "evaluate_candidates",
    "run_id:long ordinal:long validation_accuracy:dbl status:str",
    f"SELECT c.run_id, c.ordinal, {SCORE_SQL} AS validation_accuracy, 'COMPLETED' AS status FROM population_view c, eval_data_view d GROUP BY c.run_id, c.ordinal",
    f"{POP} eval_data_view",
)
def _(s):
    return e.evaluate_candidates(s.view(GENES), SPACE, SCORER, s.view("eval_data_view"))


@check(
    "expression_scores",
    "run_id:long ordinal:long validation_accuracy:dbl status:str",
    "SELECT run_id, ordinal, CASE WHEN x > 0 THEN ln(x) * y ELSE 0 END AS validation_accuracy, CASE WHEN x > 0 THEN 'COMPLETED' ELSE 'FAILED' END AS status FROM population_view",
    POP,
)
def _(s):
    scorer = e.ExpressionScorer(lambda: F.log("x") * F.col("y"))
    return e.evaluate_candidates(s.view(GENES), SPACE, scorer)


@check(
    "assign_fitness",
    "run_id:long ordinal:long fitness:dbl",
    "SELECT run_id, ordinal, CASE WHEN ordinal % 5 = 0 THEN fitness WHEN ordinal % 3 = 0 THEN 0 ELSE x / 10000 END AS fitness FROM population_view",
    POP,
)
def _(s):
    population = s.view(POP)
    results = population.filter("ordinal % 5 <> 0").select(
        *sp.CANDIDATE, (F.col("x") / 10000).alias("validation_accuracy"),
        F.when(F.col("ordinal") % 3 == 0, "FAILED").otherwise("COMPLETED").alias("status"),
    )
    return ev.assign_fitness(population, results)


@check(
    "apply_budget",
    "run_id:long generation:int",
    """
WITH b AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY generation) AS n,
                  coalesce(sum(wall_clock_ms) OVER (PARTITION BY run_id ORDER BY generation ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM generation_metrics_view)
SELECT run_id, generation FROM b WHERE n <= 50 AND spent < 9000000
""",
    "generation_metrics_view",
)
def _(s):
    return e.apply_budget(s.view("generation_metrics_view"), ["run_id"], "generation", 50, 9_000_000)


@check(
    "prefix_subset",
    "doc_id:long lang:str",
    "SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM eval_data_view) AS x WHERE n <= CASE lang WHEN 'en' THEN 50 WHEN 'fr' THEN 1000000 ELSE 20 END",
    "eval_data_view",
)
def _(s):
    rows = s.view("eval_data_view")
    limits_ = rows.select("lang").distinct().withColumn(
        "limit", F.when(F.col("lang") == "en", 50).when(F.col("lang") == "fr", 0).otherwise(20)
    )
    return e.prefix_subset(rows, ["lang"], "doc_id", limits_)


RULE_SPACE = sp.Space((sp.Param("x", sp.CONTINUOUS, 0.0, 20000.0), sp.Param("z", sp.CATEGORICAL, choices=("a", "b"))))
BEST = "max(f) OVER (PARTITION BY run_id ORDER BY generation ROWS UNBOUNDED PRECEDING)"


@check(
    "random_search",
    "run_id:long generation:long avg_fitness:dbl best_so_far:dbl",
    f"""
WITH r AS (SELECT DISTINCT run_id FROM population_view), k AS (SELECT run_id, i AS ordinal FROM r, range(0, 40) AS g(i)),
     c AS (SELECT *, 20000 * {u(SEED, 'sample', 'run_id', '0', 'ordinal', "'x'")} AS x FROM k),
     v AS (SELECT c.run_id, c.ordinal AS generation, {SCORE_SQL} AS f FROM c, eval_data_view d GROUP BY c.run_id, c.ordinal)
SELECT run_id, generation, f AS avg_fitness, {BEST} AS best_so_far FROM v
""",
    f"{POP} eval_data_view",
)
def _(s):
    runs = s.view(POP).select("run_id").distinct()
    return ps.random_search(runs, RULE_SPACE, SEED, 40, SCORER, s.view("eval_data_view"))


@check(
    "grid_search",
    "run_id:long generation:long avg_fitness:dbl best_so_far:dbl",
    f"""
WITH c AS (SELECT 0 AS run_id, i AS ordinal, (i // 2) * (CAST(20000 AS DOUBLE) / 19) AS x FROM range(0, 31) AS g(i)),
     v AS (SELECT c.run_id, c.ordinal AS generation, {SCORE_SQL} AS f FROM c, eval_data_view d GROUP BY c.run_id, c.ordinal)
SELECT run_id, generation, f AS avg_fitness, {BEST} AS best_so_far FROM v
""",
    "eval_data_view",
)
def _(s):
    return ps.grid_search(s.spark, RULE_SPACE, 20, 31, SCORER, s.view("eval_data_view"))


@check(
    "resume_evaluation",
    "run_id:long ordinal:long fitness:dbl source:str",
    f"""
WITH v AS (SELECT c.run_id, c.ordinal, {SCORE_SQL} AS f FROM population_view c, eval_data_view d GROUP BY c.run_id, c.ordinal)
SELECT run_id, ordinal, CASE WHEN ordinal % 3 = 1 THEN 0.25 WHEN ordinal % 3 = 2 THEN 0 ELSE f END AS fitness,
       CASE WHEN ordinal % 3 = 0 THEN 'evaluated' ELSE 'stored' END AS source FROM v
""",
    f"{POP} eval_data_view",
)
def _(s):
    genes = s.view(GENES)
    stored = sp.genome_keys(genes).filter("ordinal % 3 <> 0").select(
        F.concat_ws("/", *sp.CANDIDATE).alias("request_key"), "genome_key",
        F.when(F.col("ordinal") % 3 == 1, 0.25).alias("fitness"),
    )
    return e.resume_evaluation(genes, SPACE, SCORER, s.view("eval_data_view"), stored)


def search_runs(s):
    return s.view(POP).select("run_id").distinct()


@check("run_search", "run_id:long generation:int size:long best_fitness:dbl best_so_far:dbl avg_fitness:dbl reheated:bool")
def _(s):
    config = ev.EvolutionConfig(population_size=12, num_generations=3, narrowing_start=1, seed=SEED)
    return ps.run_search(search_runs(s), RULE_SPACE, config, SCORER, s.view("eval_data_view"))


@check("parzen_search", "run_id:long generation:long avg_fitness:dbl best_so_far:dbl")
def _(s):
    return ps.parzen_search(search_runs(s), RULE_SPACE, SEED, 8, 2, SCORER, s.view("eval_data_view"))


@check("benchmark_matrix", "run_name:str seed:long generation:long avg_fitness:dbl best_so_far:dbl")
def _(s):
    return ps.benchmark_matrix(s.spark, RULE_SPACE, [42, 43, 44], 5, SCORER, s.view("eval_data_view"))
