"""Search spaces and candidate generation.

A space is a short ordered list of parameters, so it travels inside the plan as an array or map
literal. Genomes are long tables ``(run_id, generation, ordinal, name, num, cat)``: numbers in
``num``, categories in ``cat``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.functions import draws
from tunelake.functions.scalars import clamp, half_even
from tunelake.operators.scans import slots

CANDIDATE = ["run_id", "generation", "ordinal"]
CONTINUOUS, DISCRETE, CATEGORICAL = "continuous", "discrete", "categorical"
PARAM_SCHEMA = (
    "ordinal int, name string, param_type string, low double, high double, choices array<string>, log_scale boolean"
)


@dataclass(frozen=True)
class Param:
    name: str
    param_type: str
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] = ()
    log_scale: bool = False

    def __post_init__(self) -> None:
        if self.param_type == CATEGORICAL and not self.choices:
            raise ValueError(f"{self.name}: a categorical parameter needs choices")
        if self.param_type != CATEGORICAL and (self.low is None or self.high is None):
            raise ValueError(f"{self.name}: a numeric parameter needs both bounds")

    def grid(self, points: int) -> list[float] | list[str]:
        """Values of a linear grid; every choice of a category."""
        if self.param_type == CATEGORICAL:
            return list(self.choices)
        gaps = max(points - 1, 1)
        if self.param_type == CONTINUOUS:
            step = (self.high - self.low) / gaps
            return [self.low + i * step for i in range(points)]
        step = max(1, int((self.high - self.low) / gaps))
        return [float(v) for v in range(int(self.low), int(self.high) + 1, step)][:points]


@dataclass(frozen=True)
class Space:
    params: tuple[Param, ...]

    def names(self) -> list[str]:
        return [p.name for p in self.params]

    def get(self, name: str) -> Param:
        for param in self.params:
            if param.name == name:
                return param
        raise KeyError(name)

    def _structs(self) -> list[Column]:
        return [
            F.struct(
                F.lit(i).alias("position"),
                F.lit(p.name).alias("name"),
                F.lit(p.param_type).alias("param_type"),
                F.lit(p.low).cast("double").alias("low"),
                F.lit(p.high).cast("double").alias("high"),
                F.array(*[F.lit(c) for c in p.choices]).cast("array<string>").alias("choices"),
                F.lit(p.log_scale).alias("log_scale"),
            )
            for i, p in enumerate(self.params)
        ]

    def expand(self) -> Column:
        """One row per parameter."""
        return F.explode(F.array(*self._structs()))

    def of(self, name: Column) -> Column:
        """Parameter struct of a gene name; null for names outside the space."""
        pairs = [item for p, s in zip(self.params, self._structs()) for item in (F.lit(p.name), s)]
        return F.try_element_at(F.create_map(*pairs), name)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i, p.name, p.param_type, p.low, p.high, list(p.choices) or None, p.log_scale)
            for i, p in enumerate(self.params)
        ]
        return spark.createDataFrame(rows, PARAM_SCHEMA)

    @staticmethod
    def from_table(table: DataFrame) -> Space:
        """Space of a parameter table; a space is a model that the driver holds, whatever its length."""
        rows = table.orderBy("ordinal").collect()
        return Space(
            tuple(
                Param(r.name, r.param_type, r.low, r.high, tuple(r.choices or ()), bool(r.log_scale)) for r in rows
            )
        )


# The two predefined spaces.
DEFAULT_SPACE = Space(
    (
        Param("learning_rate", CONTINUOUS, 1e-5, 1e-1, log_scale=True),
        Param("batch_size", CATEGORICAL, choices=("16", "32", "64", "128", "256")),
        Param("optimizer", CATEGORICAL, choices=("sgd", "adam", "rmsprop", "adamw")),
        Param("conv_filters_1", DISCRETE, 16.0, 128.0),
        Param("conv_filters_2", DISCRETE, 32.0, 256.0),
        Param("conv_filters_3", DISCRETE, 64.0, 512.0),
        Param("kernel_size", CATEGORICAL, choices=("3", "5")),
        Param("dense_units_1", DISCRETE, 64.0, 512.0),
        Param("dropout_rate", CONTINUOUS, 0.0, 0.5),
        Param("activation", CATEGORICAL, choices=("relu", "elu", "selu", "swish")),
        Param("epochs", DISCRETE, 5.0, 30.0),
    )
)
STRESS_SPACE = Space(
    (
        Param("learning_rate", CONTINUOUS, 1e-4, 1e-1, log_scale=True),
        Param("batch_size", CATEGORICAL, choices=("64", "128", "256")),
        Param("optimizer", CATEGORICAL, choices=("sgd", "adam", "rmsprop", "adamw")),
        Param("conv_filters_1", DISCRETE, 8.0, 32.0),
        Param("conv_filters_2", DISCRETE, 16.0, 64.0),
        Param("conv_filters_3", DISCRETE, 16.0, 64.0),
        Param("kernel_size", CATEGORICAL, choices=("3",)),
        Param("dense_units_1", DISCRETE, 32.0, 128.0),
        Param("dropout_rate", CONTINUOUS, 0.0, 0.5),
        Param("activation", CATEGORICAL, choices=("relu", "elu", "selu", "swish")),
        Param("epochs", CATEGORICAL, choices=("1", "2")),
    )
)


def validate_space(table: DataFrame) -> DataFrame:
    """Parameters that lack what their type needs."""
    numeric = F.col("param_type").isin(CONTINUOUS, DISCRETE)
    problem = (
        F.when(numeric & (F.col("low").isNull() | F.col("high").isNull()), "a numeric parameter lacks a bound")
        .when((F.col("param_type") == CATEGORICAL) & (F.coalesce(F.size("choices"), F.lit(0)) <= 0),
              "a categorical parameter lacks choices")
        .when(~numeric & (F.col("param_type") != CATEGORICAL), "unknown parameter type")
    )
    return table.withColumn("problem", problem).filter("problem IS NOT NULL")


def unknown_names(requested: DataFrame, table: DataFrame) -> DataFrame:
    """Requested parameter names that the space does not have."""
    return requested.join(table.select("name"), "name", "left_anti")


def clip_number(value: Column, param: Column) -> Column:
    """Number moved into its parameter's domain; discrete values are rounded half to even first."""
    whole = clamp(half_even(value), F.floor(param["low"]), F.floor(param["high"]))
    return F.when(param["param_type"] == DISCRETE, whole.cast("double")).otherwise(
        clamp(value, param["low"], param["high"])
    )


def clip_category(value: Column, param: Column) -> Column:
    """Unknown categories become the first choice."""
    return F.when(F.array_contains(param["choices"], value), value).otherwise(F.get(param["choices"], 0))


def clip_to_domain(genes: DataFrame, space: Space) -> DataFrame:
    param = space.of(F.col("name"))
    numeric = param["param_type"] != CATEGORICAL
    return genes.withColumn("num", F.when(numeric, clip_number(F.col("num"), param))).withColumn(
        "cat", F.when(~numeric, clip_category(F.col("cat"), param))
    )


def sample_number(param: Column, low: Column, high: Column, draw: Column) -> Column:
    """Uniform, log-uniform or whole draw between two bounds; reversed bounds are swapped."""
    first, last = F.least(low, high), F.greatest(low, high)
    floor_low = F.greatest(first, F.lit(1e-12))
    floor_high = F.greatest(last, floor_low + F.lit(1e-12))
    log_draw = F.exp(F.log(floor_low) + draw * (F.log(floor_high) - F.log(floor_low)))
    whole = draws.integer(draw, half_even(first), half_even(last)).cast("double")
    plain = first + draw * (last - first)
    return (
        F.when(param["param_type"] == DISCRETE, whole)
        .when(param["log_scale"], log_draw)
        .otherwise(plain)
    )


def sample_category(param: Column, preferred: Column | None, bias: float, pick: Column, gate: Column) -> Column:
    """Uniform choice; with preferred categories, one of those with the bias as probability.

    When every choice is preferred the draw is always among the preferred ones, in their order.
    """
    plain = draws.choice(pick, param["choices"])
    if preferred is None:
        return plain
    supported = F.filter(F.coalesce(preferred, F.array().cast("array<string>")),
                         lambda c: F.array_contains(param["choices"], c))
    count = F.size(supported)
    prefer = (count > 0) & ((count == F.size(param["choices"])) | (gate < F.lit(min(max(bias, 0.0), 1.0))))
    return F.when(prefer, draws.choice(pick, supported)).otherwise(plain)


def random_genes(
    candidates: DataFrame, space: Space, seed: int, purpose: str, bias: float = 0.6, extra: tuple[str, ...] = ()
) -> DataFrame:
    """Fresh genes for candidate rows; a ``constraints`` map column narrows the draws.

    ``extra`` names further columns that key the draws, such as an attempt number.
    """
    rows = candidates.withColumn("p", space.expand())
    param = F.col("p")
    key = [F.col(c) for c in (*CANDIDATE, *extra)] + [param["name"]]
    draw, gate = draws.uniform(seed, purpose, *key), draws.uniform(seed, f"{purpose}-gate", *key)
    low, high, preferred = param["low"], param["high"], None
    if "constraints" in candidates.columns:
        limit = F.try_element_at(F.col("constraints"), param["name"])
        low, high = F.coalesce(limit["low"], low), F.coalesce(limit["high"], high)
        preferred = limit["preferred"]
    numeric = param["param_type"] != CATEGORICAL
    return rows.select(
        *CANDIDATE,
        *extra,
        param["name"].alias("name"),
        F.when(numeric, sample_number(param, low, high, draw)).alias("num"),
        F.when(~numeric, sample_category(param, preferred, bias, draw, gate)).alias("cat"),
    )


def random_candidates(runs: DataFrame, space: Space, seed: int, generation: int = 0) -> DataFrame:
    """Genes of ``n`` random candidates for every ``(run_id, n)`` row."""
    rows = slots(runs, F.col("n"), "ordinal").select("run_id", F.lit(generation).alias("generation"), "ordinal")
    return random_genes(rows, space, seed, "sample")


def constrained_candidates(
    runs: DataFrame, space: Space, constraints: DataFrame, seed: int, generation: int = 0, bias: float = 0.6
) -> DataFrame:
    """Random candidates inside each run's narrowed bounds and preferred categories."""
    narrowed = runs.join(constraint_map(constraints), "run_id", "left")
    rows = slots(narrowed, F.col("n"), "ordinal").select(
        "run_id", F.lit(generation).alias("generation"), "ordinal", "constraints"
    )
    return random_genes(rows, space, seed, "sample", bias)


def constraint_map(constraints: DataFrame) -> DataFrame:
    """One row per run: parameter name to its narrowed limits."""
    limit = F.struct("low", "high", "preferred")
    return constraints.groupBy("run_id").agg(
        F.map_from_entries(F.collect_list(F.struct("name", limit))).alias("constraints")
    )


def with_defaults(genes: DataFrame, space: Space, dataset: str, epochs: int = 10) -> DataFrame:
    """Add the data set gene and, when the space has none, the default epochs."""
    fixed = [("dataset", None, dataset)] + ([] if "epochs" in space.names() else [("epochs", float(epochs), None)])
    one = genes.filter(F.col("name") == space.params[0].name)
    added = [
        one.select(
            *CANDIDATE,
            F.lit(name).alias("name"),
            F.lit(num).cast("double").alias("num"),
            F.lit(cat).cast("string").alias("cat"),
        )
        for name, num, cat in fixed
    ]
    base = genes.filter(F.col("name") != "dataset").select(*CANDIDATE, "name", "num", "cat")
    for rows in added:
        base = base.unionByName(rows)
    return base


def grid_size(space: Space, points: int) -> int:
    size = 1
    for param in space.params:
        size *= len(param.grid(points))
    return size


def grid_candidates(
    spark: SparkSession, space: Space, points: int, budget: int, run_id: int = 0, runs: DataFrame | None = None
) -> DataFrame:
    """First ``budget`` points of the grid in parameter order, the last parameter running fastest, for one run or each of ``runs``.

    Each row number is decoded into one index per parameter, so the work follows the budget
    and not the size of the full product.
    """
    values = [param.grid(points) for param in space.params]
    weight, weights = 1, []
    for options in reversed(values):
        weights.append(weight)
        weight *= len(options)
    weights.reverse()
    each = spark.range(1).select(F.lit(run_id).cast("long").alias("run_id")) if runs is None else runs.select("run_id")
    rows = slots(each, F.lit(min(budget, weight)), "ordinal").select("run_id", F.lit(0).alias("generation"), "ordinal")
    genes = []
    for param, options, step in zip(space.params, values, weights):
        # A step beyond the 64-bit range leaves the index at its first value for any row.
        digit = F.lit(0) if step >= 1 << 62 else F.expr(f"CAST((ordinal DIV {step}) % {len(options)} AS INT)")
        picked = F.get(F.array(*[F.lit(v) for v in options]), digit)
        is_text = param.param_type == CATEGORICAL
        genes.append(
            F.struct(
                F.lit(param.name).alias("name"),
                (F.lit(None) if is_text else picked).cast("double").alias("num"),
                (picked if is_text else F.lit(None)).cast("string").alias("cat"),
            )
        )
    return rows.select(*CANDIDATE, F.explode(F.array(*genes)).alias("g")).select(*CANDIDATE, "g.*")


def genome_keys(genes: DataFrame, keys: list[str] | None = None, seed_offset: int = 0) -> DataFrame:
    """Canonical text, its hash key and a derived positive seed of every genome.

    The text lists the genes by name; numbers print in shortest form, whole numbers without a
    fraction, and non-finite numbers by name.
    """
    keys = keys or CANDIDATE
    whole = (F.col("num") == F.floor("num")) & (F.abs("num") < F.lit(1e15))
    number = F.when(whole, F.col("num").cast("long").cast("string")).otherwise(F.col("num").cast("string"))
    value = F.coalesce(number, F.col("cat"), F.lit("null"))
    text = F.array_join(F.array_sort(F.collect_list(F.concat("name", F.lit("="), value))), ",")
    keyed = genes.groupBy(*keys).agg(text.alias("genome_text")).withColumn("genome_key", F.sha2("genome_text", 256))
    # Fixed value: seeds are taken modulo the largest 32-bit signed integer.
    base = F.conv(F.substring("genome_key", 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(2147483647).cast("decimal(20,0)")
    seed = (base.cast("long") + seed_offset) % 2147483647
    return keyed.withColumn("genome_seed", F.greatest(seed, F.lit(1).cast("long")))


# Wire numbers of optimizers and activations.
OPTIMIZER_NUMBER = {"sgd": 1, "adam": 2, "rmsprop": 3, "adamw": 4}
ACTIVATION_NUMBER = {"relu": 1, "elu": 2, "selu": 3, "tanh": 4, "swish": 5}


def _number_of(names: dict[str, int], value: Column, default: int) -> Column:
    pairs = [F.lit(item) for pair in names.items() for item in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), F.lit(default))


def _name_of(names: dict[str, int], value: Column, default: str) -> Column:
    pairs = [F.lit(item) for name, number in names.items() for item in (number, name)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), F.lit(default))


def genome_to_config(genes: DataFrame) -> DataFrame:
    """One configuration struct per candidate, missing genes filled with defaults.

    Genes move to their candidate before they are sorted: a scan of few bytes can give many genes, and sorting
    them in the task that reads them takes memory as the input grows. A shuffled part has a bounded size.
    """

    def gene(name: str, kind: str, default: object) -> Column:
        value = F.max(F.when(F.col("name") == name, F.coalesce(F.col("num").cast("string"), F.col("cat"))))
        typed = value.try_cast("double").cast("int") if kind == "int" else value.try_cast(kind)
        return F.coalesce(typed, F.lit(default))

    wide = genes.repartition(*CANDIDATE).groupBy(*CANDIDATE).agg(
        F.struct(
            gene("learning_rate", "double", 0.001).alias("learning_rate"),
            gene("batch_size", "int", 32).alias("batch_size"),
            _number_of(OPTIMIZER_NUMBER, gene("optimizer", "string", "adam"), 2).alias("optimizer"),
            F.array(
                gene("conv_filters_1", "int", 32), gene("conv_filters_2", "int", 64), gene("conv_filters_3", "int", 128)
            ).alias("conv_filters"),
            gene("kernel_size", "int", 3).alias("kernel_size"),
            F.array(gene("dense_units_1", "int", 128)).alias("dense_units"),
            gene("dropout_rate", "double", 0.25).alias("dropout_rate"),
            _number_of(ACTIVATION_NUMBER, gene("activation", "string", "relu"), 1).alias("activation"),
            gene("epochs", "int", 10).alias("epochs"),
            gene("dataset", "string", "mnist").alias("dataset"),
        ).alias("config")
    )
    return wide


def config_to_genome(configs: DataFrame) -> DataFrame:
    """Long genes of configuration structs; unset fields read as their defaults."""
    c = F.col("config")

    def set_or(value: Column, default: object) -> Column:
        return F.when(value.isNull() | (value.cast("string").isin("0", "")), F.lit(default)).otherwise(value)

    def row(name: str, num: Column | None = None, cat: Column | None = None) -> Column:
        none = F.lit(None)
        return F.struct(
            F.lit(name).alias("name"),
            (none if num is None else num).cast("double").alias("num"),
            (none if cat is None else cat).cast("string").alias("cat"),
        )

    filters = [
        row(f"conv_filters_{i + 1}", F.coalesce(F.get(c["conv_filters"], i), F.lit(default)))
        for i, default in enumerate((32, 64, 128))
    ]
    genes = F.array(
        row("learning_rate", c["learning_rate"]),
        row("batch_size", None, c["batch_size"]),
        row("optimizer", None, _name_of(OPTIMIZER_NUMBER, c["optimizer"], "adam")),
        *filters,
        row("kernel_size", None, set_or(c["kernel_size"], 3)),
        row("dense_units_1", F.coalesce(F.get(c["dense_units"], 0), F.lit(128))),
        row("dropout_rate", c["dropout_rate"]),
        row("activation", None, _name_of(ACTIVATION_NUMBER, c["activation"], "relu")),
        row("epochs", set_or(c["epochs"], 10)),
        row("dataset", None, set_or(c["dataset"], "mnist")),
    )
    return configs.select(*CANDIDATE, F.explode(genes).alias("g")).select(*CANDIDATE, "g.*")


def search_space_table(spark: SparkSession) -> DataFrame:
    """Both predefined spaces as rows."""
    default = DEFAULT_SPACE.table(spark).withColumn("space_id", F.lit("default"))
    return default.unionByName(STRESS_SPACE.table(spark).withColumn("space_id", F.lit("stress")))
