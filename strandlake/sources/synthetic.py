"""Synthetic columns over spark.range: each takes `id` and gives an expression. Seeds make the random ones repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows whose running sums one task makes; sums of whole blocks carry over.
BLOCK = 1 << 20


def const(value) -> Column:
    return F.lit(value)


def random(seed: int) -> Column:
    return F.rand(seed)


def gaussian(seed: int, mu: float = 0.0, sigma: float = 1.0) -> Column:
    return F.randn(seed) * sigma + mu


def steady_growing(growth: float, steps: int) -> Column:
    """growth more at every `steps` rows."""
    return F.floor(F.col("id") / steps).cast("double") * growth


def repeating_pattern(n: int, seed: int) -> Column:
    """n values in [0, 1), over and over: each is a hash of its place and the seed."""
    return F.shiftrightunsigned(F.xxhash64(F.col("id") % n, F.lit(seed)), 11).cast("double") / float(1 << 53)


def geometric_steps(p: float, step: float, seed: int) -> Column:
    """step, and once more with probability p, again and again."""
    return (F.floor(F.ln(F.lit(1.0) - F.rand(seed)) / F.ln(F.lit(p))) + 1) * step


def running_sum(df: DataFrame, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """df (with id) and the running sum of value by id, block by block."""
    base = df.withColumn("__b", F.floor(F.col("id") / block))
    sums = base.groupBy("__b").agg(F.sum(value).alias("__s"))
    starts = sums.select("__b", F.coalesce(F.sum("__s").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("__start"))
    own = F.sum(value).over(Window.partitionBy("__b").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    return base.join(starts, "__b").withColumn(out, F.col("__start") + own).drop("__b", "__start")


def random_walk(spark: SparkSession, rows: int, mu: float, sigma: float, seed: int) -> DataFrame:
    return running_sum(spark.range(rows).withColumn("step", gaussian(seed, mu, sigma)), "step", "value").drop("step")


def randomly_growing(spark: SparkSession, rows: int, p: float, step: float, seed: int) -> DataFrame:
    return running_sum(spark.range(rows).withColumn("step", geometric_steps(p, step, seed)), "step", "value").drop("step")


def finite_set(spark: SparkSession, rows: int, p: float, n: int, seed: int) -> DataFrame:
    """A category in [0, n) that stays with probability p: the number of changes so far picks it."""
    changed = spark.range(rows).withColumn("step", (F.rand(seed) >= p).cast("double"))
    return running_sum(changed, "step", "run").select("id", F.pmod(F.xxhash64(F.col("run"), F.lit(seed)), F.lit(n)).cast("int").alias("value"))


#: Patterns by family; a name in brackets tells the parameter. RandomWalk, RandomlyGrowing and FiniteSet are sums over the rows before.
_WHOLE_PATTERNS = (("Constant",), ("Random",), ("RandomWalk", 1), ("RandomWalk_(x10)", 10), ("FiniteSet_(2)", 2), ("FiniteSet_(10)", 10), ("FiniteSet_(100)", 100), ("Pattern_(2)", 2), ("Pattern_(10)", 10), ("Pattern_(100)", 100), ("SteadyGrowth", 1), ("SlowRandomGrowth", 0.05, 10), ("FastRandomGrowth", 0.5, 10))
_REAL_PATTERNS = (("Constant",), ("Random",), ("RandomWalk", 0.01), ("RandomWalk_(x10)", 0.1), *_WHOLE_PATTERNS[4:10], ("SteadyGrowth", 0.1), ("SteadyGrowth_(int)", 1), ("SlowRandomGrowth", 0.05, 0.1), ("FastRandomGrowth", 0.5, 0.1), ("SlowRandomGrowth_(int)", 0.05, 10), ("FastRandomGrowth_(int)", 0.5, 10))
_TIME_PATTERNS = (("SteadyGrowth", 1), ("SlowRandomGrowth", 0.05, 1), ("FastRandomGrowth", 0.5, 1))
_TYPES = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "float": "float", "double": "double", "decimal": "decimal(38,10)"}


def benchmark_columns() -> list[tuple[str, str, tuple]]:
    """(name, type, pattern) of the synthetic table's 56 columns."""
    sets = [(f"{kind}_FiniteSet(100)", kind, ("FiniteSet_(100)", 100)) for kind in _TYPES]
    families = (("d", "double", _REAL_PATTERNS), ("dt", "datetime", _TIME_PATTERNS), ("uint32", "uint32", _WHOLE_PATTERNS), ("uint64", "uint64", _WHOLE_PATTERNS))
    return sets + [(f"{prefix}_{p[0]}", kind, p) for prefix, kind, patterns in families for p in patterns]


def benchmark_table(spark: SparkSession, rows: int = 1_000_000, seed: int = 1) -> DataFrame:
    """id and the 56 synthetic columns, each with a seed of its own.

    Walks, growths and finite sets are running sums: all of them are summed block by block in one window, and a small table
    of the blocks' sums carries each block's start. Values outside a type's range wrap into it.
    """
    steps, values = {}, {}
    for k, (name, kind, (pattern, *numbers)) in enumerate(benchmark_columns()):
        own, column = seed * 1000 + k, F.col(f"`__{k}`")
        if pattern == "Constant":
            value = F.lit(42.0)
        elif pattern == "Random":
            value = F.rand(own)
        elif pattern.startswith("Pattern"):
            value = repeating_pattern(numbers[0], own)
        elif pattern.startswith("SteadyGrowth"):
            value = F.col("id").cast("double") * numbers[0]
        elif pattern.startswith("RandomWalk"):
            steps[k], value = gaussian(own, 0.0, numbers[0]), column
        elif pattern.startswith("FiniteSet"):
            steps[k], value = (F.rand(own) < 0.05).cast("double"), F.pmod(F.xxhash64(column, F.lit(own)), F.lit(numbers[0])).cast("double")
        else:
            steps[k], value = geometric_steps(numbers[0], numbers[1], own), column
        values[name] = _typed(value, kind, pattern)
    base = spark.range(rows).withColumns({f"__s{k}": v for k, v in steps.items()}).withColumn("__b", F.floor(F.col("id") / BLOCK))
    sums = base.groupBy("__b").agg(*[F.sum(f"__s{k}").alias(f"__t{k}") for k in steps])
    before, within = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("__b").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    starts = sums.select("__b", *[F.coalesce(F.sum(f"__t{k}").over(before), F.lit(0.0)).alias(f"__u{k}") for k in steps])
    summed = base.join(starts, "__b").select("id", *[(F.col(f"__u{k}") + F.sum(f"__s{k}").over(within)).alias(f"__{k}") for k in steps])
    return summed.select("id", *[v.alias(name) for name, v in values.items()])


def _typed(value: Column, kind: str, pattern: str) -> Column:
    if kind == "datetime":
        return F.timestamp_add("MICROSECOND", F.floor(value * 1_000_000).cast("bigint"), F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"))
    if kind.startswith("uint") and (pattern == "Random" or pattern.startswith("Pattern")):  # the whole range of the type
        value = value * float((1 << int(kind[4:])) - 1)
    elif kind.startswith("uint") and pattern.startswith("RandomWalk"):
        value = value + 10000
    elif kind.startswith("int"):
        value = value - 50
    if kind == "uint64":
        return F.pmod(F.floor(value).cast("decimal(38,0)"), F.lit(str(1 << 64)).cast("decimal(38,0)")).cast("decimal(20,0)")
    if kind.startswith("uint"):
        return F.pmod(F.floor(value).cast("bigint"), F.lit(1 << int(kind[4:]))).cast(_TYPES[kind])
    return (F.floor(value) if kind.startswith("int") else value).cast(_TYPES[kind])
