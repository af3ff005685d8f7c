"""Table evolution and positional operations: add, remove, reorder, retype, skip, zip, compare, combine."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .encode import numbered

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def positions(df: DataFrame, series: Sequence[str], order: Sequence[str], name: str = "pos", chunk: Column | None = None) -> DataFrame:
    """df with each row's place in its series; `chunk` cuts long series, as for the encoders."""
    return numbered(df, series, order, chunk).withColumnRenamed("pos", name)


def skip(df: DataFrame, series: Sequence[str], order: Sequence[str], count: int, chunk: Column | None = None) -> DataFrame:
    """Rows behind the first `count` of each series."""
    return positions(df, series, order, "__pos", chunk).filter(F.col("__pos") >= count).drop("__pos")


def add_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    if name in df.columns:
        raise ValueError(f"there is a column {name}")
    return df.withColumn(name, value)


def add_values(df: DataFrame, name: str, values: DataFrame, series: Sequence[str], order: Sequence[str], value: str, value_order: Sequence[str], offset: int = 0, chunk: Column | None = None, value_chunk: Column | None = None) -> DataFrame:
    """df with a last column of values that stand at the same places of their series, from place `offset` on.

    Fewer values than rows in a series are an error when the result is read; further values are left out.
    """
    if name in df.columns:
        raise ValueError(f"there is a column {name}")
    rows = positions(df, series, order, "__pos", chunk)
    own = positions(values.select(*series, *value_order, F.col(value).alias("__value")), series, value_order, "__pos", value_chunk)
    found = own.select(*series, (F.col("__pos") - offset).alias("__pos"), F.struct("__value").alias("__found"))
    joined = rows.join(found, [*series, "__pos"], "left")
    checked = F.when(F.col("__found").isNull(), F.raise_error(F.lit(f"{name} has fewer values than rows"))).otherwise(F.col("__found.__value"))
    return joined.select(*df.columns, checked.cast(values.schema[value].dataType).alias(name))


def positional_zip(left: DataFrame, right: DataFrame, series: Sequence[str], left_order: Sequence[str], right_order: Sequence[str], left_chunk: Column | None = None, right_chunk: Column | None = None) -> DataFrame:
    """Rows of both sides at equal places of their series. The other columns' names must differ."""
    a, b = positions(left, series, left_order, chunk=left_chunk), positions(right, series, right_order, chunk=right_chunk)
    return a.join(b, [*series, "pos"])


def remove_column(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        raise ValueError(f"no column {name}")
    return df.drop(name)


def reorder_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns in this order; a part of the columns is a projection."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no columns {missing}")
    return df.select(*names)


def change_type(df: DataFrame, name: str, kind: str) -> DataFrame:
    """A checked conversion: overflow is an error, and a real becomes the nearest whole number, halves the even one."""
    target, source = T._parse_datatype_string(kind), df.schema[name].dataType
    real = isinstance(source, (T.DoubleType, T.FloatType, T.DecimalType))
    value = F.rint(F.col(name)) if real and isinstance(target, _WHOLE) else F.col(name)
    return df.withColumn(name, value.cast(target))


def recompress(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """Write df at path under a Parquet codec (none, gzip, lz4, snappy, zstd), and read it."""
    df.write.mode("overwrite").option("compression", {"nocompress": "none", "zlib": "gzip"}.get(codec, codec)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def first_difference(left: DataFrame, right: DataFrame, series: Sequence[str], order: Sequence[str], value: str, chunk: Column | None = None) -> DataFrame:
    """(series, pos): the first place where two sides differ or one has ended; series without a difference aren't there."""
    a = positions(left, series, order, chunk=chunk).select(*series, "pos", F.struct(F.col(value).alias("v")).alias("a"))
    b = positions(right, series, order, chunk=chunk).select(*series, "pos", F.struct(F.col(value).alias("v")).alias("b"))
    return a.join(b, [*series, "pos"], "full").filter(~F.col("a").eqNullSafe(F.col("b"))).groupBy(*series).agg(F.min("pos").alias("pos"))


def combinations(dimensions: dict[str, DataFrame], keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Every choice of one row of each dimension (small, one column each), with `n`, its number in odometer order, the last fastest."""
    numbered = []
    for name, df in dimensions.items():
        w = Window.orderBy(df.columns[0])
        numbered.append(df.select(F.col(df.columns[0]).alias(name), (F.row_number().over(w) - 1).alias(f"__{name}")))
    out = reduce(lambda a, b: a.crossJoin(b), numbered)
    if keep:
        out = keep(out)
    place = F.row_number().over(Window.orderBy(*(f"__{n}" for n in dimensions))) - 1
    return out.withColumn("n", place.cast("bigint")).select("n", *dimensions)


def permutations(items: DataFrame, length: int, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Distinct sequences of `length` of the items (id, item), each id used once; equal items give equal sequences, once.

    keep filters partial sequences (`picked`), which saves what would grow from them.
    """
    out = items.sparkSession.range(1).select(F.array().cast("array<bigint>").alias("ids"), F.array().cast(T.ArrayType(items.schema["item"].dataType)).alias("picked"))
    own = items.select(F.col("id").cast("bigint").alias("id"), "item")
    for _ in range(length):
        out = out.join(own, ~F.array_contains("ids", F.col("id"))).select(F.array_append("ids", F.col("id")).alias("ids"), F.array_append("picked", F.col("item")).alias("picked"))
        if keep:
            out = keep(out)
    return out.select("picked").distinct()


def rank_candidates(df: DataFrame, within: Sequence[str], by: Sequence[Column]) -> DataFrame:
    """df with `rank`: 1 for the best of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(*by)))


def encoding_gain(sizes: DataFrame, within: Sequence[str], label: str, size: str, base: str, seconds: str | None = None) -> DataFrame:
    """sizes with `gain`: size relative to the row labelled base in the same group, less 1; with `seconds` also `speed_gain`: the base row's time relative to the own, less 1."""
    bases = sizes.filter(F.col(label) == base).select(*within, F.col(size).alias("__base"), *([F.col(seconds).alias("__time")] if seconds else []))
    out = sizes.join(bases, [*within]).withColumn("gain", F.col(size) / F.col("__base") - 1)
    return (out.withColumn("speed_gain", F.col("__time") / F.col(seconds) - 1).drop("__time") if seconds else out).drop("__base")


def friendly_name(kind: T.DataType) -> str:
    """A type's name for people: the plain name, with its parts in angle brackets."""
    name = type(kind).__name__.removesuffix("Type")
    parts = [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [kind.keyType, kind.valueType] if isinstance(kind, T.MapType) else [kind.elementType] if isinstance(kind, T.ArrayType) else []
    return f"{name}<{', '.join(map(friendly_name, parts))}>" if parts else name


def friendly_names(df: DataFrame) -> DataFrame:
    """(place, name, type) of each column."""
    return df.sparkSession.createDataFrame([(i, f.name, friendly_name(f.dataType)) for i, f in enumerate(df.schema.fields)], "place int, name string, type string")


def page_statistics(df: DataFrame, series: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """(series, n_rows, first_value, last_value, min_value, max_value)"""
    key = F.struct(*order)
    return df.groupBy(*series).agg(F.count("*").alias("n_rows"), F.min_by(value, key).alias("first_value"), F.max_by(value, key).alias("last_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))


def series_filter(df: DataFrame, column: str, ids: Sequence) -> DataFrame:
    """Rows of some series; on a table partitioned or sorted by the column, the scan skips the others."""
    return df.filter(F.col(column).isin(*ids))


def definition_frame(spark: SparkSession, rows: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rows), "type string, bits string, encoding string, compression string")
