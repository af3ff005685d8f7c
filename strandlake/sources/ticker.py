"""Ticker documents: JSON with a coin and rows of [ms, cap, btc, (platform,) usd, volume], one a file or one a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "coin struct<ID: bigint, Name: struct<Name: string, Symbol: string>>, will_need_requery boolean, format array<string>, Data array<array<double>>, _bad string"
FIELDS = ("MarketCapByAvailableSupply", "PriceBTC", "PricePlatform", "PriceUSD", "VolumeUSD")


def read_ticker(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, path of each document that doesn't parse). Documents marked as unfinished are skipped; a layout without platform has 0 there.

    A file is one document over any number of lines. Opening it costs some ms, so with `lines` each line is one: files then
    hold any number of documents and are read in splits.
    """
    raw = spark.read.schema(SCHEMA).option("multiLine", not lines).option("columnNameOfCorruptRecord", "_bad").json(path).withColumn("path", F.col("_metadata.file_path"))
    bad = raw.filter(F.col("_bad").isNotNull() | F.col("Data").isNull()).select("path")
    good = raw.filter(F.col("_bad").isNull() & F.col("Data").isNotNull() & ~F.coalesce("will_need_requery", F.lit(False)))
    rows = good.select(F.col("coin.ID").alias("CoinID"), F.col("coin.Name.Symbol").alias("Symbol"), F.explode("Data").alias("r"))
    wide = F.size("r") >= 6
    get = lambda i: F.get("r", i)
    values = [get(1), get(2), F.when(wide, get(3)).otherwise(0.0), F.when(wide, get(4)).otherwise(get(3)), F.when(wide, get(5)).otherwise(get(4))]
    return rows.select("CoinID", "Symbol", unix_ms(get(0).cast("bigint")).alias("Timestamp"), *[v.alias(n) for v, n in zip(values, FIELDS)]), bad


def unix_ms(ms):
    """UTC time of milliseconds since 1970, as a timestamp without zone."""
    return F.timestamp_add("MILLISECOND", ms, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
