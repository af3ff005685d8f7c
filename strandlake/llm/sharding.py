"""Sharding by weighted rendezvous hashing of a stable record key, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows that one slot bucket holds on average; buckets grow in number with the table.
BUCKET_ROWS = 50_000
#: Length of one run of slots; repeated rows are counted, not carried, until slots are dealt.
RUN = 4096


def rendezvous(key: Column, weights: Sequence[float]) -> list[Column]:
    """A struct (score, shard) for each shard; the greatest wins. One more shard adds one more rival and changes no other score.

    The score is -weight / ln(u) for a hash u of (key, shard) in (0, 1): shards win in proportion to their weights. A null
    key hashes like any other value.
    """
    out = []
    for shard, weight in enumerate(weights):
        if not weight > 0:
            raise ValueError("weights must be above 0")
        unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        out.append(F.struct((F.lit(-float(weight)) / F.ln(unit)).alias("score"), F.lit(shard).alias("shard")))
    return out


def winner(scores: list[Column]) -> Column:
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"].cast("int")


def assign(docs: DataFrame, key: str, text: str, weights: Sequence[float], next_weight: float = 1.0) -> DataFrame:
    """One row per row of docs: key, size, text_crc32, shard, grown_shard (with one more shard of next_weight), slot.

    Slots number each shard's rows from 0 without gaps, in an order fixed by hashes of key and text. Null text has no
    bytes; null keys share one shard, as any repeated key does; repeated rows get slots of their own. An empty table gives
    an empty one. Other columns of docs, whatever their names, are not read.

    Slots are dealt by buckets of a shard: rows of a bucket are numbered in their own task, and a small table of the
    buckets' counts gives where each begins. Equal rows are counted before the shuffle.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    scores = rendezvous(F.col(f"`{key}`"), list(weights) + [next_weight])
    rows = docs.select(
        F.col(f"`{key}`").alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        winner(scores[:-1]).alias("shard"), winner(scores).alias("grown_shard"),
    )
    place = F.xxhash64("key", "size", "text_crc32")
    # Texts are read once: what follows takes a few numbers of each row from a table of its own.
    counted = written(rows.groupBy("key", "size", "text_crc32", "shard", "grown_shard").agg(F.count("*").alias("times")), "counted")
    total = counted.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(total / BUCKET_ROWS / len(weights)))
    counted = counted.withColumn("place", place).withColumn("bucket", F.pmod("place", F.lit(buckets)).cast("int"))
    totals = counted.groupBy("shard", "bucket").agg(F.sum("times").alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = totals.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("begin"))
    within = Window.partitionBy("shard", "bucket").orderBy("place", "key", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    numbered = counted.withColumn("offset", F.coalesce(F.sum("times").over(within), F.lit(0))).join(begins, ["shard", "bucket"])
    first = F.col("begin") + F.col("offset")
    runs = numbered.withColumn("run", F.explode(F.sequence(first, first + F.col("times") - 1, F.lit(RUN).cast("long"))))
    slots = runs.withColumn("slot", F.explode(F.sequence("run", F.least(F.col("run") + (RUN - 1), first + F.col("times") - 1))))
    return slots.select("key", "size", "text_crc32", "shard", "grown_shard", "slot")
