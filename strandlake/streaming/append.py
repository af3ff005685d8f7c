"""Incremental append of series: encoder state kept between micro-batches, and resume by batch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "series bigint, ordinal bigint, value bigint, delta bigint, pos bigint, late boolean"
#: Of all series of a bucket: four rows of 64-bit numbers, which are the series in order, and their last value, number of rows and last ordinal.
STATE = "series binary"
#: Series are dealt into so many groups, since a group costs Python a few ms whatever is in it. Checkpoints hang on the number.
BUCKETS = 1024


def _continue(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    known = np.frombuffer(bytes(state.get[0]), np.int64).reshape(4, -1) if state.exists else np.empty((4, 0), np.int64)
    series, ordinal, value = np.concatenate([b[["series", "ordinal", "value"]].to_numpy(np.int64) for b in batches]).T
    order = np.lexsort((value, ordinal, series))
    series, ordinal, value = series[order], ordinal[order], value[order]
    ids = np.union1d(known[0], series)
    last, pos, seen = np.zeros_like(ids), np.zeros_like(ids), np.full_like(ids, -(2**63))
    place = np.searchsorted(ids, known[0])
    last[place], pos[place], seen[place] = known[1:]
    own = np.searchsorted(ids, series)
    late = ordinal < seen[own]  # their place in the codes is past: they are handed on without one
    now = np.flatnonzero(~late)
    delta, at = np.zeros_like(value), np.zeros_like(value)
    if len(now):
        s, v = own[now], value[now]
        starts = np.flatnonzero(np.diff(s, prepend=-1))
        ends, first = np.append(starts[1:], len(s)) - 1, s[starts]
        before = np.concatenate([v[:1], v[:-1]])
        before[starts] = last[first]
        with np.errstate(over="ignore"):
            delta[now] = v - before  # wraps, as all deltas do
        lengths = ends - starts + 1
        at[now] = np.arange(len(s)) - np.repeat(starts - pos[first], lengths)
        last[first], seen[first] = v[ends], ordinal[now][ends]
        pos[first] += lengths
    yield pd.DataFrame({"series": series, "ordinal": ordinal, "value": value, "delta": pd.arrays.IntegerArray(delta, late), "pos": pd.arrays.IntegerArray(at, late.copy()), "late": late})
    state.update((np.stack([ids, last, pos, seen]).tobytes(),))


def delta_stream(stream: DataFrame) -> DataFrame:
    """Deltas of a stream of (series, ordinal, value), all bigint: each series goes on where its last batch ended.

    The state of a series is its last value, its number of rows and its last ordinal. No row is lost: rows of equal ordinals
    all get codes, by value; a row below the last ordinal comes too late for one and is handed on as `late`, without delta
    and place. A null value counts as 0, null ordinals and series are one of their own each. Series are coded by buckets of
    them, all series of a bucket at once.
    """
    clean = stream.select(F.coalesce("series", F.lit(-(2**63))).alias("series"), F.coalesce("ordinal", F.lit(-(2**63))).alias("ordinal"), F.coalesce("value", F.lit(0).cast("bigint")).alias("value"))
    return clean.withColumn("bucket", F.pmod(F.xxhash64("series"), F.lit(BUCKETS))).groupBy("bucket").applyInPandasWithState(_continue, OUT, STATE, "append", "NoTimeout")


def append_sink(stream: DataFrame, path: str, checkpoint: str):
    """A file sink whose commit log makes each batch whole or absent."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def resume(stored: DataFrame, incoming: DataFrame, series: Sequence[str], order: str) -> DataFrame:
    """Rows of incoming behind each series' last stored place: what an append after a break still has to write.

    With no series, the place is that of the whole table: its one greatest value is found by a partial maximum, and no row
    is shuffled.
    """
    if not series:
        end = stored.agg(F.max(order).alias("__end"))
        return incoming.crossJoin(F.broadcast(end)).filter(F.col("__end").isNull() | (F.col(order) > F.col("__end"))).drop("__end")
    ends = stored.groupBy(*series).agg(F.max(order).alias("__end"))
    return incoming.join(ends, [*series], "left").filter(F.col("__end").isNull() | (F.col(order) > F.col("__end"))).drop("__end")


def observed(df: DataFrame, name: str) -> DataFrame:
    """df with row counts reported to listeners as it is read."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"))
