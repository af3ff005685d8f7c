"""Sequence encoders and decoders as window expressions over a series key and a total order.

The value before a series' first row is 0, and a null counts as 0 (the stored forms have no nulls). Sums and differences wrap
modulo 2**bits, bits being those of the encoded type. Encoders of one series share one window, so that Spark sorts it once. A long
series can be cut into chunks (`chunk`: a column that never falls along the order): chunks are numbered and sorted apart,
and a small table of the chunks' counts and last values carries each one's start, so no task has to hold a series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.bits import double_bits, float_bits, halves, joined_halves, unzigzag, wrapping_add, wrapping_subtract, zigzag

FRAME = 16


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def numbered(df: DataFrame, series: Sequence[str], order: Sequence[str], chunk: Column | None = None) -> DataFrame:
    """df with `pos` (0, 1, ... in each series)."""
    if chunk is None:
        return df.withColumn("pos", F.row_number().over(Window.partitionBy(*series).orderBy(*order)).cast("bigint") - 1)
    base = df.withColumn("__chunk", chunk)
    before = Window.partitionBy(*series).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = base.groupBy(*series, "__chunk").agg(F.count("*").alias("__n"))
    starts = counts.select(*series, "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy(*series, "__chunk").orderBy(*order))
    return base.join(starts, [*series, "__chunk"]).withColumn("pos", F.col("__start") + place - 1).drop("__chunk", "__start")


def sequenced(df: DataFrame, series: Sequence[str], order: Sequence[str], value: str, chunk: Column | None = None) -> DataFrame:
    """df with `pos` (0, 1, ... in each series) and `prev` (the value before, 0 at the start)."""
    zero = F.lit(0).cast(df.schema[value].dataType)
    own = F.coalesce(F.col(value), zero)
    if chunk is None:
        w = Window.partitionBy(*series).orderBy(*order)
        return df.withColumns({"pos": F.row_number().over(w).cast("bigint") - 1, "prev": F.lag(own, 1, 0).over(w)})
    base = df.withColumn("__chunk", chunk)
    ends = base.groupBy(*series, "__chunk").agg(F.count("*").alias("__n"), F.max_by(own, F.struct(*order)).alias("__last"))
    over = Window.partitionBy(*series).orderBy("__chunk")
    starts = ends.select(*series, "__chunk", F.coalesce(F.sum("__n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"), F.coalesce(F.lag("__last").over(over), zero).alias("__carry"))
    w = Window.partitionBy(*series, "__chunk").orderBy(*order)
    joined = base.join(starts, [*series, "__chunk"])
    place, before = F.row_number().over(w), F.lag(own).over(w)
    return joined.withColumns({"pos": F.col("__start") + place - 1, "prev": F.when(place == 1, F.col("__carry")).otherwise(before)}).drop("__chunk", "__start", "__carry")


def delta(df: DataFrame, series: Sequence[str], order: Sequence[str], value: str, chunk: Column | None = None, bits: int = 64) -> DataFrame:
    """df with `delta` and `delta_zigzag`, the value minus the one before modulo 2**bits, signed and as zigzag."""
    placed = sequenced(df, series, order, value, chunk)
    own = F.coalesce(F.col(value), F.lit(0)).cast("bigint")
    out = placed.withColumn("delta", wrapping_subtract(own, F.col("prev").cast("bigint"), bits))
    return out.withColumn("delta_zigzag", zigzag(F.col("delta"), bits))


def running(series: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*series).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running_sum(df: DataFrame, series: Sequence[str], order: Sequence[str], step: Column, out: str, chunk: Column | None = None, bits: int = 64, unsigned: bool = False) -> DataFrame:
    """df with the sum of a bigint step over a series up to each row, modulo 2**bits."""
    high, low = halves(step)
    if chunk is None:
        w = running(series, order)
        return df.withColumn(out, joined_halves(F.sum(high).over(w), F.sum(low).over(w), bits, unsigned))
    base = df.withColumns({"__chunk": chunk, "__high": high, "__low": low})
    before = Window.partitionBy(*series).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = base.groupBy(*series, "__chunk").agg(F.sum("__high").alias("__h"), F.sum("__low").alias("__l"))
    starts = ends.select(*series, "__chunk", F.coalesce(F.sum("__h").over(before), F.lit(0)).alias("__h"), F.coalesce(F.sum("__l").over(before), F.lit(0)).alias("__l"))
    w = running([*series, "__chunk"], order)
    summed = base.join(starts, [*series, "__chunk"]).withColumn(out, joined_halves(F.col("__h") + F.sum("__high").over(w), F.col("__l") + F.sum("__low").over(w), bits, unsigned))
    return summed.drop("__chunk", "__high", "__low", "__h", "__l")


def delta_decode(df: DataFrame, series: Sequence[str], order: Sequence[str], encoded: str, zigzagged: bool = False, chunk: Column | None = None, bits: int = 64, unsigned: bool = False) -> DataFrame:
    """df with `decoded`, the running sum of deltas."""
    step = unzigzag(F.col(encoded)) if zigzagged else F.col(encoded).cast("bigint")
    return running_sum(df, series, order, step, "decoded", chunk, bits, unsigned)


def delta_delta(df: DataFrame, series: Sequence[str], order: Sequence[str], value: str, unsigned: bool = False, chunk: Column | None = None, bits: int = 64) -> DataFrame:
    """df with `frame`, `frame_min` and `encoded`: in frames of 16 rows, deltas above the frame's least delta.

    A frame of fewer rows has a least delta of 0 and keeps its deltas. Unsigned deltas are zigzagged first and compared
    without sign.
    """
    out = delta(df, series, order, value, chunk, bits).withColumn("frame", F.floor(F.col("pos") / FRAME).cast("bigint"))
    step = F.col("delta_zigzag" if unsigned else "delta")
    w = Window.partitionBy(*series, "frame")
    flip = F.lit(-(2**63)).cast("bigint")
    least = F.min(step.bitwiseXOR(flip)).over(w).bitwiseXOR(flip) if unsigned else F.min(step).over(w)
    out = out.withColumn("frame_min", F.when(F.count(F.lit(1)).over(w) == FRAME, least).otherwise(F.lit(0).cast("bigint")))
    return out.withColumn("encoded", wrapping_subtract(step, F.col("frame_min"), bits, unsigned))


def delta_delta_decode(df: DataFrame, series: Sequence[str], order: Sequence[str], unsigned: bool = False, chunk: Column | None = None, bits: int = 64) -> DataFrame:
    """df, with `encoded` and `frame_min` of each row, and `decoded`."""
    step = wrapping_add(F.col("encoded"), F.col("frame_min"), bits, unsigned)
    return running_sum(df, series, order, unzigzag(step) if unsigned else step, "decoded", chunk, bits, unsigned and bits < 64)


def delta_delta_stream(encoded: DataFrame, series: Sequence[str]) -> DataFrame:
    """The stored values of delta_delta's frames: at place 0 of each the least delta, then its rows' values."""
    rows = encoded.select(*series, "frame", (F.col("pos") % FRAME + 1).cast("int").alias("place"), F.col("encoded").alias("stored"))
    heads = encoded.filter(F.col("pos") % FRAME == 0).select(*series, "frame", F.lit(0).alias("place"), F.col("frame_min").alias("stored"))
    return rows.unionByName(heads)


def xor(df: DataFrame, series: Sequence[str], order: Sequence[str], value: str, real: bool = False, chunk: Column | None = None, bits: int = 64) -> DataFrame:
    """df with `encoded`: an integer's bits, or with real those of a double (of a float, with 32 bits), xor those of the value before."""
    if real and bits == 32:
        own = float_bits(F.coalesce(F.col(value).cast("float"), F.lit(0.0).cast("float"))).cast("bigint")
    elif real:
        own = double_bits(F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
    else:
        own = F.coalesce(F.col(value).cast("bigint"), F.lit(0).cast("bigint"))
    source = df.withColumn("bits", own if bits == 64 else own.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")))
    return sequenced(source, series, order, "bits", chunk).withColumn("encoded", F.col("bits").bitwiseXOR(F.col("prev")))


def xor_decode(df: DataFrame, series: Sequence[str], order: Sequence[str], encoded: str = "encoded") -> DataFrame:
    return df.withColumn("decoded", F.bit_xor(encoded).over(running(series, order)))


def zero_runs(df: DataFrame, series: Sequence[str], order: Sequence[str], value: str, longest: int = 114, chunk: Column | None = None) -> DataFrame:
    """(series, run, zeros, codes): runs of zeros in order, and the run-length codes that they take, `longest` zeros each. A null is a zero."""
    flag = F.coalesce(F.col(value) == 0, F.lit(True))
    placed = numbered(df.select(*df.columns, flag.alias("__zero"), *([chunk.alias("__part")] if chunk is not None else [])), series, order, chunk)
    part = None if chunk is None else F.col("__part")
    # A row's number less the zeros up to it is the same for all zeros of a run.
    counted = running_sum(placed, series, order, F.col("__zero").cast("bigint"), "__zeros", part)
    runs = counted.filter("__zero").groupBy(*series, (F.col("pos") + 1 - F.col("__zeros")).cast("bigint").alias("run")).agg(F.count("*").alias("zeros"))
    return runs.withColumn("codes", F.ceil(F.col("zeros") / longest).cast("bigint"))


def bit_pack(df: DataFrame, series: Sequence[str], order: Sequence[str], value: str, bits: int, chunk: Column | None = None) -> DataFrame:
    """(series, word, packed): values of 1, 2, 4, 8 or 16 bits in 32-bit words, the first in the lowest bits. A null is 0."""
    per = 32 // bits
    own = F.coalesce(F.col(value).cast("bigint"), F.lit(0).cast("bigint")).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
    placed = numbered(df, series, order, chunk).select(*series, F.col("pos").alias("p"), own.alias("v"))
    power = F.call_function("shiftleft", F.col("v"), (F.col("p") % per * bits).cast("int"))
    return placed.groupBy(*series, F.floor(F.col("p") / per).cast("bigint").alias("word")).agg(F.sum(power).alias("packed"))


def bit_unpack(packed: DataFrame, series: Sequence[str], bits: int, counts: DataFrame) -> DataFrame:
    """(series, pos, value) of bit_pack's words; counts: (series, items), since the last word may be part full."""
    per = 32 // bits
    each = packed.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per - 1)))).withColumn("pos", F.col("word") * per + F.col("k"))
    value = F.call_function("shiftright", F.col("packed"), (F.col("k") * bits).cast("int")).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
    return each.join(counts, [*series]).filter("pos < items").select(*series, "pos", value.alias("value"))
