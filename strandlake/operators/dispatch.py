"""The encoder of a column definition: chosen by its type, bits and encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.plans.schema import ColumnDef

from . import encode as E
from .stateful import dfcm, dfcm_decode

#: Signed types; times count in microseconds here.
_SIGNED = {"int8", "int16", "int32", "int64", "datetime", "timespan"}
_REAL = {"float", "double"}
_TEMPORARY = ("pos", "prev", "bits", "delta", "delta_zigzag", "frame")


def encoded(df: DataFrame, definition: ColumnDef, series: Sequence[str], order: Sequence[str], out: str, chunk: Column | None = None) -> DataFrame:
    """df with `out`, the column's codes (and `out`_min, a frame's least delta, for DeltaDelta).

    Whole numbers of any width, times and reals as the definition says; DFCM needs a chunk in `series` to bound its tasks.
    """
    name, bits, kind = definition.name, int(definition.bits), definition.encoding
    signed = definition.type in _SIGNED
    if kind == "None":
        return df.withColumn(out, F.col(name))
    if kind == "Dfcm":
        keys = [*series, *order]
        return df.join(dfcm(df, series, order, name, bits).withColumnRenamed("encoded", out), keys)
    if kind == "Xor":
        found = E.xor(df, series, order, name, definition.type in _REAL, chunk, bits).withColumnRenamed("encoded", out)
    elif kind == "Delta":
        found = E.delta(df, series, order, name, chunk, bits).withColumn(out, F.col("delta" if signed else "delta_zigzag"))
    elif kind == "DeltaDelta":
        found = E.delta_delta(df, series, order, name, not signed, chunk, bits).withColumnsRenamed({"encoded": out, "frame_min": f"{out}_min"})
    else:
        raise ValueError(f"no encoding {kind}")
    return found.drop(*_TEMPORARY)


def decoded(df: DataFrame, definition: ColumnDef, series: Sequence[str], order: Sequence[str], codes: str, out: str, chunk: Column | None = None) -> DataFrame:
    """df with `out`, the values (bit patterns, of reals under Xor) that the codes of `encoded` give."""
    bits, kind, signed = int(definition.bits), definition.encoding, definition.type in _SIGNED
    if kind == "None":
        return df.withColumn(out, F.col(codes))
    if kind == "Dfcm":
        return df.join(dfcm_decode(df, series, order, codes, bits).withColumnRenamed("decoded", out), [*series, *order])
    if kind == "Xor":
        found = E.xor_decode(df, series, order, codes)
    elif kind == "Delta":
        found = E.delta_decode(df, series, order, codes, not signed, chunk, bits, not signed and bits < 64)
    elif kind == "DeltaDelta":
        found = E.delta_delta_decode(df.withColumns({"encoded": F.col(codes), "frame_min": F.col(f"{codes}_min")}), series, order, not signed, chunk, bits).drop("encoded", "frame_min")
    else:
        raise ValueError(f"no encoding {kind}")
    return found.withColumnRenamed("decoded", out)
