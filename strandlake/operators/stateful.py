"""Encoders that must see a series row by row: the DFCM predictor and byte-exact codec streams."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .codec import CODECS, WORD, Dfcm, read_var_size, var_size


def _by_series(df: DataFrame, series: Sequence[str], order: Sequence[str], value: str, work, fields: list[T.StructField]) -> DataFrame:
    """work(sorted table) for each series, on only the columns that it needs."""
    schema = T.StructType([*(df.schema[c] for c in series), *fields])

    def run(table: pa.Table) -> pa.Table:
        return work(table.sort_by([(c, "ascending") for c in order]))

    return df.select(*dict.fromkeys([*series, *order, value])).groupBy(*series).applyInArrow(run, schema)


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


_REAL = {64: ("<d", "<Q"), 32: ("<f", "<I")}


def dfcm(df: DataFrame, series: Sequence[str], order: Sequence[str], value: str, bits: int = 64) -> DataFrame:
    """series, order and `encoded` (bigint bit patterns) of doubles, or with 32 bits of floats. A null counts as 0.

    Rows of a series are one sequence; to bound a task, put a chunk column into `series`: each chunk starts afresh.
    """
    real, whole = _REAL[bits]

    def work(table: pa.Table) -> pa.Table:
        patterns = [struct.unpack(whole, struct.pack(real, v or 0.0))[0] for v in table.column(value).to_pylist()]
        codes = pa.array(map(_signed, Dfcm(bits).encode(patterns)), pa.int64())
        return pa.table({**{c: table.column(c) for c in [*series, *order]}, "encoded": codes})

    return _by_series(df, series, order, value, work, [*(df.schema[c] for c in order), T.StructField("encoded", T.LongType())])


def dfcm_decode(df: DataFrame, series: Sequence[str], order: Sequence[str], encoded: str = "encoded", bits: int = 64) -> DataFrame:
    """series, order and `decoded` (double) from the codes alone."""
    real, whole = _REAL[bits]

    def work(table: pa.Table) -> pa.Table:
        codes = [c & ((1 << bits) - 1) for c in table.column(encoded).to_pylist()]
        back = pa.array([struct.unpack(real, struct.pack(whole, v))[0] for v in Dfcm(bits).decode(codes)], pa.float64())
        return pa.table({**{c: table.column(c) for c in [*series, *order]}, "decoded": back})

    return _by_series(df, series, order, encoded, work, [*(df.schema[c] for c in order), T.StructField("decoded", T.DoubleType())])


def codec_stream(df: DataFrame, series: Sequence[str], order: Sequence[str], value: str, codec: str) -> DataFrame:
    """series, `items`, `size` and `data`: the codec's bytes over the series' bigint bit patterns in order; a null counts as 0."""
    mask = (1 << 32) - 1 if codec == "u32" else WORD

    def work(table: pa.Table) -> pa.Table:
        data = CODECS[codec].encode([(v or 0) & mask for v in table.column(value).to_pylist()])
        return pa.table({**{c: table.column(c).slice(0, 1) for c in series}, "items": pa.array([len(table)], pa.int64()), "size": pa.array([len(data)], pa.int64()), "data": pa.array([data], pa.binary())})

    return _by_series(df, series, order, value, work, [T.StructField("items", T.LongType()), T.StructField("size", T.LongType()), T.StructField("data", T.BinaryType())])


def codec_values(streams: DataFrame, series: Sequence[str], codec: str) -> DataFrame:
    """series, `pos` and `value` of each item of codec_stream's streams."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                values = [_signed(v) for v in CODECS[codec].decode(batch.column(len(series))[i].as_py())]
                keys = [pa.array([batch.column(k)[i].as_py()] * len(values), batch.column(k).type) for k in range(len(series))]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(range(len(values)), pa.int64()), pa.array(values, pa.int64())], [*series, "pos", "value"])

    schema = T.StructType([*(streams.schema[c] for c in series), T.StructField("pos", T.LongType()), T.StructField("value", T.LongType())])
    return streams.select(*series, "data").mapInArrow(run, schema)


def var_size_stream(df: DataFrame, series: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """series, `items`, `size` and `data`: texts with their lengths; a null stays apart from an empty text."""

    def work(table: pa.Table) -> pa.Table:
        data = b"".join(map(var_size, table.column(value).cast(pa.binary()).to_pylist()))
        return pa.table({**{c: table.column(c).slice(0, 1) for c in series}, "items": pa.array([len(table)], pa.int64()), "size": pa.array([len(data)], pa.int64()), "data": pa.array([data], pa.binary())})

    return _by_series(df, series, order, value, work, [T.StructField("items", T.LongType()), T.StructField("size", T.LongType()), T.StructField("data", T.BinaryType())])


def var_size_values(data: bytes) -> list[bytes | None]:
    out, at = [], 0
    while at < len(data):
        v, at = read_var_size(data, at)
        out.append(v)
    return out


def compressed_sizes(streams: DataFrame, series: Sequence[str]) -> DataFrame:
    """streams with `nocompress`, `zlib` and `zstd`: bytes of `data` under each block compression (zstd where it is installed)."""

    def run(batches):
        try:
            import zstandard

            zstd = zstandard.ZstdCompressor(3).compress
        except ImportError:
            zstd = None
        for batch in batches:
            data = batch.column(len(series)).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(series))), pa.array(map(len, data), pa.int64()), pa.array([len(gzip.compress(d, 1)) for d in data], pa.int64()), pa.array([len(zstd(d)) if zstd else None for d in data], pa.int64())],
                [*series, "nocompress", "zlib", "zstd"],
            )

    schema = T.StructType([*(streams.schema[c] for c in series), *(T.StructField(n, T.LongType()) for n in ("nocompress", "zlib", "zstd"))])
    return streams.select(*series, F.col("data")).mapInArrow(run, schema)
