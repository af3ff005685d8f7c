"""Binary pages as a source and a sink: one page for each series, or each chunk of one."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.operators.encode import micros
from strandlake.operators.pagefile import PageError, append_page, copy_columns, dump_channels, read_header, read_page, write_page
from strandlake.plans.schema import Series

#: Rows that one page holds at most, if `paged` deals a series out.
STRIPE = 25_000


def paged(df: DataFrame, series: Sequence[str], order: Sequence[str], rows: int = STRIPE, chunk: Column | None = None) -> DataFrame:
    """df with `page`: 0, 1, ... for each `rows` rows of a series, so that no page outgrows a task."""
    from strandlake.operators.table import positions

    return positions(df, series, order, "__pos", chunk).withColumn("page", F.floor(F.col("__pos") / rows).cast("bigint")).drop("__pos")


def to_pages(df: DataFrame, definition: Series, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(keys, n_rows, content): a page of each group's rows in order. Times are timestamps without zone."""
    names = [c.name or f"_c{i}" for i, c in enumerate(definition.columns)]
    times = [n for n, c in zip(names, definition.columns) if c.type == "datetime"]
    source = df.withColumns({f"__{n}": micros(F.col(n)) if n in times else F.col(n) for n in names})
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("n_rows", T.LongType()), T.StructField("content", T.BinaryType())])
    text = str(definition)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        data = write_page(Series.parse(text), [table.column(f"__{n}").to_pylist() for n in names])
        return pa.table({**{k: table.column(k).slice(0, 1) for k in keys}, "n_rows": pa.array([len(table)], pa.int64()), "content": pa.array([data], pa.binary())})

    return source.select(*dict.fromkeys([*keys, *order, *(f"__{n}" for n in names)])).groupBy(*keys).applyInArrow(run, schema)


def from_pages(pages: DataFrame, definition: Series, keys: Sequence[str] = (), columns: Sequence[str] | None = None, content: str = "content") -> DataFrame:
    """(keys, pos, columns) of every row of the pages; columns that aren't asked for are not decoded."""
    fields = [f for f in definition.spark_schema().fields if columns is None or f.name in columns]
    kinds = {c.name or f"_c{i}": c.type for i, c in enumerate(definition.columns)}
    times = [f.name for f in fields if kinds[f.name] == "datetime"]
    arrow = T.StructType([*(pages.schema[k] for k in keys), T.StructField("pos", T.LongType()), *(T.StructField(f.name, T.LongType() if f.name in times else f.dataType) for f in fields)])
    from pyspark.sql.pandas.types import to_arrow_type

    types = {f.name: to_arrow_type(f.dataType) for f in arrow.fields}

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                _, rows, values = read_page(batch.column(len(keys))[i].as_py(), [f.name for f in fields])
                head = [pa.array([batch.column(k)[i].as_py()] * rows, batch.column(k).type) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*head, pa.array(range(rows), pa.int64()), *(pa.array(values[f.name], types[f.name]) for f in fields)], arrow.names)

    out = pages.select(*keys, F.col(content)).mapInArrow(run, arrow)
    return out.withColumns({n: F.timestamp_add("MICROSECOND", F.col(n), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")) for n in times}) if times else out


def load_pages(spark: SparkSession, path: str, definition: Series, columns: Sequence[str] | None = None) -> DataFrame:
    """(path, pos, columns) of page files; a file that isn't a finished page is an error."""
    return from_pages(spark.read.format("binaryFile").load(path).select("path", "content"), definition, ["path"], columns)


def copied_columns(pages: DataFrame, names: Sequence[str], content: str = "content") -> DataFrame:
    """pages with only some of their columns, whose stored bytes are copied without decoding them."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(content)
            yield batch.set_column(at, content, pa.array([None if c is None else copy_columns(c, names) for c in batch.column(at).to_pylist()], pa.binary()))

    return pages.mapInArrow(run, pages.schema)


def channels(pages: DataFrame, keys: Sequence[str] = (), content: str = "content") -> DataFrame:
    """(keys, column, name, channel, data): the stored bytes of each column of the pages."""
    schema = T.StructType([*(pages.schema[k] for k in keys), *T._parse_datatype_string("column int, name string, channel int, data binary").fields])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                found = dump_channels(batch.column(len(keys))[i].as_py())
                head = [pa.array([batch.column(k)[i].as_py()] * len(found), batch.column(k).type) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*head, *(pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.string(), pa.int32(), pa.binary())))], schema.names)

    return pages.select(*keys, F.col(content)).mapInArrow(run, schema)


def appended(pages: DataFrame, more: DataFrame, definition: Series, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """pages (keys, n_rows, content) with the rows of `more` behind those of the same keys; keys without a page get one.

    A page's encoders take up where its last row ended. A page is one task's work, so give long series chunked keys.
    """
    fresh = to_pages(more, definition, keys, order)
    joined = pages.select(*keys, F.col("content").alias("old")).join(fresh.select(*keys, F.col("content").alias("new")), [*keys], "full")
    schema = T.StructType([*(pages.schema[k] for k in keys), T.StructField("n_rows", T.LongType()), T.StructField("content", T.BinaryType())])

    def run(batches):
        for batch in batches:
            counts, whole = [], []
            for old, new in zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist()):
                data = append_page(old, list(read_page(new)[2].values())) if old is not None and new is not None else old if new is None else new
                counts.append(read_header(data)[2])
                whole.append(data)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), pa.array(counts, pa.int64()), pa.array(whole, pa.binary())], schema.names)

    return joined.mapInArrow(run, schema)


def headers(pages: DataFrame, keys: Sequence[str] = (), content: str = "content") -> DataFrame:
    """(keys, series, rows, columns, error) from the heads of pages alone; error tells why a page isn't a finished one, the others are null then."""
    schema = T.StructType([*(pages.schema[k] for k in keys), *T._parse_datatype_string("series string, rows bigint, columns int, error string").fields])

    def head(data: bytes) -> tuple[str | None, int | None, int | None, str | None]:
        try:
            series, _, rows, _ = read_header(data)
        except PageError as e:
            return None, None, None, str(e)
        return series.name, rows, len(series.columns), None

    def run(batches):
        for batch in batches:
            found = [head(c or b"") for c in batch.column(len(keys)).to_pylist()]
            if found:
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), *(pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.int32(), pa.string())))], schema.names)

    return pages.select(*keys, F.col(content)).mapInArrow(run, schema)
