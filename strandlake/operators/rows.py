"""Rows of a user's own class to and from columns."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

R = TypeVar("R")


def put_rows(spark: SparkSession, rows: Iterable, schema) -> DataFrame:
    """A frame of dataclass rows."""
    return spark.createDataFrame([dataclasses.astuple(r) for r in rows], schema)


def mapped(df: DataFrame, kind: type[R], work: Callable[[R], object], schema: str) -> DataFrame:
    """What work makes of each row as an instance of a dataclass: rows of another dataclass, on the executors, batch by batch."""
    names, arrow = [f.name for f in dataclasses.fields(kind)], to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            made = [dataclasses.asdict(work(kind(*values))) for values in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_pylist(made, arrow)

    return df.select(*names).mapInArrow(run, schema)


def read_rows(df: DataFrame, kind: type[R]) -> Iterator[R]:
    """Rows as instances of a dataclass, partition by partition; columns that the class hasn't are not read."""
    names = [f.name for f in dataclasses.fields(kind)]
    for r in df.select(*names).toLocalIterator():
        yield kind(*r)
