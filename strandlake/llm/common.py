"""What the operators share: the shared folder, written tables, byte-level word splitting and hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; a longer single text is one pass of its own.
PASS_BYTES = 1 << 19

#: The white space of the word pattern [^\x20\x09-\x0D]+.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

_ODD = np.uint64(0x9E3779B97F4A7C13)
_LENGTHS = np.uint64(0xD6E8FEB86659FD93)
#: By number of bytes that count, 0 to 8, what is left of eight bytes read at once.
_LEFT = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset and all runs on one machine (tests), a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="strandlake-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives lost executors. The shuffles that made it go at once."""
    spark, path, clean = df.sparkSession, fresh_path(df.sparkSession, name), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(clean, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table that `written` made and that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_column(name: str = "text"):
    """The text, empty where it is null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def release_memory() -> None:
    """Give freed memory back to the system, so that a worker's footprint follows its present work. Only where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def passes(texts: Iterable[bytes], most: int = PASS_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first index, texts) for runs of texts of at most `most` bytes together, or one longer text."""
    start, run, size = 0, [], 0
    for i, t in enumerate(texts):
        if run and size + len(t) > most:
            yield start, run
            start, run, size = i, [], 0
        run.append(t)
        size += len(t) + 1
    if run:
        yield start, run


def small(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows: only so many texts become Python objects at once. Freed memory goes back at the end."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    batch = None
    release_memory()


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one number; zeros behind the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data), "<u8", padded, strides=(1,))


def paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in this order. Each is mixed before, so sums of unlike pairs don't cancel as powers of a base do."""
    return mix(first * _ODD + second)


def ranges_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each range [start, end): mixed numbers of eight bytes and their place in the range, summed."""
    size = ends - starts
    view = eights(data)
    out = mix(view[starts] & _LEFT[np.minimum(size, 8)]) if len(starts) else np.zeros(0, np.uint64)
    long = np.flatnonzero(size > 8)
    if len(long):
        pieces = (size[long] - 1) // 8  # behind the first
        number = spread(np.ones(len(long), np.int64), pieces)
        at = np.repeat(starts[long], pieces) + 8 * number
        left = np.minimum(np.repeat(ends[long], pieces) - at, 8)
        values = mix(mix(view[at] & _LEFT[left]) + number.astype(np.uint64) * _ODD)
        out[long] += np.add.reduceat(values, np.r_[0, np.cumsum(pieces)[:-1]])
    return mix(out + size.astype(np.uint64) * _LENGTHS)


def runs_hash(values: np.ndarray, size: int, have: int = 1) -> np.ndarray:
    """A hash of the `size` values from each value on; values: hashes of `have` things each, one from each thing on.

    Hashes of a run are paired with those of a run further on until they cover `size`.
    """
    while have < size and len(values):
        step = min(have, size - have)
        values = paired(values[:-step], values[step:]) if len(values) > step else values[:0]
        have += step
    return values


def sets_hash(values: np.ndarray, counts: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each set of distinct values, in any order."""
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(mix(mix(values + np.uint64(seed)) + _LENGTHS), dtype=np.uint64)]
    ends = np.cumsum(counts)
    return mix(sums[ends] - sums[ends - counts] + counts.astype(np.uint64) * _LENGTHS)


class Words:
    """The words of several texts: byte ranges in one buffer, a hash of each, and each text's range of words."""

    def __init__(self, texts: list[bytes], separators: np.ndarray):
        self.buffer = b"\n".join(texts)
        data = np.frombuffer(self.buffer, np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(lengths + 1)])
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ~separators[data]
        cuts = self.text_start[1:-1] - 1
        inside[cuts + 1] = 0
        change = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = change[::2], change[1::2]
        self.first = np.searchsorted(self.start, self.text_start)
        self.data = data
        self.hash = ranges_hash(data, self.start, self.end)

    def window_hashes(self, size: int) -> np.ndarray:
        """Hash of the `size` words from each word on, as if there were no borders between texts."""
        return runs_hash(self.hash, size)


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


SPACE_SEPARATORS = separators((0x20, 0x20), (0x09, 0x0D))


def byte_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes (eight or more) from each byte on."""
    return runs_hash(mix(eights(data)[: max(0, len(data) - 7)] + _LENGTHS), size, 8)


def spread(base: np.ndarray, count: np.ndarray) -> np.ndarray:
    """base[i], base[i] + 1, ... (count[i] of them) for each i, one after the other."""
    return np.repeat(base - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())


def sliding(values: np.ndarray, width: int, take=np.minimum) -> np.ndarray:
    """The least (or by take, greatest) value of each window of `width`; len(values) - width + 1 of them."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    blocks = -(-len(values) // width)
    fill = np.iinfo(values.dtype).max if take is np.minimum else np.iinfo(values.dtype).min
    padded = np.full(blocks * width, fill, values.dtype)
    padded[: len(values)] = values
    padded = padded.reshape(blocks, width)
    before = take.accumulate(padded, axis=1).ravel()
    after = take.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return take(after[:n], before[width - 1 : width - 1 + n])


def with_row(docs: DataFrame, text: str) -> DataFrame:
    """`row`, a struct of the other columns of docs whatever their names, and `text`, null where it is."""
    others = [docs[f"`{c}`"] for c in docs.columns if c != text] or [F.lit(True).alias("_")]
    return docs.select(F.struct(*others).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))


def whole_rows(frame: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of docs, from the row and text of with_row."""
    return frame.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
