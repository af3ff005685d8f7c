"""Near-duplicate detection: fast similarity sketches, banding, and verification on full shingle sets."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_SEPARATORS, Words, as_bytes, forget, mix, passes, small, spread, whole_rows, with_row, written
from .components import components

#: Words of a shingle, unless the caller gives another number.
SHINGLE = 2
#: Similarity in percent from which on documents are linked.
PERCENT = 80
#: Coordinates a band and bands: two sets of similarity 0.8 share no band once in ten million pairs.
BAND_ROWS = 5
BANDS = 40
#: Nodes of either side that one task holds against each other, and bytes of their compressed texts.
CHUNK = 200
CHUNK_BYTES = 1 << 18

_SEEDS = np.random.default_rng(1009).integers(0, 1 << 63, 2 * BAND_ROWS * BANDS, dtype=np.uint64)


def sketches(values: np.ndarray, counts: np.ndarray, size: int = BAND_ROWS * BANDS) -> np.ndarray:
    """A row of `size` coordinates for each set of distinct hashes; counts: the sets' sizes, in the order of values.

    Fast similarity sketching: in round r < size every element falls into a random bin with a value of r and a random
    fraction, in round size + i all fall into bin i; a bin keeps its least value. A set is done once its bins are full,
    which the last size rounds make certain, so every coordinate is filled, and two sets agree in each with the probability
    of their similarity. Sets of some hundred elements need a few rounds. Empty sets have no meaning here.
    """
    n = len(counts)
    out = np.full(n * size, np.uint64(2**64 - 1))
    owner = np.repeat(np.arange(n), counts)
    for r in range(2 * size):
        if not len(owner):
            break
        h = mix(values ^ _SEEDS[r % len(_SEEDS)])
        bins = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(size) >> np.uint64(32)).astype(np.int64) if r < size else np.full(len(h), r - size)
        np.minimum.at(out, owner * size + bins, (h >> np.uint64(32)) | np.uint64(r << 32))
        open_sets = (out.reshape(n, size) == np.uint64(2**64 - 1)).any(axis=1)
        left = open_sets[owner]
        values, owner = values[left], owner[left]
    return out.reshape(n, size)


def band_keys(rows: np.ndarray, band_rows: int = BAND_ROWS) -> np.ndarray:
    """A 64-bit key for each band of each sketch, unlike for different bands."""
    n, size = rows.shape
    bands = rows.reshape(n, size // band_rows, band_rows)
    key = np.broadcast_to(np.arange(size // band_rows, dtype=np.uint64), bands.shape[:2])
    for i in range(band_rows):
        key = mix(key ^ bands[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
    return key


class ShingleSets:
    """Distinct hashes of several texts' shingles of `size` words (A-Z lowered): values in ascending order for each text, and counts."""

    def __init__(self, texts: list[bytes], size: int = SHINGLE):
        words = Words([t.lower() for t in texts], SPACE_SEPARATORS)
        first, n = words.first[:-1], np.diff(words.first)
        windows = words.window_hashes(size)
        some = np.maximum(n - size + 1, 0)
        few = [np.flatnonzero(n == k) for k in range(1, size)]  # the whole sequence is one shingle
        values = np.concatenate([windows[spread(first, some)], *(words.window_hashes(k)[first[f]] for k, f in enumerate(few, 1))]) if len(n) else windows
        owner = np.concatenate([np.repeat(np.arange(len(n)), some), *few])
        order = np.lexsort((values, owner))
        values, owner = values[order], owner[order]
        fresh = np.r_[True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])] if len(values) else np.zeros(0, bool)
        self.values, self.owner = values[fresh], owner[fresh]
        self.counts = np.bincount(self.owner, minlength=len(texts))


def shingles(text: bytes, size: int = SHINGLE) -> frozenset[tuple[bytes, ...]]:
    """The full shingle set of one text, as tuples of words; fewer words than a shingle has are one shingle."""
    w = text.lower().split()
    return frozenset(zip(*(w[k:] for k in range(size)))) if len(w) >= size else frozenset([tuple(w)] if w else [])


def linked(a: frozenset, b: frozenset, percent: int = PERCENT) -> bool:
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def words_of(text: bytes) -> bytes:
    """The words of a text, A-Z lowered, with one space between."""
    return b" ".join(text.lower().split())


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))


def _digests(texts: list[bytes]) -> list[pa.Array]:
    """low, high: a 128-bit cryptographic digest of each text's words; null without words."""
    found = [hashlib.blake2b(w, digest_size=16).digest() if w else None for w in map(words_of, texts)]
    halves = np.frombuffer(b"".join([f or bytes(16) for f in found]), np.int64).reshape(-1, 2)
    none = np.array([f is None for f in found], bool)
    return [pa.array(halves[:, k].copy(), pa.int64(), mask=none) for k in (0, 1)]


def _identified(source: DataFrame, size: int | None) -> DataFrame:
    """The columns of source (the second is the text), and low, high of its words; with a size also n, the size of its full shingle set."""

    def run(batches):
        for batch in small(batches):
            for start, group in passes(as_bytes(batch.column(1))):
                count = [pa.array([len(shingles(t, size)) for t in group], pa.int64())] if size else []
                yield pa.RecordBatch.from_arrays([*(c.slice(start, len(group)) for c in batch.columns), *_digests(group), *count], schema.names)

    schema = T.StructType([*source.schema.fields, *T._parse_datatype_string("low bigint, high bigint" + ", n bigint" * bool(size)).fields])
    return source.mapInArrow(run, schema)


def _sketched(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """key, low, high, n (distinct shingles' hashes), bands and body (the words, compressed) of each row with words."""

    def run(batches):
        pack = zstandard.ZstdCompressor(3).compress
        for batch in small(batches):
            for start, group in passes(as_bytes(batch.column(1))):
                s = ShingleSets(group, size)
                keys = band_keys(sketches(s.values, s.counts)).view(np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(group) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(group)), *_digests(group), pa.array(s.counts, pa.int64()), bands, pa.array([pack(words_of(t)) for t in group], pa.binary())], ["key", "low", "high", "n", "bands", "body"])

    return _texts(docs, key, text).mapInArrow(run, "key bigint, low bigint, high bigint, n bigint, bands array<bigint>, body binary").filter("low is not null")


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    body = nodes.select("node", "body")
    with_b = pairs.join(body.select(F.col("node").alias("b"), F.col("body").alias("body_b")), "b")
    both = with_b.join(body.select(F.col("node").alias("a"), F.col("body").alias("body_a")), "a")

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        known, own = None, frozenset()
        for batch in small(batches):
            kept = []
            for i, (a, x, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3))):
                if a != known:
                    known, own = a, shingles(unpack(x.as_py()), size)
                if linked(own, shingles(unpack(y.as_py()), size), percent):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).take(pa.array(kept, pa.int64()))

    return both.select("a", "b", "body_a", "body_b").mapInArrow(run, "a bigint, b bigint")


def _across(members: DataFrame, labels: DataFrame, nodes: DataFrame, percent: int, size: int) -> DataFrame:
    """Links (a, b) between nodes of unlike labels that share a band.

    A band's main label is its most frequent one; its nodes of other labels are outsiders of that label. Each outsider is
    held against the nodes of the main label that are in such bands and against the label's other outsiders, as far as
    their sets' sizes allow a link, in tasks of about CHUNK of either side, which give links only. Two nodes that meet in no
    band differ; for those that do, this covers every pair of unlike labels.
    """
    named = members.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    times = named.groupBy("band", "label").agg(F.count("*").alias("times"))
    mixed = written(times.groupBy("band").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("times", "label")).alias("main")).filter("labels > 1").select("band", "main"), "mixed")
    # Sizes of linked sets lie in the same class or in neighbouring ones; a hundredth more, so that rounding can't matter.
    step = math.log(101 / percent)
    facts = nodes.select("node", F.octet_length("body").alias("bytes"), F.floor(F.ln("n") / step).cast("int").alias("class"))
    held = written(named.join(mixed, "band").select("main", "node", "label").distinct().join(facts, "node"), "held")
    outsiders = held.filter("label <> main")
    parts = lambda: F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("bytes") / CHUNK_BYTES)).cast("int")
    columns = written(outsiders.groupBy("main", "class").agg(parts().alias("columns")), "columns")
    near = held.withColumn("class", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1))).join(columns, ["main", "class"])
    chunks = written(near.groupBy("main", "class").agg(parts().alias("rows"), F.first("columns").alias("columns")), "chunks")
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    row_side = near.drop("columns").join(chunks, ["main", "class"]).select("main", "class", "node", "label", F.lit(False).alias("outside"), part("rows").alias("i"), every("columns").alias("j"))
    column_side = outsiders.join(chunks, ["main", "class"]).select("main", "class", "node", "label", F.lit(True).alias("outside"), every("rows").alias("i"), part("columns").alias("j"))
    tasks = row_side.union(column_side).join(nodes.select("node", "body"), "node")

    def run(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        node, label, outside = (table.column(c).to_pylist() for c in ("node", "label", "outside"))
        sets = [shingles(unpack(b.as_py()), size) for b in table.column("body")]
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        found = []
        others = [k for k, o in enumerate(outside) if not o]
        for p in (k for k, o in enumerate(outside) if o):
            own, n = sets[p], len(sets[p])
            for q in others:
                m = len(sets[q])
                if 100 * m >= percent * n and 100 * n >= percent * m and root(label[p]) != root(label[q]) and linked(own, sets[q], percent):
                    found.append((node[p], node[q]))
                    parent[root(label[p])] = root(label[q])
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    more = written(tasks.groupBy("main", "class", "i", "j").applyInArrow(run, "a bigint, b bigint"), "more")
    for done in (mixed, held, columns, chunks):
        forget(done)
    return more


def _classes(docs: DataFrame, key: str, text: str, percent: int, size: int) -> DataFrame:
    """low, high and component_id of each distinct sequence of words that isn't empty."""
    every = _sketched(docs, key, text, size)
    grouped = every.groupBy("low", "high").agg(F.min("key").alias("least_key"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("body").alias("body"))
    nodes = written(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")
    bands = nodes.select("node", F.explode("bands").alias("band"))
    shared = written(bands.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("members")).filter("members > 1").drop("members"), "shared")
    members = written(bands.join(shared, "band"), "bands")
    pairs = members.filter("node > leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    labels = components(_verified(pairs, nodes, percent, size))
    more = _across(members, labels, nodes, percent, size)
    forget(members)
    forget(shared)
    named = nodes.select("node", "low", "high", "least_key").join(labels, "node", "left").select("node", "low", "high", "least_key", F.coalesce("label", "node").alias("label"))
    end = lambda c: named.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    final = named
    if not more.isEmpty():
        lifted = more.join(end("a"), "a").join(end("b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
        joined = components(lifted).select(F.col("node").alias("label"), F.col("label").alias("whole"))
        final = named.join(joined, "label", "left").select("low", "high", "least_key", F.coalesce("whole", "label").alias("label"))
    # A table of its own: both sides of the join are shuffled then, and a large component's share can be split.
    least = written(final.groupBy("label").agg(F.min("least_key").alias("component_id")), "least")
    return final.join(least, "label").select("low", "high", "component_id")


def _checked(percent: int) -> None:
    if percent < PERCENT:
        raise ValueError(f"the bands are made for similarities from {PERCENT} percent on")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id (the least key reachable over links), kept (key = component_id).

    Rows are linked from `percent` (80 or more) on of shared in united shingles of `size` words. Texts without words (null,
    empty, blank) have an empty set and are linked with nothing. Equal sequences of words are one node, however many rows
    hold them; a repeated row is kept where the first is. A null key takes its component's least key; a component of null
    keys only has a null component_id and is kept. An empty table gives an empty one; other columns are not read.

    1. Rows with the same words are grouped by a 128-bit cryptographic digest of them; a group keeps one compressed text.
    2. Bands of the sketches: each node of a band is paired with the band's least node. A pair met in several bands is
       verified once, on the full sets of words. Links give components.
    3. A band whose nodes are still in several components may hide links between them; _across looks for these.
    """
    _checked(percent)
    rows = _identified(_texts(docs, key, text), size).drop("text").join(_classes(docs, key, text, percent, size), ["low", "high"], "left")
    component = F.when(F.col("low").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return rows.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with their columns; what it says of nulls, empty texts, repeated rows and empty tables holds."""
    _checked(percent)
    rows = _identified(with_row(docs, text), None)
    own = F.col("row").getField(key).cast("bigint")
    joined = rows.withColumn("key", own).join(_classes(docs, key, text, percent, size), ["low", "high"], "left")
    return whole_rows(joined.filter(F.col("low").isNull() | F.col("key").eqNullSafe(F.col("component_id"))), docs, text)
