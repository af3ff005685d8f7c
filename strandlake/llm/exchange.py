"""Blocks of documents that ask about their stretches of text: what the two substring operators share.

A table is cut once into blocks of a bounded size, written to the shared folder. A block has one row for each of its
distinct fingerprints, however often it stands there, so a fingerprint that a third of all documents hold has one row a
block and no task gathers a group of documents. Blocks are told which of their fingerprints recur, and send the stretches
of text around these, each distinct one once, to the part of the fingerprint; what goes from one block to one part is packed
in one row. What a part finds out goes back as ranges of the blocks' documents. However large the table, a block has no more
rows than fingerprints, and no more packs than stretches.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, release_memory, small, spread, text_column, written

#: Bytes of text in a block; one longer text is a block of its own.
BLOCK_BYTES = 2 << 20
#: Bytes of text for each part. A part holds the stretches whose fingerprints recur, some times overlapping.
PART_BYTES = 4 << 20
#: Beyond so many places a fingerprint's stretches are taken apart into single windows, which spreads them over all parts.
HOT_PLACES = 4_000
#: Equal windows of hot fingerprints meet in so many groups first; each group sends one on.
SALTS = 1_024

#: A stretch: windows that share their least fingerprint. begin, n: its first window in document `doc` and their number;
#: repeats: its fingerprint may stand in it twice; size: of its body; copies: the block's other stretches with the same body.
STRETCH = np.dtype([("value", "<u8"), ("block", "<i8"), ("key", "<i8"), ("begin", "<i8"), ("n", "<i8"), ("doc", "<i4"), ("size", "<i4"), ("copies", "<i4"), ("hot", "u1"), ("repeats", "u1")])
COPY = np.dtype([("doc", "<i4"), ("begin", "<i8"), ("later", "u1")])
SPAN = np.dtype([("doc", "<i4"), ("begin", "<i8"), ("end", "<i8")])
PACKS = "part bigint, payload binary"
_packs = pa.schema([("part", pa.int64()), ("payload", pa.binary())])


def pack_rows(rows: pa.Array, keys: pa.Array, texts: list[bytes]) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([rows, keys, pa.array(texts, pa.binary())], ["row", "key", "text"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_rows(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def blocks(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(block, n_bytes, payload) of all rows of docs: other columns, key and text once. A null key orders behind all others."""
    others = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != text])
    source = docs.select(others.alias("row"), F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(2**63 - 1)).alias("key"), text_column(f"`{text}`").alias("text"))

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, pa.Array, list[bytes]]] = []
        size = 0

        def flush():
            nonlocal held, size, number
            rows, keys = pa.concat_arrays([h[0] for h in held]), pa.concat_arrays([h[1] for h in held])
            data = pack_rows(rows, keys, [t for h in held for t in h[2]])
            out = pa.RecordBatch.from_arrays([pa.array([(part << 32) | number], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], ["block", "n_bytes", "payload"])
            held, size, number = [], 0, number + 1
            return out

        for batch in small(batches):
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            begin = 0
            for i, t in enumerate(texts):
                if size and size + len(t) > BLOCK_BYTES:
                    if i > begin:
                        held.append((batch.column(0).slice(begin, i - begin), batch.column(1).slice(begin, i - begin), texts[begin:i]))
                    yield flush()
                    begin = i
                size += len(t) + 1
            if len(texts) > begin:
                held.append((batch.column(0).slice(begin), batch.column(1).slice(begin), texts[begin:]))
        if held:
            yield flush()

    return written(source.mapInArrow(run, "block bigint, n_bytes bigint, payload binary"), "blocks")


def row_field(docs: DataFrame, text: str) -> T.StructField:
    """The column `row` that blocks carry: all columns of docs but the text."""
    return T.StructField("row", T.StructType([f for f in docs.schema.fields if f.name != text]))


def part_bits(table: DataFrame) -> int:
    size = table.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    return max(3, math.ceil(math.log2(max(size, 1) / PART_BYTES)))


def recurring(table: DataFrame, prints: Callable[[list[bytes]], np.ndarray], hot_places: int = HOT_PLACES) -> DataFrame:
    """(block, print, hot) of the fingerprints that stand at several places; prints: those of a block's texts, with repeats.

    Places are summed over a window: a fingerprint has at most one row of the tens of thousands of each block, so none has
    more than a small share of a task.
    """

    def run(batches):
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, counts = np.unique(prints(unpack_rows(payload).column("text").to_pylist()), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), block), pa.int64()), pa.array(found.view(np.int64)), pa.array(counts.astype(np.int32))], ["block", "print", "places"])
                release_memory()

    each = table.select("block", "payload").mapInArrow(run, "block bigint, print bigint, places int")
    summed = each.withColumn("all_places", F.sum("places").over(Window.partitionBy("print"))).filter("all_places > 1")
    return written(summed.select("block", "print", (F.col("all_places") > hot_places).alias("hot")), "recurring")


class Known:
    """Which of a block's fingerprints recur, and which of these are hot."""

    def __init__(self, answers: pa.Table):
        value = answers.column("print").to_numpy().view(np.uint64)
        order = np.argsort(value)
        self.value, self.is_hot = value[order], answers.column("hot").to_numpy()[order]

    def masks(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(recurring and not hot, hot) of each of the values."""
        if not len(self.value):
            return np.zeros(len(values), bool), np.zeros(len(values), bool)
        at = np.minimum(np.searchsorted(self.value, values), len(self.value) - 1)
        found, hot = self.value[at] == values, self.is_hot[at]
        return found & ~hot, found & hot


def binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Values of the given numbers of elements, cut from an array one after the other."""
    offsets = np.r_[0, np.cumsum(sizes * data.dtype.itemsize)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


class Stretches:
    """Several stretches: `rows` of STRETCH, their bodies, and the copies of all of them one after the other."""

    def __init__(self, rows: np.ndarray, bodies: list[bytes], copies: np.ndarray):
        self.rows, self.bodies, self.copies = rows, bodies, copies

    def packs(self, part: np.ndarray) -> pa.Table:
        """One pack for each part that some of them go to."""
        order = np.argsort(part, kind="stable")
        rows, owner = self.rows[order], np.repeat(np.arange(len(order)), self.rows["copies"])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        copies = self.copies[np.argsort(place[owner], kind="stable")]
        reach = np.r_[0, np.cumsum(rows["copies"])]
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        zip_up, parts, payloads = zstandard.ZstdCompressor(3).compress, [], []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)] if len(order) else []):
            parts.append(int(part[order[a]]))
            payloads.append(zip_up(b"".join([(b - a).to_bytes(8, "little"), rows[a:b].tobytes(), copies[reach[a] : reach[b]].tobytes(), *[self.bodies[k] for k in order[a:b].tolist()]])))
        return pa.table([pa.array(parts, pa.int64()), pa.array(payloads, pa.binary())], schema=_packs)

    @staticmethod
    def unpacked(payloads: list[bytes]) -> Stretches:
        rows, bodies, copies, unzip = [], [], [], zstandard.ZstdDecompressor().decompress
        for payload in payloads:
            data = unzip(payload)
            own = np.frombuffer(data, STRETCH, int.from_bytes(data[:8], "little"), 8)
            at = 8 + own.nbytes
            n = int(own["copies"].sum())
            rows.append(own)
            copies.append(np.frombuffer(data, COPY, n, at))
            at += n * COPY.itemsize
            for size in own["size"].tolist():
                bodies.append(data[at : at + size])
                at += size
        return Stretches(np.concatenate([*rows, np.zeros(0, STRETCH)]), bodies, np.concatenate([*copies, np.zeros(0, COPY)]))


def stretches(block: int, keys: np.ndarray, value: np.ndarray, doc: np.ndarray, begin: np.ndarray, n: np.ndarray, repeats: np.ndarray, body: Callable[[int, int, int], bytes], hot: bool, places: bool) -> Stretches:
    """One stretch for each distinct body, at its least place in the block; the others are its copies.

    A place is (key, begin), or without `places` the key alone; a copy is later if its place is greater.
    """
    order = np.lexsort((begin, keys[doc]))
    value, doc, begin, n, repeats = value[order], doc[order], begin[order], n[order], repeats[order]
    known: dict[bytes, int] = {}
    which = np.fromiter((known.setdefault(body(d, b, w), len(known)) for d, b, w in zip(doc.tolist(), begin.tolist(), n.tolist())), np.int64, len(order))
    _, first = np.unique(which, return_index=True)
    copies = np.zeros(len(order), COPY)
    copies["doc"], copies["begin"] = doc, begin
    copies["later"] = (keys[doc] != keys[doc[first[which]]]) | (places & (begin != begin[first[which]]))
    others = np.ones(len(order), bool)
    others[first] = False
    others = np.flatnonzero(others)
    others = others[np.argsort(which[others], kind="stable")]
    rows = np.zeros(len(first), STRETCH)
    for name, values in (("value", value), ("key", keys[doc]), ("begin", begin), ("n", n), ("doc", doc), ("repeats", repeats)):
        rows[name] = values[first]
    rows["block"], rows["hot"] = block, hot
    rows["size"], rows["copies"] = list(map(len, known)), np.bincount(which[others], minlength=len(first))
    return Stretches(rows, list(known), copies[others])


def asked(table: DataFrame, known: DataFrame, ask: Callable[[int, pa.Table, Known], list[Stretches]], bits: int) -> DataFrame:
    """Packs of the stretches that ask(block, rows, its recurring fingerprints) gives for each block."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows or not answers.num_rows:
            return _packs.empty_table()
        out = []
        for s in ask(block.column("block")[0].as_py(), unpack_rows(block.column("payload")[0].as_py()), Known(answers)):
            # Equal hot windows of different blocks meet by groups of blocks first.
            value = np.where(s.rows["hot"] > 0, mix(s.rows["value"] ^ mix((s.rows["block"] % SALTS).astype(np.uint64))), s.rows["value"])
            out.append(s.packs((value >> np.uint64(64 - bits)).astype(np.int64)))
        release_memory()
        return pa.concat_tables(out)

    return table.select("block", "payload").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, PACKS)


class Part:
    """The stretches of one part by place, as arrays, and which of the distinct bodies each has."""

    def __init__(self, found: Stretches, places: bool):
        order = np.lexsort((found.rows["begin"], found.rows["key"]))
        self.rows = found.rows[order]
        self.key, self.begin, self.n, self.value = (self.rows[c] for c in ("key", "begin", "n", "value"))
        self.repeats = self.rows["repeats"] > 0
        owner = np.repeat(np.arange(len(order)), found.rows["copies"])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by_place = np.argsort(place[owner], kind="stable")
        #: copies of all stretches, and whose they are
        self.copies, self.owner = found.copies[by_place], place[owner][by_place]
        known: dict[bytes, int] = {}
        self.which = np.fromiter((known.setdefault(found.bodies[k], len(known)) for k in order.tolist()), np.int64, len(order))
        self.bodies = list(known)
        _, self.first = np.unique(self.which, return_index=True)
        one = self.first[self.which]
        #: stretches whose body stands at a smaller place too
        self.later = (self.key != self.key[one]) | (places & (self.begin != self.begin[one]))

    def chosen(self, rows: np.ndarray, copies: np.ndarray) -> Stretches:
        """Some of the stretches with some of their copies."""
        kept = copies & rows[self.owner]
        out = self.rows[rows]
        out["copies"] = np.bincount(self.owner[kept], minlength=len(rows))[rows]
        return Stretches(out, [self.bodies[k] for k in self.which[rows].tolist()], self.copies[kept])


def spans_of(part: Part, rows: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks, spans): windows begin to end - 1 of the rows' stretches, as ranges of documents; width: length of a window less one. Copies at the same place have the same, later ones go whole."""
    block, doc = part.rows["block"], part.rows["doc"]
    gone = part.copies["later"] > 0
    later, same, own = part.copies[gone], part.copies[~gone], part.owner[~gone]
    blocks = [block[rows], block[part.owner[gone]]]
    spans = [_spans(doc[rows], part.begin[rows] + begin, part.begin[rows] + end + width), _spans(later["doc"], later["begin"], later["begin"] + part.n[part.owner[gone]] + width)]
    if len(same) and len(rows):
        order = np.argsort(rows, kind="stable")
        low, high = np.searchsorted(rows[order], own), np.searchsorted(rows[order], own, side="right")
        of, k = np.repeat(np.arange(len(own)), high - low), order[spread(low, high - low)]
        blocks.append(block[own[of]])
        spans.append(_spans(same["doc"][of], same["begin"][of] + begin[k], same["begin"][of] + end[k] + width))
    return np.concatenate(blocks), np.concatenate(spans)


def _spans(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.zeros(len(doc), SPAN)
    out["doc"], out["begin"], out["end"] = doc, begin, end
    return out


def settled(questions: DataFrame, find: Callable[[Part], tuple[np.ndarray, np.ndarray, np.ndarray]], width: int, places: bool, bits: int) -> DataFrame:
    """(block, spans): ranges of documents that go. find(part) gives (rows, begin, end): windows of rows' stretches that stand earlier.

    Hot windows meet twice: first with those of some of the blocks, where each but the first goes, and the first ones of all
    blocks then meet in the window's own part.
    """

    def run(table: pa.Table, last: bool) -> pa.Table:
        part = Part(Stretches.unpacked(table.column("payload").to_pylist()), places)
        rows, begin, end = find(part)
        on = (not last) & (part.rows["hot"] > 0) & ~part.later
        if on.any():
            kept = ~on[rows]
            rows, begin, end = rows[kept], begin[kept], end[kept]
        blocks, spans = spans_of(part, rows, begin, end, width)
        order = np.argsort(blocks, kind="stable")
        heads, sizes = np.unique(blocks[order], return_counts=True)
        found = pa.table({"block": pa.array(heads, pa.int64()), "spans": binaries(spans[order], sizes)})
        if not last:
            going = part.chosen(on, part.copies["later"] == 0)  # the later ones are settled
            packs = going.packs((going.rows["value"] >> np.uint64(64 - bits)).astype(np.int64))
            found = pa.concat_tables([packs.append_column("block", pa.nulls(len(packs), pa.int64())).append_column("spans", pa.nulls(len(packs), pa.binary())), found], promote_options="default")
        release_memory()
        return found

    first = written(questions.groupBy("part").applyInArrow(lambda t: run(t, False), f"{PACKS}, block bigint, spans binary"), "settled")
    second = first.filter("spans is null").select("part", "payload").groupBy("part").applyInArrow(lambda t: run(t, True), "block bigint, spans binary")
    return first.filter("spans is not null").select("block", "spans").union(second)


def finished(table: DataFrame, found: DataFrame, work: Callable[[pa.Table, list[np.ndarray]], pa.Table], schema) -> DataFrame:
    """work(rows, spans of each of them) for each block."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        rows = unpack_rows(block.column("payload")[0].as_py())
        spans = np.concatenate([np.zeros(0, SPAN), *(np.frombuffer(s, SPAN) for s in answers.column("spans").to_pylist())])
        spans = spans[np.argsort(spans["doc"], kind="stable")]
        out = work(rows, np.split(spans, np.searchsorted(spans["doc"], np.arange(1, rows.num_rows))))
        release_memory()
        return out

    return table.select("block", "payload").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, schema)


def covered(spans: np.ndarray, size: int) -> np.ndarray:
    """Which of `size` things the spans cover."""
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, spans["begin"], 1)
    np.add.at(change, spans["end"], -1)
    return np.cumsum(change[:-1]) > 0
