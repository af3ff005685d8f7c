"""Benchmark decontamination by winnowing: join fingerprints of documents and items, then extend hits word by word."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, as_bytes, mix, passes, separators, sliding, small, whole_rows, with_row, written
from .exchange import blocks, unpack_rows

WINDOW = 13
#: Words of a fingerprint. One of the WINDOW - GRAM + 1 in a window has the least hash and is kept, on either side of the join.
GRAM = 7
#: Bytes of item texts up to which their index goes to all executors; beyond, fingerprints meet in a join.
INDEX_BYTES = 16 << 20

#: Bytes that separate words, after A-Z are lowered.
WORD_BORDERS = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def kept_grams(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the fingerprints that winnowing keeps; every `window` words in one text hold one of them."""
    hashes = words.window_hashes(gram)
    width = window - gram + 1
    if len(hashes) < width:
        return np.arange(len(hashes)), hashes
    least = sliding(hashes, width)
    edge = np.zeros(width - 1, np.uint64)  # a fingerprint is kept if it is the least of any window that it is in
    highest = sliding(np.concatenate([edge, least, edge]), width, np.maximum)
    at = np.flatnonzero(hashes == highest)
    return at, hashes[at]


class Index:
    """Items: their words, kept fingerprints, and, for items of fewer words than a window, the whole item."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.ids = [i for i, _ in items]
        words = Words([t.lower() for _, t in items], WORD_BORDERS)
        cut = [words.buffer[a:b] for a, b in zip(words.start.tolist(), words.end.tolist())]
        first = words.first.tolist()
        self.words = [cut[a:b] for a, b in zip(first, first[1:])]
        place, hashes = kept_grams(words, window)
        owner = np.searchsorted(words.first, place, side="right") - 1
        inside = (place + GRAM <= words.first[owner + 1]) & (np.diff(words.first)[owner] >= window)
        place, hashes, owner = place[inside], hashes[inside], owner[inside]
        order = np.argsort(hashes, kind="stable")
        self.hash, self.owner, self.place = hashes[order], owner[order], (place - words.first[owner])[order]
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, w in enumerate(self.words):
            if 0 < len(w) < window:
                self.short[len(w)][int(words.window_hashes(len(w))[first[k]])].append(k)
        self.short = {n: dict(x) for n, x in self.short.items()}

    def hits(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[int]]]:
        """(number of words, ranges of words hit, items) of each text."""
        words = Words([t.lower() for t in texts], WORD_BORDERS)
        found: dict[int, tuple[list, set]] = defaultdict(lambda: ([], set()))
        first = words.first
        cut = lambda i: words.buffer[words.start[i] : words.end[i]]

        def text_of(at: int) -> int:
            return int(np.searchsorted(first, at, side="right")) - 1

        place, hashes = kept_grams(words, self.window)
        low, high = np.searchsorted(self.hash, hashes), np.searchsorted(self.hash, hashes, side="right")
        done: dict[tuple[int, int], int] = {}  # end of the run last extended on a diagonal of an item
        for k in np.flatnonzero(high > low).tolist():
            at = int(place[k])
            doc = text_of(at)
            begin, end = int(first[doc]), int(first[doc + 1])
            for j in range(int(low[k]), int(high[k])):
                item, p = int(self.owner[j]), int(self.place[j])
                if done.get((item, at - p), -1) > at:
                    continue
                own = self.words[item]
                a = 0
                while p + a < len(own) and at + a < end and own[p + a] == cut(at + a):
                    a += 1
                b = 0
                while b < p and at - b > begin and own[p - b - 1] == cut(at - b - 1):
                    b += 1
                done[item, at - p] = at + max(a, 1)
                if a + b >= self.window:
                    found[doc][0].append((at - b - begin, at + a - begin))
                    found[doc][1].add(item)
        for size, table in self.short.items():
            hashes = words.window_hashes(size)
            known = np.fromiter(table, np.uint64, len(table))
            for at in np.flatnonzero(np.isin(hashes, known)).tolist():
                doc = text_of(at)
                if at + size <= first[doc + 1]:
                    here = [cut(i) for i in range(at, at + size)]
                    for item in table[int(hashes[at])]:
                        if self.words[item] == here:
                            found[doc][0].append((at - int(first[doc]), at + size - int(first[doc])))
                            found[doc][1].add(item)
        counts = np.diff(first).tolist()
        return [(counts[d], *(found[d] if d in found else ([], set()))) for d in range(len(texts))]


def united(spans: list[tuple[int, int]]) -> int:
    """Words in the union of ranges."""
    total, reach = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def _short_hashes(words: Words, size: int) -> np.ndarray:
    """Fingerprints of all runs of `size` words: of items with fewer words than a window."""
    return mix(words.window_hashes(size) + np.uint64(size))


def _item_prints(items: DataFrame) -> DataFrame:
    """(number, size, print) of each item: its kept fingerprints with size 0, or that of a whole short item with its number of words."""

    def run(batches):
        for batch in small(batches):
            for start, group in passes(as_bytes(batch.column(1))):
                numbers = batch.column(0).to_numpy()[start : start + len(group)]
                for number, text in zip(numbers.tolist(), group):
                    words = Words([text.lower()], WORD_BORDERS)
                    n = len(words.hash)
                    found = kept_grams(words)[1] if n >= WINDOW else _short_hashes(words, n) if n else words.hash
                    found = np.unique(found)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), number)), pa.array(np.full(len(found), 0 if n >= WINDOW else n, np.int32)), pa.array(found.view(np.int64))], ["number", "size", "print"])

    return written(items.select("number", "text").mapInArrow(run, "number bigint, size int, print bigint"), "item_prints")


def _met(table: DataFrame, items: DataFrame) -> DataFrame:
    """(block, item, text) of the items that share a fingerprint with a block of documents: each once, however often."""
    prints = _item_prints(items)
    sizes = [r[0] for r in prints.select("size").filter("size > 0").distinct().collect()]  # fewer than WINDOW

    def run(batches):
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = []
                for _, group in passes(unpack_rows(payload).column("text").to_pylist()):
                    words = Words([t.lower() for t in group], WORD_BORDERS)
                    found += [kept_grams(words)[1], *(_short_hashes(words, s) for s in sizes)]
                found = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), block), pa.int64()), pa.array(found.view(np.int64))], ["block", "print"])

    pairs = table.select("block", "payload").mapInArrow(run, "block bigint, print bigint").join(prints.select("number", "print"), "print").select("block", "number").distinct()
    return written(pairs, "met").join(items, "number").select("block", "item", "text")


_FOUND = "n_words bigint, n_hit bigint, n_items bigint, items array<string>, items_sha256 string, contaminated boolean"


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row per row of docs: `row` (its other columns), text, n_words, n_hit, n_items, items (sorted ids), items_sha256, contaminated.

    Words are runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z are lowered. A window is WINDOW words of an item, or a whole
    item of fewer words. A word of a document in any occurrence of a window is hit; a document is contaminated from one hit
    word in twenty on. Null or empty texts have no words: such a document is clean, such an item has no window. Repeated
    items count once; a null id counts as "null". With no items every document is clean; no documents give no rows.

    Hits are found by fingerprints and confirmed and extended on the words themselves. The size of all items is summed
    first: up to index_bytes, their fingerprints go to all executors as an index and documents are read once, without a
    shuffle. Beyond, the fingerprints of blocks of documents are joined with those of the items, and each block gets the
    items that it met.
    """
    rows = with_row(docs, text)
    items = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(f"`{item_text}`").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item")), F.lit(0))).first()[0]
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string(_FOUND).fields])

    def found(index: Index, texts: list[bytes]) -> list[pa.Array]:
        counts, hit, items = [], [], []
        for _, group in passes(texts):
            for n, spans, own in index.hits(group):
                counts.append(n)
                hit.append(united(spans))
                items.append(sorted({index.ids[k] for k in own}))
        digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        return [pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), pa.array(map(len, items), pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(digest, pa.string()), pa.array([h > 0 and 20 * h >= n for h, n in zip(hit, counts)], pa.bool_())]

    if size <= index_bytes:
        shared = docs.sparkSession.sparkContext.broadcast(Index([(r.item, r.text.encode()) for r in items.distinct().collect()]))

        def run(batches):
            for batch in small(batches):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found(shared.value, as_bytes(batch.column(1)))], schema.names)

        return rows.mapInArrow(run, schema)

    # The text is carried as it is beside the blocks' copy, which has no nulls.
    numbered = written(items.distinct().withColumn("number", F.monotonically_increasing_id()), "items")
    table = blocks(rows.select("row", "text", F.lit(0).alias("key"), F.col("text").isNull().alias("none")), "text", "key")

    def extend(block: pa.Table, met: pa.Table) -> pa.Table:
        own = unpack_rows(block.column("payload")[0].as_py())
        texts = own.column("text").to_pylist()
        index = Index(list(zip(met.column("item").to_pylist(), as_bytes(met.column("text")))))
        row, none = (pc.struct_field(own.column("row").combine_chunks(), k) for k in ("row", "none"))
        kept = pa.array([None if x else t.decode() for t, x in zip(texts, none.to_pylist())], pa.string())
        return pa.Table.from_arrays([row, kept, *found(index, texts)], schema.names)

    return table.select("block", "payload").groupBy("block").cogroup(_met(table, numbered).groupBy("block")).applyInArrow(extend, schema)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs without any hit word, with their columns: a long document that holds one passage goes too.

    What contamination says of null and empty texts, repeated rows and empty tables holds: such rows have no hit and stay.
    """
    return whole_rows(contamination(docs, benchmark, text, **options).filter("n_hit = 0"), docs, text)
