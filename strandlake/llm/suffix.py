"""Substring deduplication on bytes by suffix arrays and longest previous factors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import exchange as X
from .common import byte_hashes, forget, mix, passes, sliding, spread

LENGTH = 100
#: Bytes of a fingerprint; the least one in each LENGTH bytes tells whether they are asked for, and where.
GRAM = 32
WIDTH = LENGTH - GRAM + 1
#: Bytes of text in one suffix array; the stretches of one fingerprint stay together.
ARRAY_BYTES = 1 << 18
#: Steps that all suffixes take at once towards the nearest smaller place.
STEPS = 48


def suffix_levels(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(h, rank of each place by its first h bytes) for growing h up to `length`; equal ranks mean equal bytes.

    Prefix doubling: ranks of h bytes, paired with those h further on, give the ranks of 2h.
    """
    n = len(data)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = data.astype(np.uint64) + np.uint64(1)
    have = min(length, 7)
    key = np.zeros(n, np.uint64)
    for i in range(have):
        key = key * np.uint64(257) + padded[i : i + n]
    levels = [(have, _ranked(key))]
    while have < length:
        ranks, step = levels[-1][1], min(have, length - have)
        further = np.zeros(n, np.uint64)
        further[: max(0, n - step)] = ranks[step:] + np.uint64(1)
        have += step
        levels.append((have, _ranked(ranks * np.uint64(n + 2) + further)))
    return levels


def _ranked(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    own = key[order]
    ranks = np.empty(len(key), np.uint64)
    ranks[order] = np.cumsum(np.r_[False, own[1:] != own[:-1]]) if len(key) else own
    return ranks


def common_prefixes(data: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at a and b have in common, up to the length of the last level."""
    n, length = len(data), levels[-1][0]
    common = np.zeros(len(a), np.int64)
    for h, ranks in reversed(levels):
        x, y = a + common, b + common
        near = np.flatnonzero((x < n) & (y < n) & (common + h <= length))
        common[near[ranks[x[near]] == ranks[y[near]]]] += h
    for _ in range(levels[0][0]):
        x, y = a + common, b + common
        near = np.flatnonzero((x < n) & (y < n) & (common < length))
        common[near[data[x[near]] == data[y[near]]]] += 1
    return np.minimum(common, n - np.maximum(a, b))


def _nearest_smaller(places: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Of each suffix, what it has in common with the nearest one before it in suffix order that stands at a smaller place.

    common: with the suffix right before. Each suffix looks at one before it, with only greater places between; while that
    one's place isn't smaller, it goes on to what that one looks at, and all do so at once. Few steps do nearly always;
    else one walk from the front to the back finishes, which is linear for any input.
    """
    at, low = np.arange(len(places)) - 1, common.copy()
    left = np.flatnonzero((at >= 0) & (places[at] >= places))
    for _ in range(STEPS):
        if not len(left):
            break
        p = at[left]
        at[left], low[left] = at[p], np.minimum(low[left], low[p])
        left = left[(at[left] >= 0) & (places[at[left]] >= places[left])]
    if len(left):
        own, at_list, low_list = places.tolist(), at.tolist(), low.tolist()
        for i in range(int(left[0]), len(own)):
            p = at_list[i]
            while p >= 0 and own[p] >= own[i]:
                low_list[i] = min(low_list[i], low_list[p])
                p = at_list[p]
            at_list[i] = p
        at, low = np.array(at_list), np.array(low_list)
    low[at < 0] = 0
    return low


def previous_factors(data: np.ndarray, starts: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """The longest-previous-factor array: of the suffix of data at each of `starts`, the length up to `length` of its longest match with a suffix at a smaller place.

    In suffix order the best earlier match is the nearest suffix before or behind that stands at a smaller place: the
    previous and next smaller values of the places, and the least common prefix on the way there.
    """
    if not len(starts):
        return np.zeros(0, np.int64)
    levels = suffix_levels(data, length)
    order = np.argsort(levels[-1][1][starts], kind="stable")
    own, at = starts[order], places[order]
    common = np.r_[0, common_prefixes(data, levels, own[:-1], own[1:])]
    before = _nearest_smaller(at, common)
    behind = _nearest_smaller(at[::-1], np.r_[0, common[:0:-1]])[::-1]
    out = np.empty(len(starts), np.int64)
    out[order] = np.maximum(before, behind)
    return out


def longest_previous_factors(data: bytes) -> np.ndarray:
    """For each place of data, the length of the longest string from there that also starts earlier."""
    at = np.arange(len(data))
    return previous_factors(np.frombuffer(data, np.uint8), at, at, max(len(data), 1))


class Segments:
    """Of several texts: stretches of windows (LENGTH bytes inside one text) that share their least fingerprint.

    doc, begin: the text and the place in it of a stretch's first window; n: its windows; its bytes are n + LENGTH - 1;
    times: how often the fingerprint stands in it.
    """

    NAMES = ("value", "doc", "begin", "n", "times")

    def __init__(self, texts: list[bytes]):
        parts = []
        for start, group in passes(texts):
            data = np.frombuffer(b"\n".join(group), np.uint8)
            lengths = np.fromiter(map(len, group), np.int64, len(group))
            first = np.r_[0, np.cumsum(lengths + 1)]
            grams = byte_hashes(data, GRAM)
            least = sliding(grams, WIDTH)
            # Number of windows that lie inside their text, from each text's start
            inside = np.zeros(len(least) + 1, np.int64)
            full = lengths >= LENGTH
            np.add.at(inside, first[:-1][full], 1)
            np.add.at(inside, (first[:-1] + lengths - LENGTH + 1)[full], -1)
            inside = np.cumsum(inside)[:-1] > 0
            change = np.r_[True, (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])] if len(least) else np.zeros(0, bool)
            heads = np.flatnonzero(change)
            ends = np.r_[heads[1:], len(least)] if len(heads) else heads
            kept = inside[heads]
            heads, ends = heads[kept], ends[kept]
            value = least[heads]
            doc = np.searchsorted(first, heads, side="right") - 1
            times = heads
            if len(heads):  # only where the least fingerprint stands more than once in a stretch can it repeat within itself
                edge = np.zeros(WIDTH - 1, np.uint64)
                own = np.flatnonzero(grams == sliding(np.r_[edge, least, edge], WIDTH, np.maximum))
                low = np.searchsorted(own, heads)
                near = np.searchsorted(own, ends + WIDTH - 1) - low
                same = grams[own[spread(low, near)]] == np.repeat(value, near)
                times = np.add.reduceat(same.astype(np.int64), np.r_[0, np.cumsum(near)[:-1]])
            # Least hashes lie close to zero; mixed once more, they spread over the parts.
            parts.append((mix(value), doc + start, heads - first[doc], ends - heads, times))
        empty = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)))
        self.value, self.doc, self.begin, self.n, self.times = (np.concatenate(x) for x in zip(*(parts or [empty])))

    def chosen(self, kept: np.ndarray) -> Segments:
        out = Segments([])
        for name in self.NAMES:
            setattr(out, name, getattr(self, name)[kept])
        return out

    def apart(self, texts: list[bytes]) -> Segments:
        """Each window as a stretch of its own, with a hash of itself for its value."""
        out = Segments([])
        out.doc, out.begin = np.repeat(self.doc, self.n), spread(self.begin, self.n)
        out.n, out.times = np.ones(len(out.doc), np.int64), np.ones(len(out.doc), np.int64)
        out.value = np.zeros(len(out.doc), np.uint64)
        for d in np.unique(out.doc).tolist():
            own = slice(*np.searchsorted(out.doc, [d, d + 1]))
            out.value[own] = byte_hashes(np.frombuffer(texts[d], np.uint8), LENGTH)[out.begin[own]]
        return out


def _prints(texts: list[bytes]) -> np.ndarray:
    s = Segments(texts)
    return np.concatenate([s.value, s.value[s.times > 1]])  # twice if it may repeat within itself


def _portions(values: np.ndarray, sizes: np.ndarray) -> Iterator[slice]:
    """Runs of stretches, sorted by fingerprint, of about ARRAY_BYTES together, without a cut between equal fingerprints."""
    reach = np.cumsum(sizes)
    begin = done = 0
    for cut in [*(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]:
        if cut > begin and (reach[cut - 1] - done >= ARRAY_BYTES or cut == len(values)):
            yield slice(begin, cut)
            begin, done = cut, reach[cut - 1]


def find(part: X.Part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, begin, end): the windows of stretches that start earlier in the part.

    Equal bodies are one suffix of the array, at their first place: what stands at a later one has it as a previous factor
    and goes whole. Bodies without another one under their fingerprint have no match but within themselves.
    """
    first, value, n = part.first, part.value[part.first], part.n[part.first]
    _, inverse, times = np.unique(value, return_inverse=True, return_counts=True)
    own = np.flatnonzero((times[inverse] > 1) | part.repeats[first])
    own = own[np.argsort(value[own], kind="stable")]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for portion in _portions(value[own], n[own] + LENGTH - 1):
        s = own[portion]
        size = n[s] + LENGTH - 1
        starts = spread(np.r_[0, np.cumsum(size)[:-1]], n[s])
        by_place = np.lexsort((part.begin[first[s]], part.key[first[s]]))
        key, begin = part.key[first[s]][by_place], part.begin[first[s]][by_place]
        number = np.empty(len(s), np.int64)
        # A text's places go on from one key to the next, far enough apart.
        reach = np.int64((part.begin[first[s]] + n[s]).max() + 1)
        number[by_place] = np.cumsum(np.r_[False, key[1:] != key[:-1]]) * reach + begin
        data = np.frombuffer(b"".join([part.bodies[k] for k in s.tolist()]), np.uint8)
        gone = previous_factors(data, starts, spread(number, n[s]), LENGTH) >= LENGTH
        # Runs of such windows in each stretch
        edge = np.zeros(len(gone) + 1, bool)
        edge[np.cumsum(n[s])] = edge[0] = True
        up = np.flatnonzero(gone & (edge[:-1] | ~np.r_[False, gone[:-1]]))
        down = np.flatnonzero(gone & (edge[1:] | ~np.r_[gone[1:], False])) + 1
        of = np.searchsorted(np.cumsum(n[s]), up, side="right")
        base = np.r_[0, np.cumsum(n[s])[:-1]][of]
        found.append((s[of], up - base, down - base))
    body, begin, end = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    # Verdicts on a body hold for all of its stretches at its first place.
    rows = np.flatnonzero(~part.later)
    order = np.argsort(part.which[rows], kind="stable")
    low, high = np.searchsorted(part.which[rows][order], body), np.searchsorted(part.which[rows][order], body, side="right")
    at, again = rows[order][spread(low, high - low)], np.repeat(np.arange(len(body)), high - low)
    later = np.flatnonzero(part.later)
    return np.r_[at, later], np.r_[begin[again], np.zeros(len(later), np.int64)], np.r_[end[again], part.n[later]]


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", digests: bool = False, as_text: bool = False, hot_places: int = X.HOT_PLACES) -> DataFrame:
    """One row per row of docs: `row` (all its columns but the text), n_bytes, n_removed, n_spans and kept (binary).

    With digests kept_sha256 comes in place of kept; with as_text kept_text, without characters that a cut left incomplete.

    Texts are UTF-8 bytes, null as empty. A byte goes if LENGTH bytes that cover it also start earlier: in a row with a
    smaller key, or under the same key at an earlier place. Rows with equal keys count as one text at the same places, so a
    repeated row keeps what the first keeps; a null key orders behind all others. Overlaps count, and strings are judged on
    the input. n_spans counts the longest runs of removed bytes. An empty table gives an empty one.

    Each LENGTH bytes go to the part of their least fingerprint, with the neighbours that share it, if it recurs at all. A
    part's suffix array and its longest previous factors tell which of them start earlier; stretches meet on their bytes.
    Stretches of fingerprints with over hot_places places are taken apart into single strings, which spread over all parts.
    """
    table = X.blocks(docs, text, key)
    bits = X.part_bits(table)

    def ask(block: int, rows: pa.Table, known: X.Known) -> list[X.Stretches]:
        texts, keys = rows.column("text").to_pylist(), rows.column("key").to_numpy()
        s = Segments(texts)
        usual, hot = known.masks(s.value)
        out = []
        for own, is_hot in ((s.chosen(usual), False), (s.chosen(hot).apart(texts), True)):
            out.append(X.stretches(block, keys, own.value, own.doc, own.begin, own.n, own.times > 1, lambda d, b, n: texts[d][b : b + n + LENGTH - 1], is_hot, True))
        return out

    known = X.recurring(table, _prints, hot_places)
    questions = X.asked(table, known, ask, bits)
    found = X.settled(questions, find, LENGTH - 1, True, bits)
    forget(known)
    last = "kept_sha256" if digests else "kept_text" if as_text else "kept"

    def finish(rows: pa.Table, spans: list[np.ndarray]) -> pa.Table:
        texts = rows.column("text").to_pylist()
        removed, runs, kept = [], [], []
        for t, s in zip(texts, spans):
            gone = X.covered(s, len(t)) if len(s) else None
            n = int(np.count_nonzero(gone)) if gone is not None else 0
            removed.append(n)
            runs.append(int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if n else 0)
            kept.append(np.frombuffer(t, np.uint8)[~gone].tobytes() if n else t)
        if digests:
            out = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())
        elif as_text:
            out = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
        else:
            out = pa.array(kept, pa.binary())
        return pa.table({"row": rows.column("row"), "n_bytes": pa.array(map(len, texts), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()), last: out})

    schema = T.StructType([X.row_field(docs, text), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField(last, T.StringType() if digests or as_text else T.BinaryType())])
    return X.finished(table, found, finish, schema)
