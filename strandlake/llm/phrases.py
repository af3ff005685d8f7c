"""Substring deduplication on words: confirm recurring passages, then find every occurrence with Aho-Corasick automata."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import exchange as X
from .common import SPACE_SEPARATORS, Words, forget, mix, passes, sliding, spread

WINDOW = 13
#: Words of a fingerprint; each window's least one tells whether the window is asked for at all.
GRAM = 7
#: Characters of the passages in one automaton.
SHARD_CHARS = 1 << 19


class Windows:
    """Of several texts: stretches of windows (WINDOW words inside one text) that share their least fingerprint.

    doc, begin: the text and the word in it at which a stretch's first window starts; n: its windows; its words are
    n + WINDOW - 1. With `each` also the hashes of all its windows, one stretch after the other.
    """

    def __init__(self, texts: list[bytes], each: bool = False):
        parts = []
        for start, group in passes(texts):
            words = Words(group, SPACE_SEPARATORS)
            least = sliding(words.window_hashes(GRAM), WINDOW - GRAM + 1)
            at = np.arange(len(least))
            doc = np.searchsorted(words.first, at, side="right") - 1
            inside = np.flatnonzero(at + WINDOW <= words.first[doc + 1])
            least, doc = least[inside], doc[inside]
            heads = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (np.diff(inside) != 1)]) if len(inside) else inside
            n = np.diff(np.r_[heads, len(inside)])
            hashes = words.window_hashes(WINDOW)[inside] if each else least[:0]
            # Least hashes lie close to zero; mixed once more, they spread over the parts.
            parts.append((mix(least[heads]), doc[heads] + start, (inside - words.first[doc])[heads], n, hashes))
        empty = np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64)
        self.value, self.doc, self.begin, self.n, self.hashes = (np.concatenate(x) for x in zip(*(parts or [empty])))


def _prints(texts: list[bytes]) -> np.ndarray:
    return Windows(texts).value


def windows_of(body: bytes) -> list[bytes]:
    words = body.split(b" ")
    return [b" ".join(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1)]


def passages(part: X.Part) -> dict[bytes, int]:
    """The passages of a part that recur, each with the least key under which it stands.

    A body alone under its fingerprint is one passage if it has several keys. Bodies that share a fingerprint may have
    windows in common: each window that stands under several keys is a passage.
    """
    value = part.value[part.first]
    _, inverse, times = np.unique(value, return_inverse=True, return_counts=True)
    alone = times[inverse] == 1
    least = part.key[part.first].tolist()
    most = np.full(len(part.first), np.iinfo(np.int64).min)
    np.maximum.at(most, part.which, part.key)
    out, seen = {}, {}
    for k in np.argsort(value, kind="stable").tolist():
        if alone[k]:
            if most[k] > least[k]:
                out[part.bodies[k]] = least[k]
        else:
            for w in windows_of(part.bodies[k]):
                low, high = seen.get(w, (least[k], most[k]))
                seen[w] = min(low, least[k]), max(high, most[k])
    return out | {w: low for w, (low, high) in seen.items() if high > low}


def automata(found: dict[bytes, int], shard_chars: int = SHARD_CHARS) -> Iterator[ahocorasick.Automaton]:
    """Automata over shards of the passages; each value is (length in characters, least key)."""
    shard, size = ahocorasick.Automaton(), 0
    for text, since in sorted(found.items()):
        if size and size + len(text) > shard_chars:
            shard.make_automaton()
            yield shard
            shard, size = ahocorasick.Automaton(), 0
        shard.add_word(" " + text.decode("latin-1") + " ", (len(text), since))
        size += len(text)
    if size:
        shard.make_automaton()
        yield shard


def located(found: dict[bytes, int], bodies: list[bytes], shard_chars: int = SHARD_CHARS) -> list[list[tuple[int, int, int]]]:
    """Of each body, (first word, word behind the last, least key) of every occurrence of a passage."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in bodies]
    texts = [" " + b.decode("latin-1") + " " for b in bodies]
    for automaton in automata(found, shard_chars):
        for hits, text in zip(out, texts):
            begins = None
            for end, (length, since) in automaton.iter(text):
                if begins is None:  # of each word, and behind the last
                    begins = list(accumulate(map(len, text.split(" ")[1:-1]), lambda a, n: a + n + 1, initial=1))
                hits.append((bisect_left(begins, end - length), bisect_left(begins, end + 1), since))
    return out


def find(part: X.Part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, begin, end): the windows of stretches that also stand under a smaller key, by streaming all bodies through the part's automata."""
    hits = located(passages(part), part.bodies)
    sizes = np.fromiter(map(len, hits), np.int64, len(hits))
    flat = np.array([h for own in hits for h in own], np.int64).reshape(-1, 3)
    base = np.r_[0, np.cumsum(sizes)[:-1]] if len(sizes) else sizes
    rows = np.repeat(np.arange(len(part.which)), sizes[part.which])
    at = spread(base[part.which], sizes[part.which])
    gone = flat[at, 2] < part.key[rows]
    return rows[gone], flat[at[gone], 0], flat[at[gone], 1] - (WINDOW - 1)


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", digests: bool = False, hot_places: int = X.HOT_PLACES) -> DataFrame:
    """One row per row of docs: `row` (all its columns but the text), n_words, n_removed and kept_text, or with digests kept_sha256.

    Words are runs of [^\\x20\\x09-\\x0D]. A word goes if a window of WINDOW words that covers it also starts in a document
    with a smaller key; windows are judged on the input. Kept words are joined by one space. Null and empty texts have no
    words. A null key orders behind all others; rows with equal keys don't count against each other, so repeated rows all
    keep what the first keeps. An empty table gives an empty one.

    Windows go to the part of their least fingerprint, with the neighbours that share it, if it recurs at all. A part
    confirms on the words themselves which passages stand under several keys, compiles automata over these, and streams the
    stretches of all documents through them; each occurrence goes from the documents behind the passage's least key.
    Stretches of fingerprints with over hot_places places are taken apart into single windows, which spread over all parts.
    """
    table = X.blocks(docs, text, key)
    bits = X.part_bits(table)

    def ask(block: int, rows: pa.Table, known: X.Known) -> list[X.Stretches]:
        texts, keys = rows.column("text").to_pylist(), rows.column("key").to_numpy()
        w = Windows(texts, each=True)
        words: dict[int, list[bytes]] = {}

        def body(d: int, b: int, n: int) -> bytes:
            if d not in words:
                words[d] = texts[d].split()
            return b" ".join(words[d][b : b + n + WINDOW - 1])

        usual, hot = known.masks(w.value)
        one = np.ones(int(w.n[hot].sum()), np.int64)
        hashes = w.hashes[spread(np.r_[0, np.cumsum(w.n)[:-1]][hot], w.n[hot])] if len(one) else w.hashes[:0]
        return [
            X.stretches(block, keys, w.value[usual], w.doc[usual], w.begin[usual], w.n[usual], w.n[usual] < 0, body, False, False),
            X.stretches(block, keys, mix(hashes), np.repeat(w.doc[hot], w.n[hot]), spread(w.begin[hot], w.n[hot]) if len(one) else one, one, one < 0, body, True, False),
        ]

    known = X.recurring(table, _prints, hot_places)
    questions = X.asked(table, known, ask, bits)
    found = X.settled(questions, find, WINDOW - 1, False, bits)
    forget(known)
    last = "kept_sha256" if digests else "kept_text"

    def finish(rows: pa.Table, spans: list[np.ndarray]) -> pa.Table:
        n, removed, out = [], [], []
        for t, s in zip(rows.column("text").to_pylist(), spans):
            words = t.split()
            n.append(len(words))
            gone = X.covered(s, len(words)) if len(s) else np.zeros(0, bool)
            removed.append(int(np.count_nonzero(gone)))
            kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if removed[-1] else words)
            out.append(hashlib.sha256(kept).hexdigest() if digests else kept.decode("utf-8", "replace"))
        return pa.table({"row": rows.column("row"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), last: pa.array(out, pa.string())})

    schema = T.StructType([X.row_field(docs, text), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(last, T.StringType())])
    return X.finished(table, found, finish, schema)
