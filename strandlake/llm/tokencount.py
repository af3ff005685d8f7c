"""Exact token counts of texts and of each of their prefixes, for sentencepiece BPE models."""

from __future__ import annotations

import gc
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import passes, text_column
from .prefixbpe import PrefixEncoder

COUNT_BYTES = 8 << 20
KEPT_CHUNKS = 600_000
LIMIT = 4096
SPACE = "▁"


class PieceCounts:
    """A sentencepiece BPE model with byte fallback, identity normalization, and pieces of spaces alone that rank behind all others.

    The text, with a space put before it, is cut before each space behind another character; no other piece crosses such a
    cut. For each distinct chunk between cuts the exact token count of every prefix is stored: the prefix programme gives
    it for words, and for runs of spaces, whose pieces are merged last and from the left, a count that grows by one with
    each run of the longest such piece.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, trainer = model.normalizer_spec, model.trainer_spec
        normal = {p.piece: -p.score for p in model.pieces if p.type == p.NORMAL}
        spaces = {p: r for p, r in normal.items() if len(p) > 1 and not p.strip(SPACE)}
        ranks = {p: r for p, r in normal.items() if p not in spaces}
        if (
            trainer.model_type != trainer.BPE or not trainer.byte_fallback or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not spec.escape_whitespaces
            or any(SPACE in p[1:] for p in ranks) or any(p.type in (p.USER_DEFINED, p.UNUSED) for p in model.pieces) or len(set(spaces.values())) > 1 or any(r >= s for p, r in ranks.items() for s in set(spaces.values()) if len(p) > 1)
        ):
            raise ValueError(f"{path}: not such a model")
        self.encoder = PrefixEncoder(ranks)
        self._longest = max(map(len, spaces), default=1)
        merge = PrefixEncoder(spaces | {SPACE: 0}).merge
        self._runs = [len(merge(SPACE * k)) if k else 0 for k in range(4 * self._longest)]
        if any(self._runs[k + self._longest] != n + 1 for k, n in enumerate(self._runs[: -self._longest])):
            raise ValueError(f"{path}: runs of spaces aren't counted so")
        known = "".join(c for c in ranks if len(c) == 1)
        self.unknown = re.compile(f"([^{re.escape(known)}])")
        #: chunk without its first space: token counts of its prefixes, from one character on with that space
        self.stored: dict[str, bytes | tuple[int, ...]] = {}
        #: the last of these
        self.total: dict[str, int] = {}

    def run_count(self, spaces: int) -> int:
        """Tokens of so many spaces."""
        return self._runs[spaces % self._longest] + spaces // self._longest

    def chunks(self, text: str) -> list[str]:
        """Each stands for itself with one space before it."""
        if not text:
            return []
        text = text.replace(" ", SPACE)
        if text.startswith(SPACE) or SPACE * 2 in text or text.endswith(SPACE):
            return [m[1:] for m in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text)]
        return text.split(SPACE)

    def _learn(self, chunks: set[str]) -> None:
        """Store the prefix counts of chunks; words are passed over in the order of a trie, each shared prefix once."""
        split, several = self.unknown.split, {c for c in chunks if c.startswith(SPACE)}
        bare = {c: c.lstrip(SPACE) for c in several}
        cut = {SPACE + c: split(SPACE + c) for c in {*bare.values(), *(chunks - several)}}
        behind = {cut[SPACE + c][0] for c in bare.values()}  # parts with more spaces before them
        own: dict[str, bytes | tuple[int, ...]] = {}  # of each part, the token counts of its prefixes
        lone: dict[str, list[bool]] = {}  # whether these begin with a space that is a token
        for part, last, count in self.encoder.walk(sorted({p for ps in cut.values() for p in ps[::2] if p})):
            n = len(part) + 1
            own[part] = bytes(count[1:n]) if n <= 256 else tuple(count[1:n])
            if part in behind:
                alone = [True] * n
                for i in range(2, n):
                    j = i - len(last[i])
                    alone[i] = j > 0 and alone[j]
                lone[part] = alone[1:]
        stored, total = self.stored, self.total
        for c in chunks:
            parts = cut[SPACE + bare.get(c, c)]
            if len(parts) == 1 and c not in several:
                found = stored[c] = own[parts[0]]
                total[c] = found[-1]
                continue
            spaces, counts, base = len(c) - len(bare.get(c, c)) + 1, [], 0
            for j, p in enumerate(parts):
                if j % 2:
                    counts.append(base := base + len(p.encode()))
                elif p:
                    found = own[p]
                    if not counts and spaces > 1:
                        # A lone first space is merged with those before it, once all other pieces are formed.
                        found = [self.run_count(spaces) + n - 1 if alone else self.run_count(spaces - 1) + n for n, alone in zip(found, lone[p])]
                        counts = [self.run_count(k) for k in range(1, spaces)]
                    counts += [base + n for n in found] if base else found
                    base = counts[-1]
            stored[c] = bytes(counts) if max(counts) < 256 else tuple(counts)
            total[c] = base

    def _known(self, texts: list[str]) -> list[list[str]]:
        cut = [self.chunks(t) for t in texts]
        needed = set().union(*cut)
        if len(self.stored) > KEPT_CHUNKS:
            self.stored = {c: n for c, n in self.stored.items() if c in needed}
            self.total = {c: n for c, n in self.total.items() if c in needed}
        self._learn(needed - self.stored.keys())
        return cut

    def counts(self, texts: list[str], budget: int | None = None) -> list[tuple[int, int]]:
        """(tokens, characters of the longest prefix within the budget) of each text, from the stored counts."""
        known, out = self._known(texts), []
        get = self.total.__getitem__
        for text, chunks in zip(texts, known):
            n = sum(map(get, chunks))
            out.append((n, len(text) if budget is None or n <= budget else self._within(chunks, budget)))
        return out

    def _within(self, chunks: list[str], budget: int) -> int:
        best = at = base = 0
        for c in chunks:
            if base >= budget:
                break
            if base + self.total[c] <= budget:
                best = at + len(c) + 1
            else:
                best = max([best, *(at + i for i, n in enumerate(self.stored[c], 1) if base + n <= budget)])
            base += self.total[c]
            at += len(c) + 1
        return max(0, best - 1)  # the space put before the text

    def prefix_counts(self, text: str) -> np.ndarray:
        """Entry i is the token count of text[:i]: each chunk's stored counts behind those before it."""
        out, at, base = np.zeros(len(text) + 1, np.int64), 0, 0
        for c in self._known([text])[0]:
            out[at : at + len(c) + 1] = np.fromiter(self.stored[c], np.int64, len(c) + 1) + base
            base += self.total[c]
            at += len(c) + 1
        out[0] = 0  # an empty text gets no space
        return out

    def longest_prefix(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most `budget` tokens."""
        return self.counts([text], budget)[0][1]


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounts:
    return PieceCounts(path)


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: the key, n_bytes, n_tokens, over_limit (more than limit tokens), limit_chars.

    limit_chars are the characters of the text's longest prefix of at most limit tokens, looked up in the stored prefix
    counts. A null or empty text has neither bytes nor tokens. Keys may be null or repeated; other columns are not read. An
    empty table gives an empty one. A very long text is a pass of its own, in memory in proportion to it.
    """
    source = docs.select(F.col(f"`{key}`").alias("key"), text_column(f"`{text}`").alias("text"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        gc.disable()  # as in bpe: no cycles here
        try:
            pieces = counter(path)
            for batch in batches:
                for start, group in passes(batch.column(1).cast(pa.binary()).to_pylist(), COUNT_BYTES):
                    n, chars = zip(*pieces.counts([g.decode("utf-8", "replace") for g in group], limit))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(group)), pa.array([len(g) for g in group], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(chars, pa.int64())], ["key", "n_bytes", "n_tokens", "over_limit", "limit_chars"])
        finally:
            gc.enable()

    return source.mapInArrow(run, f"key {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, limit_chars bigint").withColumnRenamed("key", key)


def prefix_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: the key and counts, where counts[i] is the token count of the first i characters.

    With them, truncation to any budget and the cost of any cut are lookups. A null text counts as empty: [0]. Keys may be
    null or repeated; an empty table gives an empty one. A very long text's counts are one array of its length.
    """
    source = docs.select(F.col(f"`{key}`").alias("key"), text_column(f"`{text}`").alias("text"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        pieces = counter(path)
        for batch in batches:
            for start, group in passes(batch.column(1).cast(pa.binary()).to_pylist()):
                counts = [pieces.prefix_counts(g.decode("utf-8", "replace")) for g in group]
                offsets = np.r_[0, np.cumsum([len(c) for c in counts])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(group)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(counts).astype(np.int32)))], ["key", "counts"])

    return source.mapInArrow(run, f"key {kind}, counts array<int>").withColumnRenamed("key", key)
