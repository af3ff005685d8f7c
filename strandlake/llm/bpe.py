"""Encoding and decoding with a byte-level BPE vocabulary file, equal to the tokenizers library's results."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory, spread, text_column
from .prefixbpe import ByteWalk, PrefixEncoder

#: Bytes of text encoded together: the larger, the more words and prefixes are shared; bounds a task's memory.
ENCODE_BYTES = 8 << 20
#: Bytes of results handed over at once.
OUT_BYTES = 2 << 20
#: Bytes of a word that is walked side by side with others; longer ones, which are few, are walked alone.
LONG_WORD = 64

#: The split pattern of byte-level vocabularies, and characters that count as white space in it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"

#: Below this the library's and our tables of letters agree; chunks with other characters are split by the library.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ]*")
#: A space and one word of ASCII letters; a space and plain characters that don't end with white space.
ONE_WORD = "^ [A-Za-z]+$"
PLAIN_CHUNK = r"^ [\t\n\r\x21-\x7e\x{a1}-\x{24f}]*[\x21-\x7e\x{a1}-\x{24f}]$"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in such vocabularies: itself where printable, else the next from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class ByteBPE:
    """A vocabulary file of the tokenizers library with a ByteLevel pre-tokenizer that adds no prefix space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        added = [t for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"]]
        if not plain or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or added:
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        ids = model["vocab"]
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        symbols = byte_symbols()
        self.symbols = {b: s for b, s in enumerate(symbols)}
        self.bytes_of_symbols = {ord(s): b for b, s in enumerate(symbols)}
        self.encoder = PrefixEncoder({**{s: -1 for s in symbols}, **{m: i for i, m in enumerate(merges)}})
        self.tokens = list(self.encoder.ranks)
        self.number = {t: i for i, t in enumerate(self.tokens)}
        raw = [self._raw(t) for t in self.tokens]
        self.walk = ByteWalk(raw, self._pair)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: of each token, by its number: its id as text, and its bytes; those of special strings stand behind
        self.id_text = pa.array([str(ids[t]) for t in self.tokens] + [str(i) for i in self.special.values()], pa.large_string())
        self.token_bytes = pa.array(raw + [t.encode() for t in self.special], pa.large_binary())
        self.special_number = {t: len(raw) + k for k, t in enumerate(self.special)}
        self.library = Tokenizer.from_file(path)
        self.library_split = self.library.pre_tokenizer.pre_tokenize_str
        self.find = regex.compile(PATTERN).findall
        self.risky = f"[{WHITE}] "

    def _raw(self, word: str) -> bytes:
        return word.translate(self.bytes_of_symbols).encode("latin-1")

    def _pair(self, a: int, b: int) -> bool:
        """Whether two tokens, or one behind no other, are the encoding of their text."""
        both = [self.tokens[i] for i in (a, b) if i < len(self.tokens)]
        return self.encoder.merge("".join(both)) == both

    def words(self, text: str) -> list[bytes]:
        """Pre-tokens in UTF-8."""
        if PLAIN.fullmatch(text):
            return [w.encode() for w in self.find(text)]
        return [self._raw(w) for w, _ in self.library_split(text)]

    def _words_of(self, chunks: pa.Array, heads: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The words of all chunks, each with a space before it, then of the heads as they are; and how many each has."""
        led = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), chunks, pa.scalar(" ", pa.large_string()))
        one = pc.match_substring_regex(led, ONE_WORD).to_numpy(zero_copy_only=False)
        plain = ~one & pc.match_substring_regex(led, PLAIN_CHUNK).to_numpy(zero_copy_only=False)
        # Plain chunks are cut together: a word that begins with a space begins a chunk, and none reaches over one.
        found = pa.array(self.find("".join(led.filter(pa.array(plain)).to_pylist())), pa.large_string())
        begins = np.cumsum(pc.starts_with(found, " ").to_numpy(zero_copy_only=False)) - 1
        others = np.flatnonzero(~one & ~plain)
        rest = [self.words(t) for t in [*led.take(pa.array(others)).to_pylist(), *heads]]
        owners = np.r_[others, len(chunks) + np.arange(len(heads))]
        owner = np.concatenate([np.flatnonzero(one), np.flatnonzero(plain)[begins], np.repeat(owners, np.fromiter(map(len, rest), np.int64, len(rest)))])
        words = pa.concat_arrays([led.filter(pa.array(one)).cast(pa.large_binary()), found.cast(pa.large_binary()), pa.array([w for ws in rest for w in ws], pa.large_binary())])
        return words.take(pa.array(np.argsort(owner, kind="stable"))), np.bincount(owner, minlength=len(chunks) + len(heads))

    def _tokens_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of distinct words, one after the other, and each word's number of them."""
        start = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data, size = np.frombuffer(words.buffers()[2] or b"", np.uint8), np.diff(start)
        long, short = np.flatnonzero(size > LONG_WORD), np.flatnonzero(size <= LONG_WORD)
        tokens, counts = self.walk.encode(data, start[short], size[short])
        if not len(long):
            return tokens, counts
        shown = ["".join(map(self.symbols.__getitem__, words[i].as_py())) for i in long.tolist()]
        known = dict(self.encoder.encode(shown))
        lists = [np.array([self.number[t] for t in known[w]], np.int32) for w in shown]
        sizes, which = np.r_[counts, np.fromiter(map(len, lists), np.int64, len(lists))], np.empty(len(words), np.int64)
        tokens, first = np.concatenate([tokens, *lists]), np.cumsum(sizes) - sizes
        which[np.r_[short, long]] = np.arange(len(words))
        return tokens[spread(first[which], sizes[which])], sizes[which]

    def _learned(self, chunks: pa.Array, heads: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of each chunk behind a space, then of each head, and how many each has; distinct words are encoded once."""
        words, n_words = self._words_of(chunks, heads)
        coded = words.dictionary_encode()
        tokens, counts = self._tokens_of(coded.dictionary)
        which = coded.indices.to_numpy()
        ends = np.r_[0, np.cumsum(counts[which])][np.r_[0, np.cumsum(n_words)]]
        return tokens[spread((np.cumsum(counts) - counts)[which], counts[which])], np.diff(ends)

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Number of ids, ids joined by commas, and decoded bytes of each text (large_string, no nulls); special strings get their own ids.

        Texts are cut into chunks that can be encoded alone: at their spaces, but for texts where a run of white space ends in a
        space, which such a cut would change. A chunk stands for itself with a space before it, but for a piece's first one.
        """
        n = len(texts)
        cut = ~pc.match_substring_regex(texts, self.risky).to_numpy(zero_copy_only=False)
        odd = np.zeros(n, bool)
        for s in self.special:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        pieces, owner = texts.filter(pa.array(cut & ~odd)), np.flatnonzero(cut & ~odd)
        lists = pc.split_pattern(pieces, " ")
        offsets = lists.offsets.to_numpy()
        values, sizes = lists.flatten(), np.diff(offsets)
        first = offsets[:-1] - offsets[0]
        rest = np.ones(len(values), bool)
        rest[first] = False
        coded = values.filter(pa.array(rest)).dictionary_encode()
        chunks = coded.dictionary
        # Pieces of other texts: whole, or between special strings; each is one unit.
        alone, alone_owner = [], []
        for i in np.flatnonzero(~cut | odd).tolist():
            parts = self.split_special.split(texts[i].as_py()) if odd[i] else [texts[i].as_py()]
            alone += [(p, k % 2 == 1) for k, p in enumerate(parts)]
            alone_owner += [i] * len(parts)
        heads = list(dict.fromkeys([*values.take(pa.array(first)).to_pylist(), *[p for p, special in alone if not special]]))
        place = {h: len(chunks) + k for k, h in enumerate(heads)}
        special_place = {s: len(chunks) + len(heads) + k for k, s in enumerate(self.special)}
        tokens, counts = self._learned(chunks, heads)
        tokens, counts = np.r_[tokens, np.array(list(self.special_number.values()), np.int32)], np.r_[counts, np.ones(len(self.special), np.int64)]

        # The units of all texts in order: those of the cut ones, and those of the others sorted in between.
        units = np.empty(len(values), np.int64)
        units[rest] = coded.indices.to_numpy()
        units[first] = [place[h] for h in values.take(pa.array(first)).to_pylist()]
        of = np.repeat(owner, sizes)
        if alone:
            units = np.r_[units, [special_place[p] if special else place[p] for p, special in alone]]
            of = np.r_[of, alone_owner]
            order = np.argsort(of, kind="stable")
            units, of = units[order], of[order]
        there = counts[units] > 0  # an empty piece has no ids
        units, of = units[there], of[there]
        bounds = pa.array(np.r_[0, np.cumsum(np.bincount(of, minlength=n))])
        inside, taken = pa.array(np.r_[0, np.cumsum(counts)]), pa.array(units)

        def joined(of_token: pa.Array, between: str | bytes) -> pa.Array:
            by = pa.scalar(between, of_token.type)
            of_unit = pc.binary_join(pa.LargeListArray.from_arrays(inside, of_token.take(pa.array(tokens))), by)
            return pc.binary_join(pa.LargeListArray.from_arrays(bounds, of_unit.take(taken)), by)

        total = np.r_[0, np.cumsum(counts[units])][bounds.to_numpy()]
        return np.diff(total), joined(self.id_text, ","), joined(self.token_bytes, b"")


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows of at most `most` bytes together, or one larger row."""
    first, ends = 0, np.cumsum(sizes)
    while first < len(sizes):
        end = max(first + 1, int(np.searchsorted(ends, most + (ends[first - 1] if first else 0), "right")))
        yield first, end
        first = end


def valid_text(column: pa.Array) -> pa.Array:
    """The column as large_string; what isn't UTF-8 is replaced as Python does."""
    raw = column.cast(pa.large_binary())
    try:
        return raw.cast(pa.large_string())
    except pa.ArrowInvalid:
        return pa.array([b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.large_string())


@lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBPE:
    return ByteBPE(path)


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", digests: bool = False, pass_bytes: int = ENCODE_BYTES) -> DataFrame:
    """One row per row of docs: the key, n_tokens, ids (joined by commas) and decoded text, or with digests their SHA-256.

    A null or empty text has no ids and decodes to an empty text. Keys may be null or repeated; other columns of docs are
    not read. Each row is worked on alone, so an empty table gives an empty one. pass_bytes sets how much text shares its
    words: memory against time, with equal results.
    """
    source = docs.select(F.col(f"`{key}`").alias("key"), text_column(f"`{text}`").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")

    def digest(column: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(b).hexdigest() for b in column.cast(pa.large_binary()).to_pylist()], pa.string())

    def run(batches):
        bpe = vocabulary(path)
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, end in runs(sizes, pass_bytes):
                counts, ids, decoded = bpe.encode_texts(valid_text(batch.column(1).slice(first, end - first)))
                decoded = valid_text(decoded)
                out = [digest(ids), digest(decoded)] if digests else [ids, decoded]
                made = np.add(*(pc.binary_length(c).to_numpy().astype(np.int64) for c in out))
                for a, b in runs(made, OUT_BYTES):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first + a, b - a), pa.array(counts[a:b], pa.int64()), *[c.slice(a, b - a).cast(pa.string()) for c in out]], ["key", "n_tokens", *names])
                del counts, ids, decoded, out
                release_memory()

    return source.mapInArrow(run, f"key {kind}, n_tokens bigint, {names[0]} string, {names[1]} string").withColumnRenamed("key", key)
