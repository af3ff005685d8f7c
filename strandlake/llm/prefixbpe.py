"""Byte-pair encoding by prefixes: of each prefix of a word, only the last token of its encoding is kept.

A sequence of tokens is the encoding of its text if and only if each two neighbours encode to themselves together. So the
last token of a prefix is the one token t that ends there and forms such a pair with the last token of the prefix before t.
Words that share a prefix share these states: words are visited in the depth-first order of their trie, which is their
sorted order, and only the symbols behind the prefix shared with the word before are new.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from .common import eights, spread

#: Entries that a cache of pairs holds before it starts anew; memory only, results don't depend on it.
PAIRS = 900_000
#: Words that are walked side by side; memory only.
SIDE_BY_SIDE = 1 << 16


class PrefixEncoder:
    """ranks: a token's text to its rank; of two tokens that can be formed, the lower rank comes first, then the left one.

    Every symbol (character) of a word must itself be a token.
    """

    def __init__(self, ranks: dict[str, int | float]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=0)
        #: of each token, the tokens that it was tried behind ("" at the start of a word), and whether the pair holds
        self._behind: dict[str, dict[str, bool]] = {t: {} for t in ranks}
        self._pairs = 0

    def merge(self, text: str) -> list[str]:
        """The encoding by merges; quadratic, for pairs of tokens and for tests."""
        parts, ranks = list(text), self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _pair(self, a: str, b: str) -> bool:
        if self._pairs >= PAIRS:
            for known in self._behind.values():
                known.clear()
            self._pairs = 0
        ok = self._behind[b][a] = self.merge(a + b) == ([a, b] if a else [b])
        self._pairs += 1
        return ok

    def walk(self, words: Iterable[str]) -> Iterator[tuple[str, list[str], list[int]]]:
        """(word, last, count) of each word of a sorted iterable: last[i] and count[i] hold the last token and the number of tokens of its first i symbols.

        Both lists are reused; only their first len(word) + 1 entries count.
        """
        behind, longest = self._behind.get, self.longest
        last, count, before = [""], [0], ""
        for word in words:
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            if len(last) <= len(word):
                more = len(word) + 1 - len(last)
                last += [""] * more
                count += [0] * more
            for i in range(shared + 1, len(word) + 1):
                for j in range(i - 1, i - longest - 1 if i > longest else -1, -1):
                    t = word[j:i]
                    known = behind(t)
                    if known is not None:
                        ok = known.get(last[j])
                        if ok or ok is None and self._pair(last[j], t):
                            break
                else:
                    raise ValueError(f"no token for {word[i - 1]!r}")
                last[i] = t
                count[i] = count[j] + 1
            yield word, last, count
            before = word

    def encode(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """Each distinct word and its tokens."""
        for word, last, count in self.walk(sorted(set(words))):
            i, tokens = len(word), [""] * count[len(word)]
            for k in range(len(tokens) - 1, -1, -1):
                tokens[k] = last[i]
                i -= len(tokens[k])
            yield word, tokens

    def counts(self, words: Iterable[str]) -> dict[str, int]:
        return {word: count[len(word)] for word, _, count in self.walk(sorted(set(words)))}


class IntTable:
    """Small numbers by keys from 0 on, with open addressing; many keys are looked up at once."""

    def __init__(self, bits: int):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        self.entries = 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it has none."""
        at = self._slots(keys)
        found = self.keys[at]
        hit = found == keys
        out = np.where(hit, self.values[at], -1)
        todo = np.flatnonzero(~hit & (found >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that the table doesn't have; it needs to keep free slots."""
        self.entries += len(keys)
        at = self._slots(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & self.mask


class ByteWalk:
    """PrefixEncoder.walk over many words of bytes side by side: one symbol further in all of them at a time.

    Tokens are numbers, places in `tokens`. The candidates for the last token of a prefix are read backwards from its end in a trie
    of reversed tokens; pair(a, b) tells of two tokens whether they encode to themselves together, a = len(tokens) being none.
    """

    def __init__(self, tokens: list[bytes], pair):
        self.pair, self.none = pair, len(tokens)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        children, ends = {}, {}
        for i, token in enumerate(tokens):
            node = 0
            for byte in reversed(token):
                node = children.setdefault(node << 8 | byte, len(children) + 1)
            ends[node] = i
        self.token_at = np.full(len(children) + 1, -1, np.int32)
        self.token_at[list(ends)] = list(ends.values())
        self.children = IntTable((4 * len(children)).bit_length())
        self.children.put(np.fromiter(children, np.int64, len(children)), np.fromiter(children.values(), np.int32, len(children)))
        self.pairs = IntTable((2 * PAIRS).bit_length())

    def _fit(self, before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        keys = before.astype(np.int64) << 32 | tokens
        known = self.pairs.get(keys)
        open_ = np.flatnonzero(known < 0)
        if len(open_):
            new, which = np.unique(keys[open_], return_inverse=True)
            fit = np.array([self.pair(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()], np.int32)
            known[open_] = fit[which]
            if self.pairs.entries + len(new) > PAIRS:
                self.pairs = IntTable((2 * PAIRS).bit_length())
            self.pairs.put(new[:PAIRS], fit[:PAIRS])
        return known > 0

    def _step(self, data: np.ndarray, ends: np.ndarray, at: np.ndarray, last: np.ndarray) -> None:
        """Sets last[at]: the last token of each prefix; its last byte is data[ends], what holds for the prefix one shorter is last[at - 1]."""
        node, length = np.zeros(len(at), np.int64), 0
        while len(at):
            node = self.children.get(node << 8 | data[ends - length])
            length += 1
            if (node < 0).any():
                raise ValueError("a byte without a token")
            token = self.token_at[node]
            fits = token >= 0
            some = np.flatnonzero(fits)
            fits[some] = self._fit(last[at[some] - length], token[some])
            last[at[fits]] = token[fits]
            open_ = ~fits
            node, ends, at = node[open_], ends[open_], at[open_]

    def _walk(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(start)
        base = np.cumsum(size + 1) - size - 1
        last = np.zeros(int(base[-1] + size[-1]) + 1, np.int32)
        last[base] = self.none
        shared, same, depth = np.zeros(n, np.int64), np.arange(1, n), 0
        while len(same):  # bytes shared with the word before
            same = same[(size[same] > depth) & (size[same - 1] > depth)]
            same = same[data[start[same] + depth] == data[start[same - 1] + depth]]
            depth += 1
            shared[same] = depth
        there = np.arange(n)
        for depth in range(1, int(size.max()) + 1):
            there = there[size[there] >= depth]
            new = shared[there] < depth
            at = base[there] + depth
            self._step(data, start[there[new]] + depth - 1, at[new], last)
            last[at] = last[at[np.maximum.accumulate(np.where(new, np.arange(len(there)), 0))]]
        found, left, who = [], size.copy(), np.arange(n)
        while len(who):  # from each word's end back to its start
            token = last[base[who] + left[who]]
            found.append((who, token))
            left[who] -= self.lengths[token]
            who = who[left[who] > 0]
        counts = np.bincount(np.concatenate([w for w, _ in found]), minlength=n)
        ends = np.cumsum(counts)
        tokens = np.empty(int(ends[-1]), np.int32)
        for k, (who, token) in enumerate(found):
            tokens[ends[who] - 1 - k] = token
        return tokens, counts

    def encode(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words, one after the other, and each word's number of them. A word: `size` bytes (one or more) of data from `start` on."""
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        # Words with equal first eight bytes stand together. What neighbours share is compared, so any order gives the same tokens.
        behind = (8 * (8 - np.minimum(size, 8))).astype(np.uint64)
        order = np.argsort(eights(data)[start].byteswap() >> behind << behind)
        parts = [self._walk(data, start[o], size[o]) for o in np.split(order, range(SIDE_BY_SIDE, len(order), SIDE_BY_SIDE))]
        tokens, counts = (np.concatenate(x) for x in zip(*parts))
        out, begin = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        out[order], begin[order] = counts, np.cumsum(counts) - counts
        return tokens[spread(begin, out)], out
