"""Byte-level encoding over whole columns: equal to merging, and without Python steps for each word."""

import random
import sys

import numpy as np
import pyarrow as pa
import pytest

from strandlake.llm import bpe, prefixbpe
from strandlake.llm.prefixbpe import PrefixEncoder
from strandlake.llm.queries import vocabulary_file


def test_bytes_side_by_side_equal_merging():
    rng = random.Random(3)
    tokens = ["a", "b", "c", "ab", "bc", "aa", "abc", "ca", "aab", "bcab", "cc"]
    e = PrefixEncoder({t: i if len(t) > 1 else -1 for i, t in enumerate(tokens)})
    texts = lambda *numbers: [tokens[n] for n in numbers if n < len(tokens)]
    walk = prefixbpe.ByteWalk([t.encode() for t in tokens], lambda a, b: e.merge("".join(texts(a, b))) == texts(a, b))
    words = ["".join(rng.choices("abc", k=rng.randint(1, 12))) for _ in range(500)]
    size = np.array([len(w) for w in words])
    for entries, together in ((900_000, 1 << 16), (10, 7)):  # the second: the table of pairs starts anew again and again
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(prefixbpe, "PAIRS", entries)
            patch.setattr(prefixbpe, "SIDE_BY_SIDE", together)
            walk.pairs = prefixbpe.IntTable(12)
            found, counts = walk.encode(np.frombuffer("".join(words).encode(), np.uint8), np.cumsum(size) - size, size)
        ends = np.cumsum(counts)
        assert [texts(*found[b - n : b].tolist()) for b, n in zip(ends, counts)] == [e.merge(w) for w in words]


def test_encoding_takes_no_python_steps_for_each_word():
    """Stage 5 of the pipeline was the slowest: it walked each word of a pass in Python, and words seen before once more in the next pass."""
    rng, lines = random.Random(4), 0
    words = ["".join(rng.choices("aeinorst", k=rng.randint(3, 12))) + rng.choice(["", "", ",", ".\nThe"]) for _ in range(20_000)]
    texts = [" ".join(words[k : k + 100]) for k in range(0, len(words), 100)]
    vocabulary = bpe.ByteBPE(vocabulary_file("byte_bpe_50k.json"))

    def encode():
        return [c.to_pylist() if isinstance(c, pa.Array) else c.tolist() for c in vocabulary.encode_texts(pa.array(texts, pa.large_string()))]

    def count(code, line):
        nonlocal lines
        lines += 1

    first = encode()  # what pairs of tokens encode to is learned once
    sys.monitoring.use_tool_id(4, "lines")
    sys.monitoring.register_callback(4, sys.monitoring.events.LINE, count)
    sys.monitoring.set_events(4, sys.monitoring.events.LINE)
    try:
        again = encode()
    finally:
        sys.monitoring.set_events(4, 0)
        sys.monitoring.free_tool_id(4)
    assert again == first and b"".join(first[2]).decode() == "".join(texts)
    assert lines < len(words)
