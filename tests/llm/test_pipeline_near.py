"""The pipeline's near-duplicate stage by its own rule: five-word shingles."""

from conftest import SMALL

import corpus_pipeline
from strandlake.llm import minhash

from .conftest import ROWS
from .test_dedup import brute_components


def brute_firsts(rows, size=5, percent=80):
    """Ids of the rows that are the least of their component, by shingles of `size` words."""
    sets = {}
    for d, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[d] = set(zip(*(w[k:] for k in range(size)))) if len(w) >= size else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d for d in sets if root(d) == d}


def test_stage_takes_five_words(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_firsts(rows)
    assert want != {d for d, _, _, own in brute_components(rows) if own}
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SMALL)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == want


def test_sizes_of_shingles(docs):
    for size in (1, 3, 5):
        assert {r.doc_id for r in minhash.keep_first(docs, size=size).collect()} == brute_firsts([(d, t) for d, t, *_ in ROWS], size)


def test_few_words_are_one_shingle():
    texts = [b"", b"one", b"One two", b"a b c d", b"a b c d e", b"a b c d e f"]
    assert minhash.ShingleSets(texts, 5).counts.tolist() == [len(minhash.shingles(t, 5)) for t in texts] == [0, 1, 1, 1, 1, 2]
