"""MinHash, phrase and suffix-array deduplication against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import canon

from strandlake.llm import exchange, minhash, phrases, suffix
from strandlake.llm.components import components

from .conftest import ROWS, prose


def sha(b):
    return hashlib.sha256(b).hexdigest()


def brute_components(rows, percent=80):
    sets = {}
    for d, t, *_ in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[d] = set(zip(w, w[1:])) if len(w) > 1 else set(map(lambda x: (x,), w))
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
    return [(d, len(s), root(d), root(d) == d) for d, s in sets.items()]


def test_near_duplicates(docs):
    assert canon(minhash.near_duplicates(docs).collect()) == canon(brute_components(ROWS))


def test_outsiders_of_mixed_bands(spark):
    """A chain in which most copies are not similar to the band's least node."""
    rng = random.Random(4)
    words = prose(rng, 200).split()
    rows = []
    for k in range(60):
        w = list(words)
        for j in rng.sample(range(200), 4 + k % 12):
            w[j] = f"z{k}.{j}"
        rows.append((k, " ".join(w)))
    want = brute_components(rows)
    assert 1 < len({w[2] for w in want}) < 60
    assert canon(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()) == canon(want)


def test_odd_keys(odd):
    got = canon(minhash.near_duplicates(odd).collect())
    assert [g for g in got if g[0] == "7"] == [("7", "59", "7", "True")] * 2
    assert [g[1:] for g in got if g[0] == "null"] == [("0", "null", "True"), ("1", "null", "True"), ("59", "3", "False"), ("59", "7", "False"), ("59", "7", "False")]
    assert minhash.keep_first(odd).count() == 6


def test_keep_first_keeps_columns(docs):
    want = {d for d, _, _, kept in brute_components(ROWS) if kept}
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want


def test_sketches_are_full_and_estimate():
    rng = np.random.default_rng(1)
    for n in (1, 3, 40, 600):
        a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        assert (minhash.sketches(a, np.array([len(a)])) != np.uint64(2**64 - 1)).all()
    a = rng.integers(0, 1 << 62, 1000, dtype=np.uint64)
    b = np.concatenate([a[:890], rng.integers(0, 1 << 62, 110, dtype=np.uint64)])
    s = minhash.sketches(np.concatenate([np.sort(a), np.sort(b)]), np.array([1000, 1000]))
    assert abs((s[0] == s[1]).mean() - 890 / 1110) < 0.12


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    parent = {x: x for ab in links for x in ab}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_phrases(rows, size=13):
    first = {}
    words = {d: (t or "").encode().split() for d, t, *_ in rows}
    for d in sorted(words):
        for i in range(len(words[d]) - size + 1):
            first.setdefault(tuple(words[d][i : i + size]), d)
    out = []
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        out.append((d, len(w), len(gone), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def test_phrases(docs):
    got = phrases.dedup(docs, digests=True).select("row.doc_id", "n_words", "n_removed", "kept_sha256")
    assert canon(got.collect()) == canon(brute_phrases(ROWS))


def test_phrases_over_many_blocks(docs, monkeypatch):
    monkeypatch.setattr(exchange, "BLOCK_BYTES", 2000)
    got = phrases.dedup(docs).select("row.doc_id", "n_words", "n_removed", "kept_text").collect()
    assert canon((a, b, c, sha(d.encode())) for a, b, c, d in got) == canon(brute_phrases(ROWS))


@pytest.mark.parametrize("hot", [2, 0])
def test_hot_phrases(docs, monkeypatch, hot):
    monkeypatch.setattr(exchange, "BLOCK_BYTES", 2000)
    got = phrases.dedup(docs, digests=True, hot_places=hot).select("row.doc_id", "n_words", "n_removed", "kept_sha256")
    assert canon(got.collect()) == canon(brute_phrases(ROWS))


def test_automata_in_shards():
    bodies = [b"a b c d", b"b c d e", b"c d", b"bc d"]
    found = {b"b c": 1, b"c d": 0}
    whole = phrases.located(found, bodies)
    assert [sorted(h) for h in whole] == [[(1, 3, 1), (2, 4, 0)], [(0, 2, 1), (1, 3, 0)], [(0, 2, 0)], []]
    assert [sorted(h) for h in phrases.located(found, bodies, shard_chars=1)] == [sorted(h) for h in whole]


def part_of(module, texts, places):
    """All stretches of texts (each a block of its own, its place its key) in one part."""
    payloads = []
    for k, text in enumerate(texts):
        s = module.Segments([text]) if module is suffix else module.Windows([text])
        body = (lambda d, b, n: text[b : b + n + 99]) if module is suffix else (lambda d, b, n: b" ".join(text.split()[b : b + n + 12]))  # noqa: B023
        found = exchange.stretches(k, np.array([k]), s.value, s.doc, s.begin, s.n, s.n > 0, body, False, places)
        payloads += found.packs((s.value >> np.uint64(60))[: len(found.rows)].astype(np.int64)).column("payload").to_pylist()
    return exchange.Part(exchange.Stretches.unpacked(payloads), places)


@pytest.mark.parametrize("module,engine,nothing", [(phrases, "automata", lambda found, shard_chars=0: iter(())), (suffix, "previous_factors", lambda data, starts, places, length: np.zeros(len(starts), np.int64))])
def test_the_method_makes_the_result(monkeypatch, module, engine, nothing):
    """Passages with unlike surroundings are found by the automata, or the longest previous factors, alone."""
    rng = random.Random(8)
    shared = prose(rng, 40)
    texts = [f"{prose(rng, 9)} {shared} {prose(rng, 9)}".encode() for _ in range(3)]
    part = part_of(module, texts, module is suffix)
    rows, begin, end = module.find(part)
    assert {int(part.rows["block"][r]) for r in rows} == {1, 2} and (end > begin).all()
    edge = {int(part.rows["block"][r]) for r in rows if not part.later[r]}
    assert edge == {1, 2}
    monkeypatch.setattr(module, engine, nothing)
    rows, _, _ = module.find(part)
    assert all(part.later[r] for r in rows) and (module is suffix or not len(rows))


def thue_morse(n):
    """A word of 2**n letters and its complement: powers of any base modulo 2**64 give both the same sum."""
    word = "A"
    for _ in range(n):
        word += word.translate(str.maketrans("AB", "BA"))
    return word, word.translate(str.maketrans("AB", "BA"))


def test_words_made_to_collide(spark):
    rng = random.Random(12)
    a, b = thue_morse(10)
    common = prose(rng, 12)
    rows = [(1, f"one {a} two"), (2, f"one {b} two"), (3, f"{common} {a}"), (4, f"{common} {b}"), (5, f"{common} {a}"), (6, a), (7, b)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert canon(minhash.near_duplicates(frame).collect()) == canon(brute_components(rows))
    got = phrases.dedup(frame, digests=True).select("row.doc_id", "n_words", "n_removed", "kept_sha256")
    assert canon(got.collect()) == canon(brute_phrases(rows))
    got = suffix.dedup(frame, digests=True).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert canon(got.collect()) == canon(brute_bytes(rows))


def brute_bytes(rows, size=100):
    seen, out = set(), []
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - size + 1):
            w = b[i : i + size]
            if w in seen:
                gone[i : i + size] = [True] * size
            seen.add(w)
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


@pytest.mark.parametrize("hot", [4000, 2])
def test_suffix(docs, hot):
    got = suffix.dedup(docs, digests=True, hot_places=hot).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert canon(got.collect()) == canon(brute_bytes(ROWS))


def test_suffix_over_many_blocks(docs, monkeypatch):
    monkeypatch.setattr(exchange, "BLOCK_BYTES", 2000)
    got = suffix.dedup(docs).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert canon((a, b, c, d, sha(bytes(e))) for a, b, c, d, e in got) == canon(brute_bytes(ROWS))


def test_repetition_within_one_text(spark):
    rng = random.Random(9)
    unit = prose(rng, 30)
    rows = [(1, f"{unit} and {unit} {unit}"), (2, "ab" * 400), (3, "c" * 99), (4, "c" * 100), (5, "c" * 101)]
    got = suffix.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), digests=True).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert canon(got.collect()) == canon(brute_bytes(rows))


def test_longest_previous_factors():
    rng = random.Random(3)
    for n in (0, 1, 2, 60, 200):
        data = bytes(rng.choice(b"ab") for _ in range(n))
        want = [max((next((k for k in range(n - i) if data[i + k] != data[j + k]), n - i) for j in range(i)), default=0) for i in range(n)]
        assert suffix.longest_previous_factors(data).tolist() == want


@pytest.mark.parametrize("steps", [48, 1])
def test_previous_factors_up_to_a_length(monkeypatch, steps):
    monkeypatch.setattr(suffix, "STEPS", steps)
    rng = random.Random(5)
    for length in (1, 4, 9, 20):
        data = bytes(rng.choice(b"ab") for _ in range(300))
        starts, places = np.arange(0, 290, 2), np.array(rng.sample(range(500), 145))
        want = [max((next((k for k in range(length) if max(i, j) + k >= 300 or data[i + k] != data[j + k]), length) for j, q in zip(starts.tolist(), places) if q < p), default=0) for i, p in zip(starts.tolist(), places)]
        assert suffix.previous_factors(np.frombuffer(data, np.uint8), starts, places, length).tolist() == want
    rising = np.r_[np.arange(1, 400), 0]
    assert suffix._nearest_smaller(rising, np.full(400, 7)).tolist() == [0] + [7] * 398 + [0]


def test_suffix_ranks():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 500).astype(np.uint8)
    raw = data.tobytes()
    for length in (1, 7, 13, 100):
        ranks = suffix.suffix_levels(data, length)[-1][1]
        keys = [raw[i : i + length] for i in range(500)]
        assert [sorted(set(keys)).index(k) for k in keys] == ranks.tolist()


@pytest.mark.parametrize("run", [lambda d: phrases.dedup(d), lambda d: suffix.dedup(d), lambda d: minhash.near_duplicates(d), lambda d: minhash.keep_first(d)])
def test_empty_table(empty, run):
    assert run(empty).collect() == []


def test_odd_rows_keep_their_first(odd):
    got = defaultdict(list)
    for r in phrases.dedup(odd).collect():
        got[r["row"].doc_id].append(r.n_removed)
    assert got[7] == [0, 0] and got[3] == [0] and sorted(got[None]) == [0, 0, 60, 60, 60]
    assert suffix.dedup(odd).count() == odd.count()
