"""Operators that work on rows alone: encoding, counting, decontamination, quality, sharding, pages and archives."""

import hashlib
import html
import math
import random
import re
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from conftest import SMALL, canon

from strandlake.llm import bpe, decontam, htmltext, quality, sharding, tokencount, warc
from strandlake.llm.prefixbpe import PrefixEncoder
from strandlake.llm.queries import QUERIES, SQL, vocabulary_file

from .conftest import ROWS, prose

ODD_TEXTS = "".join(("aab the  \n\n\t'sdll re,.!?0123éßñ中文字　\xa0\x85\x1c​😀▁", "ᄒǅ١\x00̀"))


def random_texts(n):
    rng = random.Random(8)
    pieces = [*ODD_TEXTS, "<|endoftext|>", "  ", "<s>", "<0x0A>", " ▁ ", "don't", "   x"]
    return ["".join(rng.choices(pieces, k=rng.randint(0, 30))) for _ in range(n)]


def test_prefix_encoder_equals_merging():
    rng = random.Random(1)
    ranks = {c: -1 for c in "abc"}
    tokens = ["ab", "bc", "aa", "abc", "ca", "aab", "bcab", "cc"]
    ranks |= {t: i for i, t in enumerate(tokens)}
    e = PrefixEncoder(ranks)
    words = {"".join(rng.choices("abc", k=rng.randint(1, 12))) for _ in range(500)}
    reachable = {t for t in ranks if e.merge(t) == [t]}
    assert len(reachable) > 6
    for w, ts in e.encode(words):
        assert ts == e.merge(w)
    assert e.counts(words) == {w: len(e.merge(w)) for w in words}


def test_encoding_equals_the_library(spark, docs, empty):
    from tokenizers import Tokenizer

    path = vocabulary_file("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [r[1] or "" for r in ROWS] + random_texts(3000)
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in bpe.encoded(frame, path).collect()}
    for k, (t, e) in enumerate(zip(texts, library.encode_batch(texts, add_special_tokens=False))):
        assert (got[k].n_tokens, got[k].ids, got[k].decoded) == (len(e.ids), ",".join(map(str, e.ids)), library.decode(e.ids, skip_special_tokens=False)), t
    assert got[None].n_tokens == 0 and got[None].ids == ""
    digest = {r.doc_id: r for r in bpe.encoded(docs, path, digests=True).collect()}
    assert digest[1].ids_sha256 == hashlib.sha256(got[0].ids.encode()).hexdigest()
    assert bpe.encoded(empty, path).collect() == []


def test_counts_equal_the_library(spark, docs, empty):
    import sentencepiece

    path = vocabulary_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [r[1] or "" for r in ROWS] + random_texts(3000)
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, None)], "doc_id bigint, text string")
    rows = tokencount.token_counts(frame, path, limit=50).collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows}
    for r in rows:
        if r.doc_id is not None:
            t = texts[r.doc_id]
            assert r.limit_chars == len(t) if not r.over_limit else len(library.encode(t[: r.limit_chars], num_threads=1)) <= 50 < len(library.encode(t[: r.limit_chars + 1], num_threads=1))
    for k, (t, ids) in enumerate(zip(texts, library.encode(texts, num_threads=1))):
        assert got[k] == (len(t.encode()), len(ids), len(ids) > 50), t
    assert got[None] == (0, 0, False)
    assert tokencount.token_counts(empty, path).collect() == []
    pieces = tokencount.PieceCounts(path)
    for t in random_texts(120):
        own = pieces.prefix_counts(t)
        assert own.tolist() == [len(library.encode(t[:i], num_threads=1)) for i in range(len(t) + 1)]
        assert pieces.longest_prefix(t, 3) == max(i for i, n in enumerate(own) if n <= 3)
    for k in range(1, 70):  # runs of spaces, alone, before words, before a character without a piece
        for t in (" " * k, " " * k + "word", "a" + " " * k, "a" + " " * k + "\x00b", " " * k + "\n", "▁" * k + ".", "x " + " " * k + "12 " + " " * k):
            assert pieces.counts([t])[0][0] == len(library.encode(t, num_threads=1)), (k, t)
    long = " " * 300_000 + "end"
    assert pieces.prefix_counts(long)[-1] == len(library.encode(long, num_threads=1))
    # The stored prefix counts make the result: with others in their place it changes.
    pieces.stored["other"] = bytes([1, 1, 1, 1, 9, 9])
    pieces.total["other"] = 9
    assert pieces.counts(["other"], 5) == [(9, 3)] and pieces.prefix_counts("other").tolist() == [0, 1, 1, 1, 9, 9]
    some = tokencount.prefix_counts(docs.filter("doc_id = 1"), path).first()
    assert some.counts[-1] == len(library.encode(ROWS[0][1], num_threads=1))


def test_counts_when_the_cache_is_full(monkeypatch):
    monkeypatch.setattr(tokencount, "KEPT_CHUNKS", 20)
    path = vocabulary_file("piece_bpe_32k.model")
    pieces, whole = tokencount.PieceCounts(path), tokencount.PieceCounts(path)
    texts = [r[1] or "" for r in ROWS[:30]]
    for k in range(0, 30, 3):
        monkeypatch.setattr(tokencount, "KEPT_CHUNKS", 20)
        got = pieces.counts(texts[k : k + 3], 50)
        monkeypatch.setattr(tokencount, "KEPT_CHUNKS", 10**6)
        assert got == whole.counts(texts[k : k + 3], 50)


def brute_hits(text, items, window=13):
    split = lambda t: [w for w in re.split(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").encode().lower()) if w]
    words, hit, found = split(text), set(), set()
    for i, t in items:
        own = split(t)
        n = min(window, len(own))
        windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
        for k in range(len(words) - n + 1 if n else 0):
            if tuple(words[k : k + n]) in windows:
                hit.update(range(k, k + n))
                found.add("null" if i is None else str(i))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("most", [1 << 24, 0])
def test_contamination(spark, docs, most):
    rng = random.Random(6)
    longer = ROWS[3][1].split()
    items = [(10, " ".join(longer[2:30])), (9, "One"), (8, "two, WORDS!"), (7, ""), (6, None), (5, " ".join(longer[1:14])), (5, " ".join(longer[1:14])), (None, ROWS[6][1]), (4, prose(rng, 40)), (3, "a " * 13)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.contamination(docs, bench, index_bytes=most).select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert canon(got.collect()) == canon((d, *brute_hits(t, items)) for d, t, *_ in ROWS)


@pytest.mark.parametrize("most", [1 << 24, -1])
def test_contamination_of_nothing(docs, empty, spark, odd, most):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.contamination(docs, none, index_bytes=most).filter("contaminated or n_hit > 0").count() == 0
    assert decontam.contamination(empty, none, index_bytes=most).collect() == []
    assert canon(decontam.clean(odd, none, index_bytes=most).collect()) == canon(odd.collect())


def brute_quality(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams, covered = [tuple(words[i : i + 3]) for i in range(len(words) - 2)], set()
    times = Counter(grams)
    for i, g in enumerate(grams):
        if times[g] > 1:
            covered.update((i, i + 1, i + 2))
    n, repeat = len(words), len(covered)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), repeat, n < 50 or 100 * repeat > 50 * n


def test_quality_measures(docs, odd, empty):
    judged = quality.judge(docs)
    rows = judged.select("row.doc_id", *quality.BASE, "base_failed").collect()
    assert canon(rows) == canon((d, *brute_quality(t)) for d, t, *_ in ROWS)
    assert judged.filter("base_failed and kept").count() == 0
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.count() == judged.filter("kept").count() > 0
    assert quality.judge(odd).count() == odd.count() and quality.judge(empty).collect() == [] and quality.keep(empty).collect() == []


def test_cascade_changes_no_verdict(docs):
    verdicts = {tuple(sorted((r[0], r[1]) for r in quality.judge(docs, rules=order).select("row.doc_id", "kept").collect())) for order in (quality.RULES, quality.RULES[::-1])}
    assert len(verdicts) == 1
    assert {r.name for r in quality.cascade(docs, "text")} == {r.name for r in quality.RULES}
    for order in (quality.RULES, quality.RULES[::-1]):
        assert {(r.doc_id, True) for r in quality.keep(docs, rules=order, ordered=True).collect()} == {x for x in next(iter(verdicts)) if x[1]}


def test_later_rules_are_not_evaluated(docs):
    """A rule that can't be evaluated does no harm behind one that rejects, and fails before it."""
    fatal, none = quality.Rule("fatal", "n_digits > 0 or raise_error('evaluated') is null", ("n_digits",)), quality.Rule("none", "n_words >= 0", ("n_words",))
    assert quality.judge(docs, rules=(none, fatal), ordered=True).filter("kept").count() == 0
    with pytest.raises(Exception, match="evaluated"):
        quality.judge(docs, rules=(fatal, none), ordered=True).filter("kept").count()
    plan = quality.judge(docs, ordered=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[0-9]") == 1 and re.search(r"THEN false WHEN element_at\(transform\(array\(cast\(\(length\(body#\d+\) - length\(regexp_replace\(body#\d+, \[0-9\]", plan)


def test_the_sample_is_bounded(spark):
    plan = quality.sampled(spark.range(0, 10**6, 1, 50).selectExpr("cast(id as string) as text"), "text")
    assert plan.count() == quality.SAMPLE_ROWS and plan.rdd.getNumPartitions() == 1


def test_equal_short_hashes_are_told_apart(spark):
    """The path for shortened hashes that fall together gives what the usual one gives."""
    steps = {n: (n, s, d) for n, s, d in quality._STEPS}
    forced = tuple(steps[n] if n != "clash" else ("clash", "true", steps[n][2]) for n in steps)
    rows = [(k, t) for k, t, *_ in ROWS if t and len(t) < 2000]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    usual = quality.measured(frame, "text", ["n_repeat_words"]).select("row.doc_id", "n_repeat_words").collect()
    try:
        kept, quality._STEPS = quality._STEPS, forced
        slow = quality.measured(frame, "text", ["n_repeat_words"]).select("row.doc_id", "n_repeat_words").collect()
    finally:
        quality._STEPS = kept
    assert canon(usual) == canon(slow)


def test_sharding(docs, odd, empty):
    got = sharding.assign(docs, "doc_id", "text", [1.0] * 16).collect()
    assert {(r.key, r.size, r.text_crc32) for r in got} == {(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in ROWS}
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    again = {r.key: r.shard for r in sharding.assign(docs, "doc_id", "text", [1.0] * 17).collect()}
    assert again == {r.key: r.grown_shard for r in got}
    repeated = sharding.assign(odd, "doc_id", "text", [1.0] * 4).collect()
    assert len(repeated) == odd.count() and len({(r.shard, r.slot) for r in repeated}) == odd.count()
    assert sharding.assign(empty, "doc_id", "text", [1.0]).collect() == []
    with pytest.raises(ValueError):
        sharding.assign(docs, "doc_id", "text", [0.0])


def brute_shard(key, weights):
    """The winner by a hash and scores of our own."""
    best = None
    for shard, weight in enumerate(weights):
        h = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", shard), h)
        score = -weight / math.log(((h >> 11) + 0.5) / 2**53)
        best = max(best or (score, shard), (score, shard))
    return best[1]


def test_shards_by_an_independent_scorer(spark):
    rng = random.Random(3)
    keys = [rng.randrange(-(2**63), 2**63) for _ in range(300)] + [0, -1, 2**63 - 1]
    weights = [1.0, 2.5, 1.0, 0.5, 3.0]
    frame = spark.createDataFrame([(k, "t") for k in keys], "`a.key` bigint, `a.text` string")
    for r in sharding.assign(frame, "a.key", "a.text", weights, 1.5).collect():
        assert (r.shard, r.grown_shard) == (brute_shard(r.key, weights), brute_shard(r.key, [*weights, 1.5]))


def test_weights_and_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    rows = sharding.assign(spark.range(6000).selectExpr("id as doc_id", "'t' as text"), "doc_id", "text", [1.0, 3.0]).collect()
    assert 0.7 < sum(r.shard == 1 for r in rows) / 6000 < 0.8
    for shard in (0, 1):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))


PAGE = "<html><head><title>T</title><style>p{{}}</style></head><body class='home'><nav><li>menu</li></nav><header>Site</header><div class='cookie-notice'>cookies</div>{0}<aside>side</aside><form>find <input></form><footer>foot &copy;</footer><script>x='<p>no</p>'</script></body></html>"


@pytest.mark.parametrize("body,text", [
    ("<article><h1>A &amp; B</h1><p>one  <b>two</b><br>three<p>four\n five</article>", "A & B one two three four five"),
    ("<main><p>x</p><section class='comments'><p>reader</p></section><!-- no --><p>y&nbsp;z</p></main>", "x y z"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a b c d"),
    ("<div><p>plain</p>text</div>", "plain text"), ("", ""), ("<article>open <i>end", "open end"), ("<article><p>&am</p><p title='a>b'>q</p></article>", "&am q"),
])
def test_page_text(body, text):
    page = PAGE.format(body) if body != "<article>open <i>end" else body
    assert " ".join(t for t, _ in htmltext.Page(page).kept()) == text


def test_templates_go(spark, docs, empty):
    box = "<div><div>Made by <b>Us</b></div><p>{0}</p></div>"
    rows = [(k, f"http://a.example/{k}", box.format(f"own text {k}"), "x") for k in range(9)] + [(90 + k, f"http://b{k}.example/", box.format("alone"), "x") for k in range(3)] + [(99, None, None, "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = {r["row"].page_id: r.text for r in htmltext.extract(pages).collect()}
    assert got == {k: f"own text {k}" for k in range(9)} | {90 + k: "Made by Us alone" for k in range(3)} | {99: ""}
    assert htmltext.extract(pages.limit(0)).collect() == []


def test_pages_against_a_plain_reading(spark):
    """The test pages' articles, read by patterns that know their one layout."""
    for r in QUERIES["op2_html_extraction"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", body)]
        assert r.text == " ".join(p for p in parts if p) and r.n_chars == len(r.text)


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    records = [warc.ArcRecord("http://a/b c", "1.2.3.4", "20010203040506", "text/html", b"HTTP/1.0 200 OK\r\n\r\nhi\n\nthere"), warc.ArcRecord("http://x", "0.0.0.0", "2001", "text/html", b"")]
    back = list(warc.read_arc(warc.write_arc("t.arc", records, version)))
    assert [(r.url, r.body) for r in back] == [("http://a/b%20c", records[0].body), ("http://x", b"")]
    parts = warc.converted(back[0])
    assert parts["date"] == "2001-02-03T04:05:06Z" and parts["payload"] == b"hi\n\nthere" and parts == warc.converted(back[0])
    assert warc.converted(back[1])["date"] == "2001-01-01T00:00:00Z"


def test_bad_archives():
    good = warc.write_arc("t.arc", [warc.ArcRecord("http://a", "1.2.3.4", "20010203040506", "text/html", b"body")])
    for bad in (good[:-4], b"nothing here\n", good.replace(b"text/html 4", b"text/html x")):
        with pytest.raises(ValueError):
            list(warc.read_arc(bad))


def test_archive(spark):
    rows = [(5, "http://a/1", "same"), (2, "http://a 2", "same"), (9, None, "same"), (1, "u", None), (3, "u", ""), (None, "u", "same"), (4, "u", "Ünïcode\r\n\r\nWARC/1.1"), (7, "u", "twice"), (7, "u", "twice"), (None, "u", "nul"), (None, "u", "nul")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    least = {}
    for p, _, h in rows:
        if p is not None:
            least[h or ""] = min(p, least.get(h or "", p))
    want = []
    for p, _, h in rows:
        first = least.get(h or "")
        again = first is not None and first != p
        want.append((p, len((h or "").encode()), warc.digest_of((h or "").encode()), "revisit" if again else "response", first if again else None))
    assert canon(warc.read_archive(spark, warc.archive(pages)).collect()) == canon(want)
    path = warc.archive(pages, file_bytes=1)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect() if r.length]
    assert len(files) == len(rows) and canon(warc.read_archive(spark, path).collect()) == canon(want)
    records = [list(warc.read_warc(f)) for f in files]
    assert all([h["warc-type"] for h, _ in r][0] == "warcinfo" and len(r) == 2 for r in records)
    responses = {h["warc-record-id"]: h.get("x-page-id") for r in records for h, _ in r if h["warc-type"] == "response"}
    for r in records:
        if r[1][0]["warc-type"] == "revisit":
            assert responses[r[1][0]["warc-refers-to"]] == r[1][0]["x-refers-to-page-id"] and b"same" not in r[1][1]
    assert all(len(list(warc.unzipped(f))) == 3 for f in files) and all(zlib.decompress(f, 31) for f in files)
    small = warc.read_archive(spark, warc.archive(pages, least_bytes=5)).filter("record_type = 'revisit'").count()
    assert small == 0
    assert warc.read_archive(spark, warc.archive(pages.limit(0))).collect() == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(spark, duck, name):
    got = QUERIES[name](spark, SMALL)
    if name in SQL:
        want = duck.execute(SQL[name])
        order = [d[0] for d in want.description]
        assert sorted(order) == sorted(got.columns)
        assert canon(tuple(r[c] for c in sorted(order)) for r in got.collect()) == canon(tuple(r[order.index(c)] for c in sorted(order)) for r in want.fetchall())
    else:
        assert got.count() > 0


@pytest.mark.parametrize("name", ["op6_sharding", "op7_quality_rules"])
def test_native_queries_run_no_python(spark, name):
    text = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", text)
