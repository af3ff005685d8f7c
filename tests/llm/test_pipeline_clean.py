"""The pipeline's decontamination stage lets no document with a benchmark passage through."""

import random

from conftest import SMALL

import corpus_pipeline

from .conftest import prose
from .test_rows import brute_hits


def test_documents_with_a_passage_go(spark):
    rng = random.Random(8)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    item = max((t for _, t in items), key=len)
    long = prose(rng, 3000)
    rows = [(1, f"Été {long}, {item.upper()}! {long} end"), (2, f"{item} few"), (3, long), (4, ""), (5, None), (6, f"{long} {item}"), (7, " ".join(item.split()[:12]))]
    docs = spark.createDataFrame([(d, t, len(t or "")) for d, t in rows], "doc_id bigint, text string, n_chars bigint")
    assert brute_hits(rows[0][1], items)[1] and not brute_hits(rows[0][1], items)[4]
    got = {r.doc_id: r for r in dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, SMALL).collect()}
    assert sorted(got) == [3, 4, 5, 7] and {d: r.text for d, r in got.items()} == {d: t for d, t in rows if d in got}
