"""The pipeline's stages, one by one, against brute force on what each is given."""

from conftest import SMALL

import corpus_pipeline
from strandlake.llm.common import written

from .test_dedup import brute_bytes
from .test_pipeline_near import brute_firsts
from .test_rows import brute_hits, brute_quality


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, steps = docs.columns, dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r.text for r in docs.collect()}

    docs = written(steps["quality_rules"](spark, docs, SMALL), "q")
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert docs.columns == columns and all(not brute_quality(t)[5] for t in kept.values()) and 0 < len(kept) < len(rows)

    docs = written(steps["near_dedup"](spark, docs, SMALL), "n")
    firsts = brute_firsts(list(kept.items()))
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert docs.columns == columns and set(kept) == firsts

    docs = written(steps["suffix_array_dedup"](spark, docs, SMALL), "s")
    removed = {d: n for d, _, n, _, _ in brute_bytes(list(kept.items()))}
    after = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == columns and set(after) == set(kept)
    for d, r in after.items():
        assert r.n_chars == len(r.text) and (r.text == kept[d] if not removed[d] else len(r.text.encode()) <= len(kept[d].encode()) - removed[d])

    docs = written(steps["decontamination"](spark, docs, SMALL), "d")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = {d for d, r in after.items() if not brute_hits(r.text, items)[1]}
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == clean

    last = steps["bpe_encoding"](spark, docs, SMALL).collect()
    assert {r.doc_id for r in last} == clean and all(r.decoded == after[r.doc_id].text for r in last)
    assert corpus_pipeline.run(spark, SMALL).count() == len(last)
