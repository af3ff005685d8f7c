"""The pipeline's stages on nulls, repeated rows and keys, empty and very long texts, empty tables, and columns with clashing names."""

import random

import pytest
from conftest import SMALL

import corpus_pipeline

from .conftest import prose

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, `row` string, key bigint, kept_text string, `n.words` int, low bigint"


def odd_rows():
    rng = random.Random(21)
    a, b, c = (prose(rng, 90) for _ in range(3))
    texts = [(1, a), (1, a), (2, b), (None, c), (None, c), (3, None), (4, ""), (5, " \t "), (6, f"{a} {b}"), (7, prose(rng, 20_000)), (None, None), (8, "x" * 300_000), (9, "Ü" * 150), (10, "Ü" * 150)]
    return [(d, t, "en" if k % 3 else None, None, len(t or ""), "row", -k, "kept", k, None) for k, (d, t) in enumerate(texts)]


STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", STAGES)
def test_odd_rows(spark, name):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    got = STAGES[name](spark, docs, SMALL)
    found = got.collect()
    if name == "bpe_encoding":
        assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"] and len(found) == len(rows)
        assert sorted(r.decoded for r in found) == sorted(r[1] or "" for r in rows)
        return
    assert got.columns == docs.columns and all(r["row"] == "row" and r.kept_text == "kept" and r.low is None for r in found)
    ids = [r.doc_id for r in found]
    if name == "quality_rules":
        assert {1, 2, 6, 7} <= set(ids) and ids.count(1) == 2 and not {3, 4, 5, 8} & set(ids)
    elif name == "near_dedup":
        assert ids.count(1) == 2 and ids.count(None) == 3 and {2, 3, 4, 5, 6, 7, 8, 9} <= set(ids) and 10 not in ids
    elif name == "suffix_array_dedup":
        texts = {r.doc_id: r.text for r in found}
        assert len(found) == len(rows) and texts[6].strip() == "" and texts[3] == "" and texts[10] == "" and len(texts[8]) < 300_000
        assert all(r.n_chars == len(r.text) for r in found)
    else:
        assert len(found) == len(rows)


@pytest.mark.parametrize("name", STAGES)
def test_empty_tables(spark, name):
    assert STAGES[name](spark, spark.createDataFrame([], SCHEMA), SMALL).collect() == []
