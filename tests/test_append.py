"""Streamed deltas: many series in few groups, over batches, with late rows."""

import random

from strandlake.streaming import append

LEAST = -(2**63)


def expected(runs):
    """(series, ordinal, value, delta, pos, late) row by row."""
    out, state = [], {}
    for run in runs:
        begun = {s: seen for s, (_, _, seen) in state.items()}
        for s, o, v in sorted((LEAST if s is None else s, LEAST if o is None else o, v or 0) for s, o, v in run):
            if o < begun.get(s, LEAST):
                out.append((s, o, v, None, None, True))
                continue
            last, pos, _ = state.get(s, (0, 0, LEAST))
            out.append((s, o, v, (v - last + 2**63) % 2**64 - 2**63, pos, False))
            state[s] = (v, pos + 1, o)
    return out


def test_series_share_groups_and_keep_their_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(append, "BUCKETS", 3)
    r = random.Random(5)
    number = lambda: r.choice([None, LEAST, 2**63 - 1, r.randrange(-9, 9)])
    runs = [[(r.choice([None, LEAST + 1, *range(60)]), None if r.random() < 0.02 else r.randrange(20) + 12 * k, number()) for _ in range(800)] for k in range(3)]
    runs.append([(7, 0, 1), (7, 1, 1), (1000, 5, 5)])  # late alone in its series, and a new series
    for run in runs:
        spark.createDataFrame(run, "series bigint, ordinal bigint, value bigint").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("series bigint, ordinal bigint, value bigint").parquet(f"{tmp_path}/in")
        done = append.append_sink(append.delta_stream(stream), f"{tmp_path}/out", f"{tmp_path}/commits").trigger(availableNow=True).start()
        done.awaitTermination()
        assert done.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3
    got = spark.read.schema(append.OUT).parquet(f"{tmp_path}/out").collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected(runs), key=str)
