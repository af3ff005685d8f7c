import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import bits as B
from strandlake.operators import encode as E
from strandlake.operators import stateful as S


def series(spark, values, key=1):
    return spark.createDataFrame([(key, i, v) for i, v in enumerate(values)], "s int, o bigint, v bigint")


def encoded(df, column="encoded"):
    return [r[0] for r in df.orderBy("o").select(column).collect()]


def test_delta_of_small_sequences(spark):
    df = E.delta(series(spark, [5, 10, 20, 30]), ["s"], ["o"], "v")
    assert encoded(df, "delta") == [5, 5, 10, 10] and encoded(df, "delta_zigzag") == [10, 10, 20, 20]


def test_delta_delta_frames(spark):
    signed = E.delta_delta(series(spark, range(50, 66)), ["s"], ["o"], "v")
    assert encoded(signed) == [49] + [0] * 15 and set(encoded(signed, "frame_min")) == {1}
    unsigned = E.delta_delta(series(spark, range(50, 66)), ["s"], ["o"], "v", unsigned=True)
    assert encoded(unsigned) == [98] + [0] * 15 and set(encoded(unsigned, "frame_min")) == {2}
    short = E.delta_delta(series(spark, range(50, 65)), ["s"], ["o"], "v")
    assert encoded(short) == [50] + [1] * 14 and set(encoded(short, "frame_min")) == {0}
    assert E.delta_delta_stream(signed, ["s"]).count() == 17


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 31, 32, 33, 115])
def test_round_trips(spark, n):
    rng = random.Random(n)
    values = [rng.randint(-(2**40), 2**40) for _ in range(n)]
    df = series(spark, values)
    for unsigned in (False, True):
        assert encoded(E.delta_delta_decode(E.delta_delta(df, ["s"], ["o"], "v", unsigned), ["s"], ["o"], unsigned), "decoded") == values
    assert encoded(E.delta_decode(E.delta(df, ["s"], ["o"], "v"), ["s"], ["o"], "delta"), "decoded") == values
    assert encoded(E.xor_decode(E.xor(df, ["s"], ["o"], "v"), ["s"], ["o"]), "decoded") == values


def test_chunks_change_nothing(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(s, i, rng.randint(-999, 999)) for s in range(3) for i in range(100)], "s int, o bigint, v bigint")
    for encode in (E.delta_delta, E.xor, E.delta):
        whole = sorted(map(tuple, encode(df, ["s"], ["o"], "v").collect()))
        cut = encode(df, ["s"], ["o"], "v", chunk=F.floor(F.col("o") / 7))
        assert sorted(map(tuple, cut.select(*encode(df, ["s"], ["o"], "v").columns).collect())) == whole


def test_zigzag_widths(spark):
    values = [0, 1, -1, 255, 256, -(2**31), 2**31, 2**62, -(2**63), 2**63 - 1]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", B.unzigzag(B.zigzag(F.col("v"))), B.lsb_width(F.col("v")), B.u64_width(F.col("v"))).collect()
    for v, back, lsb, both in rows:
        u = v & (2**64 - 1)
        low, high = (u.bit_length() + 7) // 8, 8 - ((u & -u).bit_length() - 1) // 8 if u else 0
        assert (back, lsb, both) == (v, low, max(1, min(low, high)))


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(B.humanize_bytes(F.lit(1023))) == "1023 B" and one(B.humanize_bytes(F.lit(1536))) == "1.5 KB"
    assert one(B.humanize_quantity(F.lit(1500000))) == "1.5 M"
    assert one(B.change_base(F.lit(27))) == "BB" and one(B.change_base(F.lit(-5), "01")) == "101" and one(B.change_base(F.lit(0))) == "A"
    assert one(B.varint_len(F.lit(127))) == 1 and one(B.varint_len(F.lit(128))) == 2
    assert one(B.varsize_len(F.lit(None).cast("string"))) == 1 and one(B.varsize_len(F.lit("a" * 127))) == 129
    assert one(B.float_bits(F.lit(1.0).cast("float"))) == 0x3F800000


def test_sizes_just_below_a_half(spark):
    """Values next to where the tenth changes, in every unit."""

    def words(v, base, units, plain):
        k = max((k for k in range(1, 6) if v >= base**k), default=0)
        tenths = (v * 20 + base**k) // (2 * base**k)
        return f"{tenths // 10}.{tenths % 10} {units[k - 1]}" if k else f"{v}{plain}"

    for how, base, units, plain in (B.humanize_bytes, 1024, ["KB", "MB", "GB", "TB", "PB"], " B"), (B.humanize_quantity, 1000, ["K", "M", "G", "T", "P"], ""):
        places = {v for k in range(1, 6) for tenths in (10, 11, 23, 9999) for v in range((tenths * 2 - 1) * base**k // 20 - 2, (tenths * 2 - 1) * base**k // 20 + 3)} | {0, base - 1, 342291**2 * 3, 2**63 - 1}
        df = spark.createDataFrame([(v,) for v in sorted(places)], "v bigint").select("v", how(F.col("v")))
        assert {v: s for v, s in df.collect()} == {v: words(v, base, units, plain) for v in places}


def test_zero_runs_and_packing(spark):
    runs = E.zero_runs(series(spark, [0, 0, 5, 0, 7] + [0] * 115), ["s"], ["o"], "v").select("zeros", "codes")
    assert sorted(map(tuple, runs.collect())) == [(1, 1), (2, 1), (115, 2)]
    packed = E.bit_pack(series(spark, [1, 2, 3, -1, 0, 0, 0, 0, 9]), ["s"], ["o"], "v", 4).orderBy("word").select("packed").collect()
    assert [r[0] for r in packed] == [0xF321, 9]


def test_streams(spark):
    df = series(spark, [0] * 20 + [3, -1, 2**62])
    for name in ("lsb", "u64"):
        back = S.codec_values(S.codec_stream(df, ["s"], ["o"], "v", name), ["s"], name).orderBy("pos")
        assert [r.value for r in back.collect()] == [0] * 20 + [3, -1, 2**62]
    texts = spark.createDataFrame([(1, 0, None), (1, 1, ""), (1, 2, "é")], "s int, o int, v string")
    data = S.var_size_stream(texts, ["s"], ["o"], "v").first().data
    assert S.var_size_values(bytes(data)) == [None, b"", "é".encode()]
    sizes = S.compressed_sizes(S.codec_stream(df, ["s"], ["o"], "v", "lsb"), ["s"]).first()
    assert sizes.nocompress > 0 and sizes.zlib > 0


def test_dfcm_gives_doubles_back(spark):
    rows = [(1, i, None if i == 9 else float(i % 7) * 1.1) for i in range(40)]
    codes = S.dfcm(spark.createDataFrame(rows, "s int, o int, v double"), ["s"], ["o"], "v")
    assert codes.columns == ["s", "o", "encoded"]
    assert [r.decoded for r in S.dfcm_decode(codes, ["s"], ["o"]).orderBy("o").collect()] == [r[2] or 0.0 for r in rows]


LIMITS = [2**63 - 1, -5, None, -(2**63), 0, -1, 1, 2**62, None, -(2**62) - 1] * 5


@pytest.mark.parametrize("cut", [False, True])
def test_codes_wrap_and_take_nulls(spark, cut):
    """At both ends of the type and with nulls, which count as 0; cut into chunks or not."""
    df, chunk = series(spark, LIMITS), F.floor(F.col("o") / 7) if cut else None
    want = [v or 0 for v in LIMITS]
    back = E.delta_decode(E.delta(df, ["s"], ["o"], "v", chunk), ["s"], ["o"], "delta_zigzag", True, chunk).orderBy("o")
    assert [r.decoded for r in back.collect()] == want
    for unsigned in (False, True):
        coded = E.delta_delta(df, ["s"], ["o"], "v", unsigned, chunk).drop("pos", "prev")
        assert [r.decoded for r in E.delta_delta_decode(coded, ["s"], ["o"], unsigned, chunk).orderBy("o").collect()] == want
    assert [r.decoded for r in E.xor_decode(E.xor(df, ["s"], ["o"], "v", chunk=chunk), ["s"], ["o"]).orderBy("o").collect()] == want
    for bits in (8, 16, 32):
        low = E.delta_decode(E.delta(df, ["s"], ["o"], "v", chunk, bits), ["s"], ["o"], "delta", chunk=chunk, bits=bits).orderBy("o")
        assert [r.decoded for r in low.collect()] == [((v + (1 << bits - 1)) % (1 << bits)) - (1 << bits - 1) for v in want]


def test_chunks_change_no_run_or_word(spark):
    df, chunk = series(spark, [0, 0, 5, 0, 7] + [0] * 40 + [3, None]), F.floor(F.col("o") / 6)
    for work in (lambda c: E.zero_runs(df, ["s"], ["o"], "v", chunk=c), lambda c: E.bit_pack(df, ["s"], ["o"], "v", 4, c)):
        assert sorted(map(tuple, work(None).collect())) == sorted(map(tuple, work(chunk).collect()))
