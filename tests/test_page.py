import dataclasses
import random

import pytest

from strandlake.operators import pagefile as P
from strandlake.operators.rows import put_rows, read_rows
from strandlake.plans.schema import TYPES, ColumnDef, Series, definition_matrix
from strandlake.sources import files, page


def sample(kind, bits, n, rng):
    if kind in ("string", "byte[]", "stream"):
        texts = [None, "", "x" * 126, "x" * 127, "é" * 70]
        return [rng.choice(texts) if kind == "string" else (t.encode() if (t := rng.choice(texts)) is not None else None) for _ in range(n)]
    if kind == "decimal":
        return [(rng.random() < 0.5, rng.randint(0, 28), rng.getrandbits(96)) for _ in range(n)]
    if kind in ("double", "float"):
        return [float(rng.choice([0, 1, i, -2.5, 1e10, 0.5])) for i in range(n)]
    if kind == "boolean":
        return [rng.random() < 0.5 for _ in range(n)]
    if kind in ("datetime", "timespan"):
        return [i * 1000 + rng.randint(0, 9) for i in range(n)]
    b = int(bits)
    low = -(1 << b - 1) if kind.startswith("int") else 0
    return [rng.choice([0, 0, low, low + (1 << b) - 1, low + rng.getrandbits(b)]) for _ in range(n)]


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 33, 200])
def test_every_definition(n):
    rng = random.Random(n)
    for kind, bits, encoding, compression in definition_matrix():
        if compression == "lz4":
            continue
        c = ColumnDef("x", kind, bits, encoding, P.Compression.parse(compression))
        values = sample(kind, bits, n, rng)
        series, rows, back = P.read_page(P.write_page(Series((c,)), [values]))
        assert (series.columns, rows, back["x"]) == ((c,), n, values), c


def test_unfinished_and_foreign_pages():
    good = P.write_page(Series.parse("s\nx int"), [[1, 2, 3]])
    for bad in (b"", b"nope" + good[4:], good[:8] + b"\1" + good[9:], good[:9] + b"\xff" * 8 + good[17:]):
        with pytest.raises(P.PageError):
            P.read_page(bad)


def test_channels_without_an_index():
    series, _, rows, at = P.read_header(good := P.write_page(Series.parse("s\nx int\ny string"), [[1, 2], ["a", None]]))
    lost = good[:at] + b"\xff" * 8 + good[at + 8 :]
    channels = P.read_channels(lost[at:])
    assert P.decode_column(series.columns[1], P.decompress(channels[2], series.columns[1].compression), rows) == ["a", None]
    assert P.recover_segments(b"\x01\x05\x00\x00abc") == {}


def test_recompressed():
    data = P.write_page(Series.parse("s\nx int"), [list(range(100))])
    plain = P.recompress_page(data)
    assert P.read_page(plain)[2] == P.read_page(data)[2] and P.read_header(plain)[0].columns[0].compression.algorithm == "nocompress"


def test_files_of_pages(spark, tmp_path):
    definition = Series.parse("s\no bigint,64,Delta\nv double\nt string".replace("bigint", "int64"))
    df = spark.createDataFrame([(k % 2, k, k * 0.5, None if k % 3 else "x") for k in range(50)], "s int, o bigint, v double, t string")
    pages = page.to_pages(page.paged(df, ["s"], ["o"], 10), definition, ["s", "page"], ["o"])
    assert pages.count() == 6
    files.restore_tree(pages.selectExpr("concat(s, '-', page, '.page') as FileName", "content as Content"), str(tmp_path / "pages"))
    got = page.load_pages(spark, str(tmp_path / "pages"), definition, ["o", "t"])
    assert sorted((r.o, r.t) for r in got.collect()) == [(k, None if k % 3 else "x") for k in range(50)]


def test_rows_of_a_class(spark):
    @dataclasses.dataclass
    class Point:
        x: int
        y: float

    df = put_rows(spark, [Point(1, 2.0), Point(3, 4.0)], "x int, y double")
    assert list(read_rows(df.orderBy("x"), Point)) == [Point(1, 2.0), Point(3, 4.0)]
    assert set(TYPES) >= {"int32"}
