import pytest

from strandlake.plans.schema import ColumnDef, Compression, Series, definition_matrix

SENSOR = "tide port=harbour gauge=7\nmeasured datetime,64,DeltaDelta,NoCompress\nremark string,var,None,zstd.level=10\nheight int"


def test_round_trip():
    s = Series.parse(SENSOR)
    assert s.name == "tide" and s.tags["gauge"] == "7"
    assert str(s.columns[2]) == "height int32,32,Xor,zstd.level=3"
    assert Series.parse(str(s)) == s


def test_unnamed_series_and_columns():
    s = Series.parse("\nint\nts datetime")
    assert s.name is None and s.columns[0].name is None
    assert s.spark_schema().names == ["_c0", "ts"]
    assert s.spark_schema()["ts"].metadata["encoding"] == "DeltaDelta"


def test_tag_order_does_not_matter():
    assert Series.parse("n a=1 b=2\nint") == Series.parse("n b=2 a=1\nint")


@pytest.mark.parametrize("text", ["a  b=1\nint", "n =b\nint", "n a=\nint", "n a=b=c\nint", "n a=1 a=2\nint", "n", "n\na b int", "n\nx nosuch", "n\nx int,64", "n\nx string,var,Delta", "n\nx int,32,Xor,bz2", "n\nx int\nx int", "n m\nint"])
def test_bad_text(text):
    with pytest.raises(ValueError):
        Series.parse(text)


@pytest.mark.parametrize("alias", ["int", "Int32", "INT32"])
def test_aliases(alias):
    assert ColumnDef.parse(f"x {alias}").type == "int32"


def test_compression():
    assert str(Compression.parse("gzip")) == "zlib.level=fastest"
    assert str(Compression.parse("none")) == "nocompress"
    assert Series.parse(SENSOR).recompressed().columns[1].compression == Compression("nocompress", "")


def test_matrix_is_legal():
    rows = definition_matrix()
    assert len(set(rows)) == len(rows) > 150
    for t, b, e, c in rows:
        ColumnDef("x", t, b, e, Compression.parse(c))


def test_retyped_takes_defaults():
    c = ColumnDef.parse("x int,32,Delta,lz4").retyped("int64")
    assert (c.bits, c.encoding, c.compression.algorithm) == ("64", "Xor", "lz4")
