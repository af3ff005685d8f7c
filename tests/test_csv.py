import json
import tracemalloc

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from strandlake.functions import csvtext as C
from strandlake.queries import QUERIES
from strandlake.sources import csv, files, synthetic, ticker


@pytest.mark.parametrize("text,rows", [
    ("a,b\nc,d", [["a", "b"], ["c", "d"]]), ("'a,b',\"c,d\"\n", [["a,b", "c,d"]]), ("O'Clock,x\n", [["O'Clock", "x"]]), ('"a""b"\n', [['a"b']]), ("'it''s'", [["it's"]]),
    ("a\r\nb\rc\n\n\nd", [["a"], ["b"], ["c"], ["d"]]), ("a,b,c\nd\n", [["a", "b", "c"], ["d"]]), ('""\n', [[""]]), ("a,", [["a", ""]]), ('"x\ny",z', [["x\ny", "z"]]), ("", []),
])
def test_rows(text, rows):
    assert [[v for v, _ in r] for r in csv.parse_rows(text, ",")] == rows


@pytest.mark.parametrize("text", ["a,b\r\nc,d\r\n", "'it''s',\"x\ny\"z\r\n\n\r,,\n\"open,\nend", "a,", "\"a\"\"b\"\"\"\n1", "", "\n\r\n"])
def test_pieces_give_the_rows_of_the_whole(text):
    want = list(csv.parse_rows(text, ","))
    for i in range(len(text) + 1):
        for j in range(i, len(text) + 1):
            assert list(csv.parse_pieces([text[:i], text[i:j], text[j:]], ",")) == want


def test_whole_files_in_portions(spark, tmp_path, monkeypatch):
    """Marks, places and rows hold over pieces; what Python holds of a large file is far less than its rows."""
    n = 120_000
    data = b"\xef\xbb\xbf" + "id;name\n".encode() + "".join(f"{i};'é\n{i}'\n" for i in range(n)).encode()
    (tmp_path / "a.csv").write_bytes(data)
    rows = csv.rows_of_files(spark, str(tmp_path)).select("row", F.transform("cells", lambda c: c["value"]).alias("v"), F.transform("cells", lambda c: c["quoted"]).alias("q"))
    assert [tuple(r) for r in rows.orderBy("row").collect()] == [(0, ["id", "name"], [False, False]), *((i + 1, [str(i), f"é\n{i}"], [False, True]) for i in range(n))]
    tracemalloc.start()
    assert sum(len(offsets) - 1 for _, offsets, _, _ in csv._portions(memoryview(data), None)) == n + 1
    assert tracemalloc.get_traced_memory()[1] < 16 << 20  # all rows at once are over 60 MB
    tracemalloc.stop()
    monkeypatch.setattr(csv, "PIECE", 3)
    assert [r for _, offsets, values, _ in csv._portions(memoryview(b"a|b\nc|\xc3\xa9\xc3"), None) for r in (values[i:j] for i, j in zip(offsets, offsets[1:]))] == [["a", "b"], ["c", "é\ufffd"]]


@pytest.mark.parametrize("line,sep", [("a,b;c,d", ","), ("a;b;c", ";"), ("a|b", "|"), ("a\tb", "\t"), ("a:b:c", ":"), ("a,b;c", ","), ("plain", ",")])
def test_separator(line, sep):
    assert csv.detect_separator(line) == sep


def test_header_and_marks():
    assert csv.detect_header(["id", "name"]) == ["id", "name"]
    assert csv.detect_header(["1", "2"]) is None and csv.detect_header(["a", "a"]) is None and csv.detect_header([]) is None
    assert csv.detect_encoding("﻿x".encode()) == ("utf-8", 3) and csv.detect_encoding(b"x") == ("utf-8", 0)


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;name\n1;'x;y'\n2;\"q\"\n")
    rows = csv.rows_of_files(spark, str(tmp_path)).orderBy("row").collect()
    assert [[c.value for c in r.cells] for r in rows] == [["id", "name"], ["1", "x;y"], ["2", "q"]]
    strings = csv.read_strings(spark, str(tmp_path))
    assert strings.columns == ["id", "name"] and strings.count() == 2
    typed = csv.parse_entities(strings, {"id": ("id", "int"), "n": ("name", "int")})
    assert sorted(map(tuple, typed.collect())) == [(1, None), (2, None)]
    assert csv.parse_entities(strings, {"n": ("name", "int")}).count() == 0


def test_lines_lose_nothing(spark, tmp_path):
    """Ragged rows, both quotes, backslashes, blanks, a mark, a header in each of two files, and a row that is equal to it."""
    (tmp_path / "a.csv").write_bytes("\ufeffid,name\n1,'x,y',more\n\n2,\\a\\,\"q\"\"\"\n3\nid,name\n".encode())
    (tmp_path / "b.csv").write_bytes(b"id,name\r\n 4 ,\tz \r\n5,''\r\n6,O'Clock\"s,,\r\n")
    got = csv.read_strings(spark, str(tmp_path))
    assert got.columns == ["id", "name", "Column3", "Column4"]
    want = [("1", "x,y", "more", None), ("2", "\\a\\", 'q"', None), ("3", None, None, None), ("id", "name", None, None), (" 4 ", "\tz ", None, None), ("5", "", None, None), ("6", "O'Clock\"s", "", "")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert set(map(tuple, csv.read_strings(spark, str(tmp_path), multiline=True).collect())) >= {want[0], want[1]}


def test_candidates_of_edges(spark):
    show = F.transform(C.candidates(F.col("s")), lambda x: F.concat(x["type"], F.when(x["lossless"], "+").otherwise("-")))
    values = {
        "-1": "int+ long+ double+ float+ decimal+ sbyte+ short+", "255": "int+ long+ double+ float+ uint+ ulong+ decimal+ byte+ ushort+ short+", "16777217": "int+ long+ double+ float- uint+ ulong+ decimal+",
        "2147483648": "long+ double+ float+ uint+ ulong+ decimal+", "-9223372036854775808": "long+ decimal+", "18446744073709551616": "decimal+", "1e40": "double+", "1.5E-3": "double+ float-", "+5": "string+", ".5": "float+ double+ decimal+",
        "-": "char+", "--": "string+", "2008-13-45": "string+", "20080410T063000": "datetime+",
    }
    df = spark.createDataFrame([(k,) for k in values], "s string").select("s", F.array_join(show, " ").alias("c"))
    assert {r.s: r.c for r in df.collect()} == values


KINDS = {"": "null", "null": "null", "true": "bool", "t": "bool", "0": "bool", "7": "int", "x": "char", "NaN": "double", "-Inf": "double", "123456789": "int", "1234567890": "int", "12345678901": "long", "9223372036854775808": "ulong", "18446744073709551616": "decimal", "-1.5": "double", "1.2345678901234567": "decimal", "1e5": "double", "2008/04/10": "datetime", "2008-04-10 06:30:00.1234567": "datetime", "00:00:00": "timespan", "3.17:25:30.5": "timespan", "12345678-9abc-def0-1234-56789abcdef0": "guid", "hello": "string", "a" * 65: "string"}


def test_kinds(spark):
    df = spark.createDataFrame([(k,) for k in KINDS], "s string").select("s", C.value_kind("s").alias("k"))
    assert {r.s: r.k for r in df.collect()} == KINDS


def test_inference(spark):
    df = spark.createDataFrame([("1", "a", "1.5"), ("22222222222", "b2", "2"), (None, "3", "x1")], "a string, b string, c string")
    assert {r.name: r.kind for r in csv.infer_types(df, ["a", "b", "c"]).collect()} == {"a": "long", "b": "string", "c": "double"}


def test_parsers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(C.parse_timespan(F.lit("-1.02:03:04.5"))) == -((26 * 3600 + 3 * 60 + 4) * 10**7 + 5 * 10**6)
    assert one(C.format_timespan(F.lit(-((26 * 3600 + 3 * 60 + 4) * 10**7 + 5 * 10**6)))) == "-1.02:03:04.5000000"
    assert str(one(C.parse_datetime(F.lit("20080410T063000")))) == "2008-04-10 06:30:00"
    assert one(C.parse_datetime(F.lit("2008-13-10"))) is None
    assert one(C.parse_guid(F.lit("{123456789ABCDEF0123456789abcdef0}"))) == "12345678-9abc-def0-1234-56789abcdef0"
    assert one(C.parse_int(F.lit("256"), "byte")) is None and one(C.parse_int(F.lit("-128"), "sbyte")) == -128
    assert one(C.format_string(F.lit('a"b'))) == '"a""b"' and one(C.format_bool(F.lit(True))) == "true"
    assert bytes(one(C.parse_hex(F.lit("0xfF")))) == b"\xff"


def test_ticker(spark, tmp_path):
    good = {"coin": {"ID": 7, "Name": {"Name": "Coin", "Symbol": "C"}}, "format": ["a"], "Data": [[1000, 1.0, 2.0, 3.0, 4.0], [2000, 1.0, 2.0, 9.0, 3.0, 4.0]]}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text(json.dumps(good | {"will_need_requery": True}))
    (tmp_path / "c.json").write_text("{nonsense")
    rows, bad = ticker.read_ticker(spark, str(tmp_path))
    got = rows.orderBy("Timestamp").collect()
    assert [(r.PricePlatform, r.PriceUSD, r.VolumeUSD) for r in got] == [(0.0, 3.0, 4.0), (9.0, 3.0, 4.0)]
    assert str(got[0].Timestamp) == "1970-01-01 00:00:01" and [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["c.json"]


def test_ticker_lines(spark, tmp_path):
    """Many documents in a file, whatever their texts hold; each that doesn't parse is told."""
    name = "a\n\r\u2028\"b"
    doc = lambda k, **more: json.dumps({"coin": {"ID": k, "Name": {"Name": name, "Symbol": name}}, "Data": [[1000 * k, 1.0, 2.0, 3.0, 4.0], [2000 * k, 1.0, 2.0, 9.0, 3.0, 4.0]]} | more, ensure_ascii=False)
    (tmp_path / "a.json").write_text("\n".join([doc(1), doc(2, will_need_requery=True), "", "{nonsense", doc(3, Data=[]), doc(4), "{}"]))
    (tmp_path / "b.json").write_text(doc(5) + "\r\n")
    rows, bad = ticker.read_ticker(spark, str(tmp_path), lines=True)
    assert sorted((r.CoinID, r.Symbol, r.PricePlatform, r.PriceUSD, r.VolumeUSD) for r in rows.collect()) == [(k, name, p, 3.0, 4.0) for k in (1, 4, 5) for p in (0.0, 9.0)]
    assert [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["a.json", "a.json"]


def test_ticker_files_do_not_grow_with_users(spark):
    users = spark.read.parquet(f"{SMALL}/events.parquet").select("user_id").distinct().count()
    assert len(QUERIES["json_ticker"](spark, SMALL).inputFiles()) <= 4 < users


def test_file_tree(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_bytes(b"1")
    (tmp_path / "in" / "sub" / "b.txt").write_bytes(b"22")
    tree = files.read_tree(spark, str(tmp_path / "in"), "*.txt")
    assert sorted(r.FileName for r in tree.collect()) == ["a.txt", "sub/b.txt"]
    assert files.read_tree(spark, str(tmp_path / "in"), regex="^sub/").count() == 1
    files.restore_tree(tree, str(tmp_path / "out"))
    assert (tmp_path / "out" / "sub" / "b.txt").read_bytes() == b"22"
    with pytest.raises(Exception, match="leads out"):
        files.restore_tree(spark.createDataFrame([("../x", bytearray(b"1"))], "FileName string, Content binary"), str(tmp_path / "out"))


def test_generators(spark):
    steady = [r.value for r in spark.range(10).select(synthetic.steady_growing(2.0, 3).alias("value")).collect()]
    assert steady == [0, 0, 0, 2, 2, 2, 4, 4, 4, 6]
    walk = synthetic.random_walk(spark, 1000, 0.0, 1.0, 5).orderBy("id").collect()
    assert len(walk) == 1000 and abs(walk[-1].value) < 200
    grow = [r.value for r in synthetic.randomly_growing(spark, 500, 0.5, 2.0, 5).orderBy("id").collect()]
    assert all(b - a >= 2.0 for a, b in zip(grow, grow[1:])) and 1.5 < grow[-1] / 1000 < 2.6
    kinds = [r.value for r in synthetic.finite_set(spark, 2000, 0.9, 10, 5).orderBy("id").collect()]
    assert set(kinds) <= set(range(10)) and 100 < sum(a != b for a, b in zip(kinds, kinds[1:])) < 300
    blocks = synthetic.running_sum(spark.range(100).withColumn("v", F.lit(1.0)), "v", "s", block=7)
    assert [r.s for r in blocks.orderBy("id").collect()] == [float(i + 1) for i in range(100)]
    assert synthetic.benchmark_table(spark, 100).count() == 100
