"""CSV: separator and header detection, a parser with both quotes and ragged rows, typed rows, type inference, a writer."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions.csvtext import GROUPS as TYPE_GROUPS
from strandlake.functions.csvtext import candidates, csv_line, format_bool, format_bytes, format_datetime, format_number, format_string, kind_sql

#: Separators in the order that breaks ties, and byte order marks, the shortest first.
SEPARATORS = ",;|\t:"
MARKS = [(codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"), (codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_BE, "utf-32-be")]
#: Bytes of a file that header and separator are found in.
PEEK = 1 << 16
#: Bytes of a file that are decoded and parsed at a time, and values that Python hands on at a time.
PIECE, PORTION = 1 << 20, 1 << 15
#: Types by group; within a group a column takes the widest type that it has.
GROUPS = {"int": ("whole", 1), "long": ("whole", 2), "ulong": ("whole", 3), "double": ("real", 4), "decimal": ("real", 5)}


def detect_encoding(data: bytes) -> tuple[str, int]:
    """(encoding, bytes of the mark); UTF-8 without a mark."""
    for mark, name in MARKS:
        if data.startswith(mark):
            return name, len(mark)
    return "utf-8", 0


def detect_separator(first_line: str) -> str:
    return max(SEPARATORS, key=lambda c: (first_line.count(c), -SEPARATORS.index(c)))


def separator_sql(line: str) -> str:
    """SQL for the most frequent separator of a text, in any dialect with length and replace."""
    count = {c: f"(length({line}) - length(replace({line}, '{c}', '')))" for c in SEPARATORS}
    best = f"greatest({', '.join(count.values())})"
    return "case " + " ".join(f"when {n} = {best} then '{c}'" for c, n in count.items()) + " end"


def parse_rows(text: str, separator: str) -> Iterator[list[tuple[str, bool]]]:
    """(value, quoted) of each row. A value that begins with ' or " runs to the next such mark, doubled marks being one; marks
    inside a value are ordinary. CR, LF or both end a row; empty lines are skipped; rows may be of unlike length."""
    return (row for row, _ in _rows(text, separator))


def parse_pieces(pieces: Iterable[str], separator: str) -> Iterator[list[tuple[str, bool]]]:
    """The rows of a text that comes in pieces; besides a piece, only the row that it ends in is held.

    A row counts once its line end is there; what is behind the last one is read again with the next pieces, at least as much
    more as was left, so that the work stays in proportion to the text.
    """
    held, rest, more = [], 0, 0
    for piece in pieces:
        held.append(piece)
        more += len(piece)
        if more < rest:
            continue
        text, done = "".join(held), 0
        for row, end in _rows(text, separator):
            if end > len(text):  # ended by the end of the piece alone
                break
            done = end
            yield row
        held, rest, more = [text[done:]], len(text) - done, 0
    yield from parse_rows("".join(held), separator)


def _rows(text: str, separator: str) -> Iterator[tuple[list[tuple[str, bool]], int]]:
    """(row, place behind its line end) of each row; the place is behind the text's end if that ended the row, not a line end."""
    row: list[tuple[str, bool]] = []
    i, n = 0, len(text)
    stop = re.compile(f"[{re.escape(separator)}\r\n]").search
    while i < n or row:
        c = text[i] if i < n else "\n"
        if c in "'\"" and i < n:
            parts, start = [], i + 1
            while True:
                j = text.find(c, start)
                if j < 0:
                    parts.append(text[start:])
                    i = n
                    break
                parts.append(text[start:j])
                if text[j + 1 : j + 2] != c:
                    i = j + 1
                    break
                parts.append(c)
                start = j + 2
            value, quoted = "".join(parts), True
            i = m.start() if (m := stop(text, i)) else n
        else:
            j = m.start() if (m := stop(text, i)) else n
            value, quoted, i = text[i:j], False, j
        if i < n and text[i] == separator:
            row.append((value, quoted))
            i += 1
            if i == n:
                row.append(("", False))
                yield row, n + 1
                return
            continue
        end = i + (2 if text[i : i + 2] == "\r\n" else 1)
        if row or value or quoted:
            row.append((value, quoted))
            yield row, end
            row = []
        i = end


def detect_header(row: Sequence[str]) -> list[str] | None:
    """The first row's values if each has a letter a-z and none comes twice, else None."""
    ok = len(set(row)) == len(row) and all(any("a" <= c.lower() <= "z" for c in v) for v in row)
    return list(row) if ok and row else None


#: What stands between the columns of a file read line by line: no line holds it.
_NOTHING = "\x01\x02\x01\x02"


def cells(line: Column, separator: str) -> Column:
    """The values of a line, however many: a value that begins with ' or " runs to the next such mark, doubled marks being one."""
    sep = "\\" + separator if separator in "|" else separator
    quoted = lambda q: f"{q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q}?[^{sep}]*+"
    found = F.regexp_extract_all(F.concat(F.lit(separator), line), F.lit(f"{sep}(?:{quoted(chr(34))}|{quoted(chr(39))}|[^{sep}]*+)"), F.lit(0))
    inner = lambda v, q: F.replace(F.regexp_extract(v, f"^{q}([^{q}]*+(?:{q}{q}[^{q}]*+)*+)", 1), F.lit(q + q), F.lit(q))

    def value(m: Column) -> Column:
        v = F.substr(m, F.lit(2))
        return F.when(v.startswith('"'), inner(v, '"')).when(v.startswith("'"), inner(v, "'")).otherwise(v)

    return F.transform(found, value)


def lines(spark: SparkSession, path: str, header: bool) -> DataFrame:
    """`line` of all files, large ones in splits, without empty lines and, with header, without each file's first line."""
    raw = spark.read.schema("line string").csv(path, sep=_NOTHING, quote="", header=header, enforceSchema=True, comment="")
    return raw.select(F.regexp_replace("line", "^\ufeff", "").alias("line")).filter("line <> ''")


def read_strings(spark: SparkSession, path: str, separator: str | None = None, header: bool | None = None, multiline: bool = False) -> DataFrame:
    """Every value as text. Separator and header are found from the first line where they aren't given.

    Rows may be of unlike length: a short one ends with nulls, and a column is added for each place of the longest row that
    the header doesn't name. Large files are read in splits, line by line; values that hold line ends need `multiline`,
    which reads files as wholes. No column for no rows.
    """
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0].lstrip("\ufeff") if first else ""
    separator = separator or detect_separator(line)
    names = [v for v, _ in next(parse_rows(line, separator), [])]
    header = detect_header(names) is not None if header is None else header
    if multiline:
        rows = rows_of_files(spark, path, separator)
        rows = (rows.filter("row > 0") if header else rows).select(F.transform("cells", lambda c: c["value"]).alias("cells"))
    else:
        rows = lines(spark, path, header).select(cells(F.col("line"), separator).alias("cells"))
    width = max(rows.agg(F.max(F.size("cells"))).first()[0] or 0, len(names))
    columns = [*(names if header else [f"Column{i + 1}" for i in range(len(names))]), *(f"Column{i + 1}" for i in range(len(names), width))]
    return rows.select(*[F.get("cells", i).alias(c) for i, c in enumerate(columns)])


def _decoded(data: memoryview) -> Iterator[str]:
    """The text of a file in pieces, without its mark."""
    encoding, mark = detect_encoding(bytes(data[:4]))
    decode = codecs.getincrementaldecoder(encoding)("replace").decode
    for i in range(mark, len(data), PIECE):
        yield decode(bytes(data[i : i + PIECE]))
    yield decode(b"", True)


def _file_rows(data: memoryview, separator: str | None) -> Iterator[list[tuple[str, bool]]]:
    pieces, first = _decoded(data), []
    while not separator:  # found from the whole first line, however long
        piece = next(pieces, None)
        first.append(piece or "")
        if piece is None or "\n" in piece:
            separator = detect_separator("".join(first).split("\n", 1)[0])
    return parse_pieces(chain(first, pieces), separator)


def _portions(data: memoryview, separator: str | None) -> Iterator[tuple[int, list, list, list]]:
    """(first row, offsets, values, quoted) of a file's rows; a portion ends with the row that fills it."""
    begun, offsets, values, quoted, size = 0, [0], [], [], 0
    for row in _file_rows(data, separator):
        for v, q in row:
            values.append(v)
            quoted.append(q)
            size += len(v)
        offsets.append(len(values))
        if len(values) >= PORTION or size >= PIECE:
            yield begun, offsets, values, quoted
            begun, offsets, values, quoted, size = begun + len(offsets) - 1, [0], [], [], 0
    if len(offsets) > 1:
        yield begun, offsets, values, quoted


def rows_of_files(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(path, row, cells: array of (value, quoted)) of whole files, by parse_rows.

    Python holds a file's bytes, and of what they say a piece and a portion of rows (or one row, where that is larger).
    """

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                for begun, offsets, values, quoted in _portions(memoryview(data.as_buffer()), separator):
                    n = len(offsets) - 1
                    cell = pa.StructArray.from_arrays([pa.array(values, pa.string()), pa.array(quoted, pa.bool_())], ["value", "quoted"])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(begun, begun + n), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cell)], ["path", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, row bigint, cells array<struct<value: string, quoted: boolean>>")


def parse_entities(df: DataFrame, mapping: dict[str, tuple], unparsed: str | None = None) -> DataFrame:
    """Typed columns {target: (source column, type or setter)}; a setter is a function from the text column to the value's.

    Values that don't fit are null, and rows without any value go. With `unparsed`, a map of that name holds the text of
    each target whose value was there and didn't fit.
    """
    made = {target: how(F.col(f"`{source}`")) if callable(how) else F.col(f"`{source}`").try_cast(how) for target, (source, how) in mapping.items()}
    out = [v.alias(target) for target, v in made.items()]
    if unparsed:
        failed = F.map_filter(F.create_map(*[x for target, (source, _) in mapping.items() for x in (F.lit(target), F.when(made[target].isNull(), F.col(f"`{source}`")))]), lambda _, v: v.isNotNull() & (v != ""))
        out.append(failed.alias(unparsed))
    return df.select(*out).filter(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in mapping]))


def detect_columns(df: DataFrame, columns: Sequence[str], rows: int | None = None) -> DataFrame:
    """(name, type, likely, in_group, valid, potential, rank, empty, nulls, recommended, nullable) of text columns, a row for each type that some value may have.

    likely: values whose first candidate is the type; in_group: those of it and the smaller types of its group; valid and
    potential: values that it holds without and with loss. Types rank by the greater of likely and in_group, then likely,
    valid, potential and name. The first one is recommended if half of the values that aren't empty or null fit it, else
    string. With `rows`, only so many rows are looked at.
    """
    source = df.limit(rows) if rows else df
    stacked = source.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])).alias("x")).select("x.name", candidates(F.col("x.value")).alias("found"))
    each = stacked.select("name", F.posexplode("found").alias("place", "c")).groupBy("name", F.col("c.type").alias("type")).agg(F.count_if(F.col("place") == 0).alias("likely"), F.count_if("c.lossless").alias("valid"), F.count_if(~F.col("c.lossless")).alias("potential"))
    totals = stacked.groupBy("name").agg(F.count("*").alias("rows"), F.count_if(F.col("found").isNull()).alias("empty"), F.count_if(F.size("found") == 0).alias("nulls"))
    place = F.create_map(*[x for group in TYPE_GROUPS for i, k in enumerate(group) for x in (F.lit(k), F.lit(i))])
    group = F.create_map(*[x for g, names in enumerate(TYPE_GROUPS) for k in names for x in (F.lit(k), F.lit(g))])
    in_group = F.sum("likely").over(Window.partitionBy("name", group[F.col("type")]).orderBy(place[F.col("type")].desc()))
    counted = each.withColumn("in_group", F.when(group[F.col("type")].isNotNull(), in_group).otherwise(0).cast("bigint"))
    best = Window.partitionBy("name").orderBy(F.greatest("in_group", "likely").desc(), F.desc("likely"), F.desc("valid"), F.desc("potential"), "type")
    ranked = counted.withColumn("rank", F.row_number().over(best)).join(totals, "name")
    fits = (F.col("valid") + F.col("potential")) >= F.floor((F.col("rows") - F.col("empty") - F.col("nulls")) / 2)
    top = F.first(F.when(fits, F.col("type")).otherwise(F.lit("string"))).over(Window.partitionBy("name").orderBy("rank"))
    return ranked.select("name", "type", "likely", "in_group", "valid", "potential", "rank", "empty", "nulls", top.alias("recommended"), (F.col("empty") + F.col("nulls") > 0).alias("nullable"))


def type_votes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, kind, votes) of text columns: how many values have each kind."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.name", "x.value")
    return stacked.select("name", F.expr(kind_sql("value")).alias("kind")).groupBy("name", "kind").agg(F.count("*").alias("votes"))


def infer_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, kind): the widest of the numbers, or the most frequent other kind, if it covers half of the values, else string."""
    votes = type_votes(df, columns)
    group = F.when(F.col("kind").isin(*GROUPS), F.lit("number")).otherwise(F.col("kind"))
    width = F.coalesce(*[F.when(F.col("kind") == k, F.lit(w)) for k, (_, w) in GROUPS.items()], F.lit(0))
    grouped = votes.filter("kind <> 'null'").groupBy("name", group.alias("grp")).agg(F.sum("votes").alias("n"), F.max_by("kind", width).alias("kind"))
    best = grouped.groupBy("name").agg(F.max_by("kind", F.struct("n", "grp")).alias("kind"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return best.select("name", F.when(F.col("n") * 2 >= F.col("total"), F.col("kind")).otherwise(F.lit("string")).alias("kind"))


def formatted(df: DataFrame) -> list[Column]:
    """The CSV text of each column, as its type asks for."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            out.append(format_string(c))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out.append(format_datetime(c))
        elif isinstance(f.dataType, T.BinaryType):
            out.append(format_bytes(c))
        elif isinstance(f.dataType, T.BooleanType):
            out.append(format_bool(c))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            out.append(format_number(c))
        else:
            out.append(c.cast("string"))
    return out


def write_lines(df: DataFrame, columns: Sequence[Column] | None, path: str, separator: str = ",") -> None:
    """Append rows as text files, lines ended by CR LF, without a header; columns without a form of their own are formatted by type."""
    df.select(csv_line(list(columns or formatted(df)), separator).alias("value")).write.mode("append").option("lineSep", "\r\n").text(path)
