"""Values as CSV text: formatting, parsing, and telling a value's type. Patterns are fixed values of the format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATETIME = r"^[0-9]{4}[-/]?[0-9]{2}[-/]?[0-9]{2}([ T][0-9]{2}:?[0-9]{2}:?[0-9]{2}([.][0-9]{1,7})?)?$"
TIMESPAN = r"^-?([0-9]+[.])?([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]([.][0-9]{1,7})?$"
GUID = r"^(\{[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\}|\([0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\)|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|\{[0-9a-fA-F]{32}\}|\([0-9a-fA-F]{32}\)|[0-9a-fA-F]{32})$"
HEX = r"^(0x)?([0-9a-fA-F]{2})+$"
NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
#: Bits and sign of the integer types.
INTEGERS = {"sbyte": (8, True), "byte": (8, False), "short": (16, True), "ushort": (16, False), "int": (32, True), "uint": (32, False), "long": (64, True), "ulong": (64, False)}
LONGEST_TYPED = 64


def kind_sql(s: str, dialect: str = "spark") -> str:
    """SQL for the type of a text value, unquoted: null, bool, int, long, ulong, decimal, double, char, guid, datetime, timespan or string.

    In this order: nothing and `null`; over 64 characters; words for truth and for special reals; one character (0, 1, f, t
    are truth values, other digits int); texts with other characters than numbers, dates and (from 32 on) guids have;
    guid, datetime, timespan; numbers by length and range. What fits nothing is a string.
    """
    m = (lambda x, p: f"({x} rlike '{p.replace(chr(92), chr(92) * 2)}')") if dialect == "spark" else (lambda x, p: f"regexp_matches({x}, '{p}')")
    t = f"trim(both ' \t' from {s})" if dialect == "spark" else f"trim({s}, ' \t')"
    whole = f"try_cast({t} as decimal(38,0))" if dialect == "spark" else f"try_cast({t} as hugeint)"
    count = lambda c: f"(length({t}) - length(replace({t}, '{c}', '')))"
    digits = f"length(replace(replace(replace({t}, '.', ''), '-', ''), '+', ''))"
    return f"""case
      when {s} is null or {t} = '' then 'null'
      when length({s}) > {LONGEST_TYPED} then 'string'
      when lower({t}) = 'null' then 'null'
      when lower({t}) in ('true', 'false') then 'bool'
      when lower({t}) in ('-inf', 'inf', 'nan') then 'double'
      when length({t}) = 1 then case when {t} in ('t', 'T', '1', 'f', 'F', '0') then 'bool' when {m(t, "^[2-9]$")} then 'int' else 'char' end
      when length({t}) >= 32 and {m(t, GUID)} then 'guid'
      when not {m(t, "^[-0-9./:+ TeE]+$")} then 'string'
      when {count("-")} > 1 and {m(t, "^[^eE]*$")} or {count("/")} > 0 or {count("T")} = 1 then case when {m(t, DATETIME)} then 'datetime' else 'string' end
      when {count(":")} > 0 then case when {m(t, TIMESPAN)} then 'timespan' when {m(t, DATETIME)} then 'datetime' else 'string' end
      when not {m(t, NUMBER)} then 'string'
      when {m(t, "[eE]")} then 'double'
      when {count(".")} = 0 and {m(t, "^-?[0-9]+$")} then case
        when length({t}) <= 9 then 'int'
        when length({t}) > 29 then 'decimal'
        when {whole} between -2147483648 and 2147483647 then 'int'
        when {whole} between -9223372036854775808 and 9223372036854775807 then 'long'
        when {whole} between 0 and 18446744073709551615 then 'ulong'
        else 'decimal' end
      when {digits} <= 15 then 'double'
      else 'decimal' end"""


def value_kind(s: str) -> Column:
    return F.expr(kind_sql(s))


#: Ranks of the integer and real types in a column's vote: a type's group is it and those behind it.
GROUPS = (("long", "ulong", "int", "uint", "short", "ushort", "byte", "sbyte"), ("decimal", "double", "float"))
DECIMAL_MAX = 79228162514264337593543950335
FLOAT_MAX = 3.4028234663852886e38


def candidates(s: Column) -> Column:
    """Every type that a text value can be read as, the likeliest first: an array of (type, lossless).

    Null for nothing, an empty array for the word null. Values are taken as they are, without trimming: blanks, signs of
    plus and second points make a string. Whole numbers of up to 9 characters are ints first, up to 18 longs, beyond that
    the types that hold them; reals begin with the smallest type that keeps all digits (7 for float, 15 for double).
    """
    no, yes = F.lit(None).cast("struct<type: string, lossless: boolean>"), F.lit(True)
    one = lambda kind, lossless=yes: F.struct(F.lit(kind).alias("type"), lossless.alias("lossless"))
    some = lambda *xs: F.array_compact(F.array(*xs))
    if_ = lambda c, x: F.when(c, x).otherwise(no)
    low, n = F.lower(s), F.length(s)
    small = [one(k) for k in ("int", "long", "char", "double", "float", "uint", "ulong", "decimal", "byte", "ushort", "sbyte", "short")]
    real = some(one("double"), one("float"))
    v = s.try_cast("decimal(38,0)")
    between = lambda a, b: (v >= F.lit(str(a)).cast("decimal(38,0)")) & (v <= F.lit(str(b)).cast("decimal(38,0)"))
    exact = lambda kind: s.try_cast("bigint").cast(kind).cast("decimal(38,0)") == v
    tiny = [if_(between(0, 255), one("byte")), if_(between(0, 65535), one("ushort")), if_(between(-128, 127), one("sbyte")), if_(between(-32768, 32767), one("short"))]
    short = some(one("int"), one("long"), one("double"), one("float", exact("float")), if_(v >= 0, one("uint")), if_(v >= 0, one("ulong")), one("decimal"), *tiny)
    middle = some(if_(between(-(2**31), 2**31 - 1), one("int")), one("long"), one("double", exact("double")), one("float", exact("float")), if_(between(0, 2**32 - 1), one("uint")), if_(v >= 0, one("ulong")), one("decimal"), *tiny)
    large = some(if_(between(-(2**63), 2**63 - 1), one("long")), if_(between(0, 2**64 - 1), one("ulong")), one("decimal"))
    d = s.try_cast("double")
    digits = F.length(F.regexp_replace(F.regexp_replace(s, "[-.]", ""), "^0+|0+$", ""))
    f, g, h = one("float", digits <= 7), one("double", digits <= 15), one("decimal")
    text = some(one("string"))
    return (
        F.when(s.isNull() | (s == ""), F.lit(None)).when(low == "null", F.array().cast("array<struct<type: string, lossless: boolean>>"))
        .when(low.isin("true", "false"), some(one("bool"))).when(low.isin("nan", "inf", "-inf"), real)
        .when(s.isin("0", "1"), some(one("bool"), *small)).when(s.rlike("^[2-9]$"), some(*small)).when(low.isin("t", "f"), some(one("bool"), one("char"))).when(n == 1, some(one("char")))
        .when((n >= 32) & s.rlike(GUID), some(one("guid")))
        .when(s.rlike("[.].*[.]"), text)
        .when(s.rlike("-.*-|/|^[^:]*T[^:]*$") & parse_datetime(s).isNotNull(), some(one("datetime"))).when(s.rlike(":") & s.rlike(TIMESPAN), some(one("timespan"))).when(s.rlike("T") & parse_datetime(s).isNotNull(), some(one("datetime")))
        .when(s.rlike("^-?[0-9]{1,9}$") & (n <= 9), short).when(s.rlike("^-?[0-9]{1,18}$") & (n <= 18), middle)
        .when(s.rlike("^-?[0-9]{18,38}$") & between(-DECIMAL_MAX, DECIMAL_MAX), large)
        .when((n < 32) & s.rlike("^-?([0-9]+[.]?[0-9]*|[.][0-9]+)[eE]-?[0-9]+$") & d.isNotNull(), some(one("double"), if_(F.abs(d) <= FLOAT_MAX, one("float", d.cast("float").cast("double") == d))))
        .when(s.rlike("^-?([0-9]+[.][0-9]*|[.][0-9]+)$"), F.when(digits <= 7, F.array(f, g, h)).when(digits <= 15, F.array(g, h, f)).otherwise(F.array(h, g, f)))
        .otherwise(text)
    )


def typed_value(s: str) -> Column:
    """(kind, flag, whole, real, at, ticks, guid, text) of a text column: its kind, and the value in the field of that kind."""
    c = F.trim(F.col(s))
    kind = value_kind(s)
    of = lambda kinds, v, t: F.when(F.col(s).isNotNull() & kind.isin(*kinds), v).cast(t)
    return F.struct(
        kind.alias("kind"), of(["bool"], parse_bool(c), "boolean").alias("flag"), of(["int", "long", "ulong"], parse_whole(c), "decimal(20,0)").alias("whole"),
        of(["double", "decimal"], parse_number(c), "double").alias("real"), of(["datetime"], parse_datetime(c), "timestamp_ntz").alias("at"), of(["timespan"], parse_timespan(c), "bigint").alias("ticks"),
        of(["guid"], parse_guid(c), "string").alias("guid"), of(["string", "char"], F.col(s), "string").alias("text"),
    )


def parse_whole(s: Column) -> Column:
    """A whole number of up to 64 bits, of either sign."""
    return F.coalesce(parse_int(s, "long"), parse_int(s, "ulong"))


def format_datetime(ts: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss, and seven decimals unless they are zero."""
    micro = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.when(micro == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micro, F.lit("0"))))


def format_timespan(ticks: Column) -> Column:
    """[-][d.]hh:mm:ss[.fffffff] of 100 ns ticks."""
    t = F.abs(ticks)
    part = lambda size, per: F.lpad((F.floor(t / size) % per).cast("bigint").cast("string"), 2, "0")
    days, rest = F.floor(t / 864000000000).cast("bigint"), (t % 10000000).cast("bigint")
    return F.concat(
        F.when(ticks < 0, F.lit("-")).otherwise(F.lit("")), F.when(days > 0, F.concat(days.cast("string"), F.lit("."))).otherwise(F.lit("")),
        part(36000000000, 24), F.lit(":"), part(600000000, 60), F.lit(":"), part(10000000, 60), F.when(rest > 0, F.concat(F.lit("."), F.lpad(rest.cast("string"), 7, "0"))).otherwise(F.lit("")),
    )


def format_number(v: Column) -> Column:
    """A real that is a whole number is written as one."""
    return F.when((v == F.floor(v)) & (F.abs(v) < 1e15), v.cast("bigint").cast("string")).otherwise(v.cast("string"))


def format_string(s: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))


def format_bytes(b: Column) -> Column:
    return F.concat(F.lit('"'), F.hex(b), F.lit('"'))


def format_bool(b: Column) -> Column:
    return F.when(b, "true").when(~b, "false")


def csv_line(columns: list[Column], separator: str = ",") -> Column:
    """A line of formatted values; null is empty."""
    return F.concat_ws(separator, *[F.coalesce(c, F.lit("")) for c in columns])


def parse_bool(s: Column) -> Column:
    return F.when(s.isin("0", "f", "F") | (F.lower(s) == "false"), False).when(s.isin("1", "t", "T") | (F.lower(s) == "true"), True)


def parse_int(s: Column, kind: str = "long") -> Column:
    """Digits only, with - for signed types; null where out of the type's range. decimal(20,0)."""
    bits, signed = INTEGERS[kind]
    low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
    v = F.when(s.rlike("^-?[0-9]{1,37}$" if signed else "^[0-9]{1,37}$"), s.try_cast("decimal(38,0)"))
    return F.when((v >= F.lit(str(low)).cast("decimal(38,0)")) & (v <= F.lit(str(high)).cast("decimal(38,0)")), v).cast("decimal(20,0)")


def parse_number(s: Column, kind: str = "double") -> Column:
    """A real (double, float or decimal(38,18)) with a sign, an exponent, currency signs and thousands' commas; NaN, Inf and -Inf for the first two. Null where it doesn't fit."""
    bare = F.regexp_replace(F.trim(s), "[$€£¥,]", "")
    plain = F.when(bare.rlike(NUMBER), bare.try_cast(kind))
    if kind.startswith("decimal"):
        return plain
    word = F.lower(bare)
    special = F.when(word == "nan", F.lit("NaN")).when(word == "inf", F.lit("Infinity")).when(word == "-inf", F.lit("-Infinity"))
    return F.when(special.isNotNull(), special.cast(kind)).otherwise(plain)


def parse_char(s: Column) -> Column:
    """A value of one character; null for others."""
    return F.when(F.length(s) == 1, s)


def parse_string(s: Column) -> Column:
    """The text; null for nothing and for the word null."""
    return F.when((s != "") & (F.lower(s) != "null"), s)


def parse_datetime(s: Column) -> Column:
    digits = F.regexp_replace(s, "[-/ T:]", "")
    head, fraction = F.substring_index(digits, ".", 1), F.when(F.contains(digits, F.lit(".")), F.substring_index(digits, ".", -1)).otherwise(F.lit(""))
    text = F.rpad(head, 14, "0")
    iso = F.concat(F.substring(text, 1, 4), F.lit("-"), F.substring(text, 5, 2), F.lit("-"), F.substring(text, 7, 2), F.lit(" "), F.substring(text, 9, 2), F.lit(":"), F.substring(text, 11, 2), F.lit(":"), F.substring(text, 13, 2), F.lit("."), F.substring(F.rpad(fraction, 7, "0"), 1, 6))
    return F.when(s.rlike(DATETIME), iso.try_cast("timestamp_ntz"))


def parse_timespan(s: Column) -> Column:
    """Ticks of 100 ns."""
    get = lambda k: F.coalesce(F.nullif(F.regexp_extract(s, r"^(-)?(?:([0-9]+)[.])?([0-9]{2}):([0-9]{2}):([0-9]{2})(?:[.]([0-9]{1,7}))?$", k), F.lit("")), F.lit("0"))
    ticks = (((get(2).cast("bigint") * 24 + get(3).cast("bigint")) * 60 + get(4).cast("bigint")) * 60 + get(5).cast("bigint")) * 10000000 + F.rpad(get(6), 7, "0").cast("bigint")
    return F.when(s.rlike(TIMESPAN), F.when(s.startswith("-"), -ticks).otherwise(ticks))


def parse_guid(s: Column) -> Column:
    """8-4-4-4-12 in lower case."""
    h = F.lower(F.regexp_replace(s, r"[-{}()]", ""))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(s.rlike(GUID), F.concat_ws("-", *cut))


def parse_hex(s: Column) -> Column:
    return F.when(s.rlike(HEX), F.unhex(F.regexp_replace(s, "^0x", "")))


def try_cast_default(s: Column, kind: str, default) -> Column:
    return F.coalesce(s.try_cast(kind), F.lit(default).cast(kind))
