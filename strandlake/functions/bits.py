"""Column expressions on integers' bits and bytes: zigzag, widths, varints, hex, digits, sizes in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(v: Column, bits: int = 64) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 become 0, 1, 2, 3; 64-bit results are bit patterns in a bigint."""
    if bits == 64:
        return F.shiftleft(v.cast("bigint"), 1).bitwiseXOR(F.shiftright(v.cast("bigint"), 63))
    return F.when(v >= 0, v.cast("bigint") * 2).otherwise(v.cast("bigint") * -2 - 1)


_LOW = (1 << 32) - 1


def joined_halves(high: Column, low: Column, bits: int = 64, unsigned: bool = False) -> Column:
    """high * 2**32 + low modulo 2**bits, of any two whole numbers, as a signed number (or, below 64 bits, an unsigned one)."""
    return _narrowed(F.shiftleft(high + F.shiftright(low, 32), 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW))), bits, unsigned)


def _narrowed(whole: Column, bits: int, unsigned: bool) -> Column:
    if bits == 64:
        return whole
    return whole.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")) if unsigned else F.shiftright(F.shiftleft(whole, 64 - bits), 64 - bits)


def halves(v: Column) -> tuple[Column, Column]:
    """(high, low) 32 bits of a bigint: sums of up to 2**31 of either don't overflow."""
    return F.shiftright(v, 32), v.bitwiseAND(F.lit(_LOW))


def wrapping_add(a: Column, b: Column, bits: int = 64, unsigned: bool = False) -> Column:
    """a + b modulo 2**bits of bigints; by halves only where 64 bits overflow."""
    (h, l), (i, m) = halves(a), halves(b)
    return _narrowed(F.coalesce(F.try_add(a, b), joined_halves(h + i, l + m)), bits, unsigned)


def wrapping_subtract(a: Column, b: Column, bits: int = 64, unsigned: bool = False) -> Column:
    (h, l), (i, m) = halves(a), halves(b)
    return _narrowed(F.coalesce(F.try_subtract(a, b), joined_halves(h - i, l - m)), bits, unsigned)


def unzigzag(u: Column) -> Column:
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-(u.bitwiseAND(F.lit(1).cast("bigint"))))


def double_bits(v: Column) -> Column:
    return F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), v).cast("bigint")


def float_bits(v: Column) -> Column:
    return F.reflect(F.lit("java.lang.Float"), F.lit("floatToRawIntBits"), v).cast("int")


def _hex16(v: Column) -> Column:
    return F.lpad(F.hex(v), 16, "0")


def lead_zero_bytes(v: Column) -> Column:
    """Zero bytes above the highest set one of 8; all 8 for 0."""
    return F.floor((F.lit(16) - F.length(F.ltrim(_hex16(v), F.lit("0")))) / 2).cast("int")


def trail_zero_bytes(v: Column) -> Column:
    return F.floor((F.lit(16) - F.length(F.rtrim(_hex16(v), F.lit("0")))) / 2).cast("int")


def lsb_width(v: Column) -> Column:
    """Bytes that the LSB codec keeps of a value: without high zero bytes, none for 0."""
    return (8 - lead_zero_bytes(v)).cast("int")


def u64_width(v: Column) -> Column:
    """Bytes of the 64-bit codec: without the zero bytes of the side that has more of them, at least 1."""
    return F.greatest(F.lit(1), 8 - F.greatest(lead_zero_bytes(v), trail_zero_bytes(v))).cast("int")


def u32_width(v: Column) -> Column:
    """Bytes of the 32-bit codec for 0 <= v < 2**32, none for 0."""
    text = F.lpad(F.hex(v), 8, "0")
    lead = F.floor((F.lit(8) - F.length(F.ltrim(text, F.lit("0")))) / 2)
    trail = F.floor((F.lit(8) - F.length(F.rtrim(text, F.lit("0")))) / 2)
    return F.when(v == 0, 0).otherwise(4 - F.greatest(lead, trail)).cast("int")


def varint_len(v: Column) -> Column:
    """Bytes of the prefix-length varint: 7 bits a byte up to 8 bytes, then 9."""
    out = F.when(v < 0, 9)
    for n in range(1, 9):
        out = out.when(v < F.lit(1 << (7 * n)), n)
    return out.otherwise(9).cast("int")


def varsize_len(s: Column) -> Column:
    """Bytes of a text or binary value with its length: 0 is null, 1 empty, else length + 1."""
    n = F.octet_length(s).cast("bigint")
    return F.when(s.isNull(), F.lit(1)).otherwise(varint_len(n + 1) + n).cast("bigint")


def digits10(v: Column) -> Column:
    return F.length(F.abs(v.cast("decimal(38,0)")).cast("string")).cast("int")


def _humanized(v: Column, base: int, units: list[str], plain: str) -> Column:
    """One decimal, halves up, by whole-number arithmetic: `/` of decimals keeps six places and rounds what is just below a half up to it."""
    out = F.when(v < base, F.concat(v.cast("bigint").cast("string"), F.lit(plain)))
    for k, unit in enumerate(units, 1):
        tenths = F.call_function("div", v.cast("decimal(38,0)") * 20 + F.lit(str(base**k)).cast("decimal(38,0)"), F.lit(str(2 * base**k)).cast("decimal(38,0)"))
        text = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        out = out.when(v < base ** (k + 1), text) if k < len(units) else out.otherwise(text)
    return out


def humanize_bytes(v: Column) -> Column:
    return _humanized(v, 1024, ["KB", "MB", "GB", "TB", "PB"], " B")


def humanize_quantity(v: Column) -> Column:
    return _humanized(v, 1000, ["K", "M", "G", "T", "P"], "")


def change_base(v: Column, alphabet: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZ") -> Column:
    """Digits of abs(v) in an alphabet of any length, highest first."""
    base, size = len(alphabet), 1
    while base**size < 1 << 63:
        size += 1
    whole = F.abs(v.cast("bigint"))
    parts = [F.element_at(F.array(*[F.lit(c) for c in alphabet]), (F.pmod(_whole_division(whole, base**k), F.lit(base)) + 1).cast("int")) for k in reversed(range(size))]
    text = F.ltrim(F.concat(*parts), F.lit(alphabet[0]))
    return F.when(text == "", F.lit(alphabet[0])).otherwise(text)


def _whole_division(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b)) if b < 1 << 63 else F.lit(0).cast("bigint")
