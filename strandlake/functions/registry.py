"""The scalar operations as SQL functions of a session, and functions of one's own beside them.

They are SQL functions over built-in ones, so Catalyst inlines them: nothing is compiled from text at run time, and no
Python runs for a row.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name: (parameters, result, body).
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "zigzag": ("v BIGINT", "BIGINT", "shiftleft(v, 1) ^ shiftright(v, 63)"),
    "unzigzag": ("u BIGINT", "BIGINT", "shiftrightunsigned(u, 1) ^ (-(u & 1))"),
    "lsb_width": ("v BIGINT", "INT", "CAST(ceil(length(ltrim('0', lpad(hex(v), 16, '0'))) / 2) AS INT)"),
    "wrapping_add": ("a BIGINT, b BIGINT", "BIGINT", "shiftleft(shiftright(a, 32) + shiftright(b, 32) + shiftright((a & 4294967295) + (b & 4294967295), 32), 32) | (((a & 4294967295) + (b & 4294967295)) & 4294967295)"),
    "unix_ms": ("ms BIGINT", "TIMESTAMP_NTZ", "timestampadd(MILLISECOND, ms, TIMESTAMP_NTZ '1970-01-01 00:00:00')"),
}


def register(spark: SparkSession, functions: dict[str, tuple[str, str, str]] = FUNCTIONS, prefix: str = "series_") -> list[str]:
    """Make the functions known to the session's SQL under prefix + name; the names."""
    for name, (parameters, result, body) in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {result} RETURN {body}")
    return [prefix + name for name in functions]
