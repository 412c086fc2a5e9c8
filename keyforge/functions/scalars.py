"""Scalar functions as Column expressions: all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID_PATTERN = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def legacy_uuid(table: str, key: Column) -> Column:
    """The deterministic 128-bit legacy key of a row, as lower-case text (null for a null key)."""
    h = F.md5(F.concat(F.lit(f"{table}:"), key.cast("string")))
    parts = (F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return F.when(h.isNotNull(), F.concat_ws("-", *parts))


def csv_value(value: Column, null_marker: bool = True) -> Column:
    r"""A CSV field; null is \N and a text that reads \N is quoted (without null_marker: null stays null)."""
    special = value.rlike('[,"\n\r]')
    if null_marker:
        special = special | (value == F.lit("\\N"))
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    out = F.when(special, quoted).otherwise(value)
    return F.when(value.isNull(), F.lit("\\N")).otherwise(out) if null_marker else out


def quote_identifier(name: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))


def json_text(value: Column) -> Column:
    r"""A quoted JSON string; only \ and " are escaped."""
    return F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def is_uuid(value: Column) -> Column:
    return value.rlike(UUID_PATTERN)


def without_schema(table: Column) -> Column:
    return F.regexp_replace(table, "^public\\.", "")


def infer_wal_value(value: Column) -> Column:
    """The type that a change record's text seems to have: struct(kind, long, double, bool, text).

    In this order: null, quoted (a UUID may be inside), integer, decimal, t or
    f, UUID, text. An integer too large for a long has kind 'text'.
    """
    inner = F.regexp_replace(value, "^'|'$", "")
    quoted = value.rlike("(?s)^'.*'$") & (F.length(value) > 1)
    kind = (
        F.when(value.isNull() | (F.lower(value) == "null"), "null")
        .when(quoted & is_uuid(inner), "uuid")
        .when(quoted, "text")
        .when(value.rlike("^-?[0-9]+$") & value.try_cast("long").isNotNull(), "long")
        .when(value.rlike("^-?[0-9]+\\.[0-9]+$"), "double")
        .when(F.lower(value).isin("t", "f"), "bool")
        .when(is_uuid(value), "uuid")
        .otherwise("text")
    )
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "long", value.try_cast("long")).alias("long"),
        F.when(kind == "double", value.try_cast("double")).alias("double"),
        F.when(kind == "bool", F.lower(value) == "t").alias("bool"),
        F.when(kind == "uuid", F.lower(inner)).when(kind == "text", F.when(quoted, inner).otherwise(value)).alias("text"),
    )


def _pretty(size: Column, units: list[str]) -> Column:
    whole = size.cast("long")
    out = F.concat(whole.cast("string"), F.lit(f" {units[0]}"))
    for k, unit in enumerate(units[1:], 1):
        out = F.when(whole >= 1024**k, F.concat(F.floor(whole / F.lit(1024**k)).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def pretty_size(size: Column) -> Column:
    """Whole B, KB, MB or GB."""
    return _pretty(size, ["B", "KB", "MB", "GB"])


def pretty_lag(size: Column) -> Column:
    """Whole bytes, KB or MB."""
    return _pretty(size, ["bytes", "KB", "MB"])


def per_second(records: Column, millis: Column) -> Column:
    """Whole records a second; 0 without a duration."""
    return F.when(millis > 0, F.floor(records.cast("long") * 1000 / millis)).otherwise(0).cast("long")


def ratio(part: Column, whole: Column, scale: float = 100.0) -> Column:
    """part / whole * scale; 0 if whole isn't positive."""
    return F.when(whole > 0, part / whole * scale).otherwise(0.0)


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, low), high)


def lsn(text: Column) -> Column:
    """A log position written as hi/lo in hexadecimal, as a long."""
    hi, lo = F.split_part(text, F.lit("/"), F.lit(1)), F.split_part(text, F.lit("/"), F.lit(2))
    return F.conv(hi, 16, 10).cast("long") * F.lit(1 << 32) + F.conv(lo, 16, 10).cast("long")


def jdbc_part(url: Column, part: str) -> Column:
    """host, port or database of a JDBC URL, with defaults."""
    pattern, default = {
        "host": ("jdbc:postgresql://([^:/]+)", "localhost"),
        "port": ("jdbc:postgresql://[^:]+:([0-9]+)", "5432"),
        "database": ("jdbc:postgresql://[^/]+/([^?]+)", "source_db"),
    }[part]
    return F.coalesce(F.nullif(F.regexp_extract(url, pattern, 1), F.lit("")), F.lit(default))


def index_name(table: Column, column: Column) -> Column:
    return F.concat(F.lit("idx_"), table, F.lit("_"), column)


def truthy(option: Column) -> Column:
    return F.lower(option).isin("true", "yes", "y")
