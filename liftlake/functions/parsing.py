"""Lenient value coercion for landed JSON (read as text, then typed)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_int(v: Column) -> Column:
    """Integer text, or a float text with no fractional part ("5.0") -> int;
    anything else -> null."""
    d = v.try_cast("double")
    return F.coalesce(v.try_cast("int"),
                      F.when((d == F.floor(d)) & (F.abs(d) < 2147483648), d.cast("long").cast("int")))


def to_double(v: Column) -> Column:
    return v.try_cast("double")


def to_bool(v: Column) -> Column:
    return v.try_cast("boolean")


def int_ok(v: Column, required: bool = False) -> Column:
    ok = to_int(v).isNotNull()
    return ok if required else (v.isNull() | ok)


def double_ok(v: Column, required: bool = False) -> Column:
    ok = to_double(v).isNotNull()
    return ok if required else (v.isNull() | ok)


def utc_ntz(text: Column) -> Column:
    """ISO-8601 text -> UTC wall-clock TIMESTAMP_NTZ, independent of the
    session time zone: text with a zone designator (Z, +hh:mm) is read as an
    instant and shifted to UTC; zone-less text is taken as UTC already."""
    zoned = text.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    instant_micros = F.unix_micros(text.try_cast("timestamp"))
    from_instant = F.expr("timestampadd(MICROSECOND, 0, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    shifted = F.timestamp_add("MICROSECOND", instant_micros, from_instant)
    return F.when(zoned, shifted).otherwise(text.try_cast("timestamp_ntz"))


def python_json_list(arr: Column) -> Column:
    """JSON text of a string list with the separators json.dumps writes
    ('["a", "b"]')."""
    return F.regexp_replace(F.to_json(arr), '","', '", "')
