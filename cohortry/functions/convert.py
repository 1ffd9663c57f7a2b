"""Conversions between types; what cannot be converted is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortry.functions import quantity, temporal
from cohortry.functions.logic import lit


def to_boolean(x) -> Column:
    t = F.lower(lit(x).cast("string"))
    return F.when(t.isin("true", "t", "yes", "y", "1", "1.0"), F.lit(True)).when(t.isin("false", "f", "no", "n", "0", "0.0"), F.lit(False))


def to_integer(x) -> Column:
    t = lit(x).cast("string")
    return F.when(F.rlike(t, F.lit(r"^[+-]?\d+$")), t.try_cast("int")).cast("long")


def to_long(x) -> Column:
    t = lit(x).cast("string")
    return F.when(F.rlike(t, F.lit(r"^[+-]?\d+$")), t.try_cast("long"))


def to_decimal(x) -> Column:
    t = lit(x).cast("string")
    return F.when(F.rlike(t, F.lit(r"^[+-]?\d+(\.\d+)?$")), t.try_cast("decimal(28,8)"))


def to_date(x) -> Column:
    return temporal.date_from(temporal.parse(x))


def to_datetime(x) -> Column:
    return temporal.parse(x)


def to_time(x) -> Column:
    t = lit(x)
    part = [F.regexp_extract(t, r"^T?(\d{2})(?::(\d{2})(?::(\d{2})(?:\.(\d{3}))?)?)?$", i).try_cast("int") for i in range(1, 5)]
    return temporal.time(*part)


def to_string(x) -> Column:
    return lit(x).cast("string")


def to_quantity(x) -> Column:
    return quantity.parse(x)


def to_ratio(x) -> Column:
    """quantity:quantity."""
    parts = F.split(lit(x), ":")
    n, d = quantity.parse(F.trim(F.get(parts, F.lit(0)))), quantity.parse(F.trim(F.get(parts, F.lit(1))))
    return F.when((F.size(parts) == 2) & n.isNotNull() & d.isNotNull(), quantity.ratio(n, d))


def to_concept(code: Column) -> Column:
    return F.when(code.isNotNull(), F.array(code))


_BY_NAME = {
    "Boolean": to_boolean,
    "Integer": to_integer,
    "Long": to_long,
    "Decimal": to_decimal,
    "Date": to_date,
    "DateTime": to_datetime,
    "Time": to_time,
    "String": to_string,
    "Quantity": to_quantity,
    "Ratio": to_ratio,
}


def converts_to(x, kind: str) -> Column:
    """Null for null."""
    return F.when(lit(x).isNotNull(), _BY_NAME[kind](x).isNotNull())


def as_type(value: Column, kind: str) -> Column:
    """A choice element (type, then one field per type) read as one of its types: null if it is another."""
    return F.when(value["type"] == kind, value[kind])


def is_type(value: Column, kind: str) -> Column:
    return F.coalesce(value["type"] == kind, F.lit(False))


def period_to_interval(period: Column) -> Column:
    """A period (start, end texts) as an interval; without an end it lasts to the last instant."""
    start = temporal.parse(period["start"])
    end = temporal.parse(F.coalesce(period["end"], F.lit("9999-12-31T23:59:59.999")))
    return F.when(period.isNotNull(), F.struct(start.alias("low"), end.alias("high")))


def coding_to_code(c: Column) -> Column:
    return F.when(c.isNotNull(), F.struct(c["system"].alias("system"), c["version"].alias("version"), c["code"].alias("code")))
