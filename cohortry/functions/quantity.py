"""Quantities: structs (value, unit). Units are compared after conversion to the base unit of their dimension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortry.functions.logic import lit

#: Fixed values: (dimension, factor to the base unit, offset) of common units; the base unit has factor 1.
UNITS: dict[str, tuple[str, float, float]] = {
    "1": ("1", 1.0, 0.0),
    "%": ("1", 0.01, 0.0),
    "g": ("g", 1.0, 0.0),
    "kg": ("g", 1000.0, 0.0),
    "mg": ("g", 0.001, 0.0),
    "ug": ("g", 0.000001, 0.0),
    "ng": ("g", 0.000000001, 0.0),
    "m": ("m", 1.0, 0.0),
    "km": ("m", 1000.0, 0.0),
    "cm": ("m", 0.01, 0.0),
    "mm": ("m", 0.001, 0.0),
    "[in_i]": ("m", 0.0254, 0.0),
    "[lb_av]": ("g", 453.59237, 0.0),
    "L": ("L", 1.0, 0.0),
    "dL": ("L", 0.1, 0.0),
    "mL": ("L", 0.001, 0.0),
    "s": ("s", 1.0, 0.0),
    "min": ("s", 60.0, 0.0),
    "h": ("s", 3600.0, 0.0),
    "d": ("s", 86400.0, 0.0),
    "wk": ("s", 604800.0, 0.0),
    "mol": ("mol", 1.0, 0.0),
    "mmol": ("mol", 0.001, 0.0),
    "umol": ("mol", 0.000001, 0.0),
    "g/L": ("g/L", 1.0, 0.0),
    "g/dL": ("g/L", 10.0, 0.0),
    "mg/dL": ("g/L", 0.01, 0.0),
    "mg/L": ("g/L", 0.001, 0.0),
    "mol/L": ("mol/L", 1.0, 0.0),
    "mmol/L": ("mol/L", 0.001, 0.0),
    "mm[Hg]": ("Pa", 133.322387415, 0.0),
    "kPa": ("Pa", 1000.0, 0.0),
    "K": ("K", 1.0, 0.0),
    "Cel": ("K", 1.0, 273.15),
    "/min": ("/s", 1 / 60, 0.0),
    "kg/m2": ("g/m2", 1000.0, 0.0),
}


def _map(i: int) -> Column:
    return F.create_map(*[F.lit(x) for u, v in UNITS.items() for x in (u, v[i])])


def quantity(value, unit="1") -> Column:
    return F.struct(lit(value).alias("value"), F.coalesce(lit(unit), F.lit("1")).alias("unit"))


def dimension(q: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(0), q["unit"]), q["unit"])


def base_value(q: Column) -> Column:
    """In the base unit; a unit of none of the known dimensions is its own base. Rounded to twelve digits of the point."""
    return F.round(q["value"].cast("double") * F.coalesce(F.try_element_at(_map(1), q["unit"]), F.lit(1.0)) + F.coalesce(F.try_element_at(_map(2), q["unit"]), F.lit(0.0)), 12)


def _with(a: Column, b: Column, op) -> Column:
    return F.when(dimension(a) == dimension(b), op(base_value(a), base_value(b)))


def equal(a: Column, b: Column) -> Column:
    """Null for units that do not convert."""
    return _with(a, b, lambda x, y: x == y)


def equivalent(a: Column, b: Column) -> Column:
    return F.when(a.isNull() & b.isNull(), F.lit(True)).otherwise(F.coalesce(equal(a, b), F.lit(False)))


def less(a: Column, b: Column) -> Column:
    return _with(a, b, lambda x, y: x < y)


def greater(a: Column, b: Column) -> Column:
    return less(b, a)


def less_or_equal(a: Column, b: Column) -> Column:
    return _with(a, b, lambda x, y: x <= y)


def greater_or_equal(a: Column, b: Column) -> Column:
    return less_or_equal(b, a)


def convert(q: Column, unit: str) -> Column:
    """Null if the unit does not convert."""
    dim, factor, offset = UNITS.get(unit, (unit, 1.0, 0.0))
    return F.when(dimension(q) == dim, quantity(F.round((base_value(q) - offset) / factor, 8), unit))


def can_convert(q: Column, unit: str) -> Column:
    return F.when(q.isNotNull(), convert(q, unit).isNotNull())


def add(a: Column, b: Column) -> Column:
    """In the unit of the first."""
    factor = F.coalesce(F.try_element_at(_map(1), a["unit"]), F.lit(1.0))
    other = F.coalesce(F.try_element_at(_map(1), b["unit"]), F.lit(1.0))
    return F.when(dimension(a) == dimension(b), quantity(F.round(a["value"].cast("double") + b["value"].cast("double") * other / factor, 8), a["unit"]))


def subtract(a: Column, b: Column) -> Column:
    return add(a, quantity(-b["value"], b["unit"]))


def to_string(q: Column) -> Column:
    return F.concat(q["value"].cast("string"), F.lit(" '"), q["unit"], F.lit("'"))


def stratum(q: Column) -> Column:
    """How a stratum shows a quantity."""
    return F.when(q["value"].isNotNull(), F.concat_ws(" ", q["value"].cast("string"), F.nullif(q["unit"], F.lit("1"))))


def parse(text) -> Column:
    """number ['unit']; anything else is null."""
    pattern = r"^([+-]?\d+(?:\.\d+)?)\s*(?:'([^']+)')?$"
    t = lit(text)
    return F.when(F.rlike(t, F.lit(pattern)), quantity(F.regexp_extract(t, pattern, 1).try_cast("decimal(28,8)"), F.nullif(F.regexp_extract(t, pattern, 2), F.lit(""))))


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.struct(numerator.alias("numerator"), denominator.alias("denominator"))


def ratio_to_quantity(r: Column) -> Column:
    """The denominator over the numerator."""
    n, d = r["numerator"], r["denominator"]
    return F.when(dimension(n) == dimension(d), quantity(F.round(F.try_divide(base_value(d), base_value(n)), 8)))
