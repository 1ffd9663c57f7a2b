"""Arithmetic that yields null instead of failing.

Integers are 64-bit. Decimals have 28 digits, 8 of them after the point, rounded half up; what does not fit is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortry.functions.logic import lit

DECIMAL = "decimal(28,8)"
MIN_INTEGER, MAX_INTEGER = -(1 << 31), (1 << 31) - 1
MIN_LONG, MAX_LONG = -(1 << 63), (1 << 63) - 1
MAX_DECIMAL = "99999999999999999999.99999999"
#: Smallest and largest value by type.
BOUNDS = {
    "Integer": (MIN_INTEGER, MAX_INTEGER),
    "Long": (MIN_LONG, MAX_LONG),
    "Decimal": ("-" + MAX_DECIMAL, MAX_DECIMAL),
    "Date": ("0001-01-01", "9999-12-31"),
    "DateTime": ("0001-01-01T00:00:00.000", "9999-12-31T23:59:59.999"),
    "Time": ("00:00:00.000", "23:59:59.999"),
}


def dec(x) -> Column:
    return lit(x).try_cast(DECIMAL)


def _fit(x: Column) -> Column:
    return F.round(x, 8).try_cast(DECIMAL)


def add(a, b) -> Column:
    return F.try_add(lit(a), lit(b))


def subtract(a, b) -> Column:
    return F.try_subtract(lit(a), lit(b))


def multiply(a, b) -> Column:
    return F.try_multiply(lit(a), lit(b))


def add_decimal(a, b) -> Column:
    return F.try_add(dec(a), dec(b)).try_cast(DECIMAL)


def subtract_decimal(a, b) -> Column:
    return F.try_subtract(dec(a), dec(b)).try_cast(DECIMAL)


def multiply_decimal(a, b) -> Column:
    """Operands up to eleven and ten digits before the point keep the exact product until it is rounded."""
    return _fit(F.try_multiply(lit(a).try_cast("decimal(19,8)"), lit(b).try_cast("decimal(18,8)")))


def divide(a, b) -> Column:
    """Always a decimal; division by zero is null."""
    return _fit(F.try_divide(lit(a).try_cast("decimal(28,8)"), lit(b).try_cast("decimal(28,8)")))


def truncated_divide(a, b) -> Column:
    """Toward zero; division by zero is null."""
    a, b = lit(a), F.nullif(lit(b), F.lit(0))
    return F.try_divide(F.try_subtract(a, F.try_mod(a, b)), b).cast("long")


def modulo(a, b) -> Column:
    """The sign is the dividend's; modulo zero is null."""
    return F.try_mod(lit(a), lit(b))


def negate(a) -> Column:
    return F.try_subtract(lit(a) * 0, lit(a))


def absolute(a) -> Column:
    return F.when(lit(a) < 0, negate(a)).otherwise(lit(a))


def ceiling(a) -> Column:
    return F.ceil(lit(a)).try_cast("long")


def floor(a) -> Column:
    return F.floor(lit(a)).try_cast("long")


def truncate(a) -> Column:
    """Toward zero; null beyond 32 bits."""
    return lit(a).try_cast("int").cast("long")


def round_(a, precision: int = 0) -> Column:
    return F.round(dec(a), precision).try_cast(DECIMAL)


def _real(x: Column) -> Column:
    return F.round(F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x), 8)


def exp(a) -> Column:
    return _real(F.exp(lit(a).cast("double")))


def ln(a) -> Column:
    return _real(F.when(lit(a) > 0, F.ln(lit(a).cast("double"))))


def log_double(a) -> Column:
    """The logarithm as SQL has it: minus infinity for zero, NaN for negatives."""
    a = lit(a).cast("double")
    return F.when(a == 0, F.lit(float("-inf"))).when(a < 0, F.lit(float("nan"))).otherwise(F.ln(a))


def log(a, base) -> Column:
    """Null for arguments that are not positive and for base 1."""
    a, b = lit(a).cast("double"), lit(base).cast("double")
    return _real(F.when((a > 0) & (b > 0) & (b != 1), F.ln(a) / F.ln(b)))


def power(a, b) -> Column:
    return _real(F.pow(lit(a).cast("double"), lit(b).cast("double")))


def successor(a, kind: str = "Integer") -> Column:
    """The next value of the type; null past the largest."""
    low, high = BOUNDS[kind]
    if kind in ("Integer", "Long"):
        return F.when(lit(a) < high, F.try_add(lit(a), F.lit(1)))
    if kind == "Decimal":
        return F.try_add(dec(a), F.lit("0.00000001").cast(DECIMAL)).try_cast(DECIMAL)
    raise ValueError(f"no successor of {kind} here; see temporal")


def predecessor(a, kind: str = "Integer") -> Column:
    low, high = BOUNDS[kind]
    if kind in ("Integer", "Long"):
        return F.when(lit(a) > low, F.try_subtract(lit(a), F.lit(1)))
    if kind == "Decimal":
        return F.try_subtract(dec(a), F.lit("0.00000001").cast(DECIMAL)).try_cast(DECIMAL)
    raise ValueError(f"no predecessor of {kind} here; see temporal")


def min_value(kind: str) -> Column:
    return F.lit(BOUNDS[kind][0])


def max_value(kind: str) -> Column:
    return F.lit(BOUNDS[kind][1])
