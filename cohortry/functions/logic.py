"""Three-valued logic, equality, conditionals and null handling as Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def let(fn: Callable[..., Column], *values) -> Column:
    """fn of values that are computed once, however often fn uses them."""
    bound = F.array(F.struct(*[lit(v).alias(f"_{i}") for i, v in enumerate(values)]))
    return F.get(F.transform(bound, lambda s: fn(*[s[f"_{i}"] for i in range(len(values))])), F.lit(0))


def and_(a, b) -> Column:
    return lit(a) & lit(b)


def or_(a, b) -> Column:
    return lit(a) | lit(b)


def not_(a) -> Column:
    return ~lit(a)


def xor(a, b) -> Column:
    """Null if either side is null."""
    return lit(a) != lit(b)


def implies(a, b) -> Column:
    return ~lit(a) | lit(b)


def equal(a, b) -> Column:
    return lit(a) == lit(b)


def not_equal(a, b) -> Column:
    return ~(lit(a) == lit(b))


def equivalent(a, b) -> Column:
    """Two-valued: null is equivalent to null only."""
    return lit(a).eqNullSafe(lit(b))


def code_equal(a: Column, b: Column) -> Column:
    return (a["system"] == b["system"]) & (a["version"] == b["version"]) & (a["code"] == b["code"])


def code_equivalent(a: Column, b: Column) -> Column:
    """The version does not matter."""
    return a["system"].eqNullSafe(b["system"]) & a["code"].eqNullSafe(b["code"])


def concept_equivalent(a: Column, b: Column) -> Column:
    """Concepts (arrays of codes) are equivalent if any two of their codes are."""
    return F.coalesce(F.exists(a, lambda x: F.exists(b, lambda y: code_equivalent(x, y))), F.lit(False))


def is_null(a) -> Column:
    return lit(a).isNull()


def is_true(a) -> Column:
    return lit(a).eqNullSafe(F.lit(True))


def is_false(a) -> Column:
    return lit(a).eqNullSafe(F.lit(False))


def coalesce(*items) -> Column:
    return F.coalesce(*[lit(i) for i in items])


def coalesce_list(a: Column) -> Column:
    return F.get(F.filter(a, lambda x: x.isNotNull()), F.lit(0))


def if_(cond, then, other=None) -> Column:
    """A null condition takes the other branch."""
    return F.when(lit(cond), lit(then)).otherwise(lit(other))


def case(*items: tuple, comparand=None, other=None) -> Column:
    """First item whose condition is true, or that equals the comparand."""
    out = None
    for when, then in items:
        cond = lit(when) if comparand is None else lit(comparand) == lit(when)
        out = F.when(cond, lit(then)) if out is None else out.when(cond, lit(then))
    return lit(other) if out is None else out.otherwise(lit(other))
