"""Intervals as structs (low, high), closed at both ends.

Points are of any orderable type; `prev` and `next` step by one unit of it. For partial dates pass the functions of
`temporal`; the defaults step integers. Predicates combine with three-valued logic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortry.functions.logic import lit

Step = Callable[[Column], Column]


def _next(x: Column) -> Column:
    return x + 1


def _prev(x: Column) -> Column:
    return x - 1


def interval(low, high, low_closed: bool = True, high_closed: bool = True, least=None, most=None, nxt: Step = _next, prev: Step = _prev) -> Column:
    """Open bounds move one step inside; a null closed bound is the type's least or most; a low above the high is an error."""
    lo, hi = lit(low), lit(high)
    lo = F.coalesce(lo, lit(least)) if low_closed and least is not None else lo if low_closed else nxt(lo)
    hi = F.coalesce(hi, lit(most)) if high_closed and most is not None else hi if high_closed else prev(hi)
    pair = F.struct(lo.alias("low"), hi.alias("high"))
    return F.when(lo > hi, F.raise_error(F.lit("the low bound of an interval is above its high bound"))).otherwise(pair)


def start(a: Column) -> Column:
    return a["low"]


def end(a: Column) -> Column:
    return a["high"]


def width(a: Column) -> Column:
    return a["high"] - a["low"]


def after(a: Column, b: Column) -> Column:
    return a["low"] > b["high"]


def before(a: Column, b: Column) -> Column:
    return a["high"] < b["low"]


def contains(a: Column, x) -> Column:
    return (a["low"] <= lit(x)) & (lit(x) <= a["high"])


def proper_contains(a: Column, x) -> Column:
    return (a["low"] < lit(x)) & (lit(x) < a["high"])


def includes(a: Column, b: Column) -> Column:
    return (a["low"] <= b["low"]) & (a["high"] >= b["high"])


def proper_includes(a: Column, b: Column) -> Column:
    return includes(a, b) & ((a["low"] != b["low"]) | (a["high"] != b["high"]))


def included_in(a: Column, b: Column) -> Column:
    return includes(b, a)


def starts(a: Column, b: Column) -> Column:
    return (a["low"] == b["low"]) & (a["high"] <= b["high"])


def ends(a: Column, b: Column) -> Column:
    return (a["low"] >= b["low"]) & (a["high"] == b["high"])


def meets_before(a: Column, b: Column, prev: Step = _prev) -> Column:
    return a["high"] == prev(b["low"])


def meets_after(a: Column, b: Column, prev: Step = _prev) -> Column:
    return meets_before(b, a, prev)


def meets(a: Column, b: Column, prev: Step = _prev) -> Column:
    return meets_before(a, b, prev) | meets_after(a, b, prev)


def overlaps(a: Column, b: Column) -> Column:
    return (a["high"] >= b["low"]) & (a["low"] <= b["high"])


def overlaps_before(a: Column, b: Column) -> Column:
    """The start of b lies properly inside a."""
    return proper_contains(a, b["low"])


def overlaps_after(a: Column, b: Column) -> Column:
    return proper_contains(a, b["high"])


def union(a: Column, b: Column, prev: Step = _prev) -> Column:
    """Null unless they overlap or meet."""
    return F.when(overlaps(a, b) | meets(a, b, prev), F.struct(F.least(a["low"], b["low"]).alias("low"), F.greatest(a["high"], b["high"]).alias("high")))


def intersect(a: Column, b: Column) -> Column:
    return F.when(overlaps(a, b), F.struct(F.greatest(a["low"], b["low"]).alias("low"), F.least(a["high"], b["high"]).alias("high")))


def except_(a: Column, b: Column, prev: Step = _prev, nxt: Step = _next) -> Column:
    """What of a is left of b or right of it; null if nothing or two pieces are left."""
    left = F.struct(a["low"].alias("low"), prev(b["low"]).alias("high"))
    right = F.struct(nxt(b["high"]).alias("low"), a["high"].alias("high"))
    return (
        F.when(~overlaps(a, b), a)
        .when((a["low"] < b["low"]) & (a["high"] <= b["high"]), left)
        .when((a["low"] >= b["low"]) & (a["high"] > b["high"]), right)
    )


def point_from(a: Column) -> Column:
    return F.when(a["low"] == a["high"], a["low"]).otherwise(F.raise_error(F.lit("not a unit interval")))


def collapse(items: Column, prev: Step = _prev) -> Column:
    """Overlapping and adjacent intervals of a list become one; nulls go; null for a null list."""
    ordered = F.array_sort(F.array_compact(items))

    def merge(acc: Column, x: Column) -> Column:
        top = F.try_element_at(acc, F.lit(-1))
        one = F.struct(top["low"].alias("low"), F.greatest(top["high"], x["high"]).alias("high"))
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(one))
        return F.when((F.size(acc) > 0) & (top["high"] >= prev(x["low"])), joined).otherwise(F.array_append(acc, x))

    return F.aggregate(ordered, F.slice(ordered, 1, 0), merge)
