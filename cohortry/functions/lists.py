"""List functions on arrays. Lists keep order, may hold nulls, and their positions count from 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortry.functions.arithmetic import log_double
from cohortry.functions.logic import lit


def contains(items: Column, x) -> Column:
    """Null for a null element; otherwise true or false, even if the list holds nulls."""
    return F.when(lit(x).isNotNull(), F.coalesce(F.array_contains(items, lit(x)), F.lit(False)))


def proper_contains(items: Column, x) -> Column:
    return contains(items, x) & (F.size(items) > 1)


def includes(a: Column, b: Column) -> Column:
    """Every element of b is in a."""
    return F.forall(b, lambda y: F.coalesce(F.array_contains(a, y), F.lit(False)))


def proper_includes(a: Column, b: Column) -> Column:
    return includes(a, b) & (F.size(a) > F.size(b))


def exists(items: Column) -> Column:
    """Any element that is not null; a null list has none."""
    return F.coalesce(F.exists(items, lambda x: x.isNotNull()), F.lit(False))


def _keep_nulls(whole: Column, clean: Column) -> Column:
    nulls = F.filter(whole, lambda x: x.isNull())
    return F.concat(clean, nulls)


def distinct(items: Column) -> Column:
    """Without repeats. Nulls are no repeats of one another; they come last."""
    return _keep_nulls(items, F.array_distinct(F.array_compact(items)))


def union(a: Column, b: Column) -> Column:
    """All elements without repeats (nulls stay, last); null if either list is."""
    return distinct(F.concat(a, b))


def intersect(a: Column, b: Column) -> Column:
    """Elements of the shorter list that the other holds: repeats stay, nulls go."""
    short = F.when(F.size(a) <= F.size(b), a).otherwise(b)
    long = F.when(F.size(a) <= F.size(b), b).otherwise(a)
    return F.filter(short, lambda x: x.isNotNull() & F.coalesce(F.array_contains(long, x), F.lit(False)))


def except_(a: Column, b: Column) -> Column:
    return F.filter(distinct(a), lambda x: x.isNull() | ~F.coalesce(F.array_contains(b, x), F.lit(False)))


def first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def item(items: Column, i) -> Column:
    i = lit(i)
    return F.when(i >= 0, F.get(items, i))


def slice_(items: Column, start=None, end=None) -> Column:
    """[start, end); a null start is 0, a null end the size; an impossible range is empty."""
    s = F.coalesce(lit(start).cast("int"), F.lit(0))
    e = F.least(F.coalesce(lit(end).cast("int"), F.size(items)), F.size(items))
    return F.when((s >= 0) & (e > s), F.slice(items, F.greatest(s, F.lit(0)) + 1, F.greatest(e - s, F.lit(0)))).when(items.isNotNull(), F.slice(items, 1, 0))


def index_of(items: Column, x) -> Column:
    """-1 if absent."""
    return F.array_position(items, lit(x)) - 1


def flatten(items: Column, depth: int = 1) -> Column:
    for _ in range(depth):
        items = F.flatten(items)
    return items


def singleton_from(items: Column) -> Column:
    """Null for no element; more than one is an error."""
    return F.when(F.size(items) > 1, F.raise_error(F.lit("more than one element"))).otherwise(F.get(items, F.lit(0)))


def to_list(x) -> Column:
    return F.array_compact(F.array(lit(x)))


def filter_(items: Column, keep: Callable[[Column], Column]) -> Column:
    """Keeps elements for which the condition is true, not null."""
    return F.filter(items, keep)


def for_each(items: Column, fn: Callable[[Column], Column]) -> Column:
    return F.transform(items, fn)


def sort(items: Column, ascending: bool = True) -> Column:
    """Ascending: nulls first; descending: nulls last."""
    return F.sort_array(items, asc=ascending)


def times(a: Column, b: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """All combinations, the second list's elements in the outer loop."""
    return F.flatten(F.transform(b, lambda y: F.transform(a, lambda x: combine(x, y))))


# Aggregates over a list: nulls do not count.


def all_true(items: Column) -> Column:
    return F.coalesce(F.forall(F.array_compact(items), lambda x: x), F.lit(True))


def any_true(items: Column) -> Column:
    return F.coalesce(F.exists(F.array_compact(items), lambda x: x), F.lit(False))


def count(items: Column) -> Column:
    """Elements that are neither null nor false."""
    return F.coalesce(F.size(F.filter(items, lambda x: x.isNotNull() & (x.cast("string") != "false"))), F.lit(0))


def sum_(items: Column, kind: str = "double") -> Column:
    clean = F.array_compact(items)
    return F.when(F.size(clean) > 0, F.aggregate(clean, F.lit(0).cast(kind), lambda a, x: (a + x).cast(kind)))


def product(items: Column, kind: str = "double") -> Column:
    clean = F.array_compact(items)
    return F.when(F.size(clean) > 0, F.aggregate(clean, F.lit(1).cast(kind), lambda a, x: (a * x).cast(kind)))


def avg(items: Column) -> Column:
    clean = F.array_compact(items)
    return F.when(F.size(clean) > 0, sum_(clean) / F.size(clean))


def geometric_mean(items: Column) -> Column:
    """Zero if one element is, null if one is negative."""
    return F.nullif(F.exp(avg(F.transform(F.array_compact(items), log_double))), F.lit(float("nan")))


def min_(items: Column) -> Column:
    return F.array_min(items)


def max_(items: Column) -> Column:
    return F.array_max(items)


def median(items: Column) -> Column:
    s = F.sort_array(F.array_compact(items))
    n = F.size(s)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def mode(items: Column) -> Column:
    """The most frequent element; of several the smallest."""
    clean = F.array_compact(items)
    counted = F.transform(F.array_distinct(clean), lambda v: F.struct((-F.size(F.filter(clean, lambda x: x == v))).alias("n"), v.alias("v")))
    return F.array_min(counted)["v"]


def population_variance(items: Column) -> Column:
    clean = F.array_compact(items)
    m = avg(clean)
    return avg(F.transform(clean, lambda x: (x - m) * (x - m)))


def variance(items: Column) -> Column:
    """Null for fewer than two elements."""
    n = F.size(F.array_compact(items))
    return F.when(n > 1, population_variance(items) * n / (n - 1))


def population_stddev(items: Column) -> Column:
    return F.sqrt(population_variance(items))


def stddev(items: Column) -> Column:
    return F.sqrt(variance(items))
