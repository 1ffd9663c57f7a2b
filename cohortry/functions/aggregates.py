"""The same aggregates over the rows of a group. Nulls do not count; all have map-side partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortry.functions.arithmetic import log_double
from cohortry.functions.logic import lit


def all_true(x) -> Column:
    return F.coalesce(F.every(lit(x)), F.lit(True))


def any_true(x) -> Column:
    return F.coalesce(F.some(lit(x)), F.lit(False))


def count(x) -> Column:
    return F.count(lit(x))


def count_true(x) -> Column:
    """Count of a Boolean expression: false does not count."""
    return F.count_if(lit(x))


def avg(x) -> Column:
    return F.avg(lit(x))


def geometric_mean(x) -> Column:
    """Zero if one value is, NaN if one is negative."""
    return F.exp(F.avg(log_double(x)))


def product(x) -> Column:
    return F.product(lit(x).cast("double"))


def sum_(x) -> Column:
    return F.sum(lit(x))


def min_(x) -> Column:
    return F.min(lit(x))


def max_(x) -> Column:
    return F.max(lit(x))


def median(x) -> Column:
    return F.percentile(lit(x), 0.5)


def mode(x) -> Column:
    """The most frequent value; of several the smallest."""
    return F.mode(lit(x), True)


def population_variance(x) -> Column:
    return F.var_pop(lit(x))


def variance(x) -> Column:
    return F.var_samp(lit(x))


def population_stddev(x) -> Column:
    return F.stddev_pop(lit(x))


def stddev(x) -> Column:
    return F.stddev_samp(lit(x))


def first_by(value: Column, *keys: Column) -> Column:
    """First(... sort by keys), nulls first; ties must be broken by the last key."""
    return F.min_by(value, F.struct(*[k for key in keys for k in (key.isNotNull(), key)]))


def last_by(value: Column, *keys: Column) -> Column:
    """Last(... sort by keys), nulls first."""
    return F.max_by(value, F.struct(*[k for key in keys for k in (key.isNotNull(), key)]))
