"""Dates and times of partial precision.

A value is a struct (lo, hi, p): the first and last millisecond that it can mean, and its precision from 1 (year) to
7 (millisecond). Values of different precision that overlap compare as null. Local values are in the zone of `now`,
which is UTC here; offsets are applied when text is read."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortry.functions.logic import let, lit

PRECISION = {"year": 1, "month": 2, "day": 3, "hour": 4, "minute": 5, "second": 6, "millisecond": 7}
_UNIT = {1: "YEAR", 2: "MONTH", 3: "DAY", 4: "HOUR", 5: "MINUTE", 6: "SECOND", 7: "MILLISECOND"}
_TEXT = r"^(\d{4})(?:-(\d{2})(?:-(\d{2})(?:T(?:(\d{2})(?::(\d{2})(?::(\d{2})(?:\.(\d{1,3})\d*)?)?)?)?(Z|[+-]\d{2}:\d{2})?)?)?)?$"


def _level(precision: str | int | None) -> int | None:
    return PRECISION[precision.lower().rstrip("s")] if isinstance(precision, str) else precision


def _step(lo: Column, p: int) -> Column:
    """The last millisecond of the unit of precision p that starts at lo."""
    return F.timestamp_add(_UNIT[p], F.lit(1), lo) - F.expr("interval 1 millisecond")


def _make(lo: Column, p: Column) -> Column:
    def build(lo: Column, p: Column) -> Column:
        hi = F.when(p == 1, _step(lo, 1))
        for k in range(2, 7):
            hi = hi.when(p == k, _step(lo, k))
        return F.when(lo.isNotNull() & p.isNotNull(), F.struct(lo.alias("lo"), hi.otherwise(lo).alias("hi"), p.cast("int").alias("p")))

    return let(build, lo, p)


def parse(text) -> Column:
    """From ISO text of any precision; an offset moves the value to UTC; anything else is null."""

    def build(t: Column, part: Column) -> Column:
        get = lambda i, d: F.coalesce(F.get(part, F.lit(i)), F.lit(d))
        p = F.size(F.array_compact(F.slice(part, 1, 7)))
        lo = F.concat(get(0, "x"), F.lit("-"), get(1, "01"), F.lit("-"), get(2, "01"), F.lit(" "), get(3, "00"), F.lit(":"), get(4, "00"), F.lit(":"), get(5, "00"), F.lit("."), F.rpad(get(6, "0"), 3, "0"))
        zone = F.get(part, F.lit(7))
        sign = F.when(F.startswith(zone, F.lit("-")), F.lit(1)).otherwise(F.lit(-1))
        minutes = sign * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int"))
        shifted = F.timestamp_add("MINUTE", F.coalesce(minutes, F.lit(0)), lo.try_cast("timestamp_ntz"))
        return F.when(F.rlike(t, F.lit(_TEXT)), _make(shifted, p))

    t = F.trim(lit(text))
    return let(build, t, F.array(*[F.nullif(F.regexp_extract(t, _TEXT, i), F.lit("")) for i in range(1, 9)]))


def of(value, precision: str = "millisecond") -> Column:
    """From a date or timestamp column."""
    ts = lit(value).cast("timestamp_ntz")
    p = _level(precision)
    lo = F.date_trunc(_UNIT[p].lower(), ts).cast("timestamp_ntz") if p < 7 else ts
    return F.when(lo.isNotNull(), F.struct(lo.alias("lo"), (_step(lo, p) if p < 7 else lo).alias("hi"), F.lit(p).alias("p")))


def literal(text: str) -> Column:
    """What parse() makes of a text that is known now: a small constant."""
    m = re.fullmatch(_TEXT.replace("$", ""), text.strip(), re.A)
    if not m:
        return parse(text)
    parts = m.groups()
    p = sum(x is not None for x in parts[:7])
    try:
        y, mo, d, h, mi, s = (int(x) if x else least for x, least in zip(parts[:6], (0, 1, 1, 0, 0, 0), strict=True))
        lo = datetime(y, mo, d, h, mi, s, int((parts[6] or "0").ljust(3, "0")) * 1000)
        zone = parts[7]
        if zone and zone != "Z":
            lo -= (1 if zone[0] == "+" else -1) * timedelta(hours=int(zone[1:3]), minutes=int(zone[4:6]))
        if p < 3:
            after = datetime(y + (p == 1 or mo == 12), 1 if p == 1 or mo == 12 else mo + 1, 1) if y < 9999 or p == 2 and mo < 12 else None
        else:
            after = lo + {3: timedelta(days=1), 4: timedelta(hours=1), 5: timedelta(minutes=1), 6: timedelta(seconds=1), 7: timedelta(milliseconds=1)}[p]
        if after is None:
            raise OverflowError
    except (ValueError, OverflowError):  # no date, or at the end of the calendar
        return parse(text)
    show = lambda t: F.lit(t.isoformat(" ", "milliseconds")).cast("timestamp_ntz")
    return F.struct(show(lo).alias("lo"), show(after - timedelta(milliseconds=1)).alias("hi"), F.lit(p).alias("p"))


def construct(*parts) -> Column:
    """Date or DateTime from year, month, ... in this order; the first null part ends the precision; a null year is null."""
    cols = [lit(x).cast("int") for x in parts]
    p, open_ = F.lit(0), F.lit(True)
    for c in cols:
        open_ = open_ & c.isNotNull()
        p = p + open_.cast("int")
    get = lambda i, d: F.coalesce(cols[i], F.lit(d)) if i < len(cols) else F.lit(d)
    text = F.format_string("%04d-%02d-%02d %02d:%02d:%02d.%03d", F.coalesce(cols[0], F.lit(-1)), get(1, 1), get(2, 1), get(3, 0), get(4, 0), get(5, 0), get(6, 0))
    return _make(F.when(cols[0].isNotNull(), text.try_cast("timestamp_ntz")), F.nullif(p, F.lit(0)))


def _at(v: Column, precision) -> tuple[Column, Column]:
    """The value cut to a precision, and whether it is that precise."""
    p = _level(precision)
    lo = F.date_trunc(_UNIT[p].lower(), v["lo"]) if p < 7 else v["lo"]
    return lo.cast("timestamp_ntz"), v["p"] >= p


def less(a: Column, b: Column) -> Column:
    return let(_less, a, b)


def _less(a: Column, b: Column) -> Column:
    return F.when(a["hi"] < b["lo"], F.lit(True)).when((a["lo"] > b["hi"]) | (a["p"] == b["p"]), F.lit(False))


def greater(a: Column, b: Column) -> Column:
    return less(b, a)


def less_or_equal(a: Column, b: Column) -> Column:
    return ~less(b, a)


def greater_or_equal(a: Column, b: Column) -> Column:
    return ~less(a, b)


def equal(a: Column, b: Column) -> Column:
    return let(_equal, a, b)


def _equal(a: Column, b: Column) -> Column:
    return F.when((a["hi"] < b["lo"]) | (b["hi"] < a["lo"]), F.lit(False)).when(a["p"] == b["p"], a["lo"] == b["lo"])


def equivalent(a: Column, b: Column) -> Column:
    return F.coalesce(equal(a, b), a.isNull() & b.isNull())


def _compare(a: Column, b: Column, precision, op) -> Column:
    def build(a: Column, b: Column) -> Column:
        x, ok = _at(a, precision)
        y, ok_ = _at(b, precision)
        return F.when(ok & ok_, op(x, y))

    return let(build, a, b)


def same_as(a: Column, b: Column, precision=None) -> Column:
    return equal(a, b) if precision is None else _compare(a, b, precision, lambda x, y: x == y)


def same_or_before(a: Column, b: Column, precision=None) -> Column:
    return less_or_equal(a, b) if precision is None else _compare(a, b, precision, lambda x, y: x <= y)


def same_or_after(a: Column, b: Column, precision=None) -> Column:
    return greater_or_equal(a, b) if precision is None else _compare(a, b, precision, lambda x, y: x >= y)


def before(a: Column, b: Column, precision=None) -> Column:
    return less(a, b) if precision is None else _compare(a, b, precision, lambda x, y: x < y)


def after(a: Column, b: Column, precision=None) -> Column:
    return before(b, a, precision)


def component(v: Column, precision: str) -> Column:
    """Null if the value is not that precise."""
    p = _level(precision)
    return let(lambda v: _component(v, p), v)


def _component(v: Column, p: int) -> Column:
    lo = v["lo"]
    got = {1: F.year(lo), 2: F.month(lo), 3: F.day(lo), 4: F.hour(lo), 5: F.minute(lo), 6: F.second(lo), 7: F.pmod(F.unix_millis(lo.cast("timestamp")), F.lit(1000)).cast("int")}[p]
    return F.when(v["p"] >= p, got)


def date_from(v: Column) -> Column:
    """The date part, at most of day precision."""
    return let(lambda v: _make(F.date_trunc("day", v["lo"]).cast("timestamp_ntz"), F.least(v["p"], F.lit(3))), v)


def duration_between(a: Column, b: Column, precision: str) -> Column:
    """Whole periods from a to b; null if either is less precise."""
    p = _level(precision)
    return let(lambda a, b: F.when((a["p"] >= p) & (b["p"] >= p), F.timestamp_diff(_UNIT[p], a["lo"], b["lo"])), a, b)


def difference_between(a: Column, b: Column, precision: str) -> Column:
    """Whole periods; between values of full date and time, a result that is not 0 counts one boundary more."""
    more = lambda d, a, b: F.when((a["p"] > 3) & (b["p"] > 3), d + F.signum(d).cast("long")).otherwise(d)
    return let(more, duration_between(a, b, precision), a, b)


def add(v: Column, amount, unit: str) -> Column:
    """A value plus a period; null if the unit is finer than the value, but months of a year value count in whole years."""
    p = _level(unit)

    def build(v: Column, n: Column) -> Column:
        if p > 2:
            return F.when(v["p"] >= p, _make(F.timestamp_add(_UNIT[p], n.cast("int"), v["lo"]), v["p"]))
        months = n * 12 if p == 1 else n
        whole = F.when(v["p"] == 1, (F.floor(F.abs(months) / 12) * F.signum(months) * 12).cast("int")).otherwise(months.cast("int"))
        return _make(F.timestamp_add("MONTH", whole, v["lo"]), v["p"])

    return let(build, v, amount)


def successor(v: Column) -> Column:
    """One unit of the value's precision later; null past the last."""
    last = F.lit("9999-12-31 23:59:59.999").cast("timestamp_ntz")
    return let(lambda v: F.when(v["hi"] < last, _make(v["hi"] + F.expr("interval 1 millisecond"), v["p"])), v)


def predecessor(v: Column) -> Column:
    first = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")

    def build(v: Column) -> Column:
        out = F.when(v["p"] == 1, F.timestamp_add("YEAR", F.lit(-1), v["lo"]))
        for k in range(2, 8):
            out = out.when(v["p"] == k, F.timestamp_add(_UNIT[k], F.lit(-1), v["lo"]))
        return F.when(v["lo"] > first, _make(out, v["p"]))

    return let(build, v)


def age_at(birth: Column, at: Column, precision: str = "year") -> Column:
    return duration_between(birth, at, precision)


def time(hour, minute=None, second=None, milli=None) -> Column:
    """A time of day: struct (ms, p) with precision from 4 (hour) to 7 (millisecond)."""
    cols = [lit(x).cast("int") for x in (hour, minute, second, milli)]
    p, open_ = F.lit(3), F.lit(True)
    for c in cols:
        open_ = open_ & c.isNotNull()
        p = p + open_.cast("int")
    ms = sum((F.coalesce(c, F.lit(0)) * w for c, w in zip(cols, (3_600_000, 60_000, 1000, 1), strict=True)), F.lit(0))
    fine = (cols[0] >= 0) & (cols[0] < 24) & F.coalesce((cols[1] < 60), F.lit(True)) & F.coalesce((cols[2] < 60), F.lit(True))
    return F.when(fine, F.struct(ms.alias("ms"), p.alias("p")))


def _time_at(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Both times of day cut to their common precision, and whether the precisions are one."""
    p = F.least(a["p"], b["p"])
    unit = F.when(p == 4, F.lit(3_600_000)).when(p == 5, F.lit(60_000)).when(p == 6, F.lit(1000)).otherwise(F.lit(1))
    return a["ms"] - a["ms"] % unit, b["ms"] - b["ms"] % unit, a["p"] == b["p"]


def time_less(a: Column, b: Column) -> Column:
    """Null where the times agree as far as both are known, and one is known further."""
    x, y, same = _time_at(a, b)
    return F.when(x != y, x < y).when(same, F.lit(False))


def time_equal(a: Column, b: Column) -> Column:
    x, y, same = _time_at(a, b)
    return F.when(x != y, F.lit(False)).when(same, F.lit(True))


def to_string(v: Column) -> Column:
    patterns = {1: "yyyy", 2: "yyyy-MM", 3: "yyyy-MM-dd", 4: "yyyy-MM-dd'T'HH", 5: "yyyy-MM-dd'T'HH:mm", 6: "yyyy-MM-dd'T'HH:mm:ss", 7: "yyyy-MM-dd'T'HH:mm:ss.SSS"}

    def build(v: Column) -> Column:
        out = F.when(v["p"] == 1, F.date_format(v["lo"], patterns[1]))
        for k in range(2, 8):
            out = out.when(v["p"] == k, F.date_format(v["lo"], patterns[k]))
        return out

    return let(build, v)
