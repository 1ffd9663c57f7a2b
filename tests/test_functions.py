"""Scalar, list, interval, date and quantity functions, each with its null and edge cases."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortry.functions import aggregates, arithmetic, convert, intervals, lists, logic, quantity, strings, temporal


@pytest.fixture(scope="module")
def value(spark):
    """Evaluate columns on one row."""
    one = spark.range(1)
    return lambda *cols: list(one.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def arr(*xs):
    return F.array(*[F.lit(x) for x in xs])


def iv(a, b):
    return F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"))


T, N = True, None


@pytest.mark.parametrize(
    "fn, table",
    [
        (logic.and_, {(T, T): T, (T, False): False, (T, N): N, (False, N): False, (N, N): N}),
        (logic.or_, {(T, N): T, (False, N): N, (False, False): False, (N, N): N}),
        (logic.xor, {(T, False): T, (T, T): False, (T, N): N}),
        (logic.implies, {(T, False): False, (False, N): T, (N, T): T, (N, False): N, (T, N): N}),
        (logic.equal, {(T, T): T, (T, N): N, (N, N): N}),
        (logic.equivalent, {(T, T): T, (T, N): False, (N, N): T}),
    ],
)
def test_logic(value, fn, table):
    b = lambda x: F.lit(x).cast("boolean")
    assert value(*[fn(b(x), b(y)) for x, y in table]) == list(table.values())


def test_conditionals(value):
    n = F.lit(None).cast("boolean")
    assert value(logic.if_(n, 1, 2), logic.case((n, 1), (F.lit(True), 2), other=3), logic.case((1, "a"), (2, "b"), comparand=F.lit(2)), logic.is_true(n), logic.is_null(n)) == [2, 2, "b", False, True]
    assert value(logic.coalesce_list(arr(N, 3, 4))) == [3]


def test_codes(value):
    code = lambda s, v, c: F.struct(F.lit(s).alias("system"), F.lit(v).alias("version"), F.lit(c).alias("code"))
    a, b = code("s", "1", "c"), code("s", "2", "c")
    assert value(logic.code_equal(a, b), logic.code_equivalent(a, b), logic.concept_equivalent(F.array(code("x", "1", "y"), a), F.array(b))) == [False, True, True]


def test_arithmetic_never_fails(value):
    assert value(
        arithmetic.add(arithmetic.MAX_LONG, 1), arithmetic.divide(1, 0), arithmetic.truncated_divide(7, 0), arithmetic.modulo(7, 0), arithmetic.ln(0), arithmetic.log(8, 1), arithmetic.truncate(1e12),
        arithmetic.successor(arithmetic.MAX_INTEGER), arithmetic.predecessor(arithmetic.MIN_LONG, "Long"), arithmetic.dec("1e30"),
    ) == [None] * 10


def test_arithmetic(value):
    got = value(
        arithmetic.divide(1, 3), arithmetic.truncated_divide(-7, 2), arithmetic.modulo(-7, 2), arithmetic.round_(-2.5), arithmetic.ceiling(1.1), arithmetic.floor(-1.1), arithmetic.truncate(-2.7),
        arithmetic.multiply_decimal("1.5", "2.25"), arithmetic.power(2, 10), arithmetic.log(8, 2), arithmetic.exp(0), arithmetic.absolute(-3), arithmetic.successor("1.0", "Decimal"),
    )
    assert [float(x) for x in got] == [0.33333333, -3, -1, -3, 2, -2, -2, 3.375, 1024, 3, 1, 3, 1.00000001]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=st.integers(-(10**9), 10**9), b=st.integers(-(10**6), 10**6))
def test_division_identity(value, a, b):
    q, r = value(arithmetic.truncated_divide(F.lit(a).cast("long"), F.lit(b).cast("long")), arithmetic.modulo(F.lit(a).cast("long"), F.lit(b).cast("long")))
    assert (q, r) == (None, None) if b == 0 else q * b + r == a and abs(r) < abs(b)


def test_strings(value):
    null = F.lit(None).cast("string")
    assert value(strings.combine(arr("a", "b"), "-"), strings.combine(arr("a", N)), strings.combine(F.array().cast("array<string>"))) == ["a-b", None, None]
    assert value(strings.split("a,,b,", ","), strings.split("", ","), strings.split("x", None), strings.split(null, ",")) == [["a", "", "b"], [""], ["x"], None]
    assert value(strings.substring("hello", 1, 9), strings.substring("hello", 5), strings.substring("hello", -1), strings.char_at("abc", 3), strings.length(null)) == ["ello", None, None, None, 0]
    assert value(strings.position_of("z", "abc"), strings.position_of("c", "abc"), strings.last_position_of("b", "abcb"), strings.last_position_of("z", "a")) == [-1, 2, 3, -1]
    assert value(strings.matches("abc", "b"), strings.matches("abc", "a.c"), strings.replace_matches("a1b2", r"([a-z])(\d)", "$2$1")) == [False, True, "1a2b"]
    assert value(strings.normalized("  O'Neil--Smith "), strings.phonetic("Robert"), strings.phonetic(""), strings.to_chars("ab")) == ["o neil smith", "R163", None, ["a", "b"]]
    with pytest.raises(ValueError):
        strings.split("a", "::")


def test_lists(value):
    assert value(lists.intersect(arr(1, 1, 2, N), arr(1, 3, 4, 5, 6)), lists.union(arr(1, N), arr(1, N)), lists.except_(arr(1, 2, 2), arr(1))) == [[1, 1], [1, None, None], [2]]
    assert value(lists.contains(arr(1, N), 2), lists.contains(arr(1), F.lit(None).cast("int")), lists.includes(arr(1, 2), arr(1)), lists.proper_includes(arr(1), arr(1))) == [False, None, True, False]
    assert value(lists.exists(arr(N, N)), lists.exists(F.lit(None).cast("array<int>")), lists.distinct(arr(1, N, 1, N))) == [False, False, [1, None, None]]
    assert value(lists.slice_(arr(1, 2, 3), 1), lists.slice_(arr(1, 2, 3), 2, 1), lists.slice_(arr(1, 2, 3), None, 2), lists.index_of(arr(1, 2), 3), lists.last(arr(1, 2))) == [[2, 3], [], [1, 2], -1, 2]
    assert value(lists.times(arr(1, 2), arr(10, 20), lambda x, y: x + y), lists.to_list(F.lit(None)), lists.sort(arr(2, N, 1), False)) == [[11, 12, 21, 22], [], [2, 1, None]]
    with pytest.raises(Exception, match="more than one"):
        value(lists.singleton_from(arr(1, 2)))


def test_list_aggregates(value):
    none = F.array().cast("array<double>")
    assert value(lists.all_true(F.array().cast("array<boolean>")), lists.any_true(F.array().cast("array<boolean>")), lists.sum_(none), lists.avg(none), lists.count(arr(True, False, N))) == [True, False, None, None, 1]
    assert value(lists.median(arr(1, 2, 3, 4)), lists.mode(arr(2, 1, 2, 1)), lists.variance(arr(1.0)), lists.variance(arr(1.0, 3.0)), lists.population_stddev(arr(1.0, 3.0)), lists.product(arr(2.0, N, 4.0))) == [2.5, 1, None, 2.0, 1.0, 8.0]


def test_intervals(value):
    assert value(intervals.collapse(F.array(iv(5, 7), iv(1, 2), iv(3, 4), iv(10, 12)))) == [[(1, 7), (10, 12)]]
    assert value(intervals.meets(iv(1, 2), iv(3, 4)), intervals.overlaps(iv(1, 5), iv(5, 9)), intervals.overlaps_before(iv(1, 5), iv(3, 9)), intervals.proper_contains(iv(1, 5), 5)) == [True, True, True, False]
    assert value(intervals.union(iv(1, 2), iv(5, 6)), intervals.intersect(iv(1, 5), iv(3, 9)), intervals.except_(iv(1, 5), iv(3, 9)), intervals.except_(iv(1, 9), iv(3, 5))) == [None, (3, 5), (1, 2), None]
    assert value(intervals.interval(1, 5, False, False), intervals.interval(F.lit(None).cast("int"), 5, least=-99)) == [(2, 4), (-99, 5)]
    for bad in (intervals.interval(5, 1), intervals.point_from(iv(1, 2))):
        with pytest.raises(Exception, match="interval"):
            value(bad)


def test_partial_dates(value):
    p = temporal.parse
    assert value(temporal.less(p("2019"), p("2020-03")), temporal.less(p("2020"), p("2020-03")), temporal.equal(p("2020-03"), p("2020-03")), temporal.equal(p("2020"), p("2020-03")), temporal.equal(p("2019"), p("2020-03"))) == [True, None, True, None, False]
    assert value(temporal.same_as(p("2020-03-01"), p("2020-03"), "month"), temporal.same_as(p("2020"), p("2020-03"), "month"), temporal.before(p("2020-01"), p("2020-02-10"), "year")) == [True, None, False]
    assert value(p("2020-02-30"), p("x"), temporal.component(p("2020-03"), "day"), temporal.component(p("2020-03-04"), "day")) == [None, None, None, 4]
    show = temporal.to_string
    assert value(show(temporal.successor(p("2020-12"))), show(temporal.predecessor(p("2020-01-01"))), temporal.successor(p("9999")), show(temporal.add(p("2020-01-31"), 1, "month")), show(temporal.add(p("2020"), 13, "month"))) == ["2021-01", "2019-12-31", None, "2020-02-29", "2021"]
    assert value(show(p("2020-01-01T01:00:00+02:00")), show(temporal.construct(2020, 5)), show(temporal.date_from(p("2020-05-06T07:08"))), show(temporal.construct(2020, 1, 2, 3, 4, 5, 6))) == ["2019-12-31T23:00:00", "2020-05", "2020-05-06", "2020-01-02T03:04:05.006"]
    assert value(temporal.duration_between(p("2000-01-31"), p("2000-02-29"), "month"), temporal.duration_between(p("2000"), p("2001-01"), "month"), temporal.age_at(p("1980-06-15"), p("2020-06-14"))) == [0, None, 39]
    a, b = p("2020-01-01T00:00:00"), p("2020-01-03T00:00:00")
    assert value(temporal.difference_between(a, b, "day"), temporal.difference_between(b, a, "day"), temporal.difference_between(a, a, "day"), temporal.difference_between(p("2020-01-01"), p("2020-01-03"), "day")) == [3, -3, 0, 2]


def test_quantities(value):
    q = quantity.quantity
    assert value(quantity.equal(q(1.0, "kg"), q(1000.0, "g")), quantity.equal(q(1.0, "kg"), q(1.0, "m")), quantity.equivalent(q(1.0, "kg"), q(1.0, "m")), quantity.less(q(1.0, "mg"), q(1.0, "g"))) == [True, None, False, True]
    assert value(quantity.convert(q(37.0, "Cel"), "K")["value"], quantity.convert(q(1.0, "kg"), "m"), quantity.can_convert(q(1.0, "kg"), "g"), quantity.add(q(1.0, "kg"), q(500.0, "g"))["value"]) == [310.15, None, True, 1.5]
    assert value(quantity.to_string(quantity.parse("5.5 'mg'")), quantity.parse("mg"), quantity.stratum(q(2, "1")), quantity.ratio_to_quantity(quantity.ratio(q(2.0), q(5.0)))["value"]) == ["5.50000000 'mg'", None, "2", 2.5]


def test_conversions(value):
    assert value(convert.to_boolean("Y"), convert.to_boolean("x"), convert.to_integer("12"), convert.to_integer("3000000000"), convert.to_long("3000000000"), convert.to_integer("1.5")) == [True, None, 12, None, 3000000000, None]
    null = F.lit(None).cast("string")
    assert value(convert.converts_to("2020-02", "Date"), convert.converts_to("2020-13", "Date"), convert.converts_to(null, "Date"), convert.converts_to("10:30", "Time"), convert.converts_to("1 'g'", "Quantity")) == [True, False, None, True, True]
    assert value(convert.to_ratio("1 'mg':2 'L'")["denominator"]["unit"], convert.to_ratio("1"), convert.to_decimal("1.5").cast("double")) == ["L", None, 1.5]


@pytest.mark.parametrize("text", ["2020", "2020-02", "2020-12", "2020-02-29", "2020-02-30", "2020-01-31T23", "2020-01-31T23:59", "2020-01-31T23:59:59", "2020-01-31T23:59:59.5", "2020-03-01T00:30:00Z", "2020-03-01T00:30+02:00", "2019-12-31T23:30:00-01:30", "0001-01-01", "9999", "9999-12", "9999-12-31T23:59:59.999", "x", "20"])
def test_literals_equal_parsed_texts(spark, text):
    r = spark.range(1).select(temporal.literal(text).alias("a"), temporal.parse(F.lit(text)).alias("b")).first()
    assert r["a"] == r["b"]


def test_geometric_means_count_zeros_and_negatives(spark, value):
    rows = spark.createDataFrame([("a", 0.0), ("a", 4.0), ("b", 2.0), ("b", 8.0), ("b", None), ("c", -1.0), ("c", 4.0), ("d", None)], "k string, v double")
    got = dict(rows.groupBy("k").agg(aggregates.geometric_mean(F.col("v"))).collect())
    assert got["a"] == 0 and got["b"] == pytest.approx(4) and got["c"] != got["c"] and got["d"] is None
    assert value(*[lists.geometric_mean(arr(*xs)) for xs in ((0.0, 4.0), (-1.0, 4.0))], lists.geometric_mean(F.array().cast("array<double>"))) == [0, None, None]
