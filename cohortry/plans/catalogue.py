"""Queries over the test tables, one or more for each family of operators, each with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.functions import aggregates, arithmetic, convert, intervals, lists, logic, quantity, strings, temporal
from cohortry.operators import navigate, search, snapshots
from cohortry.plans.cql import Compiler
from cohortry.plans.measure import Group, Measure, Stratifier
from cohortry.plans.models import relational
from cohortry.plans.tables import registry, table, terminology

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def day(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


# Retrieves and cohort algebra.


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'")
def retrieve_by_code(spark, d):
    return registry(spark, d).search("Event", [("type", ["purchase"])]).select("event_id", "user_id", "value")


def _cql(spark, d, text: str, names: list[str], subject: str = "Patient", parameters: dict | None = None, now: str = "2020-01-01T00:00:00") -> DataFrame:
    return Compiler(relational(spark, d, subject), f"context {subject}\n{text}", parameters, now).plan(names)


_RICH = "define Rich: exists ([Order: status in { 'F' }] O where O.total > 300000)\ndefine Segment: Patient.segment\n"
_COHORT = "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 300000)"


@query(f"SELECT c_custkey, c_mktsegment FROM customer WHERE {_COHORT}")
def exists_code_value(spark, d):
    return _cql(spark, d, _RICH, ["Rich", "Segment"]).where("Rich").select(F.col("id").alias("c_custkey"), F.col("Segment").alias("c_mktsegment"))


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type IN ('purchase', 'signup', 'error') AND value > 100)""")
def ten_code_or(spark, d):
    codes = ["purchase", "signup", "error", *(f"code {i}" for i in range(7))]
    text = f"define Any: exists ([Event: {{ {', '.join(map(repr, codes))} }}] E where E.value > 100)"
    return _cql(spark, d, text, ["Any"]).where("Any").select(F.col("id").alias("c_custkey"))


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
  AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '5-LOW' AND o_totalprice > 200000)
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice < 5000)""")
def boolean_exists_one_pass(spark, d):
    """Several exists over one type are flags of one aggregation, not several joins."""
    text = """define In: exists [Order: '1-URGENT'] and exists ([Order: '5-LOW'] O where O.total > 200000) and not exists ([Order: status in { 'P' }] O where O.total < 5000)"""
    return _cql(spark, d, text, ["In"]).where("In").select(F.col("id").alias("c_custkey"))


def _orders(spark, d, text: str) -> DataFrame:
    """The orders that a definition named Orders returns."""
    rows = Compiler(relational(spark, d), f"context Patient define function Key(o Order): o.id\ndefine Orders: {text}").rows_plan("Orders", ["Key"])
    return rows.select(F.col("Key").alias("o_orderkey"), F.col("id").alias("o_custkey"))


@query("""SELECT o_orderkey, o_custkey FROM orders a WHERE o_orderstatus = 'F' AND EXISTS (
  SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'P' AND CAST(b.o_orderdate AS DATE) < CAST(a.o_orderdate AS DATE) AND b.o_totalprice > 200000)""")
def with_semi_join(spark, d):
    return _orders(spark, d, "[Order: status in { 'F' }] A with ([Order: status in { 'P' }] P where P.total > 200000) B such that B.date before A.date")


@query("""SELECT o_orderkey, o_custkey FROM orders a WHERE o_orderstatus = 'F' AND NOT EXISTS (
  SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'O' AND b.o_totalprice > a.o_totalprice)""")
def without_anti_join(spark, d):
    return _orders(spark, d, "[Order: status in { 'F' }] A without [Order: status in { 'O' }] B such that B.total > A.total")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#2' AND p_type = 'PROMO')""")
def unfiltered_reference_semi(spark, d):
    reg = registry(spark, d)
    return reg.search("LineItem", [("part.brand", ["brand|Brand#2"]), ("part.type", ["PROMO"])]).select("l_orderkey", "l_linenumber", "l_partkey")


def _values(spark, d, expression: str) -> DataFrame:
    """The tuples that a list of the Unfiltered context returns, as columns."""
    return Compiler(relational(spark, d), f"context Unfiltered define Values: {expression}").values("Values").select("v.*")


@query("SELECT o_orderkey AS order_key, CAST(o_totalprice / 2 AS DECIMAL(18,2))::VARCHAR AS half FROM orders WHERE o_orderpriority = '2-HIGH' AND o_totalprice > 400000")
def where_return(spark, d):
    got = _values(spark, d, "[Order: '2-HIGH'] O where O.total > 400000 return all Tuple { order_key: O.id, half: O.total / 2 }")
    return got.select("order_key", F.round("half", 2).cast("decimal(18,2)").cast("string").alias("half"))


@query("SELECT DISTINCT o_orderpriority AS priority, o_orderstatus AS status FROM orders WHERE o_totalprice > 100000")
def distinct_return(spark, d):
    return _values(spark, d, "[Order] O where O.total > 100000 return Tuple { priority: O.priority, status: O.status }")


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day FROM orders GROUP BY o_custkey")
def first_sorted(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(
        aggregates.first_by(F.col("o_orderkey"), F.col("o_orderdate"), F.col("o_orderkey")).alias("first_order"), day(F.min("o_orderdate")).alias("first_day")
    )


@query("SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey")
def last_sorted(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(aggregates.last_by(F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderkey")).alias("last_order"))


# Measures: populations, strata, subject lists.


def _report(spark, d, text: str, *stratifiers: Stratifier, basis: str = "boolean", population: str = "In") -> DataFrame:
    return Measure(relational(spark, d), f"context Patient\n{text}", [Group({"initial-population": population}, stratifiers, basis)]).report()


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_totalprice > 50000 GROUP BY 1")
def population_based_count(spark, d):
    text = "define In: [Order] O where O.total > 50000\ndefine function Status(o Order): o.status"
    return _report(spark, d, text, Stratifier("status", "Status"), basis="Order").where("stratifier = 'status'").select(F.col("stratum").alias("status"), F.col("count").alias("n"))


@query(f"SELECT coalesce(c_mktsegment, 'null') AS stratum, count(*) AS n FROM customer WHERE {_COHORT} GROUP BY 1")
def stratify_single(spark, d):
    return _report(spark, d, _RICH, Stratifier("segment", "Segment"), population="Rich").where("stratifier = 'segment'").select("stratum", F.col("count").alias("n"))


@query(f"SELECT c_mktsegment || '|' || CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS stratum, count(*) AS n FROM customer WHERE {_COHORT} GROUP BY 1")
def stratify_multi(spark, d):
    text = _RICH + "define Balance: if Patient.balance < 0 then 'debt' else 'credit'"
    return _report(spark, d, text, Stratifier("both", components=(("segment", "Segment"), ("balance", "Balance"))), population="Rich").where("stratifier = 'both'").select("stratum", F.col("count").alias("n"))


@query("""SELECT CASE WHEN grouping(c_mktsegment) = 0 THEN 'segment' WHEN grouping(c_nationkey) = 0 THEN 'nation' END AS stratifier, coalesce(c_mktsegment, CAST(c_nationkey AS VARCHAR)) AS stratum, count(*) AS n
  FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())""")
def grouping_sets_strata(spark, d):
    """Several stratifiers and the whole population in one pass."""
    text = "define In: true\ndefine Segment: Patient.segment\ndefine Nation: Patient.nation"
    return _report(spark, d, text, Stratifier("segment", "Segment"), Stratifier("nation", "Nation")).select("stratifier", "stratum", F.col("count").alias("n"))


@query(f"SELECT 'Customer/' || c_custkey AS subject FROM customer WHERE {_COHORT}")
def subject_list(spark, d):
    ids = Measure(relational(spark, d), f"context Patient\n{_RICH}", [Group({"initial-population": "Rich"})]).subjects(0, "initial-population")
    return ids.select(F.concat(F.lit("Customer/"), F.col("id").cast("string")).alias("subject"))


@query("""SELECT event_type AS code, round(avg(value), 6) AS a_avg, count(value) AS a_count, round(exp(avg(ln(value))), 6) AS a_geo, max(value) AS a_max, min(value) AS a_min,
  round(median(value), 6) AS a_median, round(sum(value), 4) AS a_sum, round(var_pop(value), 4) AS a_vp, round(var_samp(value), 4) AS a_vs, round(stddev_pop(value), 6) AS a_sp,
  round(stddev_samp(value), 6) AS a_ss, bool_and(value > 0) AS a_all, bool_or(value > 480) AS a_any, count(*) FILTER (value > 50) AS a_true FROM events GROUP BY 1""")
def aggregate_functions(spark, d):
    v = F.col("value")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("code")).agg(
        r6(aggregates.avg(v)).alias("a_avg"), aggregates.count(v).alias("a_count"), r6(aggregates.geometric_mean(v)).alias("a_geo"), aggregates.max_(v).alias("a_max"),
        aggregates.min_(v).alias("a_min"), r6(aggregates.median(v)).alias("a_median"), F.round(aggregates.sum_(v), 4).alias("a_sum"), F.round(aggregates.population_variance(v), 4).alias("a_vp"),
        F.round(aggregates.variance(v), 4).alias("a_vs"), r6(aggregates.population_stddev(v)).alias("a_sp"), r6(aggregates.stddev(v)).alias("a_ss"), aggregates.all_true(v > 0).alias("a_all"),
        aggregates.any_true(v > 480).alias("a_any"), aggregates.count_true(v > 50).alias("a_true"),
    )


@query("""WITH c AS (SELECT o_custkey, o_orderpriority AS p, count(*) AS k FROM orders GROUP BY 1, 2)
  SELECT o_custkey, arg_min(p, (-k, p)) AS top, round(product(1 + k / 10.0), 6) AS prod FROM c GROUP BY 1""")
def mode_and_product(spark, d):
    df = table(spark, d, "orders")
    top = df.groupBy("o_custkey").agg(aggregates.mode(F.col("o_orderpriority")).alias("top"))
    k = df.groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("k")).groupBy(F.col("o_custkey").alias("ck")).agg(r6(aggregates.product(1 + F.col("k") / 10.0)).alias("prod"))
    return top.join(k, F.col("o_custkey") == F.col("ck")).select("o_custkey", "top", "prod")


@query("""SELECT o_custkey, round(avg(x), 4) AS l_avg, count(x) AS l_count, round(median(x), 4) AS l_median, max(x) AS l_max, min(x) AS l_min, round(sum(x), 2) AS l_sum,
  round(var_samp(x) / 1e6, 7) AS l_var, round(stddev_pop(x), 4) AS l_sd FROM (SELECT o_custkey, floor(o_totalprice) AS x FROM orders WHERE o_orderstatus = 'O') GROUP BY 1 HAVING count(*) > 1""")
def list_aggregates(spark, d):
    xs = table(spark, d, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.collect_list(F.floor("o_totalprice").cast("double")).alias("x")).where(F.size("x") > 1)
    x = F.col("x")
    return xs.select(
        "o_custkey", F.round(lists.avg(x), 4).alias("l_avg"), lists.count(x).cast("long").alias("l_count"), F.round(lists.median(x), 4).alias("l_median"), lists.max_(x).alias("l_max"), lists.min_(x).alias("l_min"),
        F.round(lists.sum_(x), 2).alias("l_sum"), F.round(lists.variance(x) / 1e6, 7).alias("l_var"), F.round(lists.population_stddev(x), 4).alias("l_sd"),
    )


# Lists and sets.

_LISTS = """WITH a AS (SELECT o_custkey AS k, list(DISTINCT o_orderpriority) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
  b AS (SELECT o_custkey AS k, list(DISTINCT o_orderpriority) AS y FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), j AS (SELECT k, x, y FROM a JOIN b USING (k))"""


def _lists(spark, d) -> DataFrame:
    df = table(spark, d, "orders")
    of = lambda s, n: df.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias(n))
    return of("F", "x").join(of("P", "y"), "k")


def _text(c: Column) -> Column:
    return F.array_join(F.array_sort(c), ",")


@query(_LISTS + " SELECT k, array_to_string(list_sort(list_distinct(list_concat(x, y))), ',') AS u FROM j")
def list_union(spark, d):
    return _lists(spark, d).select("k", _text(lists.union(F.col("x"), F.col("y"))).alias("u"))


@query(_LISTS + " SELECT k, array_to_string(list_sort(list_filter(x, lambda e: list_contains(y, e))), ',') AS i FROM j")
def list_intersect(spark, d):
    return _lists(spark, d).select("k", _text(lists.intersect(F.col("x"), F.col("y"))).alias("i"))


@query(_LISTS + " SELECT k, array_to_string(list_sort(list_filter(x, lambda e: NOT list_contains(y, e))), ',') AS e FROM j")
def list_except(spark, d):
    return _lists(spark, d).select("k", _text(lists.except_(F.col("x"), F.col("y"))).alias("e"))


@query(_LISTS + """ SELECT k, list_contains(x, '1-URGENT') AS has, list_has_all(x, y) AS inc, list_has_all(x, y) AND len(x) > len(y) AS proper, list_sort(x)[1] AS fst, list_sort(x)[-1] AS lst,
  coalesce(list_position(list_sort(x), '3-MEDIUM'), 0) - 1 AS idx, array_to_string(list_sort(x)[2:3], ',') AS sl FROM j""")
def list_operators(spark, d):
    x, y = F.array_sort("x"), F.col("y")
    return _lists(spark, d).select(
        "k", lists.contains(x, "1-URGENT").alias("has"), lists.includes(x, y).alias("inc"), lists.proper_includes(x, y).alias("proper"), lists.first(x).alias("fst"), lists.last(x).alias("lst"),
        lists.index_of(x, "3-MEDIUM").cast("int").alias("idx"), F.array_join(lists.slice_(x, 1, 3), ",").alias("sl"),
    )


@query("""WITH u AS (SELECT o_orderstatus AS s FROM orders WHERE o_totalprice > 490000 UNION SELECT l_linestatus FROM lineitem WHERE l_quantity > 49), i AS (SELECT o_orderstatus AS s FROM orders INTERSECT SELECT l_linestatus FROM lineitem),
  e AS (SELECT o_orderstatus AS s FROM orders EXCEPT SELECT l_linestatus FROM lineitem) SELECT 'u' AS op, s FROM u UNION ALL SELECT 'i', s FROM i UNION ALL SELECT 'e', s FROM e""")
def relation_set_operators(spark, d):
    o, l_ = table(spark, d, "orders"), table(spark, d, "lineitem")
    s = F.col("o_orderstatus").alias("s")
    t = F.col("l_linestatus").alias("s")
    u = o.where("o_totalprice > 490000").select(s).union(l_.where("l_quantity > 49").select(t)).distinct()
    # What orders have is in the intersection or in the difference: one aggregation with map-side partial results. The joins
    # behind intersect and subtract would take all rows of a value to one task.
    sides = o.select(s, F.lit(True).alias("o")).union(l_.select(t, F.lit(False).alias("o"))).groupBy("s").agg(F.some("o").alias("o"), F.every("o").alias("only"))
    return u.select(F.lit("u").alias("op"), "s").union(sides.where("o").select(F.when(F.col("only"), "e").otherwise("i").alias("op"), "s"))


# Intervals.


@query("""WITH o AS (SELECT o_custkey AS k, datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS lo FROM orders), p AS (SELECT k, lo, lo + 30 AS hi, max(lo + 30) OVER (PARTITION BY k ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM o),
  g AS (SELECT *, sum(CASE WHEN top IS NULL OR top < lo - 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY lo ROWS UNBOUNDED PRECEDING) AS g FROM p),
  m AS (SELECT k, g, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY 1, 2) SELECT k, count(*) AS n, CAST(sum(hi - lo) AS BIGINT) AS days FROM m GROUP BY 1""")
def collapse_intervals(spark, d):
    lo = F.unix_date(F.to_date("o_orderdate"))
    per = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), intervals.interval(lo, lo + 30).alias("i")).groupBy("k").agg(F.collect_list("i").alias("i"))
    c = intervals.collapse(F.col("i"))
    return per.select("k", c.alias("c")).select("k", F.size("c").cast("long").alias("n"), lists.sum_(F.transform("c", intervals.width), "long").alias("days"))


@query("""SELECT a.o_orderkey, a.o_custkey FROM orders a WHERE a.o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'P'
  AND CAST(a.o_orderdate AS DATE) <= CAST(b.o_orderdate AS DATE) + 10 AND CAST(b.o_orderdate AS DATE) <= CAST(a.o_orderdate AS DATE) + 10)""")
def overlaps_join(spark, d):
    return _orders(spark, d, "[Order: status in { 'F' }] A with [Order: status in { 'P' }] B such that Interval[A.date, A.date + 10 days] overlaps Interval[B.date, B.date + 10 days]")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-06-30'")
def during_filter(spark, d):
    period = intervals.interval(F.lit("1997-03-01").cast("timestamp"), F.lit("1997-06-30").cast("timestamp"))
    return table(spark, d, "orders").where(intervals.contains(period, F.col("o_orderdate"))).select("o_orderkey")


_PAIRS = "WITH p AS (SELECT p_partkey AS k, p_size % 10 AS al, p_size % 10 + p_partkey % 7 AS ah, p_partkey % 11 AS bl, p_partkey % 11 + p_size % 5 AS bh FROM part)"


def _pairs(spark, d) -> DataFrame:
    size, key = F.col("p_size").cast("long"), F.col("p_partkey")
    return table(spark, d, "part").select(key.alias("k"), intervals.interval(size % 10, size % 10 + key % 7).alias("a"), intervals.interval(key % 11, key % 11 + size % 5).alias("b"))


@query(_PAIRS + """ SELECT k, al > bh AS after, ah < bl AS before, al <= bl AND ah >= bh AS includes, al >= bl AND ah <= bh AS during, al = bl AND ah <= bh AS starts, al >= bl AND ah = bh AS ends,
  ah = bl - 1 AS meets_before, bh = al - 1 AS meets_after, ah >= bl AND al <= bh AS overlaps, al < bl AND bl < ah AS overlaps_before, al < bh AND bh < ah AS overlaps_after, ah - al AS width,
  al <= bl AND ah >= bh AND (al <> bl OR ah <> bh) AS proper_includes FROM p""")
def interval_relations(spark, d):
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, d).select(
        "k", intervals.after(a, b).alias("after"), intervals.before(a, b).alias("before"), intervals.includes(a, b).alias("includes"), intervals.included_in(a, b).alias("during"),
        intervals.starts(a, b).alias("starts"), intervals.ends(a, b).alias("ends"), intervals.meets_before(a, b).alias("meets_before"), intervals.meets_after(a, b).alias("meets_after"),
        intervals.overlaps(a, b).alias("overlaps"), intervals.overlaps_before(a, b).alias("overlaps_before"), intervals.overlaps_after(a, b).alias("overlaps_after"),
        intervals.width(a).alias("width"), intervals.proper_includes(a, b).alias("proper_includes"),
    )


@query(_PAIRS + """ SELECT k, CASE WHEN (ah >= bl AND al <= bh) OR ah = bl - 1 OR bh = al - 1 THEN least(al, bl) || '-' || greatest(ah, bh) END AS u, CASE WHEN ah >= bl AND al <= bh THEN greatest(al, bl) || '-' || least(ah, bh) END AS i,
  CASE WHEN NOT (ah >= bl AND al <= bh) THEN al || '-' || ah WHEN al < bl AND ah <= bh THEN al || '-' || (bl - 1) WHEN al >= bl AND ah > bh THEN (bh + 1) || '-' || ah END AS e FROM p""")
def interval_set_operators(spark, d):
    a, b = F.col("a"), F.col("b")
    show = lambda c: F.when(c.isNotNull(), F.concat(c["low"].cast("string"), F.lit("-"), c["high"].cast("string")))
    return _pairs(spark, d).select("k", show(intervals.union(a, b)).alias("u"), show(intervals.intersect(a, b)).alias("i"), show(intervals.except_(a, b)).alias("e"))


# Dates of partial precision.


@query("""SELECT o_orderkey, 2001 - year(o_orderdate) - CASE WHEN strftime(o_orderdate, '%m%d') > '0615' THEN 1 ELSE 0 END AS age, datediff('day', o_orderdate, TIMESTAMP '2001-06-15') AS days FROM orders WHERE o_orderdate <= TIMESTAMP '2001-06-15'""")
def duration_between(spark, d):
    at = temporal.of(F.lit("2001-06-15").cast("timestamp_ntz"), "day")
    own = temporal.of(F.col("o_orderdate"), "day")
    df = table(spark, d, "orders").where("o_orderdate <= timestamp '2001-06-15'")
    return df.select("o_orderkey", temporal.age_at(own, at).alias("age"), temporal.duration_between(own, at, "day").alias("days"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(NULL AS INTEGER) AS d FROM orders")
def date_component(spark, d):
    v = temporal.of(F.col("o_orderdate"), "month")
    df = table(spark, d, "orders").select("o_orderkey", v.alias("v"))
    return df.select("o_orderkey", temporal.component(F.col("v"), "year").alias("y"), temporal.component(F.col("v"), "month").alias("m"), temporal.component(F.col("v"), "day").alias("d"))


@query("""SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN true WHEN o_orderdate >= TIMESTAMP '1999-01-01' THEN false END AS before, CASE WHEN year(o_orderdate) <> 1998 THEN false END AS same,
  year(o_orderdate) = 1998 AS same_year, CAST(NULL AS BOOLEAN) AS same_month FROM orders""")
def precision_compare(spark, d):
    own, other = temporal.of(F.col("o_orderdate"), "day"), temporal.parse("1998")
    return table(spark, d, "orders").select(
        "o_orderkey", temporal.before(own, other).alias("before"), temporal.equal(own, other).alias("same"), temporal.same_as(own, other, "year").alias("same_year"), temporal.same_as(own, other, "month").alias("same_month")
    )


@query("SELECT event_id, strftime(date_trunc('month', ts) + INTERVAL 1 MONTH, '%Y-%m') AS next_month, strftime(CAST(ts AS DATE) - 1, '%Y-%m-%d') AS day_before, strftime(ts + INTERVAL 36 HOUR, '%Y-%m-%d %H:%M') AS later FROM events")
def date_steps(spark, d):
    month, own = temporal.of(F.col("ts"), "month"), temporal.of(F.col("ts"), "day")
    minute = temporal.add(temporal.of(F.col("ts"), "minute"), 36, "hour")
    return table(spark, d, "events").select("event_id", temporal.to_string(temporal.successor(month)).alias("next_month"), temporal.to_string(temporal.predecessor(own)).alias("day_before"), F.date_format(minute["lo"], "yyyy-MM-dd HH:mm").alias("later"))


# Scalars.


@query("""SELECT event_id, round(value / nullif(event_id % 5, 0), 8) AS q, (event_id % 13) % nullif(event_id % 4, 0) AS m, CAST(trunc((event_id - 500) / nullif(event_id % 3, 0)) AS BIGINT) AS t, CAST(ceil(value) AS BIGINT) AS c,
  CAST(floor(value) AS BIGINT) AS f, CASE WHEN value > 100 THEN round(ln(value - 100), 8) END AS l, round(pow(value, 2), 4) AS p, 500 - event_id AS n FROM events""")
def arithmetic_null_safe(spark, d):
    e, v = F.col("event_id"), F.col("value")
    return table(spark, d, "events").select(
        "event_id", F.round(F.try_divide(v, (e % 5).cast("double")), 8).alias("q"), arithmetic.modulo(e % 13, e % 4).alias("m"), arithmetic.truncated_divide(e - 500, e % 3).alias("t"), arithmetic.ceiling(v).alias("c"),
        arithmetic.floor(v).alias("f"), arithmetic.ln(v - 100).alias("l"), F.round(arithmetic.power(v, 2), 4).alias("p"), arithmetic.negate(e - 500).alias("n"),
    )


@query("""SELECT p_partkey, CAST(CAST(round(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(0.07 AS DECIMAL(18,2)), 4) AS DECIMAL(18,4)) AS VARCHAR) AS tax, CAST(CAST(CAST(p_retailprice AS DECIMAL(18,2)) + CAST(0.05 AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS VARCHAR) AS more FROM part""")
def decimal_arithmetic(spark, d):
    p = F.col("p_retailprice").cast("decimal(18,2)")
    return table(spark, d, "part").select(
        "p_partkey", arithmetic.multiply_decimal(p, "0.07").cast("decimal(18,4)").cast("string").alias("tax"), arithmetic.add_decimal(p, "0.05").cast("decimal(18,2)").cast("string").alias("more")
    )


@query("""SELECT p_partkey, upper(p_name) AS u, length(p_name) AS n, strpos(p_name, 'e') - 1 AS pos, CASE WHEN length(p_name) > 4 THEN substr(p_name, 5, 3) END AS sub, starts_with(p_name, 'small') AS st, ends_with(p_name, 'ring') AS en,
  substr(p_name, 3, 1) AS ch, p_name || '/' || p_brand AS cat, regexp_replace(p_name, '([a-z]+) ([a-z]+)', '\\2 \\1') AS swap FROM part""")
def string_functions(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select(
        "p_partkey", strings.upper(n).alias("u"), strings.length(n).cast("long").alias("n"), strings.position_of("e", n).cast("long").alias("pos"), strings.substring(n, 4, 3).alias("sub"), strings.starts_with(n, "small").alias("st"),
        strings.ends_with(n, "ring").alias("en"), strings.char_at(n, 2).alias("ch"), strings.concatenate(n, "/", F.col("p_brand")).alias("cat"), strings.replace_matches(n, "([a-z]+) ([a-z]+)", "$2 $1").alias("swap"),
    )


@query("SELECT p_partkey, p_brand FROM part WHERE regexp_full_match(p_brand, 'Brand#1[0-5]')")
def regex_match(spark, d):
    return table(spark, d, "part").where(strings.matches(F.col("p_brand"), "Brand#1[0-5]")).select("p_partkey", "p_brand")


@query("SELECT p_partkey, array_to_string(list_reverse(string_split(p_name, ' ')), '+') AS parts, len(string_split(p_name, ' ')) AS n FROM part")
def split_combine(spark, d):
    parts = strings.split(F.col("p_name"), " ")
    return table(spark, d, "part").select("p_partkey", strings.combine(F.reverse(parts), "+").alias("parts"), F.size(parts).cast("long").alias("n"))


@query("""SELECT event_id, try_cast(props->>'$.k' AS BIGINT) AS k, try_cast(event_type AS BIGINT) AS none, CAST(event_id AS VARCHAR) AS s, (event_id % 2 = 1) AS b, false AS conv FROM events""")
def type_conversions(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select(
        "event_id", convert.to_long(F.get_json_object("props", "$.k")).alias("k"), convert.to_long(F.col("event_type")).alias("none"), convert.to_string(e).alias("s"),
        convert.to_boolean(e % 2).alias("b"), convert.converts_to(F.col("event_type"), "Decimal").alias("conv"),
    )


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'low' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END AS grade, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS seg,
  coalesce(nullif(c_mktsegment, 'FURNITURE'), 'none') AS co, coalesce(c_acctbal > 9000, false) AS t FROM customer""")
def conditionals(spark, d):
    b, s = F.col("c_acctbal"), F.col("c_mktsegment")
    return table(spark, d, "customer").select(
        "c_custkey", logic.case((b < 0, "low"), (b < 5000, "mid"), other="high").alias("grade"), logic.case(("BUILDING", 1), ("MACHINERY", 2), comparand=s, other=0).alias("seg"),
        logic.coalesce(F.nullif(s, F.lit("FURNITURE")), "none").alias("co"), logic.is_true(b > 9000).alias("t"),
    )


@query("""WITH v AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 3 = 1 END AS a, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 2 = 1 END AS b FROM events)
  SELECT event_id, a AND b AS l_and, a OR b AS l_or, a <> b AS l_xor, NOT a OR b AS l_implies, a IS NOT DISTINCT FROM b AS l_equivalent, a = b AS l_equal FROM v""")
def kleene_logic(spark, d):
    e = F.col("event_id")
    v = table(spark, d, "events").select("event_id", F.when(e % 3 != 0, e % 3 == 1).alias("a"), F.when(e % 5 != 0, e % 2 == 1).alias("b"))
    a, b = F.col("a"), F.col("b")
    return v.select("event_id", logic.and_(a, b).alias("l_and"), logic.or_(a, b).alias("l_or"), logic.xor(a, b).alias("l_xor"), logic.implies(a, b).alias("l_implies"), logic.equivalent(a, b).alias("l_equivalent"), logic.equal(a, b).alias("l_equal"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 1000 > 25500 AS more, round(l_quantity * 1000, 4) AS grams, round(l_quantity + 0.5, 4) AS plus, CAST(NULL AS BOOLEAN) AS incompatible FROM lineitem""")
def quantity_units(spark, d):
    q = quantity.quantity(F.col("l_quantity"), "kg")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", quantity.greater(q, quantity.quantity(25500.0, "g")).alias("more"), F.round(quantity.convert(q, "g")["value"], 4).alias("grams"),
        F.round(quantity.add(q, quantity.quantity(500.0, "g"))["value"], 4).alias("plus"), quantity.equal(q, quantity.quantity(1.0, "cm")).alias("incompatible"),
    )


# Search.


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority = '1-URGENT'")
def token_search(spark, d):
    return registry(spark, d).search("Order", [("status", ["F", "P"]), ("priority", ["priority|1-URGENT"])]).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (7, 11)")
def reference_search(spark, d):
    return registry(spark, d).search("Order", [("subject", ["Customer/7", "11"])]).select("o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND l_returnflag = 'R'""")
def chained_search(spark, d):
    return registry(spark, d).search("LineItem", [("flag", ["R"]), ("order:Order.subject:Customer.segment", ["BUILDING"])]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_returnflag = 'A' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A'))")
def reverse_chained_search(spark, d):
    return registry(spark, d).search("Customer", [("_has:Order:subject:_has:LineItem:order:flag", ["A"])]).select("c_custkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'small r%'")
def string_prefix_search(spark, d):
    return registry(spark, d).search("Part", [("name", ["  SMALL-R"])]).select("p_partkey", "p_name")


def _date_sql(test: str) -> str:
    return f"""WITH o AS (SELECT o_orderkey, date_trunc('month', o_orderdate) AS lo, date_trunc('month', o_orderdate) + INTERVAL 1 MONTH - INTERVAL 1 SECOND AS hi, TIMESTAMP '1998-01-01' AS plo, TIMESTAMP '1998-12-31 23:59:59' AS phi FROM orders)
  SELECT o_orderkey FROM o WHERE {test}"""


def _date_query(op: str, test: str) -> None:
    def run(spark, d):
        return registry(spark, d).search("Order", [("period", [f"{op}1998"])]).select("o_orderkey")

    run.__name__ = f"date_prefix_{op}"
    query(_date_sql(test))(run)


for _op, _test in {
    "eq": "plo <= lo AND hi <= phi", "ne": "NOT (plo <= lo AND hi <= phi)", "gt": "hi > phi", "lt": "lo < plo", "ge": "hi >= phi OR lo >= plo",
    "le": "lo <= plo OR hi <= phi", "sa": "lo >= phi", "eb": "hi <= plo", "ap": "lo <= phi AND hi >= plo",
}.items():
    _date_query(_op, _test)


@query("SELECT event_id FROM events WHERE value BETWEEN 12.25 AND 12.35")
def number_eq_delta(spark, d):
    return registry(spark, d).search("Event", [("value", ["12.3"])]).select("event_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity >= 49")
def quantity_search(spark, d):
    return registry(spark, d).search("LineItem", [("quantity", ["ge49|units|pc"])]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 48")
def composite_search(spark, d):
    return registry(spark, d).search("LineItem", [("flag-quantity", ["N$gt48||pc"])]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH s AS (SELECT s_suppkey, radians(CAST(s_suppkey * 7 % 180 - 90 AS DOUBLE)) AS a, radians(CAST(s_suppkey * 13 % 360 - 180 AS DOUBLE)) AS b, radians(10.0) AS a0, radians(20.0) AS b0 FROM supplier)
  SELECT s_suppkey FROM s WHERE 2 * 6371 * asin(sqrt(pow(sin((a - a0) / 2), 2) + cos(a) * cos(a0) * pow(sin((b - b0) / 2), 2))) <= 5000""")
def near_search(spark, d):
    return registry(spark, d).search("Supplier", [("position", ["10.0|20.0|5000|km"])]).select("s_suppkey")


@query("SELECT event_id FROM events WHERE epoch_us(ts) // 1000000 >= epoch(TIMESTAMP '2024-01-10') AND event_type = 'click'")
def last_updated_search(spark, d):
    return registry(spark, d).search("Event", [("_lastUpdated", ["ge2024-01-10T00:00:00Z"]), ("type", ["click"])]).select("event_id")


@query("SELECT part_search.p_partkey FROM (SELECT * FROM part WHERE p_type IN ('ECONOMY', 'STANDARD', 'PROMO')) part_search")
def value_set_search(spark, d):
    reg = registry(spark, d)
    own = reg.tables["Part"].select("p_partkey", F.lit("part-type").alias("system"), F.col("p_type").alias("code"))
    return terminology(spark, d).in_value_set(own, "types").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_type IN ('ECONOMY', 'STANDARD', 'PROMO')")
def token_in_value_set(spark, d):
    return registry(spark, d).search("Part", [("type:in", ["types"])]).select("p_partkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 10 AND o_orderstatus = 'O'")
def compartment_search(spark, d):
    return registry(spark, d).compartment_search("10", "Order", [("status", ["O"])]).select("o_orderkey", "o_totalprice")


@query("SELECT 'Order' AS type, CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_custkey = 3 UNION ALL SELECT 'Event', CAST(event_id AS VARCHAR) FROM events WHERE user_id = 3")
def system_search(spark, d):
    return registry(spark, d).system_search([("subject", ["Customer/3"])])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 20")
def sorted_page(spark, d):
    found = registry(spark, d).search("Order", [("status", ["F"])])
    return search.sort(found, "-total", {"total": "o_totalprice"}).limit(20).select("o_orderkey", "o_totalprice")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND CAST(c_custkey AS VARCHAR) >= '5' ORDER BY 1 LIMIT 50")
def keyset_page(spark, d):
    rows, _ = search.page(registry(spark, d).search("Customer", [("segment", ["BUILDING"])]), from_id="5")
    return rows.select("id")


@query("SELECT DISTINCT 'Part' AS type, CAST(l_partkey AS VARCHAR) AS id FROM lineitem WHERE l_quantity >= 50 AND l_returnflag = 'R'")
def include(spark, d):
    reg = registry(spark, d)
    return reg.include(reg.search("LineItem", [("quantity", ["ge50"]), ("flag", ["R"])]), "LineItem", "LineItem:part")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 480000)")
def rev_include(spark, d):
    reg = registry(spark, d)
    return reg.rev_include(reg.search("Order", [("total", ["gt480000"])]), "Order", "LineItem:order").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'O' AND o_totalprice <= 100000")
def count_query(spark, d):
    return registry(spark, d).search("Order", [("status", ["O"]), ("total", ["le100000"])]).agg(F.count(F.lit(1)).alias("total"))


# Navigation.


@query("""SELECT CAST(c AS VARCHAR) AS subject_id, type, id FROM (SELECT c_custkey AS c, 'Customer' AS type, CAST(c_custkey AS VARCHAR) AS id FROM customer
  UNION ALL SELECT o_custkey, 'Order', CAST(o_orderkey AS VARCHAR) FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate >= TIMESTAMP '2000-01-01' UNION ALL SELECT user_id, 'Event', CAST(event_id AS VARCHAR) FROM events JOIN customer ON c_custkey = user_id)""")
def everything(spark, d):
    reg = registry(spark, d)
    return navigate.everything(reg, reg.tables["Customer"].select("id"), dates={"Order": F.col("o_orderdate") >= "2000-01-01"})


@query("""WITH c AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_mktsegment = 'MACHINERY'), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)), n AS (SELECT DISTINCT c_nationkey AS k FROM c)
  SELECT 'Customer' AS type, CAST(c_custkey AS VARCHAR) AS id FROM c UNION ALL SELECT 'Order', CAST(o_orderkey AS VARCHAR) FROM o UNION ALL SELECT 'Nation', CAST(k AS VARCHAR) FROM n
  UNION ALL SELECT DISTINCT 'Region', CAST(n_regionkey AS VARCHAR) FROM nation WHERE n_nationkey IN (SELECT k FROM n)""")
def graph_traverse(spark, d):
    reg = registry(spark, d)
    links = [navigate.Link("Customer", "Order", "subject", backward=True), navigate.Link("Customer", "Nation", "nation"), navigate.Link("Nation", "Region", "region")]
    return navigate.graph(reg, reg.search("Customer", [("segment", ["MACHINERY"])]), "Customer", links)


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_mktsegment = 'HOUSEHOLD'")
def graphql_list(spark, d):
    return navigate.graphql_list(registry(spark, d), "Customer", {"id": lambda: F.col("id"), "name": lambda: F.col("c_name"), "segment": lambda: F.col("c_mktsegment")}, [("segment", ["HOUSEHOLD"])])


# Versions: each event is a version of a (type, user) resource; errors are deletions.

_VERSIONS = "WITH v AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'Even' ELSE 'Odd' END AS type, CAST(user_id AS VARCHAR) AS id, event_id AS t, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, value FROM events)"


def _versions(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.when(F.col("user_id") % 2 == 0, F.lit("Even")).otherwise(F.lit("Odd"))
    op = F.when(F.col("event_type") == "error", F.lit("delete")).otherwise(F.lit("put"))
    return e.select(kind.alias("type"), F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("t"), op.alias("op"), "value")


@query(_VERSIONS + ", n AS (SELECT *, row_number() OVER (PARTITION BY type, id ORDER BY t DESC) AS r FROM v WHERE t <= 5000) SELECT type, id, t, op, value FROM n WHERE r = 1 AND op <> 'delete'")
def snapshot_as_of(spark, d):
    return snapshots.snapshot(_versions(spark, d), 5000)


@query(_VERSIONS + " SELECT type, id, t, op, value FROM v WHERE t > 300 AND t <= 900 AND type = 'Odd'")
def history_since(spark, d):
    return snapshots.history(_versions(spark, d), "Odd", None, 900, 300)


@query(_VERSIONS + ", n AS (SELECT *, row_number() OVER (PARTITION BY type, id ORDER BY t DESC) AS r FROM v) SELECT type, count(*) AS total FROM n WHERE r = 1 AND op <> 'delete' GROUP BY 1")
def totals(spark, d):
    return snapshots.totals(_versions(spark, d))


@query(_VERSIONS + " SELECT type, id, t, op, value, row_number() OVER (PARTITION BY type, id ORDER BY t) AS num_changes FROM v")
def version_numbers(spark, d):
    return snapshots.numbered(_versions(spark, d))


@query(_VERSIONS + " SELECT type, id, t, op, value FROM v WHERE t = 77")
def changes_at(spark, d):
    return snapshots.changes(_versions(spark, d), 77)


@query("SELECT user_id, max(event_id) AS last_t FROM events GROUP BY 1")
def last_change_per_subject(spark, d):
    return snapshots.last_change(table(spark, d, "events").select("user_id", F.col("event_id").alias("t")), "user_id")


@query("SELECT 'Customer' AS ref_type, CAST(user_id AS VARCHAR) AS ref_id, event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def referential_integrity(spark, d):
    refs = table(spark, d, "events").select(F.lit("Customer").alias("ref_type"), F.col("user_id").cast("string").alias("ref_id"), "event_id")
    present = table(spark, d, "customer").where("c_acctbal > 0").select(F.lit("Customer").alias("type"), F.col("c_custkey").cast("string").alias("id"))
    return snapshots.dangling_references(refs, present)


# Terminology.

_GEO = """WITH RECURSIVE e AS (SELECT 'R' || n_regionkey AS p, 'N' || n_nationkey AS c, n_name AS d FROM nation UNION ALL SELECT 'W', 'R' || r_regionkey, r_name FROM region),
  x AS (SELECT c AS a, c AS b FROM e UNION SELECT 'W', 'W' UNION SELECT e.p, x.b FROM e JOIN x ON e.c = x.a)"""


@query(_GEO + " SELECT 'geo' AS system, a AS ancestor, b AS descendant FROM x")
def is_a_closure(spark, d):
    return terminology(spark, d)._closure()


@query("WITH RECURSIVE e AS (SELECT 'R' || n_regionkey AS p, 'N' || n_nationkey AS c FROM nation UNION ALL SELECT 'W', 'R' || r_regionkey FROM region), x AS (SELECT 'R1' AS code UNION SELECT c FROM e JOIN x ON p = code) SELECT code FROM x WHERE code <> 'R1'")
def descendents_recursive(spark, d):
    from cohortry.operators.terminology import descendants

    return descendants(spark, terminology(spark, d).edges, "geo", "R1", itself=False)


@query("SELECT 'geo' AS system, 'N' || n_nationkey AS code, n_name AS display FROM nation WHERE n_regionkey = 2 AND n_nationkey % 2 = 0")
def value_set_filters(spark, d):
    return terminology(spark, d).expand("even-asia").select("system", "code", "display")


@query("""SELECT DISTINCT 'brand' AS system, p_brand AS code FROM part WHERE (regexp_full_match(p_brand, 'Brand#1[0-9]') OR p_brand IN ('Brand#2', 'Brand#3')) AND p_brand <> 'Brand#12'""")
def value_set_include_exclude(spark, d):
    return terminology(spark, d).expand("brands").select("system", "code")


@query("""SELECT DISTINCT p_brand AS code, (regexp_full_match(p_brand, 'Brand#1[0-9]') OR p_brand IN ('Brand#2', 'Brand#3')) AND p_brand <> 'Brand#12' AS result FROM part""")
def validate_code(spark, d):
    codes = table(spark, d, "part").select(F.lit("brand").alias("system"), F.col("p_brand").alias("code")).distinct()
    return terminology(spark, d).validate_code(codes, "brands").select("code", "result")


@query("SELECT 'N' || n_nationkey AS code, n_name AS display FROM nation WHERE n_regionkey = 3")
def implicit_value_set(spark, d):
    return terminology(spark, d).expand("http://fhir.org/VCL?v1=(geo)<R3").select("code", "display")


@query("SELECT 'geo' AS system, 'N4' AS code, n_name AS display, 'parity' AS property, 'even' AS value FROM nation WHERE n_nationkey = 4")
def code_lookup(spark, d):
    return terminology(spark, d).lookup("geo", "N4")


@query("SELECT DISTINCT 'part-type' AS system, p_type AS code FROM part WHERE contains(lower(p_type), 'm')")
def text_filter(spark, d):
    from cohortry.operators.terminology import Include, ValueSet

    return terminology(spark, d).expand(ValueSet("all-types", (Include("part-type"),)), text="M").select("system", "code")


# Queries and measures written in the cohort query language.


@query("""SELECT c_custkey AS id FROM customer WHERE c_acctbal > 1000 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 200000 AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31')
  AND NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'error' AND value > 200)""")
def cql_exists(spark, d):
    text = """
    define InInitialPopulation:
      Patient.balance > 1000 and
      exists ([Order: '1-URGENT'] O where O.total > 200000 and O.date during Interval[@1996-01-01, @1998-12-31]) and
      not exists ([Event: 'error'] E where E.value > 200)
    """
    return _cql(spark, d, text, ["InInitialPopulation"]).where("InInitialPopulation").select("id")


@query("""WITH a AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'P'),
  m AS (SELECT * FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.o_custkey = a.o_custkey AND b.o_orderdate < a.o_orderdate)) SELECT c_custkey AS id, count(o_orderkey) AS n, arg_max(o_orderkey, (o_orderdate, -o_orderkey)) AS newest FROM customer LEFT JOIN m ON o_custkey = c_custkey GROUP BY 1""")
def cql_with_sort(spark, d):
    text = """
    define Late: [Order: status in { 'F' }] A with [Order: status in { 'P' }] B such that B.date before A.date
    define n: Count(Late)
    define newest: First((Late) L sort by date desc, id).id
    """
    got = _cql(spark, d, text.replace("sort by date desc, id", "sort by date desc"), ["n", "newest", "Late"])
    # Equal days keep the order of the rows, which files do not fix: the smallest id of the newest day is the answer.
    top = F.array_max(F.transform("Late", lambda r: r["date"]["lo"]))
    ids = F.transform(F.filter("Late", lambda r: r["date"]["lo"] == top), lambda r: r["id"])
    return got.select("id", F.col("n").cast("long").alias("n"), F.when(F.array_contains(ids, F.col("newest")), F.array_min(ids)).alias("newest"))


@query("""WITH p AS (SELECT c_custkey, c_mktsegment AS s, c_nationkey % 5 AS r FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)) SELECT CAST(NULL AS VARCHAR) AS stratifier, CAST(NULL AS VARCHAR) AS stratum, count(*) AS n FROM p
  UNION ALL SELECT 'segment', s, count(*) FROM p GROUP BY s UNION ALL SELECT 'both', s || '|' || r, count(*) FROM p GROUP BY s, r""")
def cql_measure(spark, d):
    text = """
    context Patient
    define InInitialPopulation: exists ([Order] O where O.total > 400000)
    define Segment: Patient.segment
    define Residue: Patient.nation mod 5
    """
    group = Group({"initial-population": "InInitialPopulation"}, (Stratifier("segment", "Segment"), Stratifier("both", components=(("s", "Segment"), ("r", "Residue")))))
    report = Measure(relational(spark, d), text, [group]).report()
    return report.select("stratifier", "stratum", F.col("count").alias("n"))


@query("""SELECT stratum, count(*) AS n FROM (SELECT o_orderstatus AS stratum FROM orders WHERE o_totalprice > 250000 AND o_orderpriority = '5-LOW') GROUP BY 1""")
def cql_population_basis(spark, d):
    text = """
    context Patient
    define Orders: [Order: '5-LOW'] O where O.total > 250000
    define function Status(o Order): o.status
    """
    report = Measure(relational(spark, d), text, [Group({"initial-population": "Orders"}, (Stratifier("status", "Status"),), "Order")]).report()
    return report.where("stratifier is not null").select("stratum", F.col("count").alias("n"))


# Further surfaces: paths, text values, windows, grammars.


@query("SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k, CAST(props->>'$.k' AS INTEGER) = 50 AS fifty FROM events WHERE CAST(props->>'$.k' AS INTEGER) < 60")
def path_expressions(spark, d):
    from pyspark.sql import types as T

    from cohortry.operators.fhirpath import path

    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("props", T.StructType([T.StructField("k", T.IntegerType())]))])
    df = table(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("props"))
    get = lambda text: F.get(path(text, schema, "Event"), F.lit(0))
    return df.select("event_id", get("Event.props.k").alias("k"), get("props.k = 50").alias("fifty")).where("k < 60")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(NULL AS INTEGER) AS d, strftime(o_orderdate + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M') AS shifted FROM orders""")
def text_to_dates(spark, d):
    month = temporal.parse(F.date_format("o_orderdate", "yyyy-MM"))
    at = temporal.parse(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00-02:00")))
    df = table(spark, d, "orders").select("o_orderkey", month.alias("m"), at.alias("a"))
    m, a = F.col("m"), F.col("a")
    return df.select("o_orderkey", temporal.to_string(m).alias("month"), temporal.component(m, "year").alias("y"), temporal.component(m, "day").alias("d"), temporal.to_string(a).alias("shifted"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / 1000, 6) AS kg, l_quantity > 25 AS more, true AS can, false AS cannot FROM lineitem""")
def text_to_quantities(spark, d):
    q = quantity.parse(F.concat(F.col("l_quantity").cast("string"), F.lit(" 'g'")))
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", q.alias("q"))
    q = F.col("q")
    return df.select(
        "l_orderkey", "l_linenumber", "l_partkey", r6(quantity.convert(q, "kg")["value"]).alias("kg"), quantity.greater(q, quantity.quantity(0.025, "kg")).alias("more"),
        quantity.can_convert(q, "mg").alias("can"), quantity.can_convert(q, "cm").alias("cannot"),
    )


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type AS code, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark, d):
    from cohortry.streaming.changes import windowed_counts as counts

    got = counts(table(spark, d, "events"), "1 day")
    return got.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("code"), "n")


@query("SELECT p_partkey, CAST(list_sum([p_size * 1, p_size * 2, (p_size + 1) * 1, (p_size + 1) * 2]) AS BIGINT) AS total, p_size AS only, CAST(p_size AS INTEGER) AS fst FROM part")
def nested_lists(spark, d):
    size, key = F.col("p_size").cast("long"), F.col("p_partkey")
    pairs = lists.times(F.array(size, size + 1), F.array(F.lit(1), F.lit(2)), lambda x, y: x * y)
    flat = lists.flatten(F.array(F.array(size), F.array(key, size)))
    return table(spark, d, "part").select("p_partkey", lists.sum_(pairs, "long").alias("total"), lists.singleton_from(F.array(F.col("p_size"))).alias("only"), lists.first(flat).cast("int").alias("fst"))


@query("SELECT c_custkey, regexp_full_match(u, '[a-z]+/[a-zA-Z]+') AS ok FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'mg/dL' WHEN 1 THEN 'mg//' ELSE 'kg/L' END AS u FROM customer)")
def grammar_code_systems(spark, d):
    from cohortry.operators.terminology import valid_by_grammar

    u = logic.case((0, "mg/dL"), (1, "mg//"), comparand=F.col("c_custkey") % 3, other="kg/L")
    return table(spark, d, "customer").select("c_custkey", valid_by_grammar("http://unitsofmeasure.org", u).alias("ok"))


@query("SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') >= 3")
def cql_subject_list(spark, d):
    text = "context Patient define Cohort: Patient.segment = 'BUILDING' and Count([Order: status in { 'O' }]) >= 3"
    return Measure(relational(spark, d), text, [Group({"initial-population": "Cohort"})]).subjects(0, "initial-population")


@query("""SELECT c_custkey AS id, (SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2))::VARCHAR FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS total,
  (SELECT max(value) FROM events WHERE user_id = c_custkey) AS peak FROM customer""")
def cql_aggregates(spark, d):
    text = """
    define total: Sum([Order: status in { 'F' }] O return all O.total)
    define peak: Max([Event] E return all E.value)
    """
    got = _cql(spark, d, text, ["total", "peak"])
    return got.select("id", F.col("total").cast("decimal(18,2)").cast("string").alias("total"), F.col("peak").cast("double").alias("peak"))
