"""Further queries of the catalogue: the store, resources, search pages, and the query language's contexts and functions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions import temporal
from cohortry.operators import navigate, search
from cohortry.operators.lineage import scratch
from cohortry.plans.catalogue import query
from cohortry.plans.cql import Compiler
from cohortry.plans.measure import Group, Measure, Stratifier, subject_list_resources
from cohortry.plans.models import clinical, relational
from cohortry.plans.tables import registry, table
from cohortry.sources import index, resources
from cohortry.sources.store import Command, Conflict, Store
from cohortry.streaming import changes


def _plan(spark, d, text: str, names: list[str], subject: str = "Patient", parameters: dict | None = None) -> DataFrame:
    return Compiler(relational(spark, d, subject), text, parameters).plan(names)


# The query language: contexts, parameters, functions.


@query("""SELECT o_orderkey AS id, o_totalprice > 100000 AND EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND p_type = 'PROMO' AND l_returnflag = 'R') AS promo,
  (SELECT count(*) FROM part WHERE p_type = 'PROMO') AS parts, (SELECT max(p_size) FROM part WHERE p_brand = 'Brand#3') AS largest FROM orders""")
def cql_unfiltered(spark, d):
    """Lists of the Unfiltered context: members, counts and aggregates."""
    text = """
    context Unfiltered
    define Promo: [Part: type in { 'PROMO' }] P return P.id
    define Sizes: [Part: 'Brand#3'] P return all P.size
    context Order
    define promo: Order.total > 100000 and exists ([LineItem: 'R'] L where L.part in Promo)
    define parts: Count(Promo)
    define largest: Max(Sizes)
    """
    got = _plan(spark, d, text, ["promo", "parts", "largest"], "Order")
    return got.select("id", F.coalesce("promo", F.lit(False)).alias("promo"), "parts", F.col("largest").cast("int").alias("largest"))


@query("""WITH f AS (SELECT o_custkey AS k, min(o_orderkey) AS o FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
  SELECT c_custkey AS id, (SELECT count(*) FROM f JOIN lineitem ON l_orderkey = f.o WHERE f.k = c_custkey AND l_returnflag = 'R') AS n FROM customer""")
def cql_related_context(spark, d):
    """Line items of the order that another definition gives."""
    text = """
    context Patient
    define Earliest: First([Order: status in { 'F' }] O sort by id)
    define n: Count([Earliest -> LineItem: 'R'])
    """
    return _plan(spark, d, text, ["n"]).select("id", F.col("n").cast("long").alias("n"))


@query("SELECT o_orderkey AS id, c_mktsegment AS segment, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS items FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def cql_parent_context(spark, d):
    """Orders as subjects: their line items, and the customer they belong to."""
    got = _plan(spark, d, "context Order define segment: First([Patient]).segment define items: Count([LineItem])", ["segment", "items"], "Order")
    return got.select("id", "segment", F.col("items").cast("long").alias("items"))


@query("SELECT c_custkey AS id, c_mktsegment IN ('BUILDING', 'FURNITURE') AS chosen, c_acctbal > 2500.5 AS rich FROM customer")
def cql_parameters(spark, d):
    text = "parameter Segments List<String> parameter Limits parameter Unused Integer default 3 context Patient define chosen: Patient.segment in Segments define rich: Patient.balance > Limits.low and Unused = 3"
    return _plan(spark, d, text, ["chosen", "rich"], parameters={"Segments": ["BUILDING", "FURNITURE"], "Limits": {"low": 2500.5, "high": 9000}})


@query("SELECT o_orderkey AS id, (SELECT CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) * 1000 AS DECIMAL(18,2))::VARCHAR FROM lineitem WHERE l_orderkey = o_orderkey) AS grams FROM orders")
def cql_quantity_sum(spark, d):
    got = _plan(spark, d, "context Order define grams: (convert Sum([LineItem] L return all L.amount) to 'g').value", ["grams"], "Order")
    return got.select("id", F.col("grams").cast("decimal(18,2)").cast("string").alias("grams"))


@query("""SELECT o_orderkey AS id, datediff('year', DATE '2020-06-15', DATE '2020-06-15') + 2020 - year(o_orderdate) - CASE WHEN strftime(o_orderdate, '%m%d') > '0615' THEN 1 ELSE 0 END AS years,
  o_orderdate < TIMESTAMP '1998-01-01' AS old, strftime(o_orderdate + INTERVAL 14 DAY, '%Y-%m-%d') AS due, year(o_orderdate) = 1999 AS in99, true AS noon FROM orders""")
def cql_dates(spark, d):
    text = """
    context Order
    define years: CalculateAgeInYears(Order.date)
    define old: Order.date before Date(1998, 1, 1)
    define due: ToString(Order.date + 2 weeks)
    define in99: Order.date during Interval[@1999-01-01, @1999-12-31]
    define noon: TimeOfDay() = @T12:30:00 and Time(12, 15) < TimeOfDay() and Today() = @2020-06-15 and ToTime('T09:00') < Time(9, 30) and Now() after @2020-06-14
    """
    model = relational(spark, d, "Order")
    return Compiler(model, text, None, "2020-06-15T12:30:00").plan(["years", "old", "due", "in99", "noon"])


@query("""SELECT p_partkey AS k, substr(p_type, 1, 1) AS ch, p_size + 1 AS nxt, CAST(p_size AS VARCHAR) = '7' AS seven, p_size * 1000 AS g, p_size > 25 AS big, 3 AS n, true AS fixed FROM part""")
def cql_functions(spark, d):
    """Lists, conversions, quantities, tuples and instances, on every part."""
    text = """
    context Unfiltered
    define Rows: [Part] P return all Tuple {
      k: P.id,
      ch: ToChars(Substring(P.type, 0))[0],
      nxt: Slice({ P.size, P.size + 1, P.size + 2 }, 1, 2)[0],
      seven: ConvertsToLong(ToString(P.size)) and ToLong(ToString(P.size)) = 7,
      g: (convert Quantity { value: P.size, unit: 'kg' } to 'g').value,
      big: Interval[26, 100] contains P.size,
      n: Length(Flatten({ { P.size, P.size }, ToList(P.size) })),
      fixed: CanConvertQuantity(1 'kg', 'mg') and Children(Code { system: 's', code: 'c' })[2] = 's' and Last(Take(Skip({ 1, 2, 3 }, 1), 1)) = 2 and Interval[1, 5].high = 5
        and ToRatio('1:2').denominator = 2 '1' and not ConvertsToDate('x') and ConvertsToQuantity('3 \\'g\\'') and (P.size as String) is null and P.size is Integer and Sum({ 1 'g', 1 'kg' }) = 1001 'g'
    }
    """
    return Compiler(relational(spark, d), text).values("Rows").select("v.*").withColumns({c: F.col(c).cast("int") for c in ("nxt", "g", "n")})


@query("""SELECT p_partkey AS k FROM part WHERE ((regexp_full_match(p_brand, 'Brand#1[0-9]') OR p_brand IN ('Brand#2', 'Brand#3')) AND p_brand <> 'Brand#12') AND p_type IN (SELECT p_type FROM part) AND NOT p_brand IN ('N1')""")
def cql_terminology(spark, d):
    """Value sets and code systems in conditions."""
    text = """
    codesystem types: 'part-type'
    codesystem geo: 'geo'
    valueset brands: 'brands'
    context Unfiltered
    define Rows: [Part] P where P.brand in brands and P.type in types and not (P.brand in geo) return all P.id
    """
    return Compiler(relational(spark, d), text).values("Rows").select(F.col("v").alias("k"))


# Clinical resources as JSON and XML.


def _patients(spark, d) -> DataFrame:
    """Customers as Patient resources (type, id, content)."""
    c = table(spark, d, "customer")
    key = F.col("c_custkey").cast("string")
    body = F.struct(
        F.lit("Patient").alias("resourceType"), key.alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.lit("female")).otherwise(F.lit("male")).alias("gender"),
        F.concat((1930 + F.col("c_custkey") % 80).cast("string"), F.lit("-05-01")).alias("birthDate"), F.array(F.struct(F.col("c_mktsegment").alias("city"))).alias("address"), F.struct(F.lit("3").alias("versionId")).alias("meta"),
    )
    return c.select(F.lit("Patient").alias("type"), key.alias("id"), F.to_json(body).alias("content"))


def _observations(spark, d) -> DataFrame:
    """Events as Observation resources of their customers."""
    e = table(spark, d, "events")
    key = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    concept = F.struct(F.array(F.struct(F.lit("urn:event").alias("system"), F.col("event_type").alias("code"))).alias("coding"))
    body = F.struct(
        F.lit("Observation").alias("resourceType"), key.alias("id"), F.lit("final").alias("status"), concept.alias("code"), F.struct(F.concat(F.lit("Patient/"), F.col("user_id").cast("string")).alias("reference")).alias("subject"),
        F.date_format("ts", "yyyy-MM-dd").alias("effectiveDateTime"), F.struct(F.col("value").alias("value"), F.lit("mg").alias("unit"), F.lit("mg").alias("code")).alias("valueQuantity"),
    )
    return e.select(F.lit("Observation").alias("type"), key.alias("id"), F.to_json(body).alias("content"))


@query("SELECT 'e' || event_id AS id, event_type AS code, round(value, 4) AS value, strftime(ts, '%Y-%m-%d') AS day FROM events")
def resources_json(spark, d):
    """Written as newline-delimited JSON, read back, parsed."""
    path = scratch(spark)
    resources.write_ndjson(_observations(spark, d), path)
    got = resources.typed(resources.read_ndjson(spark, path), "Observation")
    return got.select("id", F.col("code.coding")[0]["code"].alias("code"), F.round(F.col("valueQuantity.value").cast("double"), 4).alias("value"), F.col("effectiveDateTime").alias("day"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS gender, c_mktsegment AS city FROM customer")
def resources_xml(spark, d):
    """Written as XML, read back."""
    path = scratch(spark)
    resources.write_xml(_patients(spark, d), "Patient", path)
    got = spark.read.format("xml").option("rowTag", "Patient").schema(resources.SCHEMAS["Patient"]).load(path)
    return got.select("id", "gender", F.col("address")[0]["city"].alias("city"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS city, CAST(NULL AS VARCHAR) AS gender, 'SUBSETTED' AS tag, '3' AS version FROM customer")
def resource_summary(spark, d):
    """Some elements of each resource, with the tag of an incomplete one."""
    got = resources.summary(_patients(spark, d), ["address"])
    get = lambda path: F.get_json_object("content", path)
    return got.select("id", get("$.address[0].city").alias("city"), get("$.gender").alias("gender"), get("$.meta.tag[0].code").alias("tag"), get("$.meta.versionId").alias("version"))


@query("""WITH p AS (SELECT c_custkey, c_custkey % 2 AS g, (SELECT max(value) FROM events WHERE user_id = c_custkey AND event_type = 'error') AS peak FROM customer WHERE EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'error' AND value > 20))
  SELECT stratifier, stratum, count(*) AS n FROM (SELECT 'gender' AS stratifier, CASE WHEN g = 0 THEN 'female' ELSE 'male' END AS stratum FROM p UNION ALL SELECT 'peak', printf('%.8f mg', peak) FROM p UNION ALL SELECT NULL, NULL FROM p) GROUP BY 1, 2""")
def clinical_measure(spark, d):
    """A measure over JSON resources, with a stratum of quantities."""
    text = """
    codesystem e: 'urn:event'
    code err: 'error' from e
    context Patient
    define In: exists ([Observation: err] O where O.value > 20 'mg')
    define Gender: Patient.gender
    define Peak: First([Observation: err] O sort by value desc).value
    """
    model = clinical(_patients(spark, d).union(_observations(spark, d)))
    report = Measure(model, text, [Group({"initial-population": "In"}, (Stratifier("gender", "Gender"), Stratifier("peak", "Peak")))]).report()
    return report.select("stratifier", "stratum", F.col("count").alias("n"))


@query("SELECT 'Patient/' || c_custkey AS ref FROM customer WHERE c_acctbal > 5000")
def measure_list(spark, d):
    """The List resources of a population, of bounded size, and what they refer to."""
    measure = Measure(relational(spark, d), "context Patient define In: Patient.balance > 5000", [Group({"initial-population": "In"})])
    lists = resources.typed(subject_list_resources(measure, 0, "initial-population", "l", size=100), "List")
    return lists.select(F.explode("entry").alias("e")).select(F.col("e.item.reference").alias("ref"))


# The store.

_AT = [datetime(2024, 1, i) for i in range(1, 9)]


def _store(spark, d) -> Store:
    """t 1: all customers; t 2: those in debt change, and those of one segment are deleted; t 3: all again as at first."""
    store, first = Store(spark, scratch(spark)), _patients(spark, d)
    put = first.select(F.lit("put").alias("op"), "type", "id", "content")
    store.apply(put, _AT[0])
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), "c_acctbal", "c_mktsegment")
    gone = F.coalesce(F.col("c_mktsegment") == "BUILDING", F.lit(False))
    second = put.join(c, "id").where(gone | (F.col("c_acctbal") < 0))
    store.apply(second.select(F.when(gone, "delete").otherwise("put").alias("op"), "type", "id", F.when(~gone, F.regexp_replace("content", '"gender":"[a-z]+"', '"gender":"other"')).alias("content")), _AT[1])
    store.apply(put, _AT[2])
    return store


_STORE = """WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS id, coalesce(c_mktsegment = 'BUILDING', false) AS gone, coalesce(c_acctbal < 0, false) AS debt FROM customer),
  v AS (SELECT id, 1 AS t, 'put' AS op, 1 AS n FROM c UNION ALL SELECT id, 2, CASE WHEN gone THEN 'delete' ELSE 'put' END, 2 FROM c WHERE gone OR debt UNION ALL SELECT id, 3, 'put', 3 FROM c WHERE gone OR debt)"""


@query(_STORE + " SELECT 'Patient' AS type, id, CAST(t AS BIGINT) AS t, op, CAST(n AS BIGINT) AS num_changes FROM v")
def store_history(spark, d):
    """Puts, deletes, and puts of what is there already, which make no version."""
    return _store(spark, d).history().select("type", "id", "t", "op", "num_changes")


@query(_STORE + " SELECT CAST(t AS BIGINT) AS t, CAST(count(*) AS BIGINT) AS total FROM (SELECT 1 AS t, id FROM c UNION ALL SELECT 2, id FROM c WHERE NOT gone UNION ALL SELECT 3, id FROM c) GROUP BY 1")
def store_time_travel(spark, d):
    store = _store(spark, d)
    parts = [store.sync(t).agg(F.lit(t).cast("long").alias("t"), F.count(F.lit(1)).alias("total")) for t in (1, 2, 3)]
    return parts[0].union(parts[1]).union(parts[2])


@query(_STORE + " SELECT id, CAST(max(t) AS BIGINT) AS t, CAST(max(n) AS BIGINT) AS num_changes FROM v GROUP BY 1")
def store_subscription(spark, d):
    """Derived state kept by a subscription, transaction by transaction."""
    store, out = _store(spark, d), scratch(spark)
    changes.subscribe(store, changes.upsert_into(out, ["type", "id"], "t"), scratch(spark), "Patient").awaitTermination()
    return changes.current(spark, out, ["type", "id"], "t").select("id", "t", "num_changes")


@query("""SELECT * FROM (VALUES (1, true), (2, false), (3, false), (4, false), (5, true), (6, true), (7, true), (8, true)) AS x(t, success)""")
def store_transactions(spark, d):
    """Outcomes of commands whose preconditions hold or do not: creates, keeps, conditional commands, versions, duplicates, bundles."""
    store = Store(spark, scratch(spark))
    store.apply(_patients(spark, d).select(F.lit("create").alias("op"), "type", "id", "content"), _AT[0])
    old = store.read("Patient", "1").first()
    female = F.get_json_object("content", "$.gender") == "female"
    for commands in (
        [Command("create", "Patient", "1", old["content"])],
        [Command("keep", "Patient", "1", hash="0")],
        [Command("delete", "Patient", where=female)],
        [Command("keep", "Patient", "1", hash=old["hash"], if_match=1), Command("hold", "Patient", "x"), Command("create", "Patient", "new", old["content"], if_none_exist=F.col("id") == "1")],
        [Command("delete", "Patient", where=female, allow_multiple=True)],
        [Command("delete-history", "Patient", "2"), Command("patient-purge", "Patient", "3")],
    ):
        try:
            store.transact(commands, _AT[len(commands)])
        except Conflict:
            pass
    store.apply_bundle({"entry": [{"resource": {"resourceType": "Patient", "id": "b"}, "request": {"method": "PUT"}}, {"request": {"method": "DELETE", "url": "Patient/5"}}]}, _AT[7])
    return store.transactions().select(F.col("t").cast("int").alias("t"), "success")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN n IS NULL THEN 'create' WHEN n = 1 THEN 'hold' ELSE 'conflict' END AS outcome FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 450000 GROUP BY 1) ON c_custkey = o_custkey""")
def conditional_create(spark, d):
    """What a conditional create of each customer comes to: one that a search finds is held, several are a conflict."""
    reg = registry(spark, d)
    found = reg.refs(reg.search("Order", [("total", ["gt450000"])]), "Order", "subject").groupBy("ref_id").count()
    n = reg.tables["Customer"].join(found, F.col("id") == F.col("ref_id"), "left")
    return n.select("id", F.when(F.col("count").isNull(), "create").when(F.col("count") == 1, "hold").otherwise("conflict").alias("outcome"))


# Search: modifiers, includes, pages, indexes.


@query("SELECT n_name AS name FROM nation WHERE n_regionkey = 2")
def list_search(spark, d):
    return registry(spark, d).search("Nation", [("_list", ["2"])]).select(F.col("n_name").alias("name"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (7, 12)")
def reference_identifier(spark, d):
    return registry(spark, d).search("Order", [("subject:identifier", ["urn:customers|C-7", "C-12"])]).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_type IN ('ECONOMY', 'STANDARD', 'PROMO', 'SMALL')")
def token_in_value_sets(spark, d):
    """One of several value sets."""
    return registry(spark, d).search("Part", [("type:in", ["types", "promo"])]).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_brand || ',' || p_type IN ('Brand#2,PROMO', 'Brand#3,ECONOMY')")
def escaped_values(spark, d):
    clauses, _ = search.parse_query("label=Brand%232%5C,PROMO,Brand%233%5C,ECONOMY")
    return registry(spark, d).search("Part", clauses).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_type = 'PROMO'")
def uri_below_search(spark, d):
    return registry(spark, d).search("Part", [("url:below", ["http://parts/PROMO"])]).select("p_partkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (3, 77, 1000)")
def id_search(spark, d):
    return registry(spark, d).search("Order", [("_id", ["3", "77", "1000", "none"])]).select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE strftime(l_shipdate, '%Y-%m') = '1999-03' OR strftime(l_shipdate + INTERVAL 30 DAY, '%Y-%m') = '1999-03'")
def date_any_value(spark, d):
    """A parameter with two values: one of them has to match."""
    return registry(spark, d).search("LineItem", [("times", ["1999-03"])]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH o AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity >= 50), c AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey IN (SELECT k FROM o)), n AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_custkey IN (SELECT k FROM c))
  SELECT 'Order' AS type, CAST(k AS VARCHAR) AS id FROM o UNION ALL SELECT 'Customer', CAST(k AS VARCHAR) FROM c UNION ALL SELECT 'Nation', CAST(k AS VARCHAR) FROM n""")
def include_iterate(spark, d):
    reg = registry(spark, d)
    found = reg.search("LineItem", [("quantity", ["ge50"])])
    return reg.includes(found, "LineItem", [("_include", "LineItem:order")], [("_include", "Order:subject"), ("_include", "Customer:nation")])


@query("""SELECT 'Nation' AS type, CAST(n_nationkey AS VARCHAR) AS id FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'Customer', CAST(c_custkey AS VARCHAR) FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1
  UNION ALL SELECT 'Order', CAST(o_orderkey AS VARCHAR) FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1""")
def rev_include_iterate(spark, d):
    reg = registry(spark, d)
    found = reg.search("Region", [("_id", ["1"])])
    return reg.includes(found, "Region", [("_revinclude", "Nation:region")], [("_revinclude", "Customer:nation"), ("_revinclude", "Order:subject")])


@query("SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY 1 LIMIT 20 OFFSET 40")
def page_links(spark, d):
    """The third page of a search, reached by the links of the pages before it, and back and forth again."""
    reg = registry(spark, d)
    at = lambda q: search.search_page(reg, "Customer", q)
    second = at("segment=BUILDING&_count=20").next()
    again = at(at(at(second).next()).previous()).next() if second and at(second).next() else None
    return at(again).matches.select("id") if again else reg.tables["Customer"].limit(0).select("id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice, CAST(o_orderkey AS VARCHAR) LIMIT 15 OFFSET 15")
def offset_paging(spark, d):
    reg = registry(spark, d)
    page = lambda q: search.search_page(reg, "Order", q, {"total": "o_totalprice"})
    return page(page("status=P&_sort=total&_count=15").next()).matches.select("o_orderkey", "o_totalprice")


@query("SELECT 'Order' AS type, CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_custkey = 13 UNION ALL SELECT 'Event', CAST(event_id AS VARCHAR) FROM events WHERE user_id = 13 UNION ALL SELECT 'Customer', '13' FROM customer WHERE c_custkey = 13 ORDER BY 1, 2 LIMIT 5 OFFSET 1")
def everything_pages(spark, d):
    rows, _ = navigate.everything_page(registry(spark, d), "13", 5, 1)
    return rows


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS label FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal >= 5000")
def graphql_text(spark, d):
    fields = {"Customer": {"id": lambda: F.col("id"), "name": lambda: F.col("c_name")}}
    return navigate.graphql(registry(spark, d), '{ CustomerList(segment: "MACHINERY", balance: "ge5000") { id label: name } }', fields)


@query("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#2', 'Brand#14')")
def index_lookup(spark, d):
    """A search by a rebuilt index."""
    reg, path = registry(spark, d), scratch(spark)
    index.reindex(reg, "Part", "brand", path)
    return index.lookup(reg, "Part", "brand", ["brand|Brand#2", "Brand#14"], path).select("p_partkey")


@query("SELECT event_id, epoch_ms(ts) % 86400000 < 43200000 AS morning, CASE WHEN hour(ts) <> 12 THEN hour(ts) < 12 END AS before FROM events")
def times_of_day(spark, d):
    ms = F.pmod(F.unix_millis(F.col("ts").cast("timestamp")), F.lit(86_400_000)).cast("int")
    own = F.struct(ms.alias("ms"), F.lit(7).alias("p"))
    return table(spark, d, "events").select("event_id", temporal.time_less(own, temporal.time(12, 0, 0, 0)).alias("morning"), temporal.time_less(own, temporal.time(12)).alias("before"))
