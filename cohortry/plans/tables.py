"""The relational test tables in clinical roles: customers are subjects, orders and line items their resources."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators.search import One, Param, Registry, code, instant
from cohortry.operators.terminology import Filter, Include, Terminology, ValueSet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Lazy(Mapping):
    """DataFrames, or what holds them, that are made when they are first asked for: a query reads the schemas of its own tables only."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]) -> None:
        self.makers, self.made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            maker = self.makers[name]
            self.made[name] = maker() if callable(maker) else maker
        return self.made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)


def _ref(kind: str, column: str):
    return lambda: One(F.struct(F.lit(kind).alias("type"), F.col(column).cast("string").alias("id")), F.col(column))


#: The columns that hold the ids of types whose references are compared without a cast.
NATIVE = {"Customer": "c_custkey", "Order": "o_orderkey", "Event": "event_id", "Part": "p_partkey", "Supplier": "s_suppkey", "Nation": "n_nationkey", "Region": "r_regionkey"}


def registry(spark: SparkSession, sf_dir: str) -> Registry:
    t = lambda name: table(spark, sf_dir, name)
    key = lambda name, column: lambda: t(name).withColumn("id", F.col(column).cast("string"))
    named = Lazy(
        {
            "Customer": key("customer", "c_custkey"),
            "Order": key("orders", "o_orderkey"),
            "LineItem": lambda: t("lineitem").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")),
            "Event": key("events", "event_id"),
            "Part": key("part", "p_partkey"),
            "Supplier": key("supplier", "s_suppkey"),
            "Nation": key("nation", "n_nationkey"),
            "Region": key("region", "r_regionkey"),
            "List": lambda: t("nation").groupBy(F.col("n_regionkey").cast("string").alias("id")).agg(F.collect_list(F.struct(F.lit("Nation").alias("type"), F.col("n_nationkey").cast("string").alias("id"))).alias("item")),
        }
    )
    params = {
        "Customer": {
            "segment": Param("token", lambda: code(F.col("c_mktsegment"))),
            "name": Param("string", lambda: One(F.col("c_name"))),
            "balance": Param("number", lambda: One(F.col("c_acctbal").cast("decimal(28,8)"))),
            "nation": Param("reference", _ref("Nation", "c_nationkey"), ("Nation",)),
        },
        "Order": {
            "status": Param("token", lambda: code(F.col("o_orderstatus"))),
            "priority": Param("token", lambda: code(F.col("o_orderpriority"), "priority")),
            "date": Param("date", lambda: instant(F.col("o_orderdate"), "day")),
            "period": Param("date", lambda: instant(F.col("o_orderdate"), "month")),
            "total": Param("number", lambda: One(F.col("o_totalprice").cast("decimal(28,8)"))),
            "subject": Param("reference", _ref("Customer", "o_custkey"), ("Customer",), identifier=lambda: code(F.concat(F.lit("C-"), F.col("o_custkey").cast("string")), "urn:customers")),
        },
        "LineItem": {
            "flag": Param("token", lambda: code(F.col("l_returnflag"))),
            "quantity": Param("quantity", lambda: One(F.struct(F.col("l_quantity").cast("decimal(28,8)").alias("value"), F.lit("pc").alias("unit"), F.lit("units").alias("system"), F.lit("pc").alias("code")))),
            "order": Param("reference", _ref("Order", "l_orderkey"), ("Order",)),
            "part": Param("reference", _ref("Part", "l_partkey"), ("Part",)),
            "supplier": Param("reference", _ref("Supplier", "l_suppkey"), ("Supplier",)),
            "times": Param("date", lambda: F.concat(*[F.array(instant(F.col("l_shipdate") + F.expr(f"interval {n} days"), "day").col) for n in (0, 30)])),
            "flag-quantity": Param(
                "composite",
                lambda: One(F.struct(code(F.col("l_returnflag")).col.alias("flag"), F.struct(F.col("l_quantity").cast("decimal(28,8)").alias("value"), F.lit("pc").alias("unit"), F.lit("units").alias("system"), F.lit("pc").alias("code")).alias("quantity"))),
                parts=(("token", "flag"), ("quantity", "quantity")),
            ),
        },
        "Event": {
            "type": Param("token", lambda: code(F.col("event_type"))),
            "date": Param("date", lambda: instant(F.col("ts"))),
            "value": Param("number", lambda: One(F.col("value").cast("decimal(28,8)"))),
            "subject": Param("reference", _ref("Customer", "user_id"), ("Customer",)),
        },
        "Part": {
            "name": Param("string", lambda: One(F.col("p_name"))),
            "brand": Param("token", lambda: code(F.col("p_brand"), "brand")),
            "type": Param("token", lambda: code(F.col("p_type"))),
            "sound": Param("phonetic", lambda: One(F.col("p_name"))),
            "label": Param("token", lambda: code(F.concat_ws(",", "p_brand", "p_type"))),
            "url": Param("uri", lambda: One(F.concat(F.lit("http://parts/"), F.col("p_type"), F.lit("/"), F.col("p_brand")))),
        },
        "Supplier": {
            "nation": Param("reference", _ref("Nation", "s_nationkey"), ("Nation",)),
            "position": Param("near", lambda: One(F.struct((F.pmod(F.col("s_suppkey") * 7, F.lit(180)) - 90).cast("double").alias("lat"), (F.pmod(F.col("s_suppkey") * 13, F.lit(360)) - 180).cast("double").alias("lon")))),
        },
        "Nation": {"region": Param("reference", _ref("Region", "n_regionkey"), ("Region",)), "name": Param("string", lambda: One(F.col("n_name")))},
        "Region": {"name": Param("string", lambda: One(F.col("r_name")))},
        "List": {"item": Param("reference", lambda: F.col("item"), ("Nation",))},
    }
    # Part types are plain codes in the parts' table; the code system names its own.
    expand = lambda url: terminology(spark, sf_dir).expand(url).withColumn("system", F.when(F.col("system") != "part-type", F.col("system")))
    return Registry(named, params, {"Order": "subject", "Event": "subject"}, "Customer", expand, {"Event": "ts", "Order": "o_orderdate"}, NATIVE)


def terminology(spark: SparkSession, sf_dir: str) -> Terminology:
    """Nations below regions below one root, as a code system; part brands and types as two more."""
    t = lambda name: table(spark, sf_dir, name)
    nation, region, part = t("nation"), t("region"), t("part")
    n = F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))
    r = lambda c: F.concat(F.lit("R"), F.col(c).cast("string"))
    geo = lambda code_, display: [F.lit("geo").alias("system"), code_.alias("code"), display.alias("display"), F.lit(True).alias("active")]
    concepts = nation.select(*geo(n, F.col("n_name"))).union(region.select(*geo(r("r_regionkey"), F.col("r_name")))).union(region.limit(1).select(*geo(F.lit("W"), F.lit("WORLD"))))
    concepts = concepts.union(part.select(F.lit("brand").alias("system"), F.col("p_brand").alias("code"), F.col("p_brand").alias("display"), (F.col("p_brand") != "Brand#2").alias("active")).distinct())
    concepts = concepts.union(part.select(F.lit("part-type").alias("system"), F.col("p_type").alias("code"), F.lower("p_type").alias("display"), F.lit(True).alias("active")).distinct())
    edges = nation.select(F.lit("geo").alias("system"), r("n_regionkey").alias("parent"), n.alias("child")).union(region.select(F.lit("geo").alias("system"), F.lit("W").alias("parent"), r("r_regionkey").alias("child")))
    properties = nation.select(F.lit("geo").alias("system"), n.alias("code"), F.lit("parity").alias("property"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("even")).otherwise(F.lit("odd")).alias("value"))
    sets = {
        "asia": ValueSet("asia", (Include("geo", filters=(Filter("concept", "descendent-of", "R2"),)),)),
        "world": ValueSet("world", (Include("geo", filters=(Filter("concept", "is-a", "W"),)),), (Include("geo", codes=("R0", "N0")),)),
        "even-asia": ValueSet("even-asia", (Include("geo", filters=(Filter("parity", "=", "even"),), value_sets=("asia",)),)),
        "brands": ValueSet("brands", (Include("brand", filters=(Filter("code", "regex", "Brand#1[0-9]"),)), Include("brand", codes=("Brand#2", "Brand#3"))), (Include("brand", codes=("Brand#12",)),)),
        "promo": ValueSet("promo", (Include("part-type", codes=("PROMO", "SMALL")),)),
        "types": ValueSet("types", (Include("part-type", codes=("ECONOMY", "STANDARD", "PROMO")),)),
    }
    return Terminology(concepts, edges, properties, sets)
