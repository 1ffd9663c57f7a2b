"""Models of the query language: clinical resources read from JSON, and the relational test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.functions import convert, quantity, temporal
from cohortry.operators.search import code as code_token
from cohortry.plans.cql import Model, Type
from cohortry.plans.tables import Lazy, table, terminology
from cohortry.sources.resources import typed


def _codes(c: Column) -> Column:
    """A concept as an array of (system, code)."""
    return F.transform(c["coding"], lambda x: F.struct(x["system"].alias("system"), x["code"].alias("code")))


def _concepts(c: Column) -> Column:
    return F.flatten(F.transform(c, _codes))


def _coding(c: Column) -> Column:
    return F.when(c.isNotNull(), F.array(F.struct(c["system"].alias("system"), c["code"].alias("code"))))


def _quantity(c: Column) -> Column:
    return F.when(c["value"].isNotNull(), F.struct(c["value"].alias("value"), F.coalesce(c["code"], c["unit"], F.lit("1")).alias("unit")))


def _ref_id(ref: Column, kind: str) -> Column:
    return F.when(F.startswith(ref["reference"], F.lit(f"{kind}/")), F.split_part(ref["reference"], F.lit("/"), F.lit(2)))


def clinical(resources: DataFrame, value_sets: Callable[[str], DataFrame] | None = None, subject: str = "Patient", code_systems: Callable[[str], DataFrame] | None = None) -> Model:
    """From resources (type, id, content). subject: the type whose resources are the subjects, Patient or Specimen."""
    c = F.col
    date = lambda n: lambda: (temporal.parse(c(n)), "Date")
    period = lambda n: lambda: (convert.period_to_interval(c(n)), "Interval<Date>")
    concept = lambda n: lambda: (_codes(c(n)), "Concept")
    text = lambda n: lambda: (c(n), "String")
    reference = lambda n: lambda: (F.struct(c(n)["reference"].alias("reference")), "Reference")
    of = {
        "Observation": {"Encounter": c("encounter"), "Specimen": c("specimen")},
        "Condition": {"Encounter": c("encounter")},
        "Procedure": {"Encounter": c("encounter")},
    }
    patient = _ref_id(c("subject"), "Patient")
    spec: dict[str, tuple[Column | None, dict[str, tuple[Column, str]], dict[str, Column]]] = {
        "Patient": (
            None,
            {"id": text("id"), "gender": text("gender"), "birthDate": date("birthDate"), "city": (F.get(c("address"), F.lit(0))["city"], "String"), "deceased": date("deceasedDateTime"), "profile": (c("meta")["profile"], "List<String>")},
            {},
        ),
        "Observation": (
            patient,
            {
                "id": text("id"), "status": text("status"), "code": concept("code"), "category": (_concepts(c("category")), "List<Code>"), "effective": date("effectiveDateTime"), "value": (_quantity(c("valueQuantity")), "Quantity"),
                "valueConcept": concept("valueCodeableConcept"), "encounter": reference("encounter"), "specimen": reference("specimen"), "profile": (c("meta")["profile"], "List<String>"),
            },
            {"code": _codes(c("code")), "category": _concepts(c("category")), "status": F.array(F.struct(F.lit(None).cast("string").alias("system"), c("status").alias("code")))},
        ),
        "Condition": (
            patient,
            {"id": text("id"), "code": concept("code"), "onset": date("onsetDateTime"), "encounter": reference("encounter"), "bodySite": (_concepts(c("bodySite")), "List<Code>"), "clinicalStatus": concept("clinicalStatus")},
            {"code": _codes(c("code")), "body-site": _concepts(c("bodySite")), "clinical-status": _codes(c("clinicalStatus"))},
        ),
        "Procedure": (
            patient,
            {"id": text("id"), "status": text("status"), "code": concept("code"), "category": concept("category"), "performed": lambda: (F.coalesce(convert.period_to_interval(c("performedPeriod")), F.struct(temporal.parse(c("performedDateTime")).alias("low"), temporal.parse(c("performedDateTime")).alias("high"))), "Interval<Date>"), "encounter": reference("encounter")},
            {"code": _codes(c("code")), "category": _codes(c("category"))},
        ),
        "Encounter": (
            patient,
            {"id": text("id"), "status": text("status"), "class": (F.struct(c("class")["system"].alias("system"), c("class")["code"].alias("code")), "Code"), "type": (_concepts(c("type")), "List<Code>"), "period": period("period")},
            {"type": _concepts(c("type")), "code": _concepts(c("type")), "class": _coding(c("class"))},
        ),
        "Specimen": (patient, {"id": text("id"), "type": concept("type"), "collected": date("collection.collectedDateTime"), "bodySite": (_codes(c("collection")["bodySite"]), "Concept")}, {"type": _codes(c("type")), "code": _codes(c("type"))}),
        "Medication": (None, {"id": text("id"), "code": concept("code")}, {"code": _codes(c("code"))}),
        "MedicationStatement": (patient, {"id": text("id"), "status": text("status"), "medication": reference("medicationReference"), "effective": period("effectivePeriod")}, {"code": _codes(c("medicationCodeableConcept"))}),
        "MedicationAdministration": (patient, {"id": text("id"), "status": text("status"), "medication": reference("medicationReference"), "effective": date("effectiveDateTime")}, {"code": _codes(c("medicationCodeableConcept"))}),
    }

    def made(name: str) -> Type:
        own, elements, codes = spec[name]
        contexts = ({} if own is None else {"Patient": own}) | {k: _ref_id(ref, k) for k, ref in of.get(name, {}).items()}
        return Type(typed(resources, name), contexts.get(subject), Lazy(elements), codes, contexts)

    return Model(Lazy({name: lambda name=name: made(name) for name in spec}), subject, value_sets, code_systems)


def relational(spark: SparkSession, sf_dir: str, subject: str = "Patient") -> Model:
    """Customers as patients, with orders and events; or orders as subjects, with line items. Parts belong to nobody."""
    c = F.col
    day = lambda n: lambda: (temporal.of(c(n), "day"), "Date")
    num = lambda n: (c(n).cast("decimal(28,8)"), "Decimal")
    code = lambda n: code_token(c(n))
    text = lambda n: (c(n), "String")
    spec = {
        "Patient": ("customer", {}, {"id": (c("c_custkey"), "Integer"), "segment": text("c_mktsegment"), "balance": num("c_acctbal"), "nation": (c("c_nationkey").cast("long"), "Integer")}, {}),
        "Order": (
            "orders", {"Patient": c("o_custkey")}, {"id": (c("o_orderkey"), "Integer"), "status": text("o_orderstatus"), "priority": text("o_orderpriority"), "date": day("o_orderdate"), "total": num("o_totalprice")},
            {"code": code("o_orderpriority"), "status": code("o_orderstatus")},
        ),
        "Event": ("events", {"Patient": c("user_id")}, {"id": (c("event_id"), "Integer"), "type": text("event_type"), "value": num("value"), "date": day("ts")}, {"code": code("event_type")}),
        "LineItem": (
            "lineitem", {"Order": c("l_orderkey")}, {"id": (c("l_linenumber").cast("long"), "Integer"), "flag": text("l_returnflag"), "part": (c("l_partkey"), "Integer"), "amount": (quantity.quantity(c("l_quantity").cast("decimal(28,8)"), "kg"), "Quantity"), "shipped": day("l_shipdate")},
            {"code": code("l_returnflag")},
        ),
        "Part": ("part", {}, {"id": (c("p_partkey"), "Integer"), "brand": text("p_brand"), "type": (c("p_type"), "String"), "size": (c("p_size").cast("long"), "Integer")}, {"code": code("p_brand"), "type": code("p_type")}),
    }
    made = Lazy({name: lambda t=t, x=contexts, e=elements, k=codes: Type(table(spark, sf_dir, t), x.get(subject), Lazy(e), k, x) for name, (t, contexts, elements, codes) in spec.items()})
    terms = lambda: terminology(spark, sf_dir)
    plain = lambda df: df.withColumn("system", F.when(F.col("system") != "part-type", F.col("system")))  # noqa: E731  codes in the tables have no system
    return Model(made, subject, lambda url: plain(terms().expand(url)), lambda url: plain(terms().concepts.where(F.col("system") == url)))
