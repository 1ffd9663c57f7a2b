"""Readers and writers of clinical resources: JSON bundles, newline-delimited JSON, XML, and Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The shapes of the resource types' elements.
CODING = "struct<system:string,version:string,code:string,display:string>"
CONCEPT = f"struct<coding:array<{CODING}>,text:string>"
QUANTITY = "struct<value:decimal(28,8),unit:string,system:string,code:string>"
PERIOD = "struct<start:string,end:string>"
REFERENCE = "struct<reference:string>"
IDENTIFIER = f"struct<system:string,value:string,type:{CONCEPT}>"
META = "struct<profile:array<string>,lastUpdated:string,versionId:string>"
SCHEMAS: dict[str, str] = {
    "Patient": f"id string, gender string, birthDate string, address array<struct<city:string,country:string,postalCode:string>>, name array<struct<family:string,given:array<string>>>, identifier array<{IDENTIFIER}>, managingOrganization {REFERENCE}, deceasedDateTime string, meta {META}",
    "Observation": f"id string, status string, category array<{CONCEPT}>, code {CONCEPT}, subject {REFERENCE}, encounter {REFERENCE}, specimen {REFERENCE}, effectiveDateTime string, valueQuantity {QUANTITY}, valueCodeableConcept {CONCEPT}, component array<struct<code:{CONCEPT},valueQuantity:{QUANTITY},valueCodeableConcept:{CONCEPT}>>, meta {META}",
    "Condition": f"id string, code {CONCEPT}, bodySite array<{CONCEPT}>, category array<{CONCEPT}>, clinicalStatus {CONCEPT}, subject {REFERENCE}, encounter {REFERENCE}, onsetDateTime string, meta {META}",
    "Specimen": f"id string, type {CONCEPT}, subject {REFERENCE}, identifier array<{IDENTIFIER}>, collection struct<collectedDateTime:string,collectedPeriod:{PERIOD},bodySite:{CONCEPT},fastingStatusCodeableConcept:{CONCEPT}>, meta {META}",
    "Procedure": f"id string, status string, category {CONCEPT}, code {CONCEPT}, subject {REFERENCE}, encounter {REFERENCE}, performedDateTime string, performedPeriod {PERIOD}, reasonReference array<{REFERENCE}>, meta {META}",
    "Encounter": f"id string, status string, class {CODING}, type array<{CONCEPT}>, period {PERIOD}, subject {REFERENCE}, diagnosis array<struct<condition:{REFERENCE}>>, meta {META}",
    "Medication": f"id string, code {CONCEPT}, meta {META}",
    "MedicationStatement": f"id string, status string, medicationReference {REFERENCE}, medicationCodeableConcept {CONCEPT}, subject {REFERENCE}, effectivePeriod {PERIOD}, effectiveDateTime string, meta {META}",
    "MedicationAdministration": f"id string, status string, medicationReference {REFERENCE}, medicationCodeableConcept {CONCEPT}, subject {REFERENCE}, effectiveDateTime string, meta {META}",
    "Consent": f"id string, patient {REFERENCE}, provision struct<provision:array<struct<code:array<{CONCEPT}>>>>, meta {META}",
    "Organization": f"id string, name string, identifier array<{IDENTIFIER}>, meta {META}",
    "List": f"id string, entry array<struct<item:{REFERENCE}>>, meta {META}",
    "Location": f"id string, name string, position struct<longitude:double,latitude:double>, meta {META}",
}
_REF = r"\"reference\"\s*:\s*\"([A-Z][A-Za-z]+/[A-Za-z0-9.\-]{1,64})\""


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """(bundle, position, method, type, id, content) of the entries of bundle files, one bundle to a file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("bundle"), F.parse_json("value").alias("v"))
    entries = files.select("bundle", F.posexplode(F.expr("variant_get(v, '$.entry', 'array<variant>')")).alias("position", "e"))
    return _entries(entries)


def bundle_entries(bundles: DataFrame, content: str = "content") -> DataFrame:
    """The same from a column of bundle texts; column `bundle` names them."""
    v = bundles.select("bundle", F.parse_json(content).alias("v"))
    return _entries(v.select("bundle", F.posexplode(F.expr("variant_get(v, '$.entry', 'array<variant>')")).alias("position", "e")))


def _entries(df: DataFrame) -> DataFrame:
    get = lambda path, kind="string": F.expr(f"try_variant_get(e, '{path}', '{kind}')")
    return df.select(
        "bundle",
        "position",
        F.coalesce(get("$.request.method"), F.lit("PUT")).alias("method"),
        get("$.resource.resourceType").alias("type"),
        get("$.resource.id").alias("id"),
        F.to_json(F.expr("variant_get(e, '$.resource', 'variant')")).alias("content"),
    )


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """(type, id, content) of newline-delimited resources. Types and ids are read without parsing the rest."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.get_json_object("value", "$.resourceType").alias("type"), F.get_json_object("value", "$.id").alias("id"), F.col("value").alias("content"))


def read_xml(spark: SparkSession, path: str, type_: str) -> DataFrame:
    """Resources of one type from XML files, whose primitive values are `value` attributes."""
    return spark.read.format("xml").option("rowTag", type_).option("attributePrefix", "_").load(path)


def typed(resources: DataFrame, type_: str, schema: str | None = None) -> DataFrame:
    """Resources of one type as columns. Only the elements that a query uses are parsed."""
    parsed = resources.where(F.col("type") == type_).select(F.from_json("content", schema or SCHEMAS[type_]).alias("r"))
    return parsed.select("r.*")


def references(resources: DataFrame, *more: str) -> DataFrame:
    """(type, id, more columns, ref_type, ref_id) of every literal reference in the contents."""
    refs = resources.select("type", "id", *more, F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(_REF), F.lit(1)))).alias("ref"))
    return refs.select("type", "id", *more, F.split_part("ref", F.lit("/"), F.lit(1)).alias("ref_type"), F.split_part("ref", F.lit("/"), F.lit(2)).alias("ref_id"))


def content_hash(content: Column) -> Column:
    """The hash under which a version's content is stored."""
    return F.sha2(content.cast("binary"), 256)


def write_ndjson(resources: DataFrame, path: str) -> None:
    resources.select(F.col("content").alias("value")).write.text(path)


def write_parquet(resources: DataFrame, path: str) -> None:
    """One folder to a type, so that a type's scan reads its own files only."""
    resources.write.partitionBy("type").parquet(path)


#: Fixed value: the tag of a resource that is not whole.
SUBSETTED = '{"system":"http://terminology.hl7.org/CodeSystem/v3-ObservationValue","code":"SUBSETTED"}'


def summary(resources: DataFrame, elements: list[str]) -> DataFrame:
    """Resources cut to some elements (type, id and meta stay; what is nested stays as it is), with the tag SUBSETTED."""
    keep = ["resourceType", "id", *elements]
    parts = lambda c: F.from_json(c, "map<string,variant>")
    none = F.from_json(F.lit("{}"), "map<string,variant>")
    cut = F.map_filter(parts(F.col("content")), lambda k, _: k.isin(keep))
    meta = F.coalesce(parts(F.get_json_object("content", "$.meta")), none)
    tags = F.coalesce(F.from_json(F.get_json_object("content", "$.meta.tag"), "array<variant>"), F.array().cast("array<variant>"))
    tags = F.parse_json(F.to_json(F.concat(tags, F.array(F.parse_json(F.lit(SUBSETTED))))))
    tagged = F.map_concat(F.map_filter(meta, lambda k, _: k != "tag"), F.create_map(F.lit("tag"), tags))
    whole = F.map_concat(F.map_filter(cut, lambda k, _: k != "meta"), F.create_map(F.lit("meta"), F.parse_json(F.to_json(tagged))))
    return resources.withColumn("content", F.to_json(whole))


#: Resources of one XML file: one task reads a file, as XML cannot be split.
XML_RESOURCES = 20_000


def write_xml(resources: DataFrame, type_: str, path: str) -> None:
    """Resources of one type as XML elements named after the type, in elements named Bundle, XML_RESOURCES at most to a file."""
    typed(resources, type_).write.format("xml").option("rowTag", type_).option("rootTag", "Bundle").option("maxRecordsPerFile", XML_RESOURCES).save(path)


def kafka_log(spark: SparkSession, servers: str, topic: str, start: str = "earliest") -> DataFrame:
    """A transaction log in a topic of one partition as a stream (t, instant, commands): t is the offset plus one."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", start).load()
    return raw.select((F.col("offset") + 1).alias("t"), F.col("timestamp").alias("instant"), F.col("value").cast("string").alias("commands"))
