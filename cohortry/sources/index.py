"""Derived indexes of search parameters as tables: rebuilt as a whole, read with partition pruning.

An index holds the values of one token parameter as rows (value, id), in folders by a hash of the value, so that a search
for a code reads one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.operators.search import One, Registry, SearchError, split_escaped, unescape

FOLDERS = 32


def entries(reg: Registry, type_: str, code: str) -> DataFrame:
    """(value, id): each value stands four times: `code`, `system|code`, `|code` without a system, `system|`."""
    p = reg.param(type_, code)
    if p.kind != "token":
        raise SearchError(f"{code} of {type_} is no token")
    values = p.values()
    df = reg.tables[type_].select(F.col("id").cast("string").alias("id"), (F.array(values.col) if isinstance(values, One) else values).alias("v"))
    v = df.select("id", F.explode("v").alias("v")).select("id", F.col("v.system").alias("s"), F.col("v.code").alias("c")).where("c is not null")
    forms = F.array(F.col("c"), F.concat(F.coalesce("s", F.lit("")), F.lit("|"), F.col("c")), F.concat(F.col("s"), F.lit("|")))
    return v.select(F.explode(F.array_compact(forms)).alias("value"), "id").distinct()


def _folder(value):
    return F.pmod(F.xxhash64(value), F.lit(FOLDERS)).cast("int")


def reindex(reg: Registry, type_: str, code: str, path: str) -> None:
    """Rebuild the index of a parameter. Readers see the old one or the new one: files are replaced as a whole."""
    found = entries(reg, type_, code).withColumn("folder", _folder(F.col("value")))
    found.repartition("folder").sortWithinPartitions("value").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/{type_}/{code}")


def lookup(reg: Registry, type_: str, code: str, values: list[str], path: str) -> DataFrame:
    """Resources of a type with one of the values, by the index."""
    wanted = ["|".join(map(unescape, split_escaped(v, "|"))) for v in values]
    folders = reg.tables[type_].sparkSession.createDataFrame([(w,) for w in wanted], "w string").select(_folder(F.col("w"))).distinct().collect()
    rows = reg.tables[type_].sparkSession.read.schema("value string, id string, folder int").parquet(f"{path}/{type_}/{code}")
    hits = rows.where(F.col("folder").isin([f[0] for f in folders]) & F.col("value").isin(wanted)).select("id")
    return reg.tables[type_].join(hits, "id", "left_semi")
