"""Time travel over a table of versions (type, id, t, op, num_changes, hash, purged_at, content).

Everything is one aggregation with map-side partial results, whose shuffle carries one row per resource and task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["type", "id"]


def window(versions: DataFrame, t: int | None = None, since: int | None = None) -> DataFrame:
    """Versions that a database value of time t sees: not later than t, later than since, not purged by then."""
    out = versions
    if t is not None:
        out = out.where(F.col("t") <= t)
    if since is not None:
        out = out.where(F.col("t") > since)
    if "purged_at" in versions.columns:
        purged = F.col("purged_at").isNotNull() & (F.col("purged_at") <= (t if t is not None else (1 << 62)))
        out = out.where(~purged)
    return out


def snapshot(versions: DataFrame, t: int | None = None, since: int | None = None) -> DataFrame:
    """The newest visible version of each resource; deleted resources are gone."""
    rest = [c for c in versions.columns if c not in KEY]
    newest = window(versions, t, since).groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.col("t")).alias("v"))
    return newest.select(*KEY, "v.*").where(F.col("op") != "delete").select(*versions.columns)


def history(versions: DataFrame, type_: str | None = None, id_: str | None = None, t: int | None = None, since: int | None = None) -> DataFrame:
    """All visible versions, newest first, of the system, a type or a resource."""
    out = window(versions, t, since)
    if type_ is not None:
        out = out.where(F.col("type") == type_)
    if id_ is not None:
        out = out.where(F.col("id") == id_)
    return out.orderBy(F.desc("t"), *KEY)


def changes(versions: DataFrame, t: int) -> DataFrame:
    return versions.where(F.col("t") == t)


def totals(versions: DataFrame, t: int | None = None) -> DataFrame:
    """Number of resources by type."""
    return snapshot(versions, t).groupBy("type").agg(F.count(F.lit(1)).alias("total"))


def numbered(versions: DataFrame) -> DataFrame:
    """versions with num_changes, the count of versions of the resource so far."""
    return versions.withColumn("num_changes", F.expr("row_number() over (partition by type, id order by t)").cast("long"))


def last_change(versions: DataFrame, subject: str) -> DataFrame:
    """The newest t of each subject, for incremental invalidation."""
    return versions.groupBy(subject).agg(F.max("t").alias("last_t"))


def dangling_references(references: DataFrame, present: DataFrame) -> DataFrame:
    """References (ref_type, ref_id) whose target is not among the present (type, id)."""
    return references.join(present, (references["ref_type"] == present["type"]) & (references["ref_id"] == present["id"]), "left_anti")
