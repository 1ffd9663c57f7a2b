"""Connected components as DataFrames: smallest label of the neighbours, then a jump to the label's own label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of edges (a, b): component is the smallest id that links reach.

    Loops, repeated and reversed edges do no harm; edges with a null end are left out; no edges give no rows.
    Each round is written to the shared folder. Joins have plain exchanges on both sides, so that Spark splits
    the partition of a node with very many links."""
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    e = materialize(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        near = e.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        step = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        jump = labels.select(F.col("id").alias("c"), F.col("component").alias("cc"))
        new = materialize(step.join(jump, "c", "left").select("id", "old", F.coalesce(F.least("c", "cc"), "c").alias("component")), "labels")
        labels = new.select("id", "component")
        if new.where("component <> old").isEmpty():
            return labels
