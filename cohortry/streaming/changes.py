"""Changes as streams: a feed of committed transactions, and derived state kept up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cohortry.sources.store import TRANSACTION, Conflict, Store


def transaction_stream(store: Store, files_per_trigger: int | None = None) -> DataFrame:
    """Transactions of a store as they are committed. Back-pressure is a bound on the files, one a transaction, of a batch."""
    reader = store.spark.readStream.schema(TRANSACTION)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{store.path}/transactions")


def subscribe(store: Store, handle: Callable[[DataFrame, int], None], checkpoint: str, type_: str | None = None, once: bool = True, files_per_trigger: int | None = None) -> StreamingQuery:
    """Call `handle(changes, t)` for each successful transaction that changed a type, in order of t and without loss.

    A call that fails, or a crash, repeats its batch: handlers have to take a transaction again."""

    def batch(df: DataFrame, _: int) -> None:
        for r in df.where("success").select("t").orderBy("t").collect():  # a bounded number of transactions
            changes = store.changes(r["t"])
            changes = changes if type_ is None else changes.where(F.col("type") == type_)
            if not changes.isEmpty():
                handle(changes, r["t"])

    writer = transaction_stream(store, files_per_trigger).writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer).start()


def kafka_subscribe(store: Store, log: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Apply a log of bundles (t, instant, commands) to a store, in order. A bundle that was applied already is left out:
    the store's t says how far the log has been read. One that fails leaves its error behind and takes its t."""

    def batch(df: DataFrame, _: int) -> None:
        for r in df.where(F.col("t") > store.basis_t()).orderBy("t").toLocalIterator():
            try:
                store.apply_bundle(r["commands"], r["instant"])
            except Conflict:
                pass  # logged as a failed transaction

    writer = log.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer).start()


def last_change_stream(stream: DataFrame, subject: str) -> DataFrame:
    """The newest t of each subject as state of the stream."""
    return stream.groupBy(subject).agg(F.max("t").alias("last_t"))


def upsert_into(path: str, key: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A handler that keeps the newest row of each key in a Parquet table. Replays of a batch change nothing.

    Every transaction is a folder of its own, written in overwrite mode; readers take the newest row of each key."""

    def handle(df: DataFrame, t: int) -> None:
        newest = df.groupBy(*key).agg(F.max_by(F.struct(*df.columns), F.col(order)).alias("r")).select("r.*")
        newest.write.mode("overwrite").parquet(f"{path}/batch={t}")

    return handle


def current(spark: SparkSession, path: str, key: list[str], order: str) -> DataFrame:
    """What upsert_into() keeps. Columns that a query does not ask for are not read: each has an aggregate of its own."""
    rows = spark.read.parquet(path).drop("batch")
    newest = rows.groupBy(*key).agg(*[F.max_by(c, order).alias(c) for c in rows.columns if c not in key])
    return newest.select(*rows.columns)


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes", ts: str = "ts", code: str = "event_type") -> DataFrame:
    """Counts by time window and code; rows later than the watermark no longer change a window."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, every), code).agg(F.count(F.lit(1)).alias("n"))
