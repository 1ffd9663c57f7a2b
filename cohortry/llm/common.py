"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of an Arrow batch: long texts must not pile up in one Python worker.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, for the rest of the session: results are lazy, so the bounds must still
    hold when they are computed. Smaller bounds of the caller's stay; -1 and 0 mean no bound to Spark."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(key).strip().lower())
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master (tests) gets
    a folder of its own; on a cluster that folder would differ from machine to machine, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
    return f"file://{tempfile.gettempdir()}/checkpoints/cohortry"


_WRITTEN: list[str] = []


def written() -> int:
    """How many tables materialize() has written in this process and clean() has not deleted."""
    return len(_WRITTEN)


def clean(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete what materialize() wrote in this process after its first `since` tables, but for the last `keep`.

    Results that were not saved by then cannot be read any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    end = len(_WRITTEN) - keep
    for name in _WRITTEN[since:end]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    del _WRITTEN[since:end]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True where crc32 of the id as text, mod 5, is 0. A null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def ship(spark: SparkSession) -> None:
    """Send this package's code to the Python workers, once a session: they need not have it on their path."""
    context = spark.sparkContext
    if getattr(context, "_cohortry_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp()) / "cohortry_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._cohortry_shipped = True


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    ship(df.sparkSession)
    small_batches(df.sparkSession)

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()  # workers outlive their tasks

    return df.mapInArrow(lean, schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def with_arrow_columns(df: DataFrame, source: str, out: list[T.StructField], fn: Callable[[list], list[pa.Array]], keep: Iterable[str] | None = None) -> DataFrame:
    """The columns `keep` of df (all by default) with further columns, computed batch by batch from one column.

    fn gets the column's values as a list and returns an Arrow array for each new field. The source travels to Python
    once, and back only if it is kept. Columns of df with a new field's name are replaced."""
    names = {f.name.lower() for f in out}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    slot = source if source in kept else fresh(df, "__in")
    sent = [F.col(f"`{c}`") for c in kept] + ([] if source in kept else [F.col(f"`{source}`").alias(slot)])
    schema = T.StructType([df.schema[c] for c in kept] + out)
    n, at = len(kept), [*kept, slot].index(slot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = fn(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), *cols], [f.name for f in schema])

    return map_rows(df.select(*sent), run, schema)


def bounded_sample(df: DataFrame, key: Column, rows: int, stratum: Column | None = None) -> DataFrame:
    """About `rows` rows (of each stratum, where given), chosen by a hash of key: the same rows in every run.

    Strata are counted first; the number of strata is small by contract (labels, languages)."""
    slot = fresh(df, "__stratum")
    df = df.withColumn(slot, (stratum if stratum is not None else F.lit("")).cast("string"))
    counts = {r[0]: r[1] for r in df.groupBy(slot).count().collect()}
    u = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(slot).eqNullSafe(F.lit(value)), F.lit(min(1.0, rows / n))).otherwise(share)
    return df.where(u < share).drop(slot)
