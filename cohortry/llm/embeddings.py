"""Near-duplicate embeddings: random-hyperplane signs in several tables, exact cosines, connected components.

Equal vectors are one class with a multiplicity. Classes meet in the buckets of each table; a pair is counted in the
first table where it meets, so no pair is written: a bucket yields link counts and a spanning star of each of its
components. Bits and tables follow from the number of vectors and the recall wanted at the threshold.

Sign bits are taken from components and hyperplanes rounded to integers, whose products double precision sums exactly:
a vector has the same bits in every batch, so bucket keys need not travel with the vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import map_rows, materialize, partitions, table
from cohortry.llm.components import connected_components

#: Vectors of a bucket that one task compares with as many others.
BLOCK = 2048
#: Bits beyond one vector to a bucket: strangers that meet cost a vector moved, tables only ids and keys.
SPARE_BITS = 5


def plan(n: int, cosine: float, miss: float = 0.002) -> tuple[int, int]:
    """(bits, tables): about one vector to 2 ** SPARE_BITS buckets, and a pair at the threshold missed with probability `miss`."""
    bits = min(40, max(6, math.ceil(math.log2(max(2, n))) + SPARE_BITS))
    p = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-p))


@lru_cache(maxsize=8)
def planes(dims: int, bits: int, tables: int) -> np.ndarray:
    return np.rint(np.random.default_rng([17, dims, bits]).standard_normal((dims, bits * tables)) * 4096)


def codes(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The bucket of each row of x (largest component 1) in each table."""
    powers = 1 << np.arange(bits, dtype=np.int64)
    out = np.empty((len(x), tables), np.int64)
    for s in range(0, len(x), 256):
        q = np.rint(x[s : s + 256] * 32768.0)
        out[s : s + 256] = ((q @ planes(x.shape[1], bits, tables)).reshape(len(q), tables, bits) > 0) @ powers
    return out


def packed(x: np.ndarray) -> bytes:
    """Single precision where that is exact, as it is for tables of floats; a leading byte says so."""
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    return b"f" + small.tobytes() if (small == x).all() else b"d" + x.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """The components, scaled so that the largest is 1 in size: lengths neither overflow nor vanish."""
    x = np.frombuffer(data, np.float32 if data[:1] == b"f" else np.float64, offset=1).astype(np.float64)
    return x / np.abs(x).max()


def prepared(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, cls, vec): class digest and packed components, null where the vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, vecs = [], []
            for v in batch.column(1):
                x = v.values.to_numpy(zero_copy_only=False) if v.is_valid else np.zeros(0)  # nulls become NaN
                x = x.astype(np.float64)
                if len(x) and np.isfinite(x).all() and x.any():
                    cls.append(xxhash.xxh3_128_digest((x + 0.0).tobytes()))
                    vecs.append(packed(x))
                else:
                    cls.append(None), vecs.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.binary()), pa.array(vecs, pa.binary())], ["id", "cls", "vec"])

    return map_rows(df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>")), run, "id long, cls binary, vec binary")


def bucket_keys(reps: DataFrame, bits: int, tables: int) -> DataFrame:
    """(id, keys): for each table, the key of the vector's bucket. Vectors of different lengths never meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = [unpacked(v) for v in batch.column(1).to_pylist()]
            keys: list = [None] * len(vecs)
            for dims in {len(v) for v in vecs}:
                at = [i for i, v in enumerate(vecs) if len(v) == dims]
                found = codes(np.stack([vecs[i] for i in at]), bits, tables) | ((np.int64(dims) * tables + np.arange(tables)) << np.int64(bits))
                for i, k in zip(at, found, strict=True):
                    keys[i] = k
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], ["id", "keys"])

    return map_rows(reps.select("id", "vec"), run, "id long, keys array<long>")


def links(mask: np.ndarray) -> np.ndarray:
    """Component label (smallest index) of each row of a symmetric mask."""
    label = np.arange(len(mask))
    while True:
        new = np.minimum(label, np.where(mask, label[None, :], len(mask)).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def close_pairs(unit: np.ndarray, cosine: float, side: np.ndarray | None) -> np.ndarray:
    """Mask of the pairs of rows at the threshold. side: only pairs of unlike sides count, where given."""
    product = unit @ unit.T
    close = product >= cosine
    for i, j in np.argwhere(np.abs(product - cosine) < 1e-12):  # the same answer whatever the block
        close[i, j] = np.einsum("i,i", unit[min(i, j)], unit[max(i, j)]) >= cosine
    np.fill_diagonal(close, False)
    if side is not None:
        close &= side[:, None] != side[None, :]
    return close


def bucket_links(rows: DataFrame, cosine: float, bits: int, tables: int) -> DataFrame:
    """rows: bkey, p, q, own, id, w, vec -> (id, n_links, other): counts (other null) and star edges."""

    def compare(t: pa.Table, cuts: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
        """For the groups between cuts: ids, link weights, and star edges of the rows' components."""
        ids, w, p, q, own, key = (t.column(c).to_numpy() for c in ("id", "w", "p", "q", "own", "bkey"))
        vec = t["vec"].to_pylist()
        for s, e in zip(cuts, cuts[1:], strict=False):
            if e - s < 2:
                continue
            x = np.stack([unpacked(v) for v in vec[s:e]])
            unit = x / np.sqrt((x * x).sum(1))[:, None]
            close = close_pairs(unit, cosine, None if p[s] == q[s] else own[s:e] == p[s])
            at = np.flatnonzero(close.any(1))
            if not len(at):
                continue
            close, own_ids = close[np.ix_(at, at)], ids[s:e][at]
            label = links(close | np.eye(len(at), dtype=bool))
            edges = [(int(own_ids[i]), int(own_ids[label[i]])) for i in np.flatnonzero(label != np.arange(len(at)))]
            code = codes(x[at], bits, tables)
            tbl = int(key[s] >> bits) % tables
            close &= (code[:, tbl] == key[s] & ((1 << bits) - 1))[:, None]  # an id with several vectors: this one is not of the bucket
            for k in range(tbl):  # a pair counts in the first table where it meets
                close &= code[:, k][:, None] != code[:, k][None, :]
            yield own_ids, (close & close.T) @ w[s:e][at], edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def flush(t: pa.Table, cuts: list[int]) -> Iterator[pa.RecordBatch]:
            for ids, count, edges in compare(t, cuts):
                hit = np.flatnonzero(count)
                a = np.concatenate([ids[hit], np.array([x[0] for x in edges], np.int64)])
                n = np.concatenate([count[hit], np.zeros(len(edges), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n), pa.array([None] * len(hit) + [x[1] for x in edges], pa.int64())], ["id", "n_links", "other"])

        for batch in batches:  # sorted: the last group may go on
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            k, p, q = (held.column(c).to_numpy() for c in ("bkey", "p", "q"))
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1).tolist()]
            yield from flush(held, cuts)
            held = held.slice(cuts[-1])
        if held is not None:
            yield from flush(held, [0, len(held)])

    dealt = rows.repartition(partitions(rows.sparkSession), "bkey", "p", "q").sortWithinPartitions("bkey", "p", "q")
    return map_rows(dealt, run, "id long, n_links long, other long")


def deduplicate(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """One row per row of df: id_col, n_links, component_id, kept (id = component_id).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do rows without
    an id (component_id null, kept). Very long and very short vectors are scaled first. Equal vectors link with one
    another and are counted, also where a row occurs twice; rows with one id and several vectors share their links;
    vectors of different lengths do not meet. Other columns are not read; an empty table gives no rows."""
    all_ = materialize(prepared(df, id_col, vec_col), "prepared")
    bits, tables = plan(all_.count(), cosine)
    usable = all_.where("id is not null and cls is not null")
    reps = materialize(usable.groupBy("cls").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w"), F.first("vec").alias("vec")), "reps")
    keyed = materialize(bucket_keys(reps, bits, tables), "keys").select("id", F.explode("keys").alias("bkey"))
    multi = materialize(keyed.groupBy("bkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bkey", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "buckets")
    mates = materialize(keyed.join(multi, "bkey"), "mates").join(reps.select("id", "w", "vec"), "id")
    dealt = mates.withColumn("own", F.pmod(F.hash("id"), "parts")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("p", F.least("own", "j")).withColumn("q", F.greatest("own", "j")).drop("j", "parts")
    found = materialize(bucket_links(dealt, cosine, bits, tables), "found")
    comps = connected_components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("id").agg(F.sum("n_links").alias("far"))
    known = reps.select("cls", "w", "id").join(counts, "id", "left").join(comps, "id", "left")
    known = materialize(known.select("cls", (F.col("w") - 1 + F.coalesce("far", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("c")), "classes")
    out = all_.select("id", F.when(F.col("id").isNotNull(), F.col("cls")).alias("cls")).join(known, "cls", "left")
    component = F.coalesce("c", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "embeddings"))
