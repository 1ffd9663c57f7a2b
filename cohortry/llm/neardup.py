"""Near duplicates by fast similarity sketching, banding and exact verification on full shingle sets.

Sketch: in round i every element falls into a hashed bin; a bin keeps its smallest value of the first round that
reaches it. After as many rounds as there are bins, round t + j fills bin j with the smallest hash. So every
coordinate is filled, and the share of equal coordinates concentrates around the Jaccard similarity.

Documents with equal sets are one class, and only classes are compared. In a bucket, each class is verified against
the bucket's hub (the class with the most bucket mates), which settles most groups with as many checks as members.
Buckets that still hold several components form clusters, one for each component that is the largest of a bucket:
it and the strays beside it. There every stray meets all others, closest sketches first and down to six standard
deviations below the threshold, until a full comparison links it; no pair is written but links."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm.common import map_rows, materialize, partitions, table
from cohortry.llm.components import connected_components

#: Bands x coordinates: at similarity 0.8 a pair shares no bucket with probability (1 - 0.8 ** 6) ** 40 < 6e-6.
BANDS, ROWS = 40, 6
BINS = BANDS * ROWS
#: Bytes of full sets, and rows, that one task holds on either side of a comparison.
BLOCK, BLOCK_ROWS = 16 << 20, 128
#: Rows that meet one copy of a hub's set.
FAN = 512
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K2
    x = (x ^ (x >> np.uint64(27))) * _K3
    return x ^ (x >> np.uint64(31))


_ROUND = _mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * _K1)


class Shingler:
    """Sorted 64-bit hashes of the distinct word shingles of a text."""

    def __init__(self, width: int) -> None:
        self.width, self.words = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.words) > 100_000:
            self.words.clear()
        known = self.words
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter((known[w] for w in words), np.uint64, len(words))
        width = min(self.width, len(h))
        out = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            out = _mix(out * _K1 + h[k : len(h) - width + 1 + k])
        return np.unique(out)


def sketch(e: np.ndarray) -> np.ndarray:
    """The fast similarity sketch of a set of hashes (not empty)."""
    t, n = BINS, len(e)
    s = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    low, step, i = np.uint64(0xFFFFFFFF), max(1, 2 * t // n), 0
    while i < t:
        rounds = np.arange(i, min(t, i + step), dtype=np.uint64)
        h = _mix(e[None, :] ^ _ROUND[i : i + len(rounds), None])
        bins = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        np.minimum.at(s, bins.ravel().astype(np.int64), ((rounds << np.uint64(32))[:, None] | (h & low)).ravel())
        i += len(rounds)
        if s.max() < np.uint64(t) << np.uint64(32):
            return s
    for j in np.flatnonzero(s == np.iinfo(np.uint64).max):
        h = _mix(e ^ _ROUND[t + j])
        s[j] = (np.uint64(t + j) << np.uint64(32)) | (h & low).min()
    return s


def band_keys(s: np.ndarray) -> np.ndarray:
    rows = s.reshape(BANDS, ROWS)
    out = _mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _K1)
    for k in range(ROWS):
        out = _mix(out * _K1 + rows[:, k])
    return out.view(np.int64)


def sketches(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n_shingles, set_hash, bands, sig) of each row; sig has one byte of each coordinate."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_hash", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for batch in batches:
            n, hashes, bands, sigs = [], [], [], []
            for text in batch.column(1).to_pylist():
                e = shingles(text)
                n.append(len(e))
                s = sketch(e) if len(e) else None
                hashes.append(xxhash.xxh3_128_digest(e.tobytes()) if len(e) else None)
                bands.append(None if s is None else band_keys(s))
                sigs.append(None if s is None else _mix(s).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], schema.names)

    return map_rows(df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t")), run, schema)


def full_sets(df: DataFrame, width: int) -> DataFrame:
    """(id, set): the sorted shingle hashes of (id, t) rows, for verification."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["id", "set"])

    return map_rows(df, run, "id long, set binary")


def similar(x: bytes, y: bytes, percent: int) -> bool:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. b is a hub: its set goes once to every FAN or so of its pairs."""
    hubs = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("parts"))
    hubs = materialize(hubs, "parts")
    asks = pairs.join(hubs, "b").select("a", "b", F.pmod(F.hash("a"), "parts").alias("part")).join(sets.withColumnRenamed("id", "a"), "a")
    held = hubs.join(sets.withColumnRenamed("id", "b"), "b").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = held.select("b", "part", F.lit(None).cast("long").alias("a"), "set").unionByName(asks.select("b", "part", "a", "set"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = b""
        for batch in batches:  # sorted: a hub's set comes before the rows of its part
            out: list[tuple[int, int]] = []
            for b, a, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if a is None:
                    hub = own.as_py()
                elif similar(own.as_py(), hub, percent):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    dealt = rows.repartition(partitions(rows.sparkSession), "b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    return materialize(map_rows(dealt, run, "a long, b long"), "links")


def clusters(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(main, id, comp, n, stray): classes of buckets that hold several components, gathered by the bucket's largest one."""
    m = materialize(members.join(comps.withColumnRenamed("component", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id")), "members")
    sizes = m.groupBy("bkey", "comp").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("bkey").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    main = materialize(main.select("bkey", "main"), "open")
    return m.join(main, "bkey").select("main", "id", "comp", "n", (F.col("comp") != F.col("main")).alias("stray")).distinct()


def stray_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join strays to other components of their cluster, at least one for each component they link with.

    A cluster is cut into blocks of members and blocks of strays, bounded in bytes and rows, so that a task holds one of
    each and meets BLOCK_ROWS x BLOCK_ROWS pairs at most."""
    share = percent / 100
    floor = share - 6 * math.sqrt(share * (1 - share) / BINS)
    rows = materialize(rows, "clusters")
    blocks = lambda n: F.greatest(F.ceil(F.coalesce(F.sum(n), F.lit(0)) * 8 / BLOCK), F.ceil(F.count(n) / BLOCK_ROWS), F.lit(1)).cast("int")
    sizes = rows.groupBy("main").agg(blocks(F.col("n")).alias("ps"), blocks(F.when(F.col("stray"), F.col("n"))).alias("qs"))
    rows = rows.join(materialize(sizes, "sizes"), "main")
    p, q = F.pmod(F.hash("id"), "ps"), F.pmod(F.hash("id", F.lit(1)), "qs")
    cols = ["main", "id", "comp", "n"]
    held = rows.select(*cols, F.lit(False).alias("asks"), p.alias("p"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"))
    asks = rows.where("stray").select(*cols, F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("ps") - 1)).alias("p"), q.alias("q"))
    dealt = materialize(held.unionByName(asks), "dealt").join(sets, "id")

    def compare(t: pa.Table) -> list[tuple[int, int]]:
        ids, comp, n, asks = (t.column(c).to_numpy() for c in ("id", "comp", "n", "asks"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, BINS)
        full = t.column("set").to_pylist()
        at = np.flatnonzero(~asks)
        label = comp.copy()
        out = []
        for i in np.flatnonzero(asks):
            near = at[(label[at] != label[i]) & (np.minimum(n[at], n[i]) * 100 >= percent * np.maximum(n[at], n[i]))]
            agree = (sig[near] == sig[i]).mean(1)
            order = np.argsort(-agree, kind="stable")
            for j in near[order[agree[order] >= floor]]:
                if label[j] != label[i] and similar(full[i], full[j], percent):
                    out.append((int(ids[i]), int(ids[j])))
                    label[label == label[j]] = label[i]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def flush() -> Iterator[pa.RecordBatch]:
            pairs = compare(pa.concat_tables(held).combine_chunks())
            held.clear()
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:  # sorted: cut where the group changes
            t = pa.Table.from_batches([batch])
            k = np.stack([t.column(c).to_numpy() for c in ("main", "p", "q")])
            cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), len(t)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if held and [held[0][c][0].as_py() for c in ("main", "p", "q")] != k[:, s].tolist():
                    yield from flush()
                held.append(t.slice(s, e - s))
        if held:
            yield from flush()

    parts = dealt.repartition(partitions(rows.sparkSession), "main", "p", "q").sortWithinPartitions("main", "p", "q")
    return materialize(map_rows(parts, run, "a long, b long"), "links")


def deduplicate(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of df: id_col, n_shingles, component_id, kept (id = component_id).

    Null and empty texts have no shingles and link with nothing; a text of fewer words than `width` is one shingle.
    Rows without an id link with nothing and are kept (component_id null). Repeated rows get the same answer; rows
    that share an id are one document. Other columns are not read. An empty table gives no rows."""
    docs = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    sk = materialize(sketches(docs, id_col, text_col, width), "sketches")
    full = sk.where("id is not null and n_shingles > 0")
    classes = materialize(full.groupBy("set_hash").agg(F.min("id").alias("rep")), "classes")
    reps = full.join(classes, (full.set_hash == classes.set_hash) & (full.id == classes.rep)).select("id", "n_shingles", "bands", "sig")
    reps = materialize(reps.dropDuplicates(["id"]), "reps")
    bands = reps.select("id", F.explode("bands").alias("bkey"))
    multi = materialize(bands.groupBy("bkey").agg(F.count(F.lit(1)).alias("mates")).where("mates > 1"), "buckets")
    rows = materialize(bands.join(multi, "bkey"), "mates")
    score = materialize(rows.groupBy("id").agg(F.sum("mates").alias("score")), "score")
    members = rows.select("bkey", "id").join(score, "id").join(reps.select("id", F.col("n_shingles").alias("n")), "id")
    members = materialize(members, "members")
    hubs = materialize(members.groupBy("bkey").agg(F.max_by(F.struct("id", "n"), F.struct("score", -F.col("id"))).alias("hub")), "hubs")
    text = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t"))
    sets = materialize(full_sets(text.join(score.select("id"), "id", "left_semi"), width).dropDuplicates(["id"]), "sets")
    close = F.least("n", "hub.n") * 100 >= F.greatest("n", "hub.n") * percent
    pairs = members.join(hubs, "bkey").where((F.col("id") != F.col("hub.id")) & close).select(F.col("id").alias("a"), F.col("hub.id").alias("b")).distinct()
    links = verify(pairs, sets, percent)
    comps = connected_components(links)
    more = stray_links(clusters(members, comps), sets.join(reps.select("id", "sig"), "id"), percent)
    if not more.isEmpty():
        comps = connected_components(links.union(more))
    own = materialize(classes.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("set_hash", F.coalesce("component", "rep").alias("c")), "classes")
    out = sk.select("id", "n_shingles", "set_hash").join(own, "set_hash", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("c")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(component)
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"), width=2)


