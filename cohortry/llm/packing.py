"""Packing of tokenised documents by the histogram of lengths, shortest pack first."""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm.bpe import PIECE, pieces
from cohortry.llm.common import map_rows, materialize, partitions, table

#: Parts into which the rows of one length are dealt for ranking; whole sequences, the commonest length, are dealt into
#: WHOLE for each shuffle partition. The table of their sizes has at most SALTS x width rows, and those of whole sequences.
SALTS, WHOLE = 256, 2


@lru_cache(maxsize=2)
def vocabulary(path: str):
    """The vocabulary of a `tokenizers` byte-level BPE file as an encoder of the tiktoken library, which gives the
    same ids (tested against `tokenizers`) about three times as fast. The file's added tokens are special here too."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in special}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special), tuple(special)


def token_ids(path: str, text: str | None) -> list[int]:
    if not text:
        return []
    enc, special = vocabulary(path)
    if any(s in text for s in special):
        return enc.encode(text, allowed_special="all")
    if len(text) <= PIECE:
        return enc.encode_ordinary(text)
    return [i for p in pieces(text) for i in enc.encode_ordinary(p)]


def spfhp(histogram: dict[int, int], width: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of each packing pattern. Lengths are placed longest first, each into the shortest pack.

    Works on counts of equal packs, so its time depends on the number of lengths and patterns, not of documents."""
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        room = width
        while n and room >= length:
            if not open_[room]:
                room -= 1
                continue
            count, pattern = open_[room].pop()
            used = min(n, count)
            if count > used:
                open_[room].append((count - used, pattern))
            open_[room - length].append((used, (*pattern, length)))
            n -= used
        if n:
            open_[width - length].append((n, (length,)))
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for packs in open_.values():
        for count, pattern in packs:
            merged[pattern] += count
    return sorted(((c, p) for p, c in merged.items()), key=lambda x: x[1], reverse=True)


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """By length: (first rank, number, first sequence, offset) of each slot of each pattern, in rank order."""
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    sequence = 0
    for count, pattern in patterns:
        offset = 0
        for length in pattern:
            out[length].append((ranks[length], count, sequence, offset))
            ranks[length] += count
            offset += length
        sequence += count
    return out


def cut(df: DataFrame, path: str, width: int, end_id: int, id_col: str, text_col: str, keep_ids: bool) -> DataFrame:
    """Pieces of each document: runs of `width` ids from its start, then what is left."""
    schema = T.StructType([df.schema[id_col], *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens"))])
    if keep_ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, rows, ids = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                all_ids = np.array([*token_ids(path, text), end_id], "<u4")
                for s in range(0, len(all_ids), width):
                    part = all_ids[s : s + width]
                    who.append(i)
                    rows.append((s, len(part), zlib.crc32(part.tobytes()), len(all_ids)))
                    if keep_ids:
                        ids.append(part.astype(np.int32))
            cols = [batch.column(0).take(pa.array(who, pa.int64())), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(4))]
            if keep_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return map_rows(df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), run, schema)


def pack(df: DataFrame, path: str, *, width: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, where asked for).

    Each text is encoded whole and ends with end_id; null and empty texts are that id alone. Equal rows are
    interchangeable: each of them gets a place of its own. An empty table gives no pieces. Columns other than id and
    text are not read."""
    spark = df.sparkSession
    salts = F.when(F.col("length") == width, F.lit(max(SALTS, WHOLE * partitions(spark)))).otherwise(F.lit(SALTS))
    salt = F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), salts).cast("int")
    parts = materialize(cut(df, path, width, end_id, id_col, text_col, keep_ids).withColumn("__salt", salt), "pack")
    sizes = parts.groupBy("length", "__salt").count().collect()  # at most width x SALTS rows
    histogram: dict[int, int] = defaultdict(int)
    before = []
    for r in sorted(sizes, key=lambda r: (r["length"], r["__salt"])):
        before.append((r["length"], r["__salt"], histogram[r["length"]]))
        histogram[r["length"]] += r["count"]
    place = slots(spfhp(dict(histogram), width))
    flat = [(length, *s) for length in sorted(place) for s in place[length]]
    table_ = np.array(flat, np.int64).reshape(-1, 5)
    firsts = {(a, b): c for a, b, c in before}
    bound = {length: (int(i), int(j)) for length in place for i, j in [np.searchsorted(table_[:, 0], [length, length + 1])]}

    # The part sizes and the slot table are small by construction and go along with the function.
    window_rank = F.expr(f"row_number() over (partition by length, __salt order by `{id_col}`, start, ids_crc32) - 1")
    ranked = parts.repartition(partitions(spark), "length", "__salt").withColumn("__rank", window_rank.cast("long"))
    base = [c for c in parts.columns if c != "__salt"]
    schema = T.StructType([parts.schema[c] for c in base] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, salts, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__salt", "__rank"))
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            rank = rank + np.array([firsts[k] for k in zip(length.tolist(), salts.tolist(), strict=True)], np.int64)
            for v in np.unique(length):
                i, j = bound[int(v)]
                at = np.flatnonzero(length == v)
                k = i + np.searchsorted(table_[i:j, 1], rank[at], "right") - 1
                seq[at], off[at] = table_[k, 3] + rank[at] - table_[k, 1], table_[k, 4]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in base), pa.array(seq), pa.array(off)], schema.names)

    return map_rows(ranked, run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
