"""Removal of long repeats by suffix sorting, with difference-cover samples and one suffix bucket at a time.

A suffix is a candidate if its first `length` bytes may occur twice. Its bucket is that of its anchor, the k-mer of
least hash among those bytes: equal strings have equal anchors at equal places, so equal suffixes share a bucket.
Runs of suffixes with one anchor travel as one stretch of text, which keeps what is moved near the size of the
candidates. Anchors that occur once in the corpus rule their suffixes out without loss; equal stretches are merged in
their chunk and again in their bucket, so a passage in very many documents reaches a bucket once from each chunk.

In a bucket, the suffixes whose offsets fall into the difference cover are ranked first, by prefix doubling. Then all
suffixes are sorted by their first V bytes, and ties are resolved by the ranks of the cover samples that both suffixes
of a comparison reach at the same shift below V. Neighbours in that order with a common prefix of `length` bytes form
a class; all but its first suffix in corpus order start a repeat.

The number of buckets follows the input's size. An anchor so frequent that its suffixes would not be sorted at once is
split: the suffixes at STEP neighbouring distances before it form a group, keyed also by the bytes that all strings of
the group have in common, which is all but STEP - 1 of them. Equal strings have the same distance and the same bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm.common import map_rows, materialize, partitions, table

#: Difference cover modulo V: every residue is a difference of two members (31 = 5 * 5 + 5 + 1, a perfect one).
V, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Bytes of an anchor; bytes of text in a chunk; suffixes sorted at once.
ANCHOR, CHUNK, SUFFIXES = 24, 2 << 20, 1 << 18
#: Bytes of input to a bucket; occurrences from which an anchor is split, and into groups of how many distances.
BUCKET, FREQUENT, STEP = 8 << 20, 3000, 11
#: Suffixes of one document whose anchors are found at once.
SEGMENT = 1 << 20
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def words_at(text: np.ndarray) -> np.ndarray:
    """The big-endian 8-byte word at every offset; zeros follow the text."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(16, np.uint8)]).tobytes()
    out = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        k = (n - o + 7) // 8
        out[o::8] = np.frombuffer(padded, ">u8", k, o)
    return out


def anchors(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of suffixes of one document with one anchor: (start, suffixes, anchor's hash, anchor's offset)."""
    parts = []
    for s in range(0, max(0, len(text) - length + 1), SEGMENT):
        piece = text[s : s + SEGMENT + length - 1]
        n = len(piece) - length + 1
        w = words_at(piece)
        k = len(piece) - ANCHOR + 1
        h = (w[:k] * _A) ^ ((w[8 : 8 + k] * _B) >> np.uint64(7)) ^ (w[8 : 8 + k] * _C) ^ (w[16 : 16 + k] * _B)
        h = (h ^ (h >> np.uint64(29))) * _C
        h ^= h >> np.uint64(32)
        low = (h & ~np.uint64((1 << 22) - 1)) | np.arange(k, dtype=np.uint64)  # ties: the leftmost
        span, got = length - ANCHOR + 1, 1
        while 2 * got <= span:
            low = np.minimum(low[:-got], low[got:])
            got *= 2
        if got < span:
            low = np.minimum(low[: len(low) - (span - got)], low[span - got :])
        at = (low[:n] & np.uint64((1 << 22) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        parts.append((first + s, np.diff(np.append(first, n)), h[at[first]], at[first] + s))
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), z
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


_SHIFT = np.full((V, V), -1, np.int64)
for _i in range(V):
    for _j in range(V):
        _SHIFT[_i, _j] = next(k for k in range(V) if (_i + k) % V in COVER and (_j + k) % V in COVER)


def _ranks(keys: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of rows of keys, the first key counting most."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def suffix_order(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Order the suffixes at `at` by (at least) their first `depth` bytes; zeros follow the text."""
    size = len(text)
    w = words_at(np.concatenate([text, np.zeros(depth + 8 * V, np.uint8)]))
    head = lambda p: [w[p], w[p + 8], w[p + 16], w[p + 24] >> np.uint64(8)]  # noqa: E731  V bytes
    # Ranks of the cover samples, by doubling: samples a multiple of V apart have equal residues.
    rank = np.full(len(w), -1, np.int64)
    sample = np.flatnonzero(np.isin(np.arange(size + V) % V, COVER))
    rank[sample] = _ranks(head(sample))
    done = V
    while done < depth:
        rank[sample] = _ranks([rank[sample], rank[np.minimum(sample + done, len(w) - 1)]])
        done *= 2
    # All suffixes by their first V bytes.
    keys = head(at)
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(at) + 1, bool)
    new[0] = new[-1] = True
    for k in keys:
        s = k[order]
        new[1:-1] |= s[1:] != s[:-1]
    # Ties: three-way partition of every group at once, around a pivot, by the ranks at the common shift.
    bounds = np.flatnonzero(new)
    lows, highs = bounds[:-1], bounds[1:]
    open_ = highs - lows > 1
    lows, highs = lows[open_], highs[open_]
    while len(lows):
        sizes = highs - lows
        slot = np.repeat(lows, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        group = np.repeat(np.arange(len(lows)), sizes)
        p = at[order[slot]]
        pivot = np.repeat(at[order[(lows + highs) // 2]], sizes)
        shift = _SHIFT[p % V, pivot % V]
        key = group * 3 + 1 + np.sign(rank[p + shift] - rank[pivot + shift])
        to = np.argsort(key, kind="stable")
        order[slot] = order[slot[to]]
        key = key[to]
        cut = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        side, a, b = key[cut[:-1]] % 3, cut[:-1], cut[1:]
        left = (side != 1) & (b - a > 1)  # equals of the pivot are settled
        lows, highs = slot[a[left]], slot[b[left] - 1] + 1
    return order


def repeats(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Those of the ascending offsets `at` whose first `length` bytes also start at an earlier one of them."""
    if len(at) < 2:
        return at[:0]
    sa = at[suffix_order(text, at, length)]
    w = words_at(np.concatenate([text, np.zeros(length + 8, np.uint8)]))
    pair = np.arange(len(sa) - 1)
    for o in [*range(0, length - 8, 8), length - 8]:
        pair = pair[w[sa[pair] + o] == w[sa[pair + 1] + o]]
    same = np.zeros(len(sa), bool)
    same[pair + 1] = True
    cls = np.cumsum(~same) - 1
    first = np.full(cls[-1] + 1, len(text), np.int64)
    np.minimum.at(first, cls, sa)
    return np.sort(sa[sa != first[cls]])


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """The arrays' sizes and bytes; compressed if there are enough of them. The first byte says which."""
    body = np.array([a.nbytes for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)
    return b"z" + zstandard.compress(body, 1) if len(body) > 512 else b"p" + body


def unpack_arrays(blob: bytes, *types: type) -> list[np.ndarray]:
    body = zstandard.decompress(blob[1:]) if blob[:1] == b"z" else blob[1:]
    at, out = 8 * len(types), []
    for t, n in zip(types, np.frombuffer(body, np.int64, len(types)).tolist(), strict=True):
        out.append(np.frombuffer(body[at : at + n], t))
        at += n
    return out


def chunked(df: DataFrame, text_col: str) -> DataFrame:
    """(chunk, rows): rows of df in chunks of about CHUNK bytes of text, as compressed Arrow data."""
    n = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            t = pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                out.write_table(t)
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | seq], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "rows"])

        for batch in batches:
            start = 0
            lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(n)), 0).to_numpy()
            for i, k in enumerate(lengths.tolist()):
                size += k
                if size >= CHUNK:
                    held.append(batch.slice(start, i + 1 - start))
                    yield flush()
                    held, size, start, seq = [], 0, i + 1, seq + 1
            if start < len(lengths):
                held.append(batch.slice(start))
        if held:
            yield flush()

    return map_rows(df, run, "chunk long, rows binary")


def _rows(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _texts(t: pa.Table, text_col: str) -> list[np.ndarray]:
    return [np.frombuffer((x or "").encode("utf-8", "surrogatepass"), np.uint8) for x in t.column(text_col).to_pylist()]


def anchor_counts(chunks: DataFrame, text_col: str, length: int, buckets: int) -> DataFrame:
    """(bucket, chunk, many, hashes): the distinct anchors of a chunk, with those first that it holds at several places; many: at how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = []
                for text in _texts(_rows(blob), text_col):
                    _, _, h, at = anchors(text, length)
                    keep = np.ones(len(h), bool)
                    keep[1:] = at[1:] != at[:-1]  # a run cut between segments has one anchor
                    found.append(h[keep])
                h, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
                b = (h % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((n < 2, b))
                h, n, b = h[order], n[order].astype(np.int32), b[order]
                ends = [*np.flatnonzero(np.append(True, b[1:] != b[:-1])).tolist(), len(b)] if len(b) else [0]
                cut = list(zip(ends, ends[1:], strict=False))
                many = [(lambda x: x[x > 1].tobytes())(n[s:e]) for s, e in cut]
                yield pa.RecordBatch.from_arrays([pa.array([int(b[s]) for s, _ in cut], pa.int32()), pa.array([chunk] * len(cut), pa.int64()), pa.array(many, pa.binary()), pa.array([h[s:e].tobytes() for s, e in cut], pa.binary())], ["bucket", "chunk", "many", "hashes"])

    return map_rows(chunks, run, "bucket int, chunk long, many binary, hashes binary")


def shared_anchors(counts: DataFrame) -> DataFrame:
    """(chunk, shared, frequent): those anchors of a chunk that occur at two places of the corpus or more, and at FREQUENT or more."""
    limit = FREQUENT

    def run(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b, np.uint64) for b in t.column("hashes").to_pylist()]
        h = np.concatenate(parts)
        n = np.ones(len(h), np.int64)
        at = 0
        for p, b in zip(parts, t.column("many").to_pylist(), strict=True):
            m = np.frombuffer(b, np.int32)
            n[at : at + len(m)] = m
            at += len(p)
        _, inv = np.unique(h, return_inverse=True)
        total = np.bincount(inv, weights=n).astype(np.int64)[inv] if len(h) else n
        at, chunks, data, often = 0, [], [], []
        for p, c in zip(parts, t.column("chunk").to_pylist(), strict=True):
            k = total[at : at + len(p)]
            at += len(p)
            if (k > 1).any():
                chunks.append(c)
                data.append(p[k > 1].tobytes())
                often.append(p[k >= limit].tobytes())
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "shared": pa.array(data, pa.binary()), "frequent": pa.array(often, pa.binary())})

    return counts.groupBy("bucket").applyInArrow(run, "chunk long, shared binary, frequent binary")


_STRETCH = (np.int64, np.int32, np.int64, np.int32, np.uint64, np.uint8)


def split_run(data: bytes, start: int, n: int, anchor: int, at: int, length: int, step: int) -> Iterator[tuple[int, int, int]]:
    """(start, suffixes, key) of the groups of a run whose anchor, at offset `at`, is frequent."""
    far = length - ANCHOR
    for d in range((at - start - n + 1) // step * step, at - start + 1, step):
        last = min(d + step - 1, far)
        first, end = max(start, at - last), min(start + n - 1, at - d) + 1
        yield first, end - first, xxhash.xxh3_64_intdigest(data[at - d : at - last + length], seed=(anchor + d) & (1 << 64) - 1)


def stretches(chunks: DataFrame, shared: DataFrame, id_col: str, text_col: str, length: int, buckets: int) -> DataFrame:
    """(bucket, chunk, kind, data): candidate stretches by bucket (kind 0); repeats known within the chunk (kind 1)."""
    step = STEP

    def run(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"bucket": [], "chunk": [], "kind": [], "data": []}
        if len(left) and len(right):
            hot = np.unique(np.concatenate([np.frombuffer(b, np.uint64) for b in right.column("shared").to_pylist()]))
            often = set(np.concatenate([np.frombuffer(b, np.uint64) for b in right.column("frequent").to_pylist()]).tolist())
            chunk, rows = left.column("chunk")[0].as_py(), _rows(left.column("rows")[0].as_py())
            ids = [(i is None, i or 0) for i in rows.column(id_col).to_pylist()]
            texts = _texts(rows, text_col)
            seen: set[bytes] = set()
            local, mine = [], []
            for k in sorted(range(len(ids)), key=lambda k: (ids[k], k)):
                start, n, h, at = anchors(texts[k], length)
                data = texts[k].tobytes()
                for i in np.flatnonzero(hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h):
                    s, m, a = int(start[i]), int(n[i]), int(h[i])
                    for s, m, key in split_run(data, s, m, a, int(at[i]), length, step) if a in often else ((s, m, a),):  # noqa: PLW2901
                        piece = data[s : s + m + length - 1]
                        if piece in seen:
                            local.append((k, s, m))
                        else:
                            seen.add(piece)
                            mine.append((k, s, m, key, piece))
            by = np.array([x[3] % buckets for x in mine], np.int64)
            order = np.argsort(by, kind="stable")
            edges = np.flatnonzero(np.append(True, by[order][1:] != by[order][:-1])).tolist() if mine else []
            for e, f in zip(edges, [*edges[1:], len(mine)], strict=True):
                b, some = by[order[e]], [mine[i] for i in order[e:f].tolist()]
                who = np.array([np.iinfo(np.int64).max if ids[x[0]][0] else ids[x[0]][1] for x in some], np.int64)
                cols = (who, *(np.array([x[j] for x in some], t) for j, t in enumerate(_STRETCH[1:5])), np.frombuffer(b"".join(x[4] for x in some), np.uint8))
                out["bucket"].append(int(b)), out["chunk"].append(chunk), out["kind"].append(0), out["data"].append(pack_arrays(*cols))
            if local:
                cols = np.array(local, np.int64).T
                out["bucket"].append(chunk % buckets), out["chunk"].append(chunk), out["kind"].append(1), out["data"].append(pack_arrays(*cols))
        return pa.table([pa.array(out["bucket"], pa.int32()), pa.array(out["chunk"], pa.int64()), pa.array(out["kind"], pa.int32()), pa.array(out["data"], pa.binary())], names=list(out))

    return chunks.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(run, "bucket int, chunk long, kind int, data binary")


def sort_bucket(parts: list[tuple[int, tuple[np.ndarray, ...]]], length: int) -> dict[int, list[np.ndarray]]:
    """By chunk: (row, start, suffixes) of the repeats among the stretches of a bucket."""
    chunk = np.concatenate([np.full(len(p[0]), c, np.int64) for c, p in parts])
    who, row, start, n, h = (np.concatenate([p[j] for _, p in parts]) for j in range(5))
    pieces: list[bytes] = []
    for _, p in parts:
        data, at = p[5].tobytes(), 0
        for m in p[3].tolist():
            pieces.append(data[at : at + m + length - 1])
            at += m + length - 1
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    order = np.lexsort((start, row, chunk, who))  # corpus order; rows without an id come last
    seen: set[bytes] = set()
    known, rest = [], []
    for i in order.tolist():  # equal stretches: all but the first are repeats
        (known if pieces[i] in seen else rest).append(i)
        seen.add(pieces[i])
    known, rest = np.array(known, np.int64), np.array(rest, np.int64)
    found.append((chunk[known], row[known].astype(np.int64), start[known], n[known].astype(np.int64)))
    # One suffix bucket at a time: anchors in order of their hash, cut into groups of about SUFFIXES.
    rest = rest[np.argsort(h[rest], kind="stable")]
    last = np.append(h[rest][1:] != h[rest][:-1], True) if len(rest) else np.zeros(0, bool)
    bucket = np.cumsum(n[rest]) // SUFFIXES
    cuts = [0]
    for e in (np.flatnonzero(last) + 1).tolist():
        if e == len(rest) or bucket[e - 1] != bucket[cuts[-1]]:
            cuts.append(e)
    for s, e in zip(cuts, cuts[1:], strict=False):
        some = rest[s:e]
        some = some[np.lexsort((start[some], row[some], chunk[some], who[some]))]
        text = np.frombuffer(b"".join(pieces[i] for i in some.tolist()), np.uint8)
        m = n[some].astype(np.int64)
        base = np.cumsum(m + length - 1) - (m + length - 1)
        at = np.repeat(base - (np.cumsum(m) - m), m) + np.arange(m.sum())
        hit = repeats(text, at, length)
        if len(hit):
            own = np.searchsorted(base, hit, "right") - 1
            new = np.append(True, (hit[1:] != hit[:-1] + 1) | (own[1:] != own[:-1]))
            f = np.flatnonzero(new)
            who_ = some[own[f]]
            found.append((chunk[who_], row[who_].astype(np.int64), start[who_] + hit[f] - base[own[f]], np.diff(np.append(f, len(hit)))))
    c, r, s, m = (np.concatenate(x) for x in zip(*found, strict=True))
    out: dict[int, list[np.ndarray]] = {}
    order = np.argsort(c, kind="stable")
    edges = np.append(np.flatnonzero(np.append(True, c[order][1:] != c[order][:-1])), len(order)) if len(order) else [0]
    for a, b in zip(edges, edges[1:], strict=False):
        i = order[a:b]
        out[int(c[i[0]])] = [r[i], s[i], m[i]]
    return out


def found_repeats(work: DataFrame, length: int) -> DataFrame:
    """(chunk, found): rows, starts and numbers of repeated suffixes."""

    def run(t: pa.Table) -> pa.Table:
        chunks, data, parts = [], [], []
        for chunk, kind, blob in zip(t.column("chunk").to_pylist(), t.column("kind").to_pylist(), t.column("data").to_pylist(), strict=True):
            if kind:
                chunks.append(chunk)
                data.append(blob)
            else:
                parts.append((chunk, unpack_arrays(blob, *_STRETCH)))
        if parts:
            for chunk, cols in sort_bucket(parts, length).items():
                chunks.append(chunk)
                data.append(pack_arrays(*(c.astype(np.int64) for c in cols)))
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "found": pa.array(data, pa.binary())})

    return work.groupBy("bucket").applyInArrow(run, "chunk long, found binary")


def _merge(n: int, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of covered bytes."""
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, s[1:] > e[:-1])
    f = np.flatnonzero(new)
    return s[f], np.minimum(e[np.append(f[1:] - 1, len(e) - 1)], n)


def remove_repeats(df: DataFrame, *, length: int = 100, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """df without text_col, with n_bytes, n_removed, n_spans and kept_sha256 of each row.

    keep: further columns, of `kept` (the bytes left) and `kept_text` (those bytes as text; characters cut in part go).

    A byte goes if a string of `length` bytes that covers it also starts earlier: in a row of smaller id, or earlier in
    the same row. Rows of equal id follow the order in which they were read, rows without an id come last. Null and
    empty texts, and texts shorter than `length`, lose nothing. Columns of df with a new column's name are replaced;
    an empty table stays empty."""
    new = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    new += [T.StructField("kept", T.BinaryType())] if "kept" in keep else []
    new += [T.StructField("kept_text", T.StringType())] if "kept_text" in keep else []
    taken = {f.name.lower() for f in new}
    cols = [c for c in df.columns if c == text_col or c.lower() not in taken]
    df = df.select(*[F.col(f"`{c}`") for c in cols])
    spark = df.sparkSession
    chunks = materialize(chunked(df, text_col), "chunks")
    buckets = max(partitions(spark), chunks.count() * CHUNK // BUCKET)
    shared = materialize(shared_anchors(anchor_counts(chunks, text_col, length, buckets)), "anchors")
    work = stretches(chunks, shared, id_col, text_col, length, buckets)
    found = found_repeats(work, length)
    rest = [c for c in cols if c != text_col]
    schema = T.StructType([df.schema[c] for c in rest] + new)

    def finish(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = _rows(left.column("rows")[0].as_py())
        texts = _texts(rows, text_col)
        got = [unpack_arrays(b, np.int64, np.int64, np.int64) for b in right.column("found").to_pylist()]
        r, s, m = (np.concatenate([g[j] for g in got]) if got else np.zeros(0, np.int64) for j in range(3))
        order = np.argsort(r, kind="stable")
        r, s, m = r[order], s[order], m[order]
        edges = np.searchsorted(r, np.arange(len(texts) + 1))
        out = [[] for _ in new]
        for k, text in enumerate(texts):
            a, b = edges[k], edges[k + 1]
            spans, left, gone = 0, text.tobytes(), 0
            if a < b:
                start, end = _merge(len(text), s[a:b], s[a:b] + m[a:b] + length - 1)
                pieces, at = [], 0
                for x, y in zip(start.tolist(), end.tolist(), strict=True):
                    pieces.append(left[at:x])
                    at = y
                left = b"".join([*pieces, left[at:]])
                spans, gone = len(start), int((end - start).sum())
            for f, col in zip(new, out, strict=True):
                col.append({"n_bytes": len(text), "n_removed": gone, "n_spans": spans}[f.name] if f.name.startswith("n_") else hashlib.sha256(left).hexdigest() if f.name == "kept_sha256" else left if f.name == "kept" else left.decode("utf-8", "ignore"))
        types = {"LongType()": pa.int64(), "StringType()": pa.string(), "BinaryType()": pa.binary()}
        return pa.table([*(rows.column(c) for c in rest), *(pa.array(c, types[str(f.dataType)]) for c, f in zip(out, new, strict=True))], names=schema.names)

    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(finish, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
