"""Byte-level BPE: encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cohortry.llm.common import table, with_arrow_columns

#: Texts longer than this many code points are cut at safe boundaries before encoding.
PIECE = 1 << 16
#: Between a character that is not white space and a space or line end, a match of the pattern always ends: white space
#: stands only at the start of a match or makes up all of it. Engines differ over rarer white space, which is left alone.
_SAFE = regex.compile(r"(?<=\S)(?=[ \n])")
#: What encoding can return for each text; nothing else leaves the Python worker. The digests are lowercase hex: of the
#: decimal ids joined by commas, and of the bytes that the ids decode to.
OUTPUTS = {
    "ids": T.ArrayType(T.IntegerType()),
    "n_tokens": T.LongType(),
    "decoded": T.BinaryType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoding(path: str):
    """One encoder for each rank file and Python worker."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


def pieces(text: str, size: int = PIECE) -> list[str]:
    """Cut text at safe boundaries into pieces of about `size`; encoding the pieces equals encoding the text."""
    out, at = [], 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


@lru_cache(maxsize=4)
def _decimals(path: str) -> list[str]:
    return [str(i) for i in range(encoding(path).n_vocab)]


def encode_text(enc, text: str | None) -> np.ndarray:
    """Token ids; special tokens are ordinary text."""
    if not text:
        return np.zeros(0, np.uint32)
    parts = [enc.encode_to_numpy(p, disallowed_special=()) for p in (pieces(text) if len(text) > PIECE else [text])]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate([*rows, np.zeros(0, np.uint32)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", *, outputs: Iterable[str] = ("ids",), keep: Iterable[str] | None = None) -> DataFrame:
    """The columns `keep` of df (all by default) with what `outputs` names (see OUTPUTS) for each whole text.

    Null and empty texts have no ids and decode to no bytes; special tokens are ordinary text. Rows are independent: ties
    and repeated rows each get their own ids, an empty table gives an empty table, other columns pass through, and a
    column with the name of an output (ids_col for the ids) is replaced."""
    outputs = list(outputs)

    def fn(texts: list) -> list[pa.Array]:
        enc, cols = encoding(path), {o: [] for o in outputs}
        for text in texts:
            ids = encode_text(enc, text)
            listed = ids.tolist() if cols.keys() - {"ids", "n_tokens"} else []
            data = enc.decode_bytes(listed) if cols.keys() & {"decoded", "decoded_sha256"} else b""
            for o, col in cols.items():
                if o == "ids":
                    col.append(ids)
                elif o == "n_tokens":
                    col.append(len(ids))
                elif o == "decoded":
                    col.append(data)
                elif o == "ids_sha256":
                    col.append(hashlib.sha256(",".join(map(_decimals(path).__getitem__, listed)).encode()).hexdigest())
                else:
                    col.append(hashlib.sha256(data).hexdigest())
        kinds = {"n_tokens": pa.int64(), "decoded": pa.binary()}
        return [_lists(col) if o == "ids" else pa.array(col, kinds.get(o, pa.string())) for o, col in cols.items()]

    fields = [T.StructField(ids_col if o == "ids" else o, OUTPUTS[o]) for o in outputs]
    return with_arrow_columns(df, text_col, fields, fn, keep)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded", *, keep: Iterable[str] | None = None) -> DataFrame:
    """df with the raw bytes of each id list (any cut of ids decodes: bytes need not be UTF-8). Null gives no bytes."""

    def fn(rows: list) -> list[pa.Array]:
        enc = encoding(path)
        return [pa.array([enc.decode_bytes(r) if r else b"" for r in rows], pa.binary())]

    return with_arrow_columns(df, ids_col, [T.StructField(out_col, T.BinaryType())], fn, keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, path, outputs=("n_tokens", "ids_sha256", "decoded_sha256"), keep=["doc_id"])
