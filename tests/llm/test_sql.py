"""Registered queries against their SQL, and all of them over the smallest tables."""

import os

import duckdb
import pytest

from cohortry.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    got = sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    assert got == sorted(tuple(r[rel.columns.index(c)] for c in sorted(df.columns)) for r in rel.fetchall())


COLUMNS = {
    "op1": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op2": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op3": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op4": "page_id url text n_chars",
    "op5": "doc_id held_out score predicted",
    "op6": "vec_id n_links component_id kept",
    "op7": "doc_id held_out lang_pred score",
    "op8": "doc_id n_shingles component_id kept",
    "op9": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op10": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
}


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n != "pipeline"))
def test_query_covers_its_table(spark, name):
    df = QUERIES[name](spark, FOLDER)
    op = name.split("_")[0]
    assert df.columns == COLUMNS[op].split()
    key = df.columns[0]
    source = {"page_id": "pages", "vec_id": "embeddings"}.get(key, "documents")
    have = {r[0] for r in df.select(key).collect()}
    assert have == {r[0] for r in spark.read.parquet(f"{FOLDER}/{source}.parquet").select(key).collect()}
