"""The corpus pipeline, stage by stage, on documents with planted cases."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.data import SCHEMA, near, prose, rows
from tests.llm.test_operators import brute_repeats, check_sequences, toxic_rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    toxic = toxic_rows(300)
    docs = [*rows(), *((10_000 + i, t, "en", "s", len(t)) for i, t, _ in toxic)]
    base = prose(90, 150)
    docs += [(20_000 + i, near(base, i, 0.004), "en", "s", None) for i in range(5)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(10_000 + i, 1, y) for i, _, y in toxic], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages_keep_what_is_clean(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    toxic = {10_000 + i for i, _, y in toxic_rows(300) if y}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/out/{name}")
        docs = spark.read.parquet(f"{folder}/out/{name}")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    ids = lambda n: {r["doc_id"] for r in seen[n].select("doc_id").collect()}
    first = {r["doc_id"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len(toxic & ids("toxicity")) <= 0.05 * len(toxic) and first - toxic == ids("toxicity") - toxic
    left = ids("near_duplicates")
    assert 6 not in left and 5 in left and 20_000 in left and not left & {20_001, 20_002, 20_003, 20_004} and None in left
    before = {(r["doc_id"], r["text"]) for r in seen["near_duplicates"].collect()}
    after = {r["doc_id"]: r["text"] for r in seen["repeats"].collect() if r["doc_id"] is not None}
    order = sorted((x for x in before if x[0] is not None), key=lambda x: x[0])
    for (k, text), (_, kept, *_) in zip(order, brute_repeats(order, 100), strict=True):
        if len(text or "") < 20_000:
            assert after[k] == (None if text is None else kept.decode("utf-8", "ignore"))
    clean = {r["doc_id"]: r["text"] for r in seen["secrets"].collect()}
    assert "deadbeefdeadbeef" not in clean[15] and "[REDACTED]" in clean[15]
    assert all(clean[k] == t for k, t in after.items() if k != 15)
    pieces = seen["packing"].collect()
    check_sequences(pieces)
    assert {p["doc_id"] for p in pieces} == set(clean)


def test_run_equals_the_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.where(F.col("length") > 1024).count() == 0 and got.count() > 100


def test_stages_take_empty_tables(spark, folder):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_stages_take_rows_of_nulls_and_extra_columns(spark, folder):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0)], SCHEMA).withColumn("kept", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == (4 if name == "toxicity" else 3)
