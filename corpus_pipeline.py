"""A corpus pipeline of five stages. Part of the subpackage of training-data operators.

Each stage takes the documents that the stage before it kept and decides on all of them: toxic documents go, of each
group of near duplicates one document stays, repeated passages and secrets leave the texts, and what is left is packed
into sequences. All but the last stage return the columns of documents; n_chars follows the text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm import neardup, packing, secrets, suffix, toxicity
from cohortry.llm.common import clean, held_out, materialize, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the toxic-span model scores below 0.5; it learns from labelled rows outside the held-out fold."""
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), allowed=lambda i: ~held_out(i))
    return toxicity.tag(docs, model, outputs=("predicted",)).where("predicted = 0").select(*COLUMNS)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, of the smallest id, of each group linked by similarity of five-word shingles.

    Of rows with equal id and text one stays. Rows without an id link with nothing and stay."""
    docs = docs.select(*COLUMNS)
    kept = neardup.deduplicate(docs).where("kept and doc_id is not null").select("doc_id")
    # One shuffle by id serves the join and the removal of repeated rows.
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").withColumn("__text", F.xxhash64("text"))
    return named.dropDuplicates(["doc_id", "__text"]).select(*COLUMNS).union(docs.where("doc_id is null"))


def stage_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every byte of a 100-byte string that starts earlier in the corpus. Characters cut in part go whole; documents stay, even if emptied."""
    done = suffix.remove_repeats(docs.select(*COLUMNS, F.col("text").isNull().alias("__null")), keep=("kept_text",))
    text = F.when(~F.col("__null"), F.col("kept_text"))
    n = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return done.select("doc_id", text.alias("text"), "lang", "source", n.alias("n_chars"))


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark. Documents without one are unchanged."""
    found = secrets.redact(secrets.scan(docs.select(*COLUMNS)))
    n = F.when(F.size("secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n).select(*COLUMNS)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stage_toxicity),
    ("near_duplicates", stage_near_duplicates),
    ("repeats", stage_repeats),
    ("secrets", stage_secrets),
    ("packing", stage_packing),
]

#: The stages train a model and decode bytes, which SQL cannot express; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next.

    What a stage has written for itself is deleted once its result is written, and that once the next one's is. The last
    stage's result is lazy: clean() deletes its tables when the result is saved."""
    docs, since = table(spark, sf_dir, "documents"), written()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
            clean(spark, since, keep=1)
    return docs
