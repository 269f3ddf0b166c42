"""From raw documents to token ids: toxic documents go, near copies go, repeated passages go, benchmark leaks go, the rest is encoded.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. A stage sees the whole
of what the one before it kept, as Parquet. Rows with null ids or texts pass all stages unless toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltstone.llm import bpe, decontaminate, labelled, minhash, registry, store, substrings, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = toxicity.fit(docs, registry.table(spark, sf_dir, "labels"), labelled.remainder("doc_id", 5) != 0)
    return toxicity.remove(docs, net)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.remove(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = substrings.remove(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in left.columns else left


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, registry.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit) and the text decoded from them."""
    path = registry.byte_bpe()
    coded = bpe.encode(docs, path, carry=["doc_id", "lang", "source"]).select("row.doc_id", "row.lang", "row.source", "ids")
    return bpe.decode(coded, path).select("row.doc_id", "row.lang", "row.source", (F.octet_length("row.ids") / 4).cast("long").alias("n_tokens"), "row.ids", "res.text")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("bpe", encode),
]

#: The first two stages, trained and hashed, have no SQL; tests/llm/test_models.py holds all five on planted documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = registry.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store.written(stage(spark, docs, sf_dir), name)
    return docs
