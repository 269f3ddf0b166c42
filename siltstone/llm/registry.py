"""Queries of this subpackage over the tables of one folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, decontaminate, html, labelled, language, minhash, oracle, quality, repair, substrings, toxicity, vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def classified(scored: DataFrame, held) -> DataFrame:
    doc_id = F.col("row.doc_id")
    return scored.select(doc_id.alias("doc_id"), F.coalesce(held(doc_id), F.lit(False)).alias("held_out"), F.col("res.score").alias("score"), (F.col("res.score") >= 0.5).cast("int").alias("predicted"))


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), byte_bpe(), carry=["doc_id"])
    decoded = bpe.decode(coded.select("row.doc_id", "ids"), byte_bpe())
    return decoded.select("row.doc_id", (F.octet_length("row.ids") / 4).cast("long").alias("n_tokens"), F.sha2("row.ids", 256).alias("ids_sha256"), F.sha2(F.col("res.text").cast("binary"), 256).alias("decoded_sha256"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("*", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("row.doc_id", "res.n_words", "res.n_removed", F.sha2(F.col("res.kept").cast("binary"), 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), labelled.remainder("doc_id", 5) != 0)
    return classified(toxicity.score(docs, net, carry=["doc_id"]), lambda c: labelled.remainder(c, 5) == 0)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(labelled.remainder("doc_id", 7) == 2, F.lit(False))
    found = language.score(table(spark, sf_dir, "documents"), ~held, carry=["doc_id"])
    held = F.coalesce(labelled.remainder(F.col("row.doc_id"), 7) == 2, F.lit(False))
    return found.select("row.doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(table(spark, sf_dir, "pages"), carry=["page_id", "url"])
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = repair.in_order(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # each worker learns its words: the documents are dealt out and encoded in one pass
    coded = bpe.encode(docs, byte_bpe(), counted=False, carry=["doc_id"])
    end = (2).to_bytes(4, "little")
    found = repair.read(repair.write(coded.select("row.doc_id", F.concat("ids", F.lit(end)).alias("ids"))))
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    items = F.array_distinct(F.col("res.matches.item_id"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("res.n_words").alias("n_words"),
        F.aggregate("res.spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"])).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items.cast("array<string>")), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("res.spans") > 0).alias("contaminated"),
    )


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.fit(docs, table(spark, sf_dir, "labels"), labelled.remainder("doc_id", 3) != 1)
    return classified(quality.score(docs, weights, carry=["doc_id"]), lambda c: labelled.remainder(c, 3) == 1)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and class_id of each document; kept: whether it stays. Documents with a null id are in no class."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.classes(docs).select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [op1_bpe, op2_embedding_near_dedup, op3_substring_dedup, op4_toxicity, op5_lm_scoring, op6_html_extraction, op7_token_output, op8_benchmark_decontamination, op9_quality_classifier, op10_minhash_near_dedup]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
