"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airweave.llm import ann, common, licenses, media, packing, pieces, quality, simhash, substrings, templates, toxicity


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    common.small_batches(spark)
    return common.load(spark, sf_dir, table)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(load(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, 20)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = toxicity.remainder(3)
    return quality.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), lambda c: third(c) == 1)


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(load(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(load(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media_of_documents(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(load(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fifth = toxicity.remainder(5)
    held = lambda c: fifth(c) == 0
    docs = load(spark, sf_dir, "documents")
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"), "toxic", held)
    out = toxicity.scored(docs, model)
    return out.select("doc_id", F.coalesce(held(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_hits")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.digests(load(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_neighbours, op2_quality, op3_pieces, op4_substrings, op5_simhash, op6_packing, op7_media, op8_licenses, op9_toxicity, op10_lines)}


def oracle_sql() -> dict[str, str]:
    return {"op4_substrings": substrings.sql(), "op8_licenses": licenses.sql(), "op10_lines": templates.sql()}
