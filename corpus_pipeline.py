"""A training corpus from ``documents``: five stages, each over all that its predecessor kept.

Every stage but the last returns the columns of its input. Ids, lang and source
are carried; the text changes, and n_chars with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airweave.llm import packing, simhash, substrings, templates, toxicity
from airweave.llm.common import small_batches, stored
from airweave.llm.queries import load, tokenizer_path


def counted(docs: DataFrame) -> DataFrame:
    """``docs`` with the number of characters that their texts have now."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from all labels of these documents, scores under 0.5."""
    held = lambda c: F.lit(False)
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"), "toxic", held)
    return toxicity.without_toxic(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of templates that recur in five texts or more, but for each one's first."""
    small_batches(spark)
    return counted(templates.drop_recurring(docs, keep_first=True))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: by fingerprint, and with a similarity of 0.8 of five-word shingles or more."""
    small_batches(spark)
    return simhash.one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 35 words or more that occur elsewhere."""
    small_batches(spark)
    return counted(substrings.remove_repeats(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 1024: the pieces of each, with their ids."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), with_ids=True)


STAGES = [("toxicity", toxic), ("lines", lines), ("near_copies", near_copies), ("passages", passages), ("packing", packed)]
#: SQL has no learned model, fingerprint or tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
