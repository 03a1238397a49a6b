"""From raw documents to encoded training text: stages that each read what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from windrow.llm import bpe, exact_dedup, mixing, near_dedup, queries, rows, toxicity
from windrow.llm.store import saved
from windrow.session import small_batches


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.7."""
    small_batches(spark)
    return toxicity.without_toxic(docs, queries.toxicity_index(spark, docs, sf_dir), threshold=0.7)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest id."""
    digest = F.sha2(exact_dedup.normalised(docs["text"]), 256)
    groups = exact_dedup.exact_groups(docs, carry={"digest": digest})
    return rows.only(docs, groups.filter("kept"), digest=digest)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more).

    Rows are told apart by id and text, so a row that is dropped does not stay because another one with its id, or without an id, is kept.
    """
    small_batches(spark)
    digest = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    groups = near_dedup.near_groups(docs, shingle=5, similarity=(80, 100), carry={"digest": digest})
    return rows.only(docs, groups.filter("kept"), digest=digest)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs, weights=(5, 2, 1), share=1.5, most=2.0)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of ids and of the decoded text."""
    small_batches(spark)
    out = bpe.encode(docs, queries.word_vocabulary())
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", *queries.encoding_digests())


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("source_mix", mix_sources), ("bpe", encode_texts)]

#: Trained scores, hashed signatures, seeded draws and subword merges cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
