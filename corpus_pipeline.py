"""From raw documents to encoded training text: reject toxic documents, keep one of each near-duplicate group, cut out secrets, mix sources
to target weights, encode. Each stage is written to the shared folder and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm import bpe, mixing, secrets, simhash, toxicity
from scholia.llm.common import stage


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not predict toxic. Copies of an id are judged by their own text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(*toxicity.training_sample(docs, labels, ~toxicity.held_out("doc_id", 4, 2)))
    return docs.where(toxicity.scorer(spark, model)("text") < toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: one with the smallest id. A group without any id keeps one document too."""
    return simhash.representatives(docs)


def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in training order."""
    return mixing.curriculum(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`doc_id`, `n_tokens` and `ids` (little-endian unsigned 32-bit) of each document."""
    return (bpe.encode(docs, bpe.vocabulary_path())
            .select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids"))


STAGES = [("toxicity", reject_toxic), ("simhash_near_dedup", drop_near_duplicates), ("secret_scan", cut_secrets),
          ("source_mixing", mix_sources), ("bpe_encoding", encode_texts)]

# Embeddings, component search and byte-pair merges have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
