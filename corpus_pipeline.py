"""A training-data pipeline over `documents`: quality rules, exact and near deduplication, mixing, encoding.

Each stage gets all rows that the one before has kept, as a written table, and returns the rows that it keeps with the
columns of documents; the last returns the encoded documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, exact_dedup, minhash, mixing, quality_rules
from tidemark.llm.common import Scratch, table
from tidemark.llm.queries import TOKENIZER
from tidemark.session import ship


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and empty texts have too few words and go; null doc_ids and repeated rows
    are rows like any other."""
    ship(spark)
    return quality_rules.keep_good(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the smallest doc_id; a null doc_id loses to any other, and
    rows that agree in doc_id and text are one."""
    ship(spark)
    return exact_dedup.keep_unique(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more; that of the smallest doc_id
    that links reach. Documents without words or with a null doc_id are linked with nothing and stay."""
    ship(spark)
    return minhash.keep_representatives(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and with the words, as the mix of sources to their targets takes them. A null source is a source,
    the last in order; documents without words give no row; rows equal in source, doc_id and text count as one."""
    ship(spark)
    return mixing.mix_documents(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of every document that the mix has, each as often as it occurs; a null
    text has no tokens."""
    ship(spark)
    return bpe.digests(bpe.encode_documents(docs, TOKENIZER), keep_ids=True)


STAGES = [
    ("quality rules", rules_stage),
    ("exact dedup", exact_stage),
    ("minhash near-dedup", near_stage),
    ("mixing", mix_stage),
    ("bpe", encode_stage),
]

#: Permutations, shingle sets and byte-pair merges are beyond SQL; tests/llm hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next."""
    ship(spark)
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        last = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.put(f"stage{k}", last)
            if k:
                scratch.drop(f"stage{k - 1}")
    return last
