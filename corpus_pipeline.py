"""A training corpus from ``documents``: each stage is one of the operators in ``tessera.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact, language, mixing, pieces, shingles, simhash
from tessera.llm._common import materialize, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go."""
    return language.known_language(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact.without_copies(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) one stays: linked fingerprints propose pairs as
    in op2, and bands of minima those that fingerprints do not reach; the sets decide."""
    return shingles.representatives(docs, proposed=simhash.text_pairs(docs))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the text that they decode to."""
    return pieces.encode_decode(docs, ("doc_id", "lang", "source"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained probabilities, fingerprints and tokens are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None
