"""From raw documents to packed training sequences: quality rules, near-duplicate removal, removal of repeated passages,
mixing of sources, packing.

Every stage takes (spark, docs, sf_dir), works on all documents that the one before has kept, and returns the columns of
``documents``; the last returns the places of the packed pieces. Nulls, empty texts, repeated rows and further columns
are treated as the operators say. Rows that share a doc_id stay or go together in the near-duplicate stage. A document that loses
all its text to earlier ones stays as an empty one and isn't drawn by the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import mixing, near, packing, quality, suffixes
from tidewatch.llm.queries import tokenizer
from tidewatch.plans.lineage import stage

#: SQL cannot express the classifier nor the tokenizer; the tests hold every stage against a plain version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the classifier, which is fitted on labelled documents."""
    return quality.keep(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at likeness 0.8 of five-word shingles, the one with the least doc_id."""
    return near.keep(docs, width=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 bytes and more that a document with a smaller doc_id has."""
    return suffixes.trim(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeat(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequence and offset of every piece of the documents."""
    return packing.pack(stage(packing.tokenise(docs, tokenizer())))


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
