"""A training corpus from raw documents: classify, drop exact and near copies, mask personal data, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The stages
are meant to be run one by one, each result written as Parquet and read as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmart.llm import exact_dedup, packing, pii, quality, simhash
from cellmart.llm.common import table, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it learns from the rated ones among docs."""
    model = quality.train(docs, quality.ratings(table(spark, sf_dir, "labels")))
    return quality.drop_rejected(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one of the smallest doc_id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, Jaccard similarity of 0.8 or more) the document of the smallest doc_id.

    SimHash and its pigeonhole blocks give the candidates within 4 bits, least hashes those farther apart; sets decide.
    """
    return simhash.drop_similar(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data masked."""
    return pii.mask(docs, pii.train(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences for training, with their ids' digest beside them."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality", classify), ("exact", exact), ("near", near), ("pii", private), ("packing", packed)]

#: SQL cannot express the classifier, SimHash's XXH64, the random field or the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, name)
    return docs
