"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written and read again as
the next stage's ``docs``.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import bpe, mixing, near_copies, pii, quality_rules, simhash
from pulsegrid.llm.common import materialise, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the compression bands reject go."""
    return quality_rules.keep_good(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by fingerprint or by five-word shingles, the document with the least id stays."""
    return simhash.keep_one(docs, alike=near_copies.ALIKE)


def private_data_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it are replaced."""
    return pii.sanitise(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them."""
    return mixing.mix(docs)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids (little-endian 32-bit) and number; ``text`` is what the ids decode to."""
    encoded = bpe.encode(docs, bpe.default_path(), back="text")
    return encoded.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES = [
    ("quality rules", good_documents),
    ("SimHash near-dedup", distinct_documents),
    ("PII", private_data_removed),
    ("mixing sources to target weights", mixed_sources),
    ("BPE encoding and decoding", encoded_documents),
]

#: Compression ratios, fingerprints, sampling keys and merges are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
