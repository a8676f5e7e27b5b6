"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

1. language ID: documents whose language isn't recognised go
2. exact dedup: of equal texts one document stays
3. MinHash near-dedup (five words, similarity 0.8): of each group the document with the smallest doc_id stays
4. secret scans: the spans found are masked, all documents stay
5. packing: the texts' ids in sequences of at most 2048

All but the last return the columns of documents. Null texts go with stage 1; empty tables give empty results throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge.llm.common import read_table, written
from codegauge.llm.exact_dedup import keep_first
from codegauge.llm.language_id import keep_known
from codegauge.llm.near_dedup import keep_one
from codegauge.llm.packing import packed
from codegauge.llm.secret_scan import redact


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_known(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("secret scan", secret_scan),
    ("packing", packing),
]

#: The learned and the packing stages can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
