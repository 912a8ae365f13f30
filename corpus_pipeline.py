"""A corpus from raw documents to packed sequences, in stages that each write what they keep."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpivane.llm import mixing, neardup, packing, pii, quality
from kpivane.llm.queries import table, tokenizer_file
from kpivane.sources.stage import settled, stage_root

CAPACITY = 4096
END_ID = 1
LEAST_QUALITY = 0.3
MOST_EPOCHS = 2.0


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"), LEAST_QUALITY)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.without_duplicates(docs)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and the words that reveal it, replaced by their kinds."""
    return pii.sanitised(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated and left out so that the domains meet their target weights."""
    return mixing.mixed_documents(docs, table(spark, sf_dir, "labels"), most=MOST_EPOCHS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most CAPACITY ids."""
    pieces = packing.token_pieces(docs, tokenizer_file(), CAPACITY, END_ID)
    return packing.best_fit(settled(pieces.withColumn("ids_crc32", F.crc32("tokens")).drop("tokens")), CAPACITY)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", remove_personal_data),
    ("mixing", mix_domains),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each is written to the shared folder and read again by the next."""
    root = f"{stage_root(spark).rstrip('/')}/pipeline-{uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs


#: SQL can express neither the trained stages nor the packing; tests compare each with brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
