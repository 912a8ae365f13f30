"""The registered queries of this subpackage, `opN_<name>`, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stage import settled, stage_root
from . import centroids, chat, digests, grammar, hamming, mixing, neardup, packing, pii, quality, spelling, toxicity, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of at most 4096 ids."""
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), tokenizer_file(), 4096, 1)
    pieces = settled(pieces.withColumn("ids_crc32", F.crc32("tokens")).drop("tokens"))
    return packing.best_fit(pieces, 4096)


@query
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share three quarters of their five-word shingles."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors, rates and copies of all documents for the default target mix."""
    return mixing.document_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest binary codes of every vector whose id is divisible by 20, among all vectors."""
    codes = settled(table(spark, sf_dir, "embeddings").select("vec_id", hamming.sign_code("embedding").alias("code")))
    return hamming.top_k(codes, codes.where("vec_id % 20 = 0"), 10)


@query
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, and the words that reveal it."""
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    kinds = (*pii.KINDS, "term")
    return found.select(
        "doc_id", *[pii.count_of(k, "base").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.span_list("base", kinds), 256).alias("base_sha256"),
        pii.span_list(F.concat("base", "terms"), kinds).alias("spans"), F.size("terms").cast("bigint").alias("n_term"))


@query
def op7_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors of one label with a cosine of at least 0.93."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as grammar-compressed id files and read back."""
    path = f"{stage_root(spark).rstrip('/')}/ids-{uuid4().hex}"
    grammar.write_ids(table(spark, sf_dir, "documents"), path, tokenizer_file(), 2)
    return grammar.read_ids(spark, path).withColumn("ids_crc32", F.crc32("tokens")).drop("tokens")


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation rendered from the perspective of each of its participants."""
    return chat.perspectives(table(spark, sf_dir, "conversations"))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, forms and roots of the frequent words of all documents."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query
def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and their likeness."""
    return digests.fingerprints(table(spark, sf_dir, "documents"))


@query
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 components in 40 clusters after five rounds."""
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


SQL["op2_minhash_near_dedup"] = neardup.NEAR_DUPLICATES_SQL
SQL["op7_vector_near_dedup"] = vectors.NEAR_VECTORS_SQL
SQL["op10_chat_perspectives"] = chat.PERSPECTIVES_SQL
SQL["op13_centroid_clusters"] = centroids.CLUSTERED_SQL
SQL["op5_exact_top_k"] = """
WITH sound AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x > 0) AS signs
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.signs, v.signs), lambda p: (p[1] <> p[2])::INT)) AS distance
  FROM sound q JOIN sound v ON q.vec_id <> v.vec_id
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""
