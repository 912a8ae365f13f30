"""Labelled rows for training, and the split into training and held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column | str) -> Column:
    """True for the fifth of the rows that no model may learn from; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def training_rows(labels: DataFrame, label: str, most: int) -> DataFrame:
    """At most `most` labelled rows of each class (0 and 1) outside the held-out fifth: doc_id and label.

    The rows with the smallest hashes of their ids, so that a rerun takes the same. Null ids and labels
    are left out; of a repeated id the smallest label counts.
    """
    known = (
        labels.select(F.col("doc_id").cast("bigint"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.min("label").alias("label"))
    )
    parts = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def with_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents of a bounded set of training rows; the set is sent to the scan, the texts do not move."""
    return docs.join(F.broadcast(rows), "doc_id")
