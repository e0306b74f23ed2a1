"""Bounded labelled samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on at most: those with the least hash of their id.
SAMPLE = 40_000


def labelled(docs: DataFrame, labels: DataFrame, name: str, learn: Column, most: int = SAMPLE, seed: int = 11) -> DataFrame:
    """(doc_id, text, y) of at most `most` labelled documents that `learn` (of doc_id) admits.

    Repeated labels of an id count once, the largest; of rows that repeat an id that of the least text counts, null texts last. The id
    list is broadcast; its bound is `most`. Empty tables give no rows.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull() & learn).groupBy("doc_id").agg(F.max(name).cast("double").alias("y"))
    ids = ids.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
