"""Bounded samples of labelled rows, for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.runtime import texts_of


def sample(docs: DataFrame, labels: DataFrame, column: str, most: int, *more: str) -> DataFrame:
    """doc_id, text, y (0 or 1) and more (0, 1 or null) of labelled rows; beyond most ids, those with the least hashes.

    Null labels and ids are left out; of several labels of an id the largest counts, and of several texts the one with the least
    hash, so there are at most as many rows as ids. Columns of more that labels has not are null.
    """
    own = [c for c in more if c in labels.columns]
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max(F.col(column).cast("int")).alias("y"), *(F.max(F.col(c).cast("int")).alias(c) for c in own))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = texts_of(docs).join(F.broadcast(picked.select("doc_id")), "doc_id")
    once = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one")).select("doc_id", F.col("one.text").alias("text"))
    out = once.join(F.broadcast(picked), "doc_id")
    return out.select("doc_id", "text", "y", *(c if c in own else F.lit(None).cast("int").alias(c) for c in more))
