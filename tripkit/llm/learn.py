"""Bounded training samples and held-out rows, shared by the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True for rows whose crc32 of the id as text leaves ``fold``; false for NULL ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def training_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    folds: int,
    fold: int,
    max_docs: int,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(text, label)`` of at most ``max_docs`` labelled documents outside the held-out fold.

    Which ones is decided by a hash of the id, so the sample does not change between runs. A
    document with several labels has the largest; NULL labels and ids are left out. Of several rows
    with one id the one whose text has the smallest hash counts. The ids are broadcast, which
    ``max_docs`` bounds.
    """
    key = F.col(doc_id)
    chosen = (
        labels.where(F.col(label).isNotNull() & key.isNotNull() & ~held_out(key, folds, fold))
        .groupBy(key.alias("id"))
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64(F.col("id"), F.lit(label)), "id")
        .limit(max_docs)
    )
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "id")
    # One row for each id, however many share it.
    once = rows.groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("label").alias("label"))
    return once.select("text", "label")
