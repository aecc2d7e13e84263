"""Bounded samples of labelled training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, texts


def training_labels(labels: DataFrame, column: str, most: int, folds: int = 5, held: int = 0) -> DataFrame:
    """``doc_id`` and ``y`` of at most ``most`` rows of each class outside the held-out fold.

    Labels of one document given twice are joined by their maximum; null ids and labels are
    left out. The sample is the rows of least hash of the id, so it is the same in every run.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y"))
        .where("doc_id is not null and y is not null")
        .where(crc_bucket(F.col("doc_id"), folds) != held)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    part = [known.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for v in (0, 1)]
    return part[0].unionByName(part[1])


def training_texts(docs: DataFrame, labels: DataFrame, column: str, most: int, **folds) -> DataFrame:
    """``text`` and ``y`` of the sampled rows; the sample is broadcast, being bounded."""
    sample = training_labels(labels, column, most, **folds)
    return texts(docs).join(F.broadcast(sample), "doc_id").select("text", "y")
