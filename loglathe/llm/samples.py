"""Bounded samples of labelled documents, for fitting a model on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out

#: Labelled documents fetched of each class, at most.
PER_CLASS = 1200


def labelled_ids(labels: DataFrame, target: str, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, y of at most ``per_class`` rows of either class, never held-out ones, in a fixed pseudo-random order; a repeated row comes once."""
    rows = labels.where(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).select("doc_id", F.col(target).cast("int").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    halves = [rows.where(F.col("y") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    return halves[0].unionAll(halves[1]).distinct()


def labelled_texts(docs: DataFrame, labels: DataFrame, target: str, per_class: int = PER_CLASS) -> tuple[list[bytes], list[int]]:
    """Whole texts and labels of a sample, the same whenever run; of documents with equal doc_id the text that sorts first."""
    ids = labelled_ids(labels, target, per_class)
    few = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")
    rows = few.groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()  # 2 * per_class rows at most
    rows = sorted((r.doc_id, r.y, bytes(r.text)) for r in rows)
    return [r[2] for r in rows], [r[1] for r in rows]
