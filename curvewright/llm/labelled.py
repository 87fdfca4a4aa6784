"""Bounded, deterministic samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def held_out():
    """True for every fifth document by crc32 of its id as text; its label is never learnt from."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def training_ids(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """doc_id and y of at most ``per_class`` learnable rows of each class, least hash first.

    Null labels and ids are left out; a repeated id counts once, with its greatest label.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """doc_id, text and y of the sample; at most 2 * ``per_class`` ids are broadcast."""
    rows = docs.join(F.broadcast(training_ids(labels, label, per_class)), "doc_id")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))  # a few thousand rows, keys of their own
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
