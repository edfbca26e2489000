"""Bounded, repeatable samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import held_fold, text_of


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, label, key, text) of at most ``most`` labelled documents outside fold ``held``.

    Takes the ids with the smallest hashes, so it is the same sample whatever the order of the rows. Labels
    other than 0 and 1 and null ids are left out; of several labels of one id the smallest counts, and of several
    texts of one id the least.
    """
    chosen = (
        labels.select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
        .where(held_fold("id", folds) != held)
        .groupBy("id").agg(F.min("label").alias("label"))
        .withColumn("key", F.xxhash64("id")).orderBy("key", "id").limit(most)
    )
    texts = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    found = texts.join(F.broadcast(chosen), "id")  # at most ``most`` rows
    return found.groupBy("id", "label", "key").agg(F.min("text").alias("text"))
