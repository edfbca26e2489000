"""Listing of cached packages: what is old enough to go, and how much that frees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

OLDER_THAN_DAYS = 30


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified, size) of every file below ``root``; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def candidates(entries: DataFrame, now: Column, older_than_days: int = OLDER_THAN_DAYS) -> DataFrame:
    """``entries`` (…, modified, size) that are at least so many days old, with their age."""
    return entries.withColumn("age_days", T.age_days(now, F.col("modified"))).where(F.col("age_days") >= older_than_days)


def totals(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_freed"))
