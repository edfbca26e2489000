"""Small fixed dimensions as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import constants as C


def weights(spark: SparkSession) -> DataFrame:
    """325 rows: every profile's weight for every weighted kind."""
    return spark.createDataFrame(C.weight_rows(), "profile string, kind string, per_finding int, cap int, role_typical boolean, dyn_per int, dyn_cap int")


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, p) for i, p in enumerate(C.PROFILES)], "ordinal int, profile string")
