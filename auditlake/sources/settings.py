"""Thresholds that a session or its environment can set."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from ..functions import constants as C


def threshold(spark: SparkSession, name: str, default: int) -> int:
    """A whole number of the session (``auditlake.<name>``), else of the environment (``AUDITLAKE_<NAME>``), else ``default``; so also where it is no number."""
    for raw in (spark.conf.get(f"auditlake.{name}", None), os.environ.get("AUDITLAKE_" + name.upper())):
        if raw is not None and raw.strip().lstrip("+-").isdigit():
            return int(raw)
    return default


def min_score(spark: SparkSession) -> int:
    return threshold(spark, "min_score", C.MIN_SCORE)


def auto_accept_score(spark: SparkSession) -> int:
    return threshold(spark, "auto_accept_score", C.AUTO_ACCEPT_SCORE)
