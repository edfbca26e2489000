"""Lineage cuts for loops: reliable checkpoints in the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _shared(spark: SparkSession) -> str:
    """The folder for checkpoints: ``spark.checkpoint.dir``; where that is unset and all tasks run in this process (tests), a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="auditlake-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def folder(spark: SparkSession, tag: str) -> str:
    """A new path below the folder for checkpoints."""
    return f"{_shared(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def numbered(df: DataFrame, order: list[Column | str], name: str, first: int = 1) -> DataFrame:
    """``df`` with ``name``: ``first``, ``first`` + 1 … in ``order``, in as many tasks as there are partitions.

    Rows are dealt by range and numbered there; what the ranges before hold, one number a partition, is added.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)  # the id has the partition above these bits, and the row's number in it below
    before, starts = first, []
    for r in sorted(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((r.part, before))
        before += r.n
    offsets = df.sparkSession.createDataFrame(starts or [(0, first)], "__part long, __start long")
    return placed.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(name, F.col("__start") + F.col("__at") - F.shiftleft("__part", 33)).drop("__part", "__start", "__at")
