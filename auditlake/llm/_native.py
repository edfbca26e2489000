"""Small helpers for operators that are DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once: inside a lambda of ``body`` it would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, 3 … in ``order``, which should tell all rows apart.

    Rows are dealt by range and sorted there; the ranges' numbers of rows, one row a partition, give what each begins with.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the id is the partition's number and, in the lower 33 bits, the row's number in it
    placed = materialize(sorted_.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each partition
    before, sums = 0, {}
    for r in sorted(sizes, key=lambda r: r["__part"]):
        sums[r["__part"]], before = before, before + r.n
    starts = df.sparkSession.createDataFrame(list(sums.items()) or [(0, 0)], "__part long, __start long")
    numbered = placed.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return numbered.withColumn(name, F.col("__start") + F.col("__at") - F.shiftleft("__part", 33) + 1).drop("__part", "__at", "__start")
