"""Shared folder, written intermediate tables and the text reader of the corpus operators.

Intermediate tables are Parquet files under the folder named by ``spark.checkpoint.dir``:
they cut the lineage and survive a lost executor.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = r"[\x20\x09-\x0D]+"
#: An Arrow batch ends at so many rows or bytes: whole texts are sent to Python, so batches of these are kept short.
BATCH_ROWS, BATCH_BYTES = "5000", "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession, batch_bytes: str = BATCH_BYTES) -> None:
    """Short Arrow batches, so that a worker's memory doesn't grow with the texts' length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch_bytes)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a temporary folder where it is unset and all tasks run in this process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="auditlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again; its path is in ``.path`` of the result."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that no lazy result reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def quoted(column: str) -> Column:
    """A column by its very name, whatever signs are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that no name of a table clashes with an operator's own."""
    return F.struct(*[quoted(c) for c in df.columns])


def text_of(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def row_key(id_column: str, text_column: str) -> tuple[Column, Column]:
    """128 bits by which a row is known in shuffles, of its id and text: rows that repeat both have the same key."""
    known = [F.col(id_column).isNull(), F.col(id_column), F.col(text_column).isNull(), F.col(text_column)]
    return F.xxhash64(*known), F.xxhash64(F.lit("second"), *known)


def held_fold(id_column: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % folds
