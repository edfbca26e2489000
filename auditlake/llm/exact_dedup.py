"""Exact deduplication in two passes over a Bloom filter.

Pass one reads the digests of all rows and builds a filter whose cells count to two (a cell is
"used once" or "used twice or more"). Pass two probes every digest: a digest that occurs twice has
all its cells at two, so a row with any cell below two is certainly unique and passes straight
through. Only the other rows shuffle, as digests without their texts, and are grouped exactly, so
a false positive costs a few bytes and never a wrong result.

Scale: the filter takes ``cells_per_row / 8`` bytes a row and is broadcast. Its size is known
before it is built; above ``max_filter_bytes`` the digests are split into ranges, each with its own
filter and pass (at most ``MAX_RANGES``; beyond that a filter gets fewer cells a row, more rows
shuffle and the result stays exact).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WHITE, materialize, table, text_of
from ._words import mix

CELLS_PER_ROW = 12
PROBES = 3
CHUNK = 1 << 16
MAX_RANGES = 64
MAX_FILTER_BYTES, COLLECTED_BYTES = 64 << 20, 128 << 20
_STEP = 0x9E3779B97F4A7C15


def _cells(h: np.ndarray, n_cells: int) -> np.ndarray:
    """``PROBES`` cells of each hash, as an array of one row a probe."""
    h = h.view(np.uint64)
    return np.stack([mix(h + np.uint64(_STEP * (i + 1) % (1 << 64))) % np.uint64(n_cells) for i in range(PROBES)]).astype(np.int64)


def _partial(n_cells: int):
    """Of the hashes that a task reads: for each chunk of cells those used once and those used again."""

    def build(batches):
        read = [np.zeros(0, np.int64)]
        for batch in batches:
            read.append(batch.column(0).to_numpy(zero_copy_only=False))
        h, times = np.unique(np.concatenate(read), return_counts=True)
        cells = _cells(h, n_cells)
        # a hash uses each of its cells once, even if two of its probes meet
        first = np.stack([~np.any(cells[:i] == cells[i], axis=0) if i else np.ones(len(h), bool) for i in range(PROBES)])
        at, n = np.unique(np.concatenate([cells[first], cells[first & (times > 1)]]), return_counts=True)
        chunk = at // CHUNK
        for c, low, high in zip(*_runs(chunk)):
            own = (at[low:high] % CHUNK).astype("<u2")
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([own.tobytes()], pa.binary()), pa.array([own[n[low:high] > 1].tobytes()], pa.binary())], ["chunk", "used", "again"])

    return build


def _runs(sorted_keys: np.ndarray):
    low = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, np.int64)
    return sorted_keys[low].tolist(), low.tolist(), np.r_[low[1:], len(sorted_keys)].tolist() if len(low) else []


def _merge(least: int):
    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells of one chunk that are used ``least`` times over all tasks, as a bitmap of ``CHUNK`` bits."""
        uses = np.zeros(CHUNK, np.uint8)
        for batch in batches:
            for column in ("used", "again"):
                for cells in batch.column(column):
                    at = np.frombuffer(cells.as_buffer(), "<u2")
                    uses[at] = np.minimum(uses[at] + 1, 2)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(uses >= least).tobytes()], pa.binary())], ["chunk", "bits"])

    return merge


class BloomFilter:
    """Membership of 64-bit hashes; false positives only."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def holds(self, h: np.ndarray) -> np.ndarray:
        cells = _cells(h, len(self.bits) * 8)
        return np.all((self.bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1, axis=0)


def membership_filter(values: DataFrame, rows: int, bits_per_row: int, max_bytes: int) -> BloomFilter:
    """Filter of the first column of ``values`` (long), of at most ``max_bytes`` (64 KB at least)."""
    n_cells = max(CHUNK * 8, min(rows * bits_per_row, max_bytes * 8))
    n_cells = -(-n_cells // CHUNK) * CHUNK
    return BloomFilter(gather(values, n_cells, 1))


def gather(values: DataFrame, n_cells: int, least: int) -> np.ndarray:
    """Bits of the cells used ``least`` times (1 or 2): ``n_cells`` / 8 bytes in all come to the driver."""
    chunks = values.mapInArrow(_partial(n_cells), "chunk long, used binary, again binary").groupBy("chunk").applyInArrow(_merge(least), "chunk long, bits binary")
    bits = np.zeros(n_cells // 8, np.uint8)
    # of a bounded size: at once, if it fits well into a result, else partition by partition
    for r in chunks.collect() if n_cells <= COLLECTED_BYTES * 8 else chunks.toLocalIterator():
        bits[r.chunk * CHUNK // 8 : (r.chunk + 1) * CHUNK // 8] = np.frombuffer(r.bits, np.uint8)
    return bits


def _probe(spark: SparkSession, digests: DataFrame, rows: int, max_filter_bytes: int) -> DataFrame:
    """``digests`` (id, digest, h) with a boolean ``maybe``: false if the digest certainly occurs once."""
    n_cells = max(CHUNK, min(rows * CELLS_PER_ROW, max_filter_bytes * 8))
    n_cells = -(-n_cells // CHUNK) * CHUNK
    shared = spark.sparkContext.broadcast(BloomFilter(gather(digests.select("h"), n_cells, 2)))

    def probe(batches):
        for batch in batches:
            maybe = shared.value.holds(batch.column(2).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maybe)], ["id", "digest", "maybe"])

    kind = digests.schema["id"].dataType.simpleString()
    return digests.select("id", "digest", "h").mapInArrow(probe, f"id {kind}, digest binary, maybe boolean")


def exact_groups(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """One row for each row of ``df``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are the same once each run of white space is one space; null counts as
    empty, and all empty texts are one group. Of equal texts the row with the smallest id stays; a null
    id stays only in a group of null ids. Rows that repeat the smallest id are all marked as kept, as
    nothing tells them apart. An empty table gives an empty result. Further columns are not read.
    """
    spark = df.sparkSession
    digest = F.unhex(F.sha2(F.regexp_replace(text_of(text_column), WHITE, " "), 256))
    digests = df.select(F.col(id_column).alias("id"), digest.alias("digest")).withColumn("h", F.xxhash64("digest"))
    rows = df.count()
    ranges = min(MAX_RANGES, max(1, -(-rows * CELLS_PER_ROW // (8 * max_filter_bytes))))
    digests = materialize(digests.withColumn("range", F.pmod("h", F.lit(ranges)).cast("int")), "digests", "range" if ranges > 1 else None)
    out = None
    for r in range(ranges):
        own = digests.where(F.col("range") == r) if ranges > 1 else digests
        probed = materialize(_probe(spark, own, -(-rows // ranges), max_filter_bytes), "probed")
        maybe = probed.where("maybe").select("id", "digest")
        groups = materialize(maybe.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
        # of its own exchange on both sides, so that a digest of very many rows is split at run time
        joined = maybe.hint("merge").join(groups, "digest").select("id", "keep_id", "group_size", "digest")
        single = probed.where(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest")
        part = single.unionByName(joined)
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("id").alias(id_column), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document the row that stays for its text, by :func:`exact_groups`: null texts and empty ones are one group, ties go to the smallest id."""
    return exact_groups(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
