"""Mixing sources to target weights by a low-discrepancy schedule.

A source's words lie in the order of a hash of the documents' ids and texts and are cut into equal blocks of its own
(their numbers of words differ by one at most). Slot ``i`` of the mix takes the van der Corput point of ``i``
(its bits in reverse order); the point falls into one source's part of all slots, so every stretch of the
schedule is mixed as the whole is. The ``r``-th slot of a source takes its block ``r``, and after the last
block begins again with the first, three times at most; its last slot takes only as many words of its
block as its target still lacks, so each source has its target exactly, rounded to words.

Scale: no window runs over a whole source. Positions of documents and ranks of slots are running sums
in two levels (:func:`running_sum`): sums of hash buckets, their running sum, then sums inside one
bucket. Sources are a table, too; the driver sees sums over them only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import materialize, table, text_of

WEIGHTS = (1, 2, 3)
MOST_TIMES = 3
#: A block has at most so many words, and the mix at least so many slots where it has as many words.
BLOCK_WORDS, LEAST_SLOTS = 1024, 1 << 16
#: The plan of so many sources at most is broadcast.
FEW_SOURCES = 100_000
CELLS = 1 << 12
BUCKET_ROWS = 1000


def fill_level(sources: DataFrame, total: int, most: int) -> float:
    """Words for each unit of weight, so that shares by weight, and of what some can't take (over ``most`` times their size) the others' by weight, are ``total``.

    ``sources``: size, weight. A source is full if its share is over what it can take; a higher level fills more sources, so the
    level rises until no further one is full. Only two whole numbers come to the driver in each round.
    """
    level, full = 0.0, -1
    while True:
        over = F.lit(level) * F.col("weight") > most * F.col("size")
        r = sources.where("size > 0").agg(
            F.coalesce(F.sum(F.when(over, most * F.col("size"))), F.lit(0)).alias("taken"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("weight"), F.count_if(over).alias("full"),
        ).first()
        if r.full == full or not r.weight:
            return level
        full, level = r.full, (total - r.taken) / r.weight


def running_sum(df: DataFrame, group: str, bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` before each row, in its group in the order of (bucket, *order).

    A bucket has a bounded number of rows, so a group of any size is spread over many tasks.
    """
    per = materialize(df.groupBy(group, bucket).agg(F.sum(value).alias("_in")), "buckets")
    before = per.withColumn("_before", F.coalesce(F.sum("_in").over(W.partitionBy(group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum(value).over(W.partitionBy(group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_inside", inside).join(before.select(group, bucket, "_before"), [group, bucket]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def bits_reversed(i, bits: int):
    """Of a column of integers under 2**bits: the bits in reverse order, which is 2**bits times the van der Corput point."""
    return F.conv(F.reverse(F.lpad(F.bin(i), bits, "0")), 2, 10).cast("long")


def schedule(spark: SparkSession, plan: DataFrame, total: int, near) -> DataFrame:
    """One row a slot: slot, source_no, rank among the slots of its source. ``plan``: source_no, low, n_slots; slots are ``total``.

    Slots are numbered in their order; numbers whose point lies behind the last part are left out. ``near`` marks a table for a join.
    """
    bits = max(1, (total - 1).bit_length()) if total > 0 else 1
    # a source's part is found through the cells that it meets, so a point is held against a few parts only
    width = -(-total // CELLS) or 1
    parts = plan.where("n_slots > 0").select("source_no", "low", (F.col("low") + F.col("n_slots")).alias("high"))
    parts = parts.withColumn("cell", F.explode(F.expr(f"sequence(low div {width}, (high - 1) div {width})")))
    points = spark.range(total).select(F.col("id").alias("x"), bits_reversed(F.col("id"), bits).alias("slot"), F.expr(f"id div {width}").alias("cell"))
    dealt = points.join(near(parts), "cell").where((F.col("x") >= F.col("low")) & (F.col("x") < F.col("high"))).select("slot", "source_no", F.lit(1).cast("long").alias("one"), F.floor(F.col("slot") / BUCKET_ROWS).alias("stretch"))
    return running_sum(dealt, "source_no", "stretch", ["slot"], "one", "rank").select("slot", "source_no", "rank")


def block_of(word):
    """The block of a source's word. Blocks have ``least`` words, the first ``more`` of them one word more; no product of two large numbers is needed."""
    w = f"({word})"
    return F.expr(f"CASE WHEN {w} < more * (least + 1) THEN {w} div (least + 1) ELSE more + ({w} - more * (least + 1)) div least END")


def begin_of(block):
    """The first word of a block."""
    return F.expr(f"({block}) * least + least({block}, more)")


def plan_sources(docs: DataFrame, weights: tuple, most: int) -> tuple[DataFrame, int, int]:
    """(plan, its slots, number of sources): one row a source: source_no, source, size, target, its blocks, slots, and where its slots begin.

    Sources are numbered in two levels: in ranges, and in each range. rest is the number of words of the last slot if that isn't a full block.
    """
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")).withColumn("none", F.col("source").isNull())
    ranged = materialize(sources.repartitionByRange("none", "source").withColumns({"range": F.spark_partition_id(), "all": F.lit(0), "one": F.lit(1).cast("long")}), "sources")
    sums = ranged.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.count(F.lit(1)).alias("n")).first()
    numbered = running_sum(ranged, "all", "range", ["none", "source"], "one", "source_no")
    numbered = materialize(numbered.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), F.pmod("source_no", F.lit(len(weights))).cast("int"))), "numbered")
    level = fill_level(numbered.select(F.col("source_size").alias("size"), "weight"), sums.words, most)
    target = F.when(F.col("source_size") > 0, F.least(F.lit(level) * F.col("weight"), (most * F.col("source_size")).cast("double"))).otherwise(0.0)
    block = max(1, min(BLOCK_WORDS, sums.words // LEAST_SLOTS))
    plan = numbered.withColumn("target", target).withColumn("n_blocks", F.expr(f"greatest(1, (source_size + {block - 1}) div {block})"))
    plan = plan.withColumns({"least": F.expr("source_size div n_blocks"), "more": F.expr("source_size % n_blocks"), "words": F.floor(F.col("target") + 0.5)})
    # whole rounds, whole blocks of the last round, and words of its last block
    plan = plan.withColumn("left", F.expr("CASE WHEN source_size > 0 THEN words % source_size ELSE 0 END")).withColumn("full", F.when(F.col("source_size") > 0, block_of("left")).otherwise(0))
    plan = plan.withColumn("rest", F.when(F.col("source_size") > 0, F.col("left") - begin_of("full")).otherwise(0))
    slots = F.expr("CASE WHEN source_size > 0 THEN words div source_size * n_blocks + full + CAST(rest > 0 AS INT) ELSE 0 END")
    plan = running_sum(plan.withColumn("n_slots", slots), "all", "range", ["none", "source"], "n_slots", "low")
    plan = plan.select("source_no", "source", "source_size", "target", F.expr(f"greatest(1, rows div {BUCKET_ROWS})").alias("n_buckets"), "n_blocks", "least", "more", "n_slots", "rest", "low")
    plan = materialize(plan, "plan")
    return plan, plan.agg(F.coalesce(F.sum("n_slots"), F.lit(0)).alias("n")).first().n, sums.n


def mix(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple = WEIGHTS, most_times: int = MOST_TIMES, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pieces, slots) of the mix.

    documents: id, size, source, source_size, target, taken; one row for each row of ``df``.
    pieces: the parts of documents in blocks (source_no, block, start, at, words). slots: the schedule.

    Size counts words ``[^\\x20\\x09-\\x0D]+``; a null text has none. Sources stand in the order of
    their code points, a null source last, and weigh ``weights`` (whole numbers) in turn. A document without words takes
    no slot. Rows that repeat an id are rows of their own, null ids are ids like others. An empty table gives an empty
    mix. Columns other than the three are not read. Reruns over the same rows give the same mix.
    """
    spark = df.sparkSession
    size = F.regexp_count(text_of(text_column), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    key = F.xxhash64(F.lit(seed), F.col(id_column), F.col(text_column))
    docs = materialize(df.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), size.alias("size"), key.alias("key")), "sizes")
    plan, total, n = plan_sources(docs, weights, most_times)
    # a plan of more rows is joined by its keys
    near = (lambda t: F.broadcast(t)) if n <= FEW_SOURCES else (lambda t: t.hint("merge"))
    docs = docs.join(near(plan.select(F.col("source").alias("_source"), "source_no", "source_size", "target", "n_buckets", "n_blocks", "least", "more")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    docs = docs.withColumn("bucket", F.shiftrightunsigned("key", 24) % F.col("n_buckets"))
    placed = materialize(running_sum(docs, "source_no", "bucket", ["key", "id", "size"], "size", "start"), "placed").withColumn("row", F.struct("source_no", "start", "key"))
    slots = materialize(schedule(spark, plan, total, near), "slots")
    short = (F.col("rank") == F.col("n_slots") - 1) & (F.col("rest") > 0)
    times = (
        slots.join(near(plan.select("source_no", "n_blocks", "n_slots", "rest")), "source_no")
        .groupBy("source_no", (F.col("rank") % F.col("n_blocks")).alias("block"))
        .agg(F.count_if(~short).alias("times"), F.max(F.when(short, F.col("rest")).otherwise(0)).alias("part"))
    )
    pieces = placed.where("size > 0").select("source_no", "start", "size", "least", "more", F.explode(F.sequence(block_of("start"), block_of("start + size - 1"))).alias("block"))
    pieces = pieces.withColumn("at", F.greatest(F.col("start"), begin_of("block")) - begin_of("block"))
    pieces = pieces.select("source_no", "block", "start", "at", (F.least(F.col("start") + F.col("size"), begin_of("block + 1")) - begin_of("block") - F.col("at")).alias("words"))
    part = F.greatest(F.lit(0), F.least(F.col("words"), F.col("part") - F.col("at")))
    taken = pieces.join(times, ["source_no", "block"]).groupBy("source_no", "start").agg(F.sum(F.col("words") * F.col("times") + part).alias("taken"))
    # among documents with words (source_no, start) is a key
    out = placed.where("size > 0").join(taken, ["source_no", "start"], "left").unionByName(placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return out.select(F.col("id").alias(id_column), "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "row"), pieces, slots


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, by :func:`mix` at its defaults. A null text has size 0 and takes part in none of the words."""
    return mix(table(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken")
