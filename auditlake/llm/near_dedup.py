"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A document is the set of its five-word shingles, with weights of 1 and, where shingles repeat, once more weighted
1 + ln(times). Each shingle has a Poisson process whose rate is its weight; a process throws its arrivals into ``HASHES`` registers, a register keeps
the shingle that arrived first, and a process ends as soon as its next arrival is later than all registers
hold. Two signatures agree in a register with the probability Jaccard similarity of the weighted sets.
Signatures are cut into ``BANDS``; documents that share a band of either signature are candidates (with weights of 1
the similarity is the one that is verified, so repeats hide no pair), and a candidate pair counts if the exact Jaccard similarity of the shingle sets is ``THRESHOLD`` or more.

Pairs of a band's bucket are never all formed at once. Copies (sets equal in 128 bits) are one node. Each bucket's nodes
are first held against one node of it, its hub; linked nodes become one component. Buckets that still hold
several components are held against further hubs. What is left over then is compared across components: pair by pair
if it has few pairs a row, else through an index of each set's rarest shingles; by size and by a bound on how many
shingles differ, and what passes both by its sets. So no link is lost and a group of n near copies costs about n comparisons of sets.

Scale: signatures, hubs, links and components are tables; nothing but counts and a Bloom filter of
checked size comes to the driver. Shingle sets are written for nodes that share a bucket only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import discard, materialize, prepare, table, text_of
from ._words import buffers, hashes, mix, spans, trim, windows
from .exact_dedup import membership_filter

SHINGLE, THRESHOLD = 5, 0.8
BANDS, BAND_ROWS = 20, 4
HASHES = BANDS * BAND_ROWS
#: Hubs a bucket and round after the first; rounds before what is left is compared in full, at most.
HUBS, ROUNDS = 3, 8
#: What is left is compared pair by pair if it has so many pairs a row at most.
FEW_PAIRS = 4
#: Of each node's shingles, dealt into so many cells, whether a cell has an odd number: two sets differ in at least as
#: many shingles as cells, which rules pairs out without their sets.
PARITY_BITS = 1024
MAX_FILTER_BYTES = 64 << 20
_STEP_BYTES = 8 << 20


def _shingles(data: np.ndarray, at: np.ndarray, size: int):
    """Distinct shingles of each text: (row, hash, times), sorted by both. A text of fewer words is one shingle."""
    starts, ends, bounds = spans(data, at)
    h, n = hashes(data, starts, ends), np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n)
    g = windows(h, size)
    valid = row[: len(g)] == row[size - 1 :] if len(g) else np.zeros(0, bool)
    short = np.flatnonzero((n > 0) & (n < size))
    whole = [mix(np.bitwise_xor.reduce(mix(h[bounds[i] : bounds[i + 1]] + np.arange(1, n[i] + 1, dtype=np.uint64)), keepdims=True))[0] for i in short]
    rows, values = np.concatenate([row[: len(g)][valid], short]), np.concatenate([g[valid], np.array(whole, np.uint64)])
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])]) if len(rows) else np.zeros(0, np.int64)
    return rows[first], values[first], np.diff(np.r_[first, len(rows)])


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(row: np.ndarray, value: np.ndarray, weight: np.ndarray, rows: int, m: int = HASHES) -> np.ndarray:
    """ProbMinHash of weighted sets given as (row, value, weight): ``rows`` x ``m`` values, 0 for an empty set."""
    first = np.full(rows * m, np.inf)
    kept = np.zeros(rows * m, np.uint64)
    latest = np.full(rows, np.inf)
    row, value, weight, time = row.copy(), value.copy(), weight.astype(float), np.zeros(len(row))
    arrival = 0
    while len(row):
        arrival += 1
        state = mix(value + np.uint64(0x9E3779B97F4A7C15 * arrival % (1 << 64)))
        time = time - np.log(_uniform(state)) / weight
        alive = time < latest[row]
        row, value, weight, time, state = row[alive], value[alive], weight[alive], time[alive], state[alive]
        cell = row * m + (mix(state + np.uint64(1)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, cell, time)
        won = first[cell] == time
        kept[cell[won]] = value[won]
        changed = np.unique(row)
        latest[changed] = first.reshape(rows, m)[changed].max(axis=1)
    return kept.reshape(rows, m)


def _steps(batches, size: int):
    for batch in batches:
        data, at = buffers(batch.column(1))
        low = 0
        while low < len(at) - 1:
            high = max(low + 1, int(np.searchsorted(at, at[low] + _STEP_BYTES, "right")) - 1)
            yield batch.column(0).slice(low, high - low), high - low, *_shingles(data[at[low] : at[high]], at[low : high + 1] - at[low], size)
            low = high
    trim()


def _set_hash(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """128 bits of each text's set of shingles, as two integers; 0 for none."""
    total = np.zeros((rows, 2), np.uint64)
    for i in range(2):
        np.add.at(total[:, i], row, mix(value + np.uint64(0x9E3779B97F4A7C15 * i + 1)))
    return total


def _binary(node: np.ndarray) -> pa.Array:
    """Two integers a row as 16 bytes."""
    at = np.arange(len(node) + 1, dtype=np.int32) * 16
    return pa.BinaryArray.from_buffers(pa.binary(), len(node), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(node).tobytes())])


def _first_half(batches):
    for batch in batches:
        data = buffers(batch.column(0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(data.tobytes(), np.int64)[::2])], ["h"])


def _bands(kept: np.ndarray) -> np.ndarray:
    """``BANDS`` hashes of each signature."""
    kept = kept.reshape(-1, BANDS, BAND_ROWS)
    band = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), kept.shape[:2]).copy()
    for i in range(BAND_ROWS):
        band = mix(band * np.uint64(3) + kept[:, :, i])
    return band


def _sign(size: int):
    def run(batches):
        for ids, rows, row, value, times in _steps(batches, size):
            band = _bands(signatures(row, value, np.ones(len(row)), rows))
            # texts with repeats have the bands of their weighted sets, too
            again = np.zeros(rows, bool)
            again[row[times > 1]] = True
            own, index = again[row], np.cumsum(again) - 1
            weighted = _bands(signatures(index[row[own]], value[own], 1 + np.log(times[own]), int(again.sum())))
            n = np.bincount(row, minlength=rows)
            ends = np.cumsum(np.where(again, 2 * BANDS, BANDS))
            all_ = np.empty(int(ends[-1]) if rows else 0, np.uint64)
            at = np.r_[0, ends][:-1]
            all_[at[:, None] + np.arange(BANDS)] = band
            all_[at[again][:, None] + np.arange(BANDS, 2 * BANDS)] = weighted
            bands = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(all_.view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), _binary(_set_hash(row, value, rows)), bands], ["id", "n", "node", "bands"])

    return run


def _sets(size: int, shared):
    def run(batches):
        seen = set()
        for _, rows, row, value, _ in _steps(batches, size):
            node = _set_hash(row, value, rows)
            edge = np.searchsorted(row, np.arange(rows + 1))
            chosen, nodes, parities = [], [], []
            for i in np.flatnonzero(shared.value.holds(np.ascontiguousarray(node[:, 0]).view(np.int64))).tolist():
                if edge[i] < edge[i + 1] and (k := node[i].tobytes()) not in seen:  # a task sends a set once
                    seen.add(k)
                    nodes.append(k)
                    own = value[edge[i] : edge[i + 1]]
                    chosen.append(own.view(np.int64))
                    odd = np.bincount((own % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
                    parities.append(np.packbits(odd.astype(np.uint8)).view(np.int64).tolist())
            offsets = np.concatenate([[0], np.cumsum([len(c) for c in chosen])]).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *chosen])))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), sets, pa.array(parities, pa.list_(pa.int64()))], ["node", "shingles", "parity"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): the smallest node that it is connected with.

    Labels move along edges and then along labels (pointer jumping) until none changes; each round is two
    joins over tables, and nodes of very many edges are summed before they shuffle.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), "edges")
    label = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        moved = label.join(near.withColumnRenamed("a", "node"), "node").select("node", "comp", F.least("comp", "m").alias("m"))
        up = label.select(F.col("node").alias("m"), F.col("comp").alias("up"))
        new = materialize(moved.join(up, "m").select("node", F.col("up").alias("new"), (F.col("up") != F.col("comp")).alias("changed")), "labels")
        done = new.where("changed").isEmpty()
        discard(label)
        label = new.select("node", F.col("new").alias("comp"))
        label.path = new.path
        if done:
            discard(both)
            return label


class _Search:
    """Links between nodes that share a bucket; components of what is linked so far."""

    def __init__(self, members: DataFrame, sets: DataFrame, threshold: float):
        self.members, self.sets, self.threshold, self.labels = members, sets, threshold, None

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b): those whose sets are similar enough. Sizes were held against each other before."""
        left = self.sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        right = self.sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        both = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b")
        common = F.size(F.array_intersect("x", "y"))
        return both.where(common >= self.threshold * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b")

    def link(self, pairs: DataFrame) -> None:
        """Verify ``pairs`` (a, b) and join the components that they connect."""
        links = materialize(self.verified(pairs), "links")
        if self.labels is None:
            self.labels = components(links)
            return
        of = lambda side: self.labels.select(F.col("node").alias(side), F.col("comp").alias(f"{side}_comp"))
        edges = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
        merged = components(edges)
        old = self.labels.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("new")), "comp", "left").select("node", F.coalesce("new", "comp").alias("comp"))
        fresh = merged.join(self.labels, "node", "left_anti")
        self.labels = materialize(old.unionByName(fresh), "components")

    def open_members(self) -> DataFrame:
        """(bucket, node, n, comp, parity) of the buckets that hold more than one component."""
        known = self.members.join(self.labels, "node", "left").select("bucket", "node", "n", F.coalesce("comp", "node").alias("comp"))
        several = known.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("bucket")
        left = materialize(known.hint("merge").join(materialize(several, "open"), "bucket"), "open-members")
        return left.join(self.sets.select("node", "parity"), "node")

    def against_hubs(self, members: DataFrame, seed: int, hubs: int) -> DataFrame:
        """Pairs of each member with its bucket's hubs: those with the smallest hashes under ``seed``."""
        order = F.struct(F.xxhash64("node", F.lit(seed)).alias("h"), "node", "n", "comp", *(["parity"] if seed else []))
        # of each of a few sorts one hub: the smallest of its sort
        chosen = members.groupBy("bucket", F.pmod(F.xxhash64("node", F.lit(seed + 1)), F.lit(hubs)).alias("sort")).agg(F.min(order).alias("hub"))
        chosen = materialize(chosen.select("bucket", F.col("hub.node").alias("other"), F.col("hub.n").alias("m"), F.col("hub.comp").alias("other_comp"), *([F.col("hub.parity").alias("other_parity")] if seed else [])), "hubs")
        return self.pairs(members.hint("merge").join(chosen, "bucket").where("comp != other_comp"), bool(seed))

    def pairs(self, rows: DataFrame, parities: bool) -> DataFrame:
        """Distinct (a, b) of (node, other, n, m, …) whose sizes, and parities, allow the threshold."""
        fits = F.least("n", "m") >= self.threshold * F.greatest("n", "m") - 1e-9
        if parities:
            apart = F.aggregate(F.zip_with("parity", "other_parity", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, c: s + c)
            fits = fits & (apart <= (1 - self.threshold) / (1 + self.threshold) * (F.col("n") + F.col("m")) + 1e-9)
        return rows.where(fits).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).where("a != b").distinct()

    def through_index(self, members: DataFrame) -> DataFrame:
        """Pairs of nodes of different components that share one of the rarest shingles of each (prefix filter), whatever bucket they are in.

        Rarity is counted over the nodes that are left. Nodes that have much in common, but not enough, mostly meet in no such shingle.
        """
        nodes = members.select("node", "n", "comp", "parity").distinct()
        each = materialize(self.sets.select("node", "shingles").join(nodes.select("node", "n"), "node").select("node", "n", F.explode("shingles").alias("shingle")), "left")
        counts = materialize(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "counts")
        shared = each.hint("merge").join(counts, "shingle")
        # those that a node alone has come first, and can't be shared
        per = W.partitionBy("node")
        placed = shared.select("node", "shingle", F.row_number().over(per.orderBy("c", "shingle")).alias("i"), (F.col("n") - F.count(F.lit(1)).over(per)).alias("alone"), "n")
        rare = placed.where(F.col("i") + F.col("alone") <= F.col("n") - F.ceil(self.threshold * F.col("n") - 1e-9) + 1).select("node", "shingle")
        index = materialize(rare.join(nodes, "node"), "index")
        other = index.select("shingle", F.col("node").alias("other"), F.col("n").alias("m"), F.col("comp").alias("other_comp"), F.col("parity").alias("other_parity"))
        return self.pairs(index.hint("merge").join(other, "shingle").where("node < other AND comp != other_comp"), True)

    def run(self) -> DataFrame:
        rows = self.members.withColumn("comp", F.col("node"))
        self.link(self.against_hubs(rows, 0, 1))
        for seed in range(1, ROUNDS + 1):
            members = materialize(self.open_members(), "members")
            sizes = members.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("bucket").agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("same"))
            left = sizes.agg(F.sum("all").alias("rows"), F.sum(F.col("all") * F.col("all") - F.col("same")).alias("pairs")).first()
            if not left.rows:
                return self.labels
            if left.pairs <= FEW_PAIRS * left.rows:
                break
            if seed == ROUNDS:
                self.link(self.through_index(members))
                return self.labels
            self.link(self.against_hubs(members, 10 * seed, HUBS))
        other = members.select("bucket", F.col("node").alias("other"), F.col("n").alias("m"), F.col("comp").alias("other_comp"), F.col("parity").alias("other_parity"))
        self.link(self.pairs(members.join(other, "bucket").where("node < other AND comp != other_comp"), True))
        return self.labels


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    r"""One row for each row of ``df``: id, class_id, class_size.

    A class is what is connected by pairs of shingle sets with Jaccard ``threshold`` or more; its id is the
    smallest id in it. Words are runs of ``[^\x20\x09-\x0D]``, unchanged; a text of one to ``shingle`` - 1 words is one
    shingle, texts without words (null counts as empty) are one class. Rows are judged by their texts alone, so
    ids may repeat or be null; a class of null ids only has a null id. A pair at exactly ``threshold`` is a pair. Long texts are read
    whole, in steps of a few megabytes. An empty table gives an empty result. Other columns are not read.
    """
    spark = df.sparkSession
    prepare(spark)
    docs = df.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    kind = docs.schema["id"].dataType
    signed = materialize(docs.mapInArrow(_sign(shingle), T.StructType().add("id", kind).add("n", "long").add("node", "binary").add("bands", T.ArrayType(T.LongType()))), "signed")
    # equal sets are one node, with the bands of all their signatures; those differ by weights only
    nodes = signed.where("n > 0").select("node", "n", "bands").distinct()
    rows = materialize(nodes.select("node", "n", F.explode("bands").alias("bucket")), "bands")
    several = materialize(rows.groupBy("bucket").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x != y").select("bucket"), "buckets")
    members = materialize(rows.hint("merge").join(several, "bucket").distinct(), "members")
    discard(rows, several)
    wanted = members.select("node").distinct()
    shared = spark.sparkContext.broadcast(membership_filter(wanted.mapInArrow(_first_half, "h long"), max(1, wanted.count()), 10, MAX_FILTER_BYTES))
    sets = docs.mapInArrow(_sets(shingle, shared), "node binary, shingles array<long>, parity array<long>")
    sets = materialize(sets.groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("parity").alias("parity")), "sets")
    labels = _Search(members, sets, threshold).run()
    placed = signed.select("id", "node").hint("merge").join(labels, "node", "left").select("id", F.coalesce("comp", "node").alias("comp"))
    placed = materialize(placed, "placed")
    classes = materialize(placed.groupBy("comp").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "classes")
    return placed.hint("merge").join(classes, "comp").select(F.col("id").alias(id_column), "class_id", "class_size")


def op9_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document, by :func:`near_duplicates` at its defaults; the one with the smallest id is kept. Texts without words are one class."""
    return near_duplicates(table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
