r"""Line deduplication by an exact set-similarity join.

A line is the set of its words, held as 64-bit hashes. Words are ordered by rarity, so that two sets with Jaccard
``THRESHOLD`` or more must share one of the rarest few words of each (prefix filter); sizes (length filter), the
places of the shared word (positional filter) and the bits in which two 128-bit parities of the sets differ, which
bound the number of words that differ, rule out nearly all others, and every remaining pair is verified on the sets.
A line is removed if an earlier line matches it.

Equal sets (equal in size and 128 bits of hash) are one class, led by the earliest line; the other lines go without a join.
A word that very many lines have stands in the index only together with each later word of a prefix that is longer by one:
sets of two words or more that match share two words of such prefixes, too. For any word or pair with many lines
classes are first held against a few early classes with it, its hubs; a class that has found an earlier match looks
no further, and only the others are held against all. So many variants of one line cost a few comparisons
each, and no match is lost.

Scale: rarity is a table of ``BUCKETS`` counts over all lines (one byte each, broadcast); it decides the order only, so
shared buckets cost time, not results. Which words have many lines is counted in the index itself. Its rows are narrow, and rare
words, which are most of them, shuffle once.
Sets are read again only for the classes of pairs that passed all filters. Texts that lose a line shuffle once, to meet the
numbers of these lines; nearly all others pass straight through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import discard, materialize, prepare, quoted, row_key, table, text_of
from ._words import buffers, hashes, mix, spans, trim
from .exact_dedup import CELLS_PER_ROW, BloomFilter, gather, membership_filter

THRESHOLD = 0.8
BUCKETS = 1 << 24
#: A word with more than HUB_LINES lines in the index: they meet so many hubs first. A word in more than PAIR_LINES lines, and in so many
#: times more than buckets have on average: it counts with a second word only.
HUB_LINES, HUBS, PAIR_LINES, PAIR_TIMES = 400, 2, 5000, 16
#: Sets of more words than this have all 128 bits of parity in the index, others have them folded to 64.
FOLDED = 80
#: Sets of at most so many words have them folded to 32 in the index: most of what the index shuffles is its words and these.
HALVED = 32
KEY_BITS = 48
#: Numbers of so many sets (8 bytes each) at most are broadcast to fetch them; more become a filter.
FEW_SETS = 250_000
MAX_FILTER_BYTES = 64 << 20
_STEP_BYTES = 2 << 20
#: So many words are counted at a time.
_COUNTED = 1 << 21
#: An Arrow batch of the join and the cut: both ends of the pipe to Python hold a few of them, outside of the heap.
_BATCH_BYTES = "2m"
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SHIFT = np.uint64(40)
_SECOND = np.uint64(0x9E3779B97F4A7C15)
_ID = ("id", "line", "key_a", "key_b")


def _code(n):
    """Rarity in a byte: 0 for none, 1 for once, then eight steps for each doubling."""
    return np.where(n < 1, 0, np.minimum(255, 1 + np.ceil(8 * np.log2(np.maximum(n, 1))))).astype(np.uint8)


def _sums(values: np.ndarray, edge: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    return (total[edge[1:]] - total[edge[:-1]]).view(np.int64)


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of runs of 64-bit ``values``."""
    at = np.concatenate([[0], np.cumsum(8 * sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(values.tobytes())])


def _lines(batches):
    """Every line with words: its row's key and id, number, number of words, class (node_a, node_b), whether it leads the
    lines of that class in a few megabytes of text (lead), and its words, sorted, if it leads and has two or more."""
    for batch in batches:
        data, at = buffers(batch.column(3))
        own = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        low = 0
        while low < len(at) - 1:
            high = max(low + 1, int(np.searchsorted(at, at[low] + _STEP_BYTES, "right")) - 1)
            part, edges = data[at[low] : at[high]], at[low : high + 1] - at[low]
            starts, ends, bounds = spans(part, edges)
            row = np.repeat(np.arange(high - low), np.diff(bounds))
            breaks = np.flatnonzero(part == 10)
            line, word = np.searchsorted(breaks, starts) + row, hashes(part, starts, ends)  # lines are counted over all rows of the step
            order = np.lexsort((word, line))
            line, word = line[order], word[order]
            new = np.r_[True, (line[1:] != line[:-1]) | (word[1:] != word[:-1])] if len(line) else np.zeros(0, bool)
            line, word = line[new], word[new]
            first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)
            edge = np.r_[first, len(line)]
            n, line = np.diff(edge), line[first]
            node = [_sums(mix(word + np.uint64(1)), edge), _sums(mix(word ^ _SECOND), edge)] if len(n) else [np.zeros(0, np.int64)] * 2
            begins = np.searchsorted(breaks, edges[:-1]) + np.arange(high - low)  # the first line of each row
            row = np.searchsorted(begins, line, "right") - 1
            number = line - begins[row]
            key_a, key_b, id_ = (c[low:high][row] for c in own)
            by = (key_b, key_a, number, id_, n, node[1], node[0])
            order = np.lexsort(by)
            moves = lambda own: np.r_[True, np.any([c[order][1:] != c[order][:-1] for c in own], axis=0)] if len(n) else np.zeros(0, bool)
            new = moves(by[4:])
            lead = np.zeros(len(n), bool)
            lead[order[new]] = True
            # a row that repeats id and text is the same document: its line doesn't go because of itself
            again = np.zeros(len(n), bool)
            again[order[~new & (np.maximum.accumulate(np.where(moves(by), np.arange(len(n)), 0)) == np.maximum.accumulate(np.where(new, np.arange(len(n)), 0)))]] = True
            sets = lead & (n > 1)
            columns = [pa.array(key_a), pa.array(key_b), pa.array(id_), pa.array(number.astype(np.int32)), pa.array(n.astype(np.int32)), *map(pa.array, node), pa.array(lead)]
            out = pa.RecordBatch.from_arrays([*columns, _binary(word[np.repeat(sets, n)], np.where(sets, n, 0))], ["key_a", "key_b", "id", "line", "n", "node_a", "node_b", "lead", "words"])
            yield out.filter(pa.array(~again)) if again.any() else out
            low = high
        trim()


_LINES = "key_a long, key_b long, id long, line int, n int, node_a long, node_b long, lead boolean, words binary"


def _word_counts(batches):
    """Of the words that a task reads: for each chunk of buckets, which of them occur and in how many lines. Counts go out whenever ``_COUNTED``
    words are held, so that memory follows neither the task nor ``BUCKETS``."""
    held = []
    for batch in batches:
        word = buffers(batch.column(0))[0].view(np.uint64)
        for low in range(0, len(word), _COUNTED):
            held.append((word[low : low + _COUNTED] >> _SHIFT).astype(np.int32))
            if sum(map(len, held)) >= _COUNTED:
                yield from _counted(held)
                held = []
    if held:
        yield from _counted(held)
    trim()


def _counted(buckets: list[np.ndarray]):
    at, n = np.unique(np.concatenate(buckets), return_counts=True)
    chunk = at >> 16
    low = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]) if len(at) else np.zeros(0, np.int64)
    for a, b in zip(low, [*low[1:], len(at)]):
        yield pa.RecordBatch.from_arrays([pa.array([chunk[a]], pa.int32()), pa.array([at[a:b].astype("<u2").tobytes()], pa.binary()), pa.array([n[a:b].astype("<i4").tobytes()], pa.binary())], ["chunk", "at", "n"])


def _codes(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for at, n in zip(batch.column("at"), batch.column("n")):
            total[np.frombuffer(at.as_buffer(), "<u2")] += np.frombuffer(n.as_buffer(), "<i4")
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([_code(total).tobytes()], pa.binary()), pa.array([int(total.sum())], pa.int64())], ["chunk", "codes", "total"])


def rarity(lines: DataFrame) -> tuple[np.ndarray, int]:
    """A byte for each of ``BUCKETS`` buckets of words: how many lines have one of them; and how many on average."""
    counts = lines.where("length(words) > 0").select("words").mapInArrow(_word_counts, "chunk int, at binary, n binary")
    codes, total = np.zeros(BUCKETS, np.uint8), 0
    for r in counts.groupBy("chunk").applyInArrow(_codes, "chunk int, codes binary, total long").collect():  # ``BUCKETS`` bytes in all
        codes[r.chunk << 16 : (r.chunk + 1) << 16] = np.frombuffer(r.codes, np.uint8)
        total += r.total
    return codes, total // BUCKETS


def prefix_size(n, threshold: float):
    """How many of the rarest words of a set of ``n`` must hold one that is shared."""
    return n - np.ceil(threshold * n - 1e-9).astype(int) + 1


def parity(word: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each run of words, as two integers: each tells whether an odd number of the words falls on it. Folded to the first 64 where there are few words."""
    bit = np.uint64(1) << (word & np.uint64(63))
    high = (word & np.uint64(64)) > 0
    out = [np.bitwise_xor.reduceat(np.where(side, bit, np.uint64(0)), edge[:-1]) if len(edge) > 1 else np.zeros(0, np.uint64) for side in (~high, high)]
    few = np.diff(edge) <= FOLDED
    return np.where(few, out[0] ^ out[1], out[0]).view(np.int64), np.where(few, np.uint64(0), out[1]).view(np.int64)


def _halved(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``p`` with its upper half folded into the lower, which is a parity, too, where sets have at most ``HALVED`` words."""
    bits = p.view(np.uint64)
    return np.where(n <= HALVED, (bits ^ (bits >> np.uint64(32))) & np.uint64(0xFFFFFFFF), bits).view(np.int64)


def _index(shared, threshold: float):
    """Rows (ref, word, id, line, key_a, key_b, p, size_place, q, maybe) of the prefixes of sets.

    word: hash of a word of the prefix, or of two. size_place: number of words and place of the word (of a far one 65535: the
    positional filter then lets more pass). p, q: parity. maybe: it can have
    over ``HUB_LINES`` lines. Words that one line alone has are left out. ``own``: only classes that the filter holds, or only the others.
    """

    def run(batches):
        codes, several, firsts, pair = shared.value
        hub = int(_code(np.array([HUB_LINES]))[0])
        for batch in batches:
            node, ref = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node_a", "ref"))
            # should a filter err, a class has a second line here, which changes nothing but the work
            batch = batch.filter(pa.array(~several.holds(node) | firsts.holds(ref)))
            if not batch.num_rows:
                continue
            data, at = buffers(batch.column("words"))
            word, at = np.frombuffer(data.tobytes(), np.uint64), at // 8
            n = np.diff(at)
            row = np.repeat(np.arange(len(n)), n)
            p, q = parity(word, at)
            p = _halved(p, n)
            code = codes[(word >> _SHIFT).astype(np.int64)]
            # words come sorted, so ties of rarity stand in the order of their hashes
            order = np.argsort((row << 8) | code, kind="stable")
            word, code = word[order], code[order]
            place = np.arange(len(word)) - at[:-1][row]
            size = prefix_size(n, threshold)[row]
            inside = (place < size) & (code > 1)
            single, first = np.flatnonzero(inside & (code <= pair)), np.flatnonzero(inside & (code > pair))
            more = (size - place)[first]  # words behind it in the prefix that is longer by one
            lead = np.repeat(first, more)
            second = lead + 1 + np.arange(len(lead)) - np.repeat(np.cumsum(more) - more, more)
            value = np.concatenate([mix(word[single]), mix(mix(word[lead]) + word[second])]) >> np.uint64(64 - KEY_BITS)
            lead = np.concatenate([single, lead])
            order = np.argsort(lead, kind="stable")  # rows of one line together: nearly all columns then repeat
            lead, value = lead[order], value[order]
            row = row[lead]
            line = [batch.column(c).take(pa.array(row)) for c in ("ref", *_ID)]
            columns = [p[row], n[row] << 16 | np.minimum(place[lead], 0xFFFF), q[row], code[lead] > hub]
            yield pa.RecordBatch.from_arrays([line[0], pa.array(value.view(np.int64)), *line[1:], *map(pa.array, columns)], ["ref", "word", *_ID, "p", "size_place", "q", "maybe"])
        trim()

    return run


_INDEX = "ref long, word long, id long, line int, key_a long, key_b long, p long, size_place long, q long, maybe boolean"


def _fits(threshold: float):
    """What rows ``x`` and ``y`` of one word must meet: sizes, places and parities allow the threshold."""
    c = F.col
    n, m = (F.shiftright(c(f"{t}.size_place"), 16) for t in "xy")
    rest = F.least(n - c("x.size_place").bitwiseAND(0xFFFF), m - c("y.size_place").bitwiseAND(0xFFFF))
    p, q = c("x.p").bitwiseXOR(c("y.p")), c("x.q").bitwiseXOR(c("y.q"))
    one = p.bitwiseXOR(q)
    half = one.bitwiseXOR(F.shiftrightunsigned(one, 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    apart = F.when(F.least(n, m) > FOLDED, F.bit_count(p) + F.bit_count(q)).when(F.least(n, m) > HALVED, F.bit_count(one)).otherwise(F.bit_count(half))
    few = (1 - threshold) / (1 + threshold)
    return (F.least(n, m) >= threshold * F.greatest(n, m) - 1e-9) & (rest >= threshold / (1 + threshold) * (n + m) - 1e-9) & (apart <= few * (n + m) + 1e-9)


def _place(t: str):
    return F.struct(*[F.col(f"{t}.{c}") for c in _ID])


def _verify(threshold: float):
    """The later lines of pairs of sets (x, y) that are similar enough."""

    def run(batches):
        for batch in batches:
            (x, at), (y, to) = (buffers(batch.column(c)) for c in ("x", "y"))
            n, m = np.diff(at) // 8, np.diff(to) // 8
            pair = np.r_[np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)]
            word = np.concatenate([np.frombuffer(x.tobytes(), np.uint64), np.frombuffer(y.tobytes(), np.uint64)])
            order = np.lexsort((word, pair))
            pair, word = pair[order], word[order]
            common = np.bincount(pair[1:][(word[1:] == word[:-1]) & (pair[1:] == pair[:-1])], minlength=len(n))
            yield batch.select(["ref", "key_a", "key_b", "line"]).filter(pa.array(common >= threshold * (n + m - common) - 1e-9))

    return run


def _chosen(shared, column: str):
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.holds(batch.column(column).to_numpy(zero_copy_only=False))))

    return run


class _Join:
    """Which leading lines (ref, key_a, key_b, line) have an earlier match. ``sets`` (ref, id, line, key_a, key_b, words) holds all that are in the index."""

    def __init__(self, sets: DataFrame, threshold: float):
        self.spark, self.threshold, self.sets = sets.sparkSession, threshold, sets

    def pairs(self, x: DataFrame, y: DataFrame, first) -> DataFrame:
        """(ref, other) of rows of one word that may match and of which ``first`` says that they are a pair."""
        return x.alias("x").hint("merge").join(y.alias("y"), "word").where(first & _fits(self.threshold)).select(F.col("x.ref").alias("ref"), F.col("y.ref").alias("other"))

    def verified(self, pairs: DataFrame, done: tuple = ()) -> DataFrame:
        """The later lines of the pairs whose sets are similar enough. The tables ``done`` are deleted once the pairs are known."""
        pairs = materialize(pairs.distinct(), "pairs")
        discard(*done)
        named = materialize(pairs.select(F.explode(F.array("ref", "other")).alias("ref")).distinct(), "named")
        number = named.count()
        if number <= FEW_SETS:
            sets = self.sets.join(F.broadcast(named), "ref", "left_semi")
        else:
            known = self.spark.sparkContext.broadcast(membership_filter(named, number, 10, MAX_FILTER_BYTES))
            sets = self.sets.mapInArrow(_chosen(known, "ref"), self.sets.schema)
        sets = materialize(sets, "sets")
        if number > FEW_SETS:
            known.destroy()
        one = sets.select("ref", F.struct(*_ID).alias("at"), F.col("words").alias("x"))
        two = sets.select(F.col("ref").alias("other"), F.struct(*_ID).alias("other_at"), F.col("words").alias("y"))
        both = pairs.hint("merge").join(one, "ref").hint("merge").join(two, "other")
        later = F.when(F.col("at") > F.col("other_at"), F.struct("ref", "at")).otherwise(F.struct(F.col("other").alias("ref"), F.col("other_at").alias("at")))
        both = both.where("at != other_at").select(later.alias("l"), "x", "y").select("l.ref", "l.at.key_a", "l.at.key_b", "l.at.line", "x", "y")
        out = materialize(both.mapInArrow(_verify(self.threshold), "ref long, key_a long, key_b long, line int").distinct(), "matched")
        discard(pairs, named, sets)
        return out

    def run(self, index: DataFrame) -> DataFrame:
        maybe = index.where("maybe")
        heavy = materialize(maybe.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HUB_LINES).select("word"), "heavy")
        common = materialize(maybe.hint("merge").join(heavy, "word", "left_semi"), "common")
        rare = index.where("NOT maybe").unionByName(maybe.join(heavy, "word", "left_anti")).select("ref", "word", "p", "size_place", "q")
        # of each of a few sorts of a word's lines the earliest
        sort = F.pmod(F.xxhash64("ref"), F.lit(HUBS)).alias("sort")
        hubs = common.groupBy("word", sort).agg(F.min(F.struct(*_ID, "ref", "size_place", "p", "q")).alias("hub"))
        hubs = materialize(hubs.select("word", "hub.*"), "hubs")
        earlier = _place("y") < _place("x")
        matched = self.verified(self.pairs(rare, rare, F.col("y.ref") < F.col("x.ref")).union(self.pairs(common, hubs, earlier)), done=(index, heavy, hubs))
        seeking = materialize(common.join(matched.select("ref"), "ref", "left_anti"), "seeking")
        out = matched.union(self.verified(self.pairs(seeking, common, earlier)))
        discard(common, seeking)
        return out


def removed_lines(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(key_a, key_b, lines): the numbers of the lines that go, for each text that loses one. ``df`` has key_a, key_b, id (long) and text."""
    with _shuffles_go(df.sparkSession):
        return _removed_lines(df, threshold)


@contextmanager
def _shuffles_go(spark: SparkSession):
    """The shuffle files of each table that is written within go as soon as it is, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_SHUFFLES_GO)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(_SHUFFLES_GO, before)


def _removed_lines(df: DataFrame, threshold: float) -> DataFrame:
    spark = df.sparkSession
    lines = df.select("key_a", "key_b", "id", "text").mapInArrow(_lines, _LINES)
    # ref is written with its line, so it stays the same in all that follows
    lines = materialize(lines.withColumn("ref", F.monotonically_increasing_id()), "lines")
    lead = lines.where("lead")
    # classes that come from several steps: their lines shuffle, without their words, to find the earliest
    cells = max(1 << 16, min(lead.count() * CELLS_PER_ROW, MAX_FILTER_BYTES * 8))
    cells = -(-cells // (1 << 16)) * (1 << 16)
    several = BloomFilter(gather(lead.select("node_a"), cells, 2))
    narrow = lead.select("ref", *_ID, "n", "node_a", "node_b")
    repeated = spark.sparkContext.broadcast(several)
    again = materialize(narrow.mapInArrow(_chosen(repeated, "node_a"), narrow.schema), "several")
    repeated.destroy()
    first = materialize(again.groupBy("node_a", "node_b", "n").agg(F.min(F.struct(*_ID, "ref")).alias("first")), "first")
    firsts = membership_filter(first.select("first.ref"), max(1, first.count()), 16, MAX_FILTER_BYTES)
    codes, load = rarity(lines)
    pair = int(_code(np.array([max(PAIR_LINES, PAIR_TIMES * load)]))[0])
    shared = spark.sparkContext.broadcast((codes, several, firsts, pair))
    sets = lead.where("length(words) > 0").select("ref", *_ID, "node_a", "words")
    index = materialize(sets.mapInArrow(_index(shared, threshold), _INDEX), "index")
    shared.destroy()
    matched = _Join(sets.drop("node_a"), threshold).run(index)
    later = again.hint("merge").join(first, ["node_a", "node_b", "n"]).where("ref != first.ref AND NOT (id = first.id AND line = first.line AND key_a = first.key_a AND key_b = first.key_b)")
    gone = [g.select("key_a", "key_b", "line") for g in (lines.where("NOT lead"), later, matched)]
    out = materialize(gone[0].union(gone[1]).union(gone[2]).groupBy("key_a", "key_b").agg(F.collect_set("line").alias("lines")), "removed")
    discard(lines, again, first)
    return out


def _cut(own: list[str]):
    def run(batches):
        for batch in batches:
            texts, total, removed, sums = [], [], [], []
            for text, lines in zip(batch.column("text"), batch.column("lines")):
                all_lines = (text.as_py() or "").split("\n")
                gone = set(lines.as_py() or ())
                kept = "\n".join(x for i, x in enumerate(all_lines) if i not in gone)
                texts.append(kept if text.is_valid else None)
                total.append(len(all_lines) if text.is_valid else 0)
                removed.append(len(gone))
                sums.append(hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest())
            columns = dict(zip(_OWN, (pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sums, pa.string()))))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(columns[c] for c in own)], ["row", *own])

    return run


_OWN = {"text": T.StringType(), "n_lines": T.LongType(), "n_removed": T.LongType(), "kept_sha256": T.StringType()}


def dedup_lines(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    r"""One row for each row of ``df``: its ``keep`` columns (the id if it isn't given), then n_lines, n_removed and kept_sha256.

    If ``keep`` names the text, that has lost its repeated lines. A column of ``df`` in ``keep`` stays as it is where it is
    named like one of the last three, which is then left out. Lines end at a line feed; words are runs of
    ``[^\x20\x09-\x0D]``, unchanged. A line goes if the set of its words has Jaccard ``threshold`` or more with that of an
    earlier line, whether that one stays or not: earlier in the order of (id, number of the line, key of the row), a null
    id last. Lines without words stay. Rows that repeat id and text are one document here: their lines don't remove each
    other. A null text stays null and has no lines. Ids are integers. An empty table gives an empty result.
    """
    prepare(df.sparkSession, _BATCH_BYTES)
    keep = keep or [id_column]
    order = F.coalesce(F.col(id_column).cast("long"), F.lit((1 << 63) - 1))
    key = row_key(id_column, text_column)
    gone = removed_lines(df.select(key[0].alias("key_a"), key[1].alias("key_b"), order.alias("id"), text_of(text_column).alias("text")), threshold)
    carried = [c for c in keep if c != text_column]
    # all that is only carried is one column, so that no name of a table can clash with those used here
    row = F.struct(*[quoted(c) for c in carried]) if carried else F.struct(F.lit(0).alias("none"))
    docs = df.select(key[0].alias("key_a"), key[1].alias("key_b"), row.alias("row"), quoted(text_column).alias("text"))
    joined = docs.join(gone, ["key_a", "key_b"], "left").select("row", "text", "lines")
    own = [c for c in _OWN if (c == "text" and text_column in keep) or (c != "text" and c not in keep)]
    kinds = T.StructType([T.StructField("row", joined.schema["row"].dataType), *[T.StructField(c, _OWN[c]) for c in own]])
    cut = joined.mapInArrow(_cut(own), kinds)
    return cut.select(*[F.col("text").alias(c) if c == text_column else F.col("row").getField(c).alias(c) for c in keep], *[c for c in own if c != "text"])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that every document has and loses, and a digest of what it keeps, by :func:`dedup_lines` at its defaults. No column but id and text is read."""
    return dedup_lines(table(spark, sf_dir, "documents"))
