"""Substring deduplication by seed and extend over words.

Seeds: of every ``length`` consecutive words, the group of ``SEED`` words with the smallest hash is the
anchor (winnowing), so two equal passages of that length have the same anchor at the same place.
Anchors that occur once in the corpus rule out all windows around them. Around each other anchor the
match is extended both ways: all windows of ``length`` words that hold it are looked up at once by a 128-bit
hash, and one by one where the surroundings of its places differ. Overlapping repeated windows join to
maximal repeats.

Skew: within a few megabytes of text equal windows are resolved where they are, and one row stands for
all of them in the shuffle, so a passage that a third of all documents share sends one row for each such
step, not one for each document; of equal texts in one task two send their windows, the others one row.

Scale: anchors shuffle as partial counts (about 8 % of the words); the repeated ones become a Bloom filter of checked size.
Beyond ``MAX_FILTER_BYTES`` they stay a table and the rows of all anchors shuffle to meet it: texts are read as often as
before, and meet the ranges of their single windows by their key. A false positive costs a row, not a wrong result. No pair of
documents is ever formed. Texts shuffle once (then twice), to meet their repeats.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, materialize, prepare, row_key, table, text_of
from ._words import _power, buffers, hashes, mix, spans, trim, windows
from .exact_dedup import membership_filter

LENGTH, SEED = 35, 12
_KEY = ("key_a", "key_b")
FILTER_BITS = 10
MAX_FILTER_BYTES = 128 << 20
_STEP_BYTES = 8 << 20
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_FIRST_BASE, _SECOND_BASE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def _slide(join, x: np.ndarray, n: int) -> np.ndarray:
    """``join`` (minimum or maximum) of every ``n`` consecutive values, by doubling."""
    k = 1
    while 2 * k <= n:
        x, k = join(x[:-k], x[k:]), 2 * k
    return x if k == n else join(x[: len(x) - (n - k)], x[n - k :])


class _Step:
    """Words, anchors and windows of a few megabytes of texts."""

    def __init__(self, data: np.ndarray, at: np.ndarray, length: int):
        starts, ends, self.bounds = spans(data, at)
        n = np.diff(self.bounds)
        self.row = np.repeat(np.arange(len(n)), n)
        self.h = hashes(data, starts, ends)
        place = np.arange(len(self.h)) - self.bounds[:-1][self.row]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.h + np.uint64(0x9E3779B97F4A7C15) * place.astype(np.uint64)))])
        #: hash of all words of each text, in their order
        self.whole = total[self.bounds[1:]] - total[self.bounds[:-1]]
        self.place, self.length = place, length
        size = len(self.h) - length + 1
        self.valid = self.row[: max(0, size)] == self.row[length - 1 :] if size > 0 else np.zeros(0, bool)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """For every window its anchor's hash (valid windows), and for every seed whether it is an anchor."""
        g = windows(self.h, SEED)
        wide = self.length - SEED + 1
        if not len(self.valid):
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        least = _slide(np.minimum, g, wide)
        chosen = np.where(self.valid, least, np.uint64(0))
        edge = np.zeros(wide - 1, np.uint64)
        self.g = g
        return least, g == _slide(np.maximum, np.concatenate([edge, chosen, edge]), wide)[: len(g)]


def _steps(batches, length: int):
    """(keys, step, rows of third and later copies in this task) of each few megabytes."""
    seen: dict[tuple, int] = {}
    for batch in batches:
        data, at = buffers(batch.column(2))
        key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
        low = 0
        while low < len(at) - 1:
            high = max(low + 1, int(np.searchsorted(at, at[low] + _STEP_BYTES, "right")) - 1)
            step = _Step(data[at[low] : at[high]], at[low : high + 1] - at[low], length)
            n = np.diff(step.bounds)
            again = np.zeros(high - low, bool)
            for i, whole in enumerate(zip(step.whole.tolist(), n.tolist())):
                if whole[1] >= length:
                    seen[whole] = seen.get(whole, 0) + 1
                    again[i] = seen[whole] > 2
            yield key[:, low:high], step, again
            low = high


def _anchor_counts(length: int):
    def run(batches):
        for _, step, again in _steps(batches, length):
            _, chosen = step.anchors()
            at = np.flatnonzero(chosen)
            value, n = np.unique(step.g[at[~again[step.row[at]]]] if len(at) else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], ["anchor", "n"])

    return run


def _range_hashes(h: np.ndarray, low: np.ndarray, high: np.ndarray, base: int) -> np.ndarray:
    """Hash of the words ``low`` to ``high`` (not included) of each range; it depends on their order and number."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _power(base, len(h)))])
    return mix((total[high] - total[low]) * _power(pow(base, -1, 1 << 64), len(h) + 1)[low] + (high - low).astype(np.uint64))


def _units(step: _Step, least: np.ndarray, at: np.ndarray, whole: bool):
    """First and last window, and both hashes, of what is looked up: each window of ``at``, or each run of windows around one anchor."""
    if not whole or not len(at):
        high = at
        low = at
    else:
        cut = np.r_[True, (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]]) | (step.row[at[1:]] != step.row[at[:-1]])]
        first = np.flatnonzero(cut)
        low, high = at[first], at[np.r_[first[1:], len(at)] - 1]
    return low, high, *(_range_hashes(step.h, low, high + step.length, base) for base in (_FIRST_BASE, _SECOND_BASE))


def _flat(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (a, b, n, key_a, key_b, low, high, anchor) of groups of arrays, of which any may be None for null."""
    out = []
    for group in rows:
        count = next(len(v) for v in group if v is not None and not np.isscalar(v))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        column = lambda v, t: pa.nulls(count, t) if v is None else pa.array(np.full(count, v, np.int32) if np.isscalar(v) else v.view(np.int64) if t == pa.int64() else np.asarray(v).astype(np.int32), t)
        out.append([column(v, t) for v, t in zip(group, kinds)])
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*out)], ["a", "b", "n", *_KEY, "low", "high", "anchor"])


def _candidates(length: int, shared, whole: bool):
    """Rows (a, b, n, key_a, key_b, low, high, anchor): windows (or, with ``whole``, all windows around an anchor at once) to look up with
    their owner (n is 1), or with one of the owners where they are known as repeated (n is 2); and places (no hash) where windows low
    to high of a text are repeated. ``shared``: a filter of the anchors to look at, or None for all."""

    def run(batches):
        for key, step, again in _steps(batches, length):
            least, _ = step.anchors()
            at = np.flatnonzero(step.valid & ~again[step.row[: len(step.valid)]])
            if shared is not None:
                at = at[shared.value.holds(least[at])]
            low, high, a, b = _units(step, least, at, whole)
            order = np.lexsort((b, a))
            a, b, low, high = a[order], b[order], low[order], high[order]
            new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
            group = np.cumsum(new) - 1
            alone = (np.bincount(group) if len(a) else np.zeros(0, np.int64))[group] == 1
            lead = new & ~alone
            own = lambda x: (*key[:, step.row[low[x]]], step.place[low[x]], step.place[high[x]])
            rows = [(a[alone], b[alone], 1, *own(alone), least[low[alone]]), (a[lead], b[lead], 2, *own(lead), least[low[lead]]), (None, None, 0, *own(~alone), None)]
            if whole:  # a third copy in this task: all of its windows are repeated
                copies = np.flatnonzero(again)
                rows.append((None, None, 0, *key[:, copies], np.zeros(len(copies), np.int32), np.diff(step.bounds)[copies] - length, None))
            yield _flat(rows)
            trim()

    return run


def _singles(length: int):
    """Rows as of :func:`_candidates` for each window in the ranges (low, high, n) of a text."""

    def run(batches):
        for batch in batches:
            data, at = buffers(batch.column(2))
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
            ranges = batch.column(3)
            for i in range(len(key[0])):
                step = _Step(data[at[i] : at[i + 1]], np.array([0, at[i + 1] - at[i]]), length)
                low, high, n = (ranges[i].values.field(c).to_numpy() for c in range(3))
                count = high - low + 1
                place = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                n = np.repeat(n, count)
                _, _, a, b = _units(step, None, place, False)
                owner = [np.full(len(place), k) for k in key[:, i]]
                yield _flat([(a[x], b[x], v, *(o[x] for o in owner), place[x], place[x], None) for v, x in ((1, n == 1), (2, n == 2))])

    return run


_ROWS = "a long, b long, n int, key_a long, key_b long, low int, high int, anchor long"


def _cut(id_column: str, length: int, keep_text: bool):
    def run(batches):
        for batch in batches:
            out = []
            for text, places in zip(batch.column(1), batch.column(2)):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                gone = np.zeros(len(words) + 1, np.int32)
                if places.is_valid:
                    flat = places.values
                    low, high = (flat.field(i).to_numpy() for i in (0, 1))
                    np.add.at(gone, low, 1)
                    np.add.at(gone, high + length, -1)
                    stays = np.cumsum(gone)[:-1] == 0
                    kept = list(compress(words, stays.tolist()))
                else:
                    kept = words
                joined = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "surrogatepass") if keep_text else None))
            columns = list(zip(*out)) or [()] * 4
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string())))]
            names = [id_column, "n_words", "n_removed", "kept_sha256", "kept_text"]
            yield pa.RecordBatch.from_arrays(arrays[: 5 if keep_text else 4], names[: 5 if keep_text else 4])

    return run


def _twice(found: DataFrame) -> DataFrame:
    """The hashes (a, b) that occur twice, written."""
    return materialize(found.where("a IS NOT NULL").groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 1").select("a", "b"), "repeated")


def repeats(df: DataFrame, length: int = LENGTH, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """(key_a, key_b, places): for texts with repeats, where windows of ``length`` words start that start elsewhere, too; written.

    ``df`` has key_a, key_b and text. All windows around an anchor are looked up at once first. Only where an anchor's surroundings
    differ between its places are windows looked up one by one. Anchors to look at are a filter that is broadcast, or, where that would
    be over ``max_filter_bytes``, a table: rows of all anchors then meet it, and texts meet their own ranges of single windows.
    """
    spark = df.sparkSession
    counts = df.mapInArrow(_anchor_counts(length), "anchor long, n int")
    repeated = materialize(counts.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "anchors")

    def filter_of(anchors: DataFrame):
        number = anchors.count()
        return spark.sparkContext.broadcast(membership_filter(anchors, max(1, number), FILTER_BITS, max_filter_bytes)) if number * FILTER_BITS <= 8 * max_filter_bytes else None

    known = filter_of(repeated)
    found = materialize(df.mapInArrow(_candidates(length, known, True), _ROWS), "windows")
    if known is None:
        every = found
        found = materialize(every.where("anchor IS NULL").unionByName(every.where("anchor IS NOT NULL").hint("merge").join(repeated, "anchor", "left_semi").select(*every.columns)), "windows")
        discard(every)
    twice = _twice(found)
    differing = materialize(found.where("n = 1").hint("merge").join(twice, ["a", "b"], "left_anti").select("anchor").distinct(), "differing")
    known = filter_of(differing)
    if known is not None:
        single = df.mapInArrow(_candidates(length, known, False), _ROWS)
    else:
        wanted = found.where("a IS NOT NULL").hint("merge").join(differing, "anchor", "left_semi").groupBy(*_KEY).agg(F.collect_list(F.struct("low", "high", "n")).alias("ranges"))
        single = df.join(wanted, list(_KEY)).select(*_KEY, "text", "ranges").mapInArrow(_singles(length), _ROWS)
    single = materialize(single, "windows")
    again = _twice(single)
    place = lambda rows, known: rows.where("n = 1").select("a", "b", *_KEY, "low", "high").hint("merge").join(known, ["a", "b"]).select(*_KEY, "low", "high")
    places = place(found, twice).unionByName(place(single, again))
    for rows in (found, single):
        places = places.unionByName(rows.where("a IS NULL").select(*_KEY, "low", "high"))
    out = materialize(places.groupBy(*_KEY).agg(F.collect_list(F.struct("low", "high")).alias("places")), "places")
    discard(repeated, differing, found, twice, single, again)
    return out


def remove_repeats(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, keep_text: bool = False, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """One row for each row of ``df``: id, n_words, n_removed, kept_sha256 (and kept_text).

    Words are runs of ``[^\\x20\\x09-\\x0D]``, unchanged. Each word is removed that a window of ``length`` words
    covers whose words also start elsewhere, in the same text or another; windows are judged on the input.
    Null and empty texts have no words; texts of fewer words than a window stay whole. Rows that repeat count as
    two places. Kept words are joined by one space. Other columns are not read.
    """
    spark = df.sparkSession
    prepare(spark)
    # the key stands for the row in the shuffles, also where ids repeat or are null
    key = row_key(id_column, text_column)
    docs = df.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"), key[0].alias("key_a"), key[1].alias("key_b"))
    places = repeats(docs.select(*_KEY, "text"), length, max_filter_bytes)
    kind = docs.schema["id"].dataType.simpleString()
    joined = docs.join(places, list(_KEY), "left").select(F.col("id").alias(id_column), "text", "places")
    return joined.mapInArrow(_cut(id_column, length, keep_text), f"`{id_column}` {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that every document has and loses to repeated windows, by :func:`remove_repeats` at its defaults. Null texts have none."""
    return remove_repeats(table(spark, sf_dir, "documents"))
