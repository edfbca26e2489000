r"""Phrase collocations from word-id suffix arrays.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\x0A-\x0D]`` and these into words; a phrase never leaves its piece. A shard of
texts becomes an array of word ids whose suffixes are sorted by prefix doubling (orders by 1, 2, 4, … words, each from
the one before); the lengths of neighbours' common prefixes cut the array into intervals, and an interval of depth n is an n-gram
with its count. The shards' counts are added up by (language, phrase).

Only frequent phrases matter, and a phrase can be frequent only if the phrases in it are. So lengths are
counted one after the other, and a pass over the texts counts n-grams whose two (n - 1)-grams may be frequent: these are known by a
Bloom filter of bounded size, which lets no frequent phrase be missed; what it lets through in error falls short of the
least count as all others do. Scores are exact: products are decimals of 38 digits.

Scale: a shard's rows are added up before they shuffle, so a hot phrase is a few rows a task. The filter is the one thing that is
broadcast; phrases, their parts, and the extensions that make them redundant meet by joins. The first
``top`` of a language are found in two levels, so the last has a bounded number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import discard, materialize, prepare, table, text_of
from ._words import buffers, hashes, mix, spans, trim, windows
from .exact_dedup import BloomFilter, membership_filter

LEAST, MOST_WORDS, TOP = 100, 5, 2000
MAX_FILTER_BYTES = 64 << 20
BITS_PER_PHRASE = 12
#: Words of a suffix array, at most, and bytes of texts that are cut into words at once, but for a longer text.
SHARD_WORDS, _STEP_BYTES = 1 << 20, 3 << 19
#: The word counts of so many languages at most are broadcast.
FEW_LANGUAGES = 20_000
#: A language's phrases are ranked in so many parts before all together.
PARTS = 32

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?", 10, 11, 12, 13]] = True
_STOP = _CUT.copy()
_STOP[[9, 32]] = True


def suffix_array(ids: np.ndarray, run: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, length of each one's common prefix with the one before, at most ``depth``).

    A suffix begins at each position of ``ids`` and has ``run`` words at most; the order is by its first ``depth`` words or more.
    """
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1
    words, k = rank, 1
    while k < depth and n:
        after = np.zeros(n, np.int64)
        longer = np.flatnonzero(run > k)
        after[longer] = rank[longer + k]
        rank = np.unique(rank * np.int64(n + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
        k *= 2
    order = np.argsort(rank, kind="stable")
    common = np.zeros(n, np.int64)
    same = np.ones(max(0, n - 1), bool)
    a, b = order[:-1], order[1:]
    for d in range(depth):
        same = same & (run[a] > d) & (run[b] > d)
        same[same] = words[a[same] + d] == words[b[same] + d]
        common[1:] += same
    return order, common


def intervals(order: np.ndarray, common: np.ndarray, long_enough: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(a position, count) of each n-gram of ``depth`` words: the intervals of suffixes with so long a common prefix. Only suffixes that are ``long_enough`` count."""
    total = np.r_[0, np.cumsum(long_enough[order])]
    starts = np.flatnonzero(common < depth)
    count = total[np.r_[starts[1:], len(order)]] - total[starts]
    return order[starts[count > 0]], count[count > 0]


def _said(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes from each start to its end, as strings with one space for each white run."""
    size = ends - starts
    at = np.r_[0, np.cumsum(size)]
    picked = low[np.repeat(starts - at[:-1], size) + np.arange(at[-1])]
    text = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(picked.tobytes())).cast(pa.string())
    return pc.replace_substring_regex(text, "[ \t]+", " ")


def _language_hash(langs: pa.Array) -> np.ndarray:
    data, at = buffers(langs)
    return hashes(data, at[:-1], at[1:])


def _steps(batches):
    """Rows of the batches in steps of a few megabytes: languages, bytes, offsets. Freed memory goes back to the system after each."""
    for batch in batches:
        data, at = buffers(batch.column(1))
        low = 0
        while low < len(at) - 1:
            high = max(low + 1, int(np.searchsorted(at, at[low] + _STEP_BYTES, "right")) - 1)
            yield batch.column(0).slice(low, high - low), data[at[low] : at[high]], at[low : high + 1] - at[low]
            low = high
        trim()


def _counts(n: int, shared):
    """Of each batch: (lang, phrase, f) of its n-grams whose parts ``shared`` (a Bloom filter) may hold; for n = 1 also the number of words, as the phrase ''."""

    def run(batches):
        for langs, data, at in _steps(batches):
            low = _LOWER[data]
            starts, ends, bounds = spans(low, at, _STOP)
            if len(starts) < n:
                continue
            row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            own = mix(hashes(low, starts, ends) + _language_hash(langs)[row])
            cuts = np.r_[0, np.cumsum(_CUT[low])]
            linked = np.r_[(row[1:] == row[:-1]) & (cuts[starts[1:]] == cuts[ends[:-1]]), False]
            phrases, langs_, counts = [], [], []
            if n == 1:
                words = np.bincount(row, minlength=len(langs))
                some = np.flatnonzero(words)
                phrases, langs_, counts = [pa.array([""] * len(some), pa.string())], [langs.take(pa.array(some))], [words[some]]
                wanted = np.ones(len(own), bool)
            else:
                # chain[i]: words i and what follows, up to n, are in one piece
                chain = np.ones(len(own), bool)
                for d in range(n - 2):
                    chain[: len(own) - d] &= linked[d:]
                    chain[len(own) - d :] = False
                part = np.zeros(len(own), bool)
                if len(own) >= n - 1:
                    g = windows(own, n - 1)
                    part[: len(g)] = shared.value.holds(g.view(np.int64)) & chain[: len(g)]
                wanted = part & linked & np.r_[part[1:], False]
            for first in range(0, len(own), SHARD_WORDS):
                # an n-gram counts where it begins; those that begin in the shard may end behind it
                here = slice(first, min(len(own), first + SHARD_WORDS + n - 1))
                want = wanted[here].copy()
                want[SHARD_WORDS:] = False
                covered = want.copy()
                for d in range(1, min(n, len(want))):
                    covered[d:] |= want[: len(want) - d]
                kept = np.flatnonzero(covered)
                if not len(kept):
                    continue
                # words in no such n-gram go, and part what stands around them
                follows = np.r_[(kept[1:] == kept[:-1] + 1) & linked[here][kept[:-1]], False]
                breaks = np.flatnonzero(~follows)
                length = breaks[np.searchsorted(breaks, np.arange(len(kept)))] - np.arange(len(kept)) + 1
                order, common = suffix_array(own[here][kept], length, n)
                position, count = intervals(order, common, want[kept], n)
                position = kept[position] + first
                phrases.append(_said(low, starts[position], ends[position + n - 1]))
                langs_.append(langs.take(pa.array(row[position])))
                counts.append(count)
            for lang, phrase, count in zip(langs_, phrases, counts):
                yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(count.astype(np.int64))], ["lang", "phrase", "f"])

    return run


def _keys(n: int):
    """The hash of each (lang, phrase) of ``n`` words, as :func:`_counts` probes it."""

    def run(batches):
        for batch in batches:
            data, at = buffers(batch.column(1))
            starts, ends, bounds = spans(data, at, _STOP)
            row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            own = mix(hashes(data, starts, ends) + _language_hash(batch.column(0))[row])
            yield pa.RecordBatch.from_arrays([pa.array(windows(own, n)[bounds[:-1]].view(np.int64) if len(own) else np.zeros(0, np.int64))], ["h"])

    return run


def frequent(docs: DataFrame, n: int, held: BloomFilter | None, least: int) -> DataFrame:
    """(lang, phrase, f) of the n-grams of ``docs`` (lang, text) with ``least`` occurrences, and for n = 1 of the empty phrase, which stands for all words."""
    shared = docs.sparkSession.sparkContext.broadcast(held)
    found = docs.mapInArrow(_counts(n, shared), "lang string, phrase string, f long")
    return materialize(found.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least), f"phrases-{n}")


def scored(known: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two words or more in ``known`` (lang, phrase, f, size), at the cut with the lowest score.

    ``words``: (lang, n), the number of words of each language.
    """
    parts = F.split("phrase", " ")
    # a part's words, in one row for each cut
    cuts = known.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), parts.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    left = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    # few languages: none of them then brings all its phrases into one task
    near = F.broadcast(words) if words.count() <= FEW_LANGUAGES else words.hint("merge")
    both = cuts.hint("merge").join(left, ["lang", "first"]).hint("merge").join(right, ["lang", "rest"]).join(near, "lang")
    whole = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    score = F.expr(f"(CAST(1000 AS DECIMAL(4, 0)) * {whole('a')} * CAST(n AS DECIMAL(15, 0))) div ({whole('l')} * {whole('r')})").cast("long")
    best = both.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(df: DataFrame, text_column: str = "text", lang_column: str = "lang", least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a (its occurrences), l and r (those of its parts at the lowest-scoring cut), n (the language's words), score.

    Phrases have two to ``most_words`` words and ``least`` occurrences, overlaps included. A phrase that occurs only inside one longer
    phrase goes. Order: score and a descending, then phrase by its bytes. A null text has no words, a null language is ``und``.
    Repeated rows count as often as they stand there. An empty table, or one without a frequent phrase, gives an empty result. Other columns are not
    read. Texts are read whole; a suffix array has ``SHARD_WORDS`` words at most.
    """
    spark = df.sparkSession
    prepare(spark)
    docs = df.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), text_of(text_column).alias("text"))
    levels, held = [], None
    for n in range(1, most_words + 1):
        found = frequent(docs, n, held, least)
        rows = found.count()
        levels.append(found.withColumn("size", F.lit(n)))
        if n < most_words:
            keys = found.where("phrase <> ''").select("lang", "phrase").mapInArrow(_keys(n), "h long")
            held = membership_filter(keys, max(1, rows), BITS_PER_PHRASE, max_filter_bytes)
    known = levels[0].where("phrase <> ''")
    for found in levels[1:]:
        known = known.unionByName(found)
    words = levels[0].where("phrase = ''").select("lang", F.col("f").alias("n"))
    # an extension by one word that is as frequent says all that the phrase says; longer ones have such an extension in them
    w = F.split("phrase", " ")
    longer = known.where("size > 2").select("lang", F.col("f").alias("a"), F.explode(F.array(F.slice(w, F.lit(1), F.col("size") - 1), F.slice(w, F.lit(2), F.col("size") - 1))).alias("inner"))
    longer = longer.select("lang", "a", F.array_join("inner", " ").alias("phrase")).distinct()
    left = materialize(scored(known, words).hint("merge").join(longer, ["lang", "phrase", "a"], "left_anti"), "scored")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    few = few.withColumn("i", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("i") <= top)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language over all documents, by :func:`collocations` at its defaults. Null texts have no words, null languages are ``und``."""
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM words),
grams AS (SELECT lang, size, array_to_string(ws[i : i + size - 1], ' ') AS phrase FROM places, unnest(range(1, 6)) AS s(size) WHERE i + size - 1 <= len(ws)),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE size = 1 GROUP BY lang),
known AS (SELECT * FROM counts WHERE f >= 100),
cuts AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w, k FROM known, unnest(range(1, 5)) AS s(k) WHERE k < size),
scores AS (
  SELECT c.lang, c.size, c.phrase, c.a, c.k, x.f AS l, y.f AS r, n,
         (1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN known x ON x.lang = c.lang AND x.phrase = array_to_string(w[1 : k], ' ')
  JOIN known y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1 :], ' ')
), lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
left_over AS (
  SELECT * FROM lowest c
  WHERE NOT EXISTS (SELECT 1 FROM known d WHERE d.lang = c.lang AND d.size > c.size AND d.f * 100 >= c.a * 100 AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM left_over QUALIFY rank <= 2000
"""
