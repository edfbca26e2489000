r"""Importance resampling: documents drawn by how much likelier their words are in a target text.

A document's features are its runs of 1 to ``max_n`` words, hashed into ``BUCKETS``. A bucket's gain is the logarithm of its
smoothed share in the target over that in all documents, in whole thousandths; a document's weight is the mean gain of its features.
Weight plus Gumbel noise, which depends on the id alone, is the score, and the highest scores are a sample without replacement.

Higher-order functions turn a text into its array of buckets and add up ``element_at`` of one literal array of gains, so
scoring makes no rows of words and shuffles nothing. Only bucket totals shuffle, added up in each task before. They and
the counts of documents by score (whole numbers of a bounded range) are all that the driver sees. The drawn share
alone is ordered: by range, with the ranges' numbers of rows added up, so no task holds more than a range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, table, text_of
from ._native import let, number_rows

BUCKETS = 10_000
MAX_N = 1
#: Documents of so many words at least take part; so many of a hundred of them are drawn.
LEAST_WORDS, PERCENT = 20, 10
SEED = "2024"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words, before A-Z are lower-cased.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lower-cased."""
    words = F.filter(F.split(text, _BETWEEN), lambda w: w != "")
    # lower() changes letters beyond ASCII, too, so it is for words without any; it is much faster than translate()
    return F.transform(words, lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER)))


def buckets_of(text: Column, max_n: int = MAX_N, buckets: int = BUCKETS) -> Column:
    """The bucket of every run of 1 to ``max_n`` words of a text."""

    def of_length(words: Column, n: int) -> Column:
        return F.transform(F.slice(words, 1, F.greatest(F.size(words) - (n - 1), F.lit(0))), lambda _, i: F.array_join(F.slice(words, i + 1, F.lit(n)), " "))

    def runs(words: Column) -> Column:
        return F.concat(words, *[of_length(words, n) for n in range(2, max_n + 1)])

    features = let(words_of(text), runs) if max_n > 1 else words_of(text)
    return F.transform(features, lambda w: F.crc32(w.cast("binary")) % buckets)


def totals(df: DataFrame, text_column: str, max_n: int, buckets: int) -> list[int]:
    """Features of all texts in each bucket: ``buckets`` numbers come to the driver."""
    found = df.select(F.explode(buckets_of(text_of(text_column), max_n, buckets)).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()
    out = [0] * buckets
    for r in found:
        out[r.bucket] = r.n
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket."""
    k, s_all, t_all = len(source), sum(source), sum(target)
    return [math.floor(1000 * math.log(float((t + 1) * (s_all + k)) / float((s + 1) * (t_all + k)))) for s, t in zip(source, target)]


def noise(id_column: str, seed: str) -> Column:
    """Gumbel noise in whole thousandths, from the first 32 bits of sha256 of ``seed:id``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighed(df: DataFrame, gain: list[int], id_column: str, text_column: str, max_n: int, seed: str) -> DataFrame:
    """(id, n_features, n_words, weight, score) of each row."""
    # one literal: the optimizer folds the list of numbers into an array
    literal = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    b = df.select(F.col(id_column).alias("id"), buckets_of(text_of(text_column), max_n, len(gain)).alias("b"))
    total = F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + F.element_at(literal, (x + 1).cast("int")))
    n = b.select("id", F.size("b").cast("long").alias("n_features"), total.alias("total"))
    # of w words there are w + (w - 1) + ... runs, max_n terms at most
    n_words = F.col("n_features")
    if max_n > 1:
        few = F.floor((F.sqrt(8 * F.col("n_features") + 1) - 1) / 2).cast("long")
        n_words = F.when(few < max_n, few).otherwise(F.expr(f"(n_features + {max_n * (max_n - 1) // 2}) div {max_n}"))
    n = n.withColumn("n_words", n_words)
    weight = F.when(F.col("n_features") == 0, F.lit(0)).otherwise(F.expr("(total - pmod(total, n_features)) div nullif(n_features, 0)")).cast("long")
    return n.withColumn("weight", weight).select("id", "n_features", "n_words", "weight", (F.col("weight") + noise("id", seed)).cast("long").alias("score"))


def resample(
    docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text", target_column: str = "text",
    percent: int = PERCENT, least_words: int = LEAST_WORDS, max_n: int = MAX_N, buckets: int = BUCKETS, seed: str = SEED,
) -> DataFrame:
    """One row for each row of ``docs``: id, n_features, weight, score, and its rank among the drawn, null if it wasn't drawn.

    Of the N rows with ``least_words`` words, floor(percent N / 100) with the highest scores are drawn; ties go to the smaller id, a null id
    first. Null and empty texts have no features and weight 0. A null id has the noise of an empty one. Rows that repeat an id and
    text have equal scores and ranks of their own. With an empty table of documents the result is empty; with an empty target
    all gains come from the documents' counts alone. Texts are read whole; other columns are not read.
    """
    gain = gains(totals(docs, text_column, max_n, buckets), totals(target, target_column, max_n, buckets))
    scored = materialize(weighed(docs, gain, id_column, text_column, max_n, seed), "scored")
    able = F.col("n_words") >= least_words
    # scores are whole numbers of a bounded range, so their counts are few
    by_score = sorted(((r.score, r.n) for r in scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    left = wanted = percent * sum(n for _, n in by_score) // 100
    cut = None
    for score, n in by_score:
        if left <= 0:
            break
        cut, left = score, left - n
    near = able & (F.col("score") >= cut) if cut is not None else F.lit(False)
    none = scored.where(~near).withColumn("rank", F.lit(None).cast("long"))
    order = [F.desc("score"), F.asc_nulls_first("id"), F.asc("n_features"), F.asc("row")]
    drawn = number_rows(scored.where(near).withColumn("row", F.monotonically_increasing_id()), order, "rank").drop("row") if cut is not None else none.limit(0)
    out = none.unionByName(drawn.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))))
    return out.select(F.col("id").alias(id_column), "n_features", "weight", "score", "rank")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document against the benchmark's texts, by :func:`resample` at its defaults. Null texts have no features; ties go to the smaller id."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: crc32 isn't a function of SQL: it is computed bit by bit for each distinct word.
OP13_SQL = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 'b', 0, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), digits AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM words)),
bytes AS (SELECT w, list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT)) AS b FROM digits),
crc AS (
  SELECT w, xor(list_reduce(b, lambda c, v: list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(c, v)), 4294967295), 4294967295) % 10000 AS bucket FROM bytes
), found AS (SELECT side, id, bucket FROM words JOIN crc USING (w)),
counts AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM found GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0) AS sa, coalesce(sum(t), 0) AS ta FROM counts),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (sa + 10000) AS DOUBLE) / CAST((s + 1) * (ta + 10000) AS DOUBLE))) AS BIGINT) AS g FROM counts, sums),
weights AS (SELECT id, count(*) AS n, sum(g) AS total FROM found JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, CAST(coalesce((total - ((total % n) + n) % n) // n, 0) AS BIGINT) AS weight,
         (CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296 AS u
  FROM documents LEFT JOIN weights ON id = doc_id
), noisy AS (SELECT doc_id, n_features, weight, CAST(weight + floor(-1000 * ln(-ln(CAST(u AS DOUBLE)))) AS BIGINT) AS score FROM scored),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM noisy WHERE n_features >= 20
  QUALIFY rank <= 10 * count(*) OVER () // 100
)
SELECT doc_id, n_features, weight, score, rank FROM noisy LEFT JOIN ranked USING (doc_id)
"""
