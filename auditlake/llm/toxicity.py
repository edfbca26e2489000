"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The features are rates of a text: hits in a fixed word list and in a lexicon learned from the labels
(words and beginnings of words), hits near the second person, capitals, punctuation and obfuscated
words. The labelled sample is dealt into parts by the hash of the id: a part's features come from a lexicon
that was learned without it, and its margins for the calibration from trees that were fitted without it.

Scale: the sample is bounded (``SAMPLE`` documents by the smallest hash of their id), the driver sees
dense features of the sample only, the lexicon has at most ``LEXICON`` entries. Scoring reads every text
once and shuffles nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import held_fold, materialize, prepare, quoted, table, text_of
from ._training import labelled_sample
from ._words import buffers, hashes, mix, spans, trim, windows
from .quality import _steps

#: Labelled documents that are read for fitting, at most; entries of the learned lexicon, at most.
SAMPLE, LEXICON = 12_000, 4096
PREFIXES = (4, 5, 6, 7, 8)
PARTS = 3
#: A fixed list of insults in English.
INSULTS = (
    "idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown clowns dumb dumbass garbage "
    "imbecile fool jerk freak coward bastard bitch asshole vermin filth degenerate retard retarded ugly pig"
).split()
#: The second person in English, German, French and Spanish.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine tu te toi ton ta vous votre tú ti usted tus".split()
NEAR = 4
TREES, DEPTH, RATE, BINS = 60, 3, 0.15, 32

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_OTHER = np.ones(256, bool)  # bytes that part words: ASCII other than letters, digits and the signs of obfuscation
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789@$*":
    _OTHER[_c] = False
_OTHER[128:] = False
_SIGN = np.zeros(256, bool)
_SIGN[[*b"0123456789@$*"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*b"abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True
_MARK = np.zeros(256, bool)
_MARK[[*b"!\"#%&'()*+,-./:;<=>?[\\]^_`{|}~$@"]] = True
_PLAIN = np.arange(256, dtype=np.uint8)  # what the signs of obfuscation stand for
for _a, _b in zip(b"013457@$", b"oleastas"):
    _PLAIN[_a] = _b


def _hash_list(words) -> np.ndarray:
    data, at = buffers(pa.array(list(words)))
    return np.sort(hashes(data, at[:-1], at[1:]))


def _within(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def _parse(data: np.ndarray, at: np.ndarray):
    """Words, lower-cased in ASCII, with the hashes of each word, of its beginnings, and of what its signs stand for."""
    low = _LOWER[data]
    starts, ends, bounds = spans(data, at, _OTHER)
    word = hashes(low, starts, ends)
    parts = [np.where(ends - starts > n, mix(hashes(low, starts, np.minimum(ends, starts + n)) + np.uint64(n)), np.uint64(0)) for n in PREFIXES]
    signs = np.concatenate([[0], np.cumsum(_SIGN[data])])
    letters = np.concatenate([[0], np.cumsum(_LETTER[low])])
    mixed = (signs[ends] > signs[starts]) & (letters[ends] > letters[starts])
    plain = word.copy()
    if mixed.any():
        plain[mixed] = hashes(_PLAIN[low], starts[mixed], ends[mixed])
    return starts, ends, bounds, word, parts, mixed, plain


NAMES = ["insults", "insult_count", "learned", "learned_count", "beginnings", "beginning_count", "strongest", "second_person", "near", "capitals", "capital_words", "marks", "exclamations", "obfuscated", "obfuscated_hits", "log_words", "word_length"]


def features(data: np.ndarray, at: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One row of ``NAMES`` for each text; an empty text has zeros."""
    known, weight = lexicon
    starts, ends, bounds, word, parts, mixed, plain = _parse(data, at)
    rows, n = len(at) - 1, np.diff(bounds)
    row = np.repeat(np.arange(rows), n)
    count = lambda hit: np.bincount(row, hit, rows)
    per, size = np.maximum(n, 1), np.maximum(np.diff(at), 1)
    byte = lambda t: np.diff(np.concatenate([[0], np.cumsum(t[data])])[at]) / size
    insult = _within(_INSULTS, plain)
    learned = _within(known, word)
    strength = np.zeros(len(word))
    begins = np.zeros(len(word), bool)
    for h, found in [(word, learned), *((p, _within(known, p)) for p in parts)]:
        if found.any():
            strength[found] = np.maximum(strength[found], weight[np.searchsorted(known, h[found])])
        if h is not word:
            begins |= found
    hit = insult | learned | begins
    you = np.flatnonzero(_within(_YOU, word))
    near = np.zeros(len(word), bool)
    if len(you):
        h = np.flatnonzero(hit)
        k = np.searchsorted(you, h)
        for side in (np.maximum(k - 1, 0), np.minimum(k, len(you) - 1)):
            near[h] |= (np.abs(you[side] - h) <= NEAR) & (row[you[side]] == row[h])
    strongest = np.zeros(rows)
    if len(word):
        np.maximum.at(strongest, row, strength)
    capital = np.concatenate([[0], np.cumsum(_CAPITAL[data])])
    shouted = (ends - starts > 1) & (capital[ends] - capital[starts] == ends - starts)
    exclaim = np.zeros(256, bool)
    exclaim[ord("!")] = True
    columns = [count(insult) / per, np.log1p(count(insult)), count(learned) / per, np.log1p(count(learned)), count(begins) / per, np.log1p(count(begins)), strongest, np.bincount(row[you], minlength=rows) / per, count(near) / per, byte(_CAPITAL), count(shouted) / per, byte(_MARK), byte(exclaim), count(mixed) / per, count(mixed & insult) / per, np.log1p(n), size / per]
    return np.stack(columns, axis=1)


_INSULTS, _YOU = _hash_list(INSULTS), _hash_list(SECOND_PERSON)


def learn_lexicons(sample: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Words and beginnings that stand out in toxic texts of ``sample`` (label, part, text): sorted hashes, log odds.

    One lexicon without each of the ``PARTS`` parts, and one of all. Copies count once: of texts with the same
    smallest hash of five words one is read: a toxic one if there is any, so a clean text that
    quotes a toxic one does not take its words back.
    """

    def run(batches):
        for batch in batches:
            labels, parts_ = batch.column("label").to_pylist(), batch.column("part").to_pylist()
            for low, high, data, at in _steps(batch.column("text")):
                _, _, bounds, word, parts, _, _ = _parse(data, at)
                keys, own = [], []
                for a, b in zip(bounds, bounds[1:]):
                    h = np.unique(np.concatenate([word[a:b], *(p[a:b] for p in parts)]))
                    own.append(h[h != 0].view(np.int64).tolist())
                    keys.append(int(windows(word[a:b], 5).view(np.int64).min()) if b - a >= 5 else int(np.bitwise_xor.reduce(word[a:b]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(labels[low:high], pa.int32()), pa.array(parts_[low:high], pa.int64()), pa.array(keys, pa.int64()), pa.array(own, pa.list_(pa.int64()))], ["label", "part", "copies", "words"])

    docs = sample.select("label", "part", "text").mapInArrow(run, "label int, part long, copies long, words array<long>")
    docs = materialize(docs.groupBy("copies").agg(F.max(F.struct("label", "part", "words")).alias("d")).select("d.*"), "lexicon")
    sizes = {r.part: (r.n - r.toxic, r.toxic) for r in docs.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")).collect()}
    words = docs.select("label", "part", F.explode("words").alias("w"))
    of = lambda label, k: F.sum(((F.col("label") == label) & (F.col("part") != k)).cast("int")).alias(f"n{label}_{k}")
    counts = materialize(words.groupBy("w").agg(*[of(label, k) for label in (0, 1) for k in range(PARTS + 1)]).where(f"n1_{PARTS} >= 3"), "words")
    out = []
    for k in range(PARTS + 1):
        clean, toxic = (sum(v[i] for p, v in sizes.items() if p != k) for i in (0, 1))
        a, b = F.col(f"n1_{k}"), F.col(f"n0_{k}")
        odds = F.log((a + 0.5) / (toxic + 1.0)) - F.log((b + 0.5) / (clean + 1.0))
        rows = counts.where(a >= max(3, round(0.01 * toxic))).select("w", a.alias("a"), odds.alias("odds")).where("odds >= 2.5").orderBy(F.desc("odds"), F.desc("a"), "w").limit(LEXICON).collect()
        known = np.array([r.w for r in rows], np.int64).view(np.uint64)
        order = np.argsort(known)
        out.append((known[order], np.array([r.odds for r in rows], float)[order]))
    return out


def fit_trees(x: np.ndarray, y: np.ndarray):
    """Boosted trees of depth ``DEPTH`` for logistic loss over binned features: (edges, start, [(feature, edge, left, right | value)])."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    start = float(np.log(p / (1 - p)))
    margin, trees = np.full(len(y), start), []
    for _ in range(TREES if 0 < y.sum() < len(y) else 0):
        prob = 1 / (1 + np.exp(-margin))
        g, h = y - prob, prob * (1 - prob)
        tree = []

        def grow(rows, depth):
            node, total_g, total_h = len(tree), g[rows].sum(), h[rows].sum()
            tree.append(None)
            best = (1e-6, None, None)
            if depth < DEPTH and len(rows) >= 10:
                for f in range(x.shape[1]):
                    bins = len(edges[f]) + 1
                    gl = np.cumsum(np.bincount(binned[rows, f], g[rows], bins))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, f], h[rows], bins))[:-1]
                    gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
                    gain[(hl < 0.5) | (total_h - hl < 0.5)] = 0
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), f, int(gain.argmax()))
            if best[1] is None:
                tree[node] = (-1, 0.0, 0, 0, RATE * total_g / (total_h + 1))
                return node
            left = binned[rows, best[1]] <= best[2]
            tree[node] = (best[1], float(edges[best[1]][best[2]]), grow(rows[left], depth + 1), grow(rows[~left], depth + 1), 0.0)
            return node

        grow(np.arange(len(y)), 0)
        trees.append(tree)
        margin += tree_values(tree, x)
    return start, trees


def tree_values(tree, x: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), int)
    feature, edge, left, right, value = (np.array(c) for c in zip(*tree))
    for _ in range(DEPTH):
        f = feature[node]
        inner = f >= 0
        node = np.where(inner, np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= edge[node], left[node], right[node]), node)
    return value[node]


def margins(model, x: np.ndarray) -> np.ndarray:
    start, trees = model
    return start + sum((tree_values(t, x) for t in trees), np.zeros(len(x)))


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (margins, rates), both rising, with a little of the overall rate in each pool."""
    if not len(y):
        return np.array([-1.0, 1.0]), np.array([0.27, 0.73])
    order = np.argsort(margin, kind="stable")
    pools = []  # [sum of labels, weight, sum of margins]
    for m, v in zip(margin[order], y[order]):
        pools.append([float(v), 1.0, float(m)])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[2] / p[1] for p in pools]), np.array([(p[0] + y.mean()) / (p[1] + 1) for p in pools])


def train(sample: DataFrame):
    """(lexicon, trees, calibration) from ``sample`` (id, label, key, text), whose size is bounded."""
    spark = sample.sparkSession
    prepare(spark)
    sample = materialize(sample.withColumn("part", F.pmod(F.xxhash64("key", F.lit(3)), F.lit(PARTS))), "toxicity")
    lexicons = learn_lexicons(sample)
    shared = spark.sparkContext.broadcast(lexicons)

    def run(batches):
        for batch in batches:
            for k in range(PARTS):
                own = batch.filter(pa.array(batch.column("part").to_numpy(zero_copy_only=False) == k))
                parts = [features(data, at, shared.value[k]) for _, _, data, at in _steps(own.column("text"))]
                x = np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))
                yield pa.RecordBatch.from_arrays([own.column("key"), own.column("label"), own.column("part"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["key", "label", "part", "x"])

    rows = sample.select("key", "label", "text", "part").mapInArrow(run, "key long, label int, part long, x array<double>").toPandas()
    rows = rows.sort_values("key", kind="stable")
    x = np.array(rows.x.tolist(), float).reshape(len(rows), len(NAMES))
    y, part = rows.label.to_numpy(float), rows.part.to_numpy()
    unseen = np.zeros(len(y))
    for k in range(PARTS):
        own = part == k
        unseen[own] = margins(fit_trees(x[~own], y[~own]), x[own])
    return lexicons[PARTS], fit_trees(x, y), isotonic(unseen, y)


def score(df: DataFrame, model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) for each row; null and empty texts are scored as texts without a word, repeated rows alike. An id may be of any type, a struct of a whole row too.

    Long texts are read whole, in steps of a few megabytes. An empty table gives an empty result. Other columns are not read.
    """
    spark = df.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        lexicon, trees, (at_margin, rate) = shared.value
        for batch in batches:
            parts = [margins(trees, features(data, at, lexicon)) for _, _, data, at in _steps(batch.column(1))]
            m = np.concatenate([np.zeros(0), *parts])
            # steps of the calibration, with a thousandth of the margin so that texts on one step keep their order
            out = 0.999 * np.interp(m, at_margin, rate) + 0.001 / (1 + np.exp(-np.clip(m, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], [id_column, "score"])
        trim()

    rows = df.select(quoted(id_column).alias("id"), text_of(text_column).alias("text"))
    return rows.mapInArrow(run, T.StructType([T.StructField(id_column, rows.schema["id"].dataType), T.StructField("score", T.DoubleType())]))


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame):
    return train(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", 5, 0, SAMPLE))


def op3_toxicity_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learned outside of the held-out fifth. Null and empty texts are scored as texts without a word, repeated rows alike."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, toxicity_model(spark, sf_dir, docs))
    return scored.select("doc_id", (held_fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
