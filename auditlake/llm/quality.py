"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal.

Features are hashes of words, word shapes, and pairs of either, each counted per word of the text; a pair
of equal words is one feature of its own. The model is one array of ``DIMENSIONS`` weights, a score is the
sparse dot product of the text's features with it.

Training is sequential by nature, so it runs in one task over a bounded sample (``SAMPLE`` documents by
the smallest hash of their id); scoring reads every text once and shuffles nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import held_fold, prepare, table, text_of
from ._training import labelled_sample
from ._words import buffers, hashes, mix, spans

DIMENSIONS = 1 << 18
#: Labelled documents that the model is fitted on, at most.
SAMPLE = 6000
EPOCHS, ALPHA, BETA, L1, L2 = 4, 1.0, 1.0, 1e-4, 1e-3
_STEP_BYTES = 4 << 20

#: Each byte's class in a word's shape: letters a or A, digits 0, all beyond ASCII a, the rest itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = _SHAPE[128:] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word's shape: byte classes with runs of one class as one."""
    classes = _SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = classes[1:] != classes[:-1]
    keep[starts] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return hashes(classes[keep], at[starts], at[ends])


def ngrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature) of every n-gram, and the number of words of each row."""
    starts, ends, bounds = spans(data, at)
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n)
    word, shape = hashes(data, starts, ends), _shapes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    both = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)

    def pairs(h, same):
        p = mix(h[:-1] * np.uint64(3) + h[1:])
        p[h[:-1] == h[1:]] = same
        return p[both]

    parts = [mix(word + np.uint64(1)), mix(shape + np.uint64(2))]
    rows = [row, row]
    if len(row) > 1:
        parts += [pairs(word, 0x5A5A), pairs(shape + np.uint64(7), 0xA5A5)]
        rows += [row[1:][both], row[1:][both]]
    feature = (np.concatenate(parts) % np.uint64(DIMENSIONS)).astype(np.int64)
    return np.concatenate(rows), feature, n


def _steps(column):
    """Rows of a column in steps of a few megabytes: (first, last, bytes, offsets)."""
    data, at = buffers(column)
    low = 0
    while low < len(at) - 1:
        high = max(low + 1, int(np.searchsorted(at, at[low] + _STEP_BYTES, "right")) - 1)
        yield low, high, data[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def _examples(batches):
    """For each labelled text: label, key, its features and their counts per word."""
    for batch in batches:
        label, key = batch.column("label").to_pylist(), batch.column("key").to_pylist()
        for low, high, data, at in _steps(batch.column("text")):
            row, feature, n = ngrams(data, at)
            cell, count = np.unique(row * DIMENSIONS + feature, return_counts=True)
            edge = np.searchsorted(cell, np.arange(high - low + 1) * DIMENSIONS)
            index = [(cell[a:b] % DIMENSIONS).astype("<i4").tobytes() for a, b in zip(edge, edge[1:])]
            value = [(count[a:b] / max(1, m)).astype("<f4").tobytes() for a, b, m in zip(edge, edge[1:], n)]
            yield pa.RecordBatch.from_arrays([pa.array(label[low:high], pa.int32()), pa.array(key[low:high], pa.int64()), pa.array(index, pa.binary()), pa.array(value, pa.binary())], ["label", "key", "index", "value"])


def fit_ftrl(examples: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
    """Weights and bias after ``EPOCHS`` passes over (label, index, value), in the given order."""
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weight(i):
        return np.where(np.abs(z[i]) <= L1, 0.0, (np.sign(z[i]) * L1 - z[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for label, index, value in examples:
            i, x = np.append(index, DIMENSIONS), np.append(value, 1.0)  # the bias is the last weight
            w = weight(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    w = weight(np.arange(DIMENSIONS + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def _train(batches):
    rows = [(b.column("key")[i].as_py(), b.column("label")[i].as_py(), b.column("index")[i].as_py(), b.column("value")[i].as_py()) for b in batches for i in range(b.num_rows)]
    # in the order of the hashed keys, which is none; repeated rows stand together
    weights, bias = fit_ftrl([(y, np.frombuffer(i, "<i4"), np.frombuffer(v, "<f4").astype(float)) for _, y, i, v in sorted(rows)])
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["weights", "bias"])


def train(sample: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and bias for ``sample`` (label, key, text), whose size is bounded; without rows all weights are 0."""
    prepare(sample.sparkSession)
    examples = sample.select("label", "key", "text").mapInArrow(_examples, "label int, key long, index binary, value binary")
    model = examples.repartition(1).mapInArrow(_train, "weights binary, bias double").first()
    return np.frombuffer(model.weights, np.float32), model.bias


def score(df: DataFrame, model: tuple[np.ndarray, float], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) for each row; null and empty texts have the score of the bias alone, repeated rows the same score.

    Long texts are read whole, in steps of a few megabytes. An empty table gives an empty result. Other columns are not read.
    """
    spark = df.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        weights, bias = shared.value
        for batch in batches:
            parts = [np.zeros(0)]
            for low, high, data, at in _steps(batch.column(1)):
                row, feature, n = ngrams(data, at)
                parts.append(bias + np.bincount(row, weights[feature], high - low) / np.maximum(n, 1))
            margin = np.clip(np.concatenate(parts), -30, 30)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-margin)))], [id_column, "score"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(F.col(id_column), text_of(text_column).alias("text")).mapInArrow(run, f"`{id_column}` {kind}, score double")


def op8_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text, learned outside of the held-out third. Null and empty texts have the score of the bias, repeated rows the same."""
    docs = table(spark, sf_dir, "documents")
    model = train(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", 3, 1, SAMPLE))
    scored = score(docs, model)
    return scored.select("doc_id", (held_fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
