"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of n-grams: bytes in threes, and word shapes
(first, second and last byte's class, length, same word as before) in ones, twos
and threes, hashed.  Indicators are scaled by the log ratio of their smoothed
shares in the two classes and a linear hinge-loss model is fitted to them by dual
coordinate descent; a logistic curve over the margins gives scores.

The model is fitted on at most ``SAMPLE`` labelled rows, chosen by a hash of
their doc_id; every text is scored whole.

Defined cases: a null or empty text has no indicators and gets the model's base
score; rows without a label and labels without a row are not learnt from; of
several labels of a doc_id the least counts; without rows of both classes each
score is the share of class 1 (0.5 without any label).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, slices, tidy

BITS = 16
SIZE = 2 << BITS  # indicators: byte n-grams, then shape n-grams
SAMPLE = 6000  # labelled rows to learn from at most
EPOCHS, COST = 12, 0.1
_CLASS = np.zeros(256, np.uint64)
for _c, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b".,;:", b"-'\"()", range(128, 256)), 1):
    _CLASS[list(_bytes)] = _c


def indicators(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, indicator), sorted and distinct, of a slice of texts."""
    rows = len(starts) - 1
    doc = np.repeat(np.arange(rows), np.diff(starts))
    keys = []
    if len(data) > 2:
        b = data.astype(np.uint64)
        three = mix(b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]) >> np.uint64(64 - BITS)
        inside = doc[:-2] == doc[2:]
        keys.append(doc[:-2][inside] * SIZE + three[inside].astype(np.int64))
    w = Words(data, starts)
    if len(w.hash):
        size = w.end - w.start
        second = np.minimum(w.start + 1, w.end - 1)
        shape = _CLASS[data[w.start]] * np.uint64(49) + _CLASS[data[second]] * np.uint64(7) + _CLASS[data[w.end - 1]]
        shape = shape * np.uint64(8) + np.minimum(np.log2(size).astype(np.uint64), np.uint64(7))
        same = np.zeros(len(size), np.uint64)
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        shape = shape * np.uint64(2) + same
        for k in (1, 2, 3):
            n = len(shape) - k + 1
            if n > 0:
                h = np.full(n, k, np.uint64)
                for j in range(k):
                    h = h * np.uint64(4096) + shape[j : j + n]
                inside = w.doc[:n] == w.doc[k - 1 :]
                keys.append(w.doc[:n][inside] * SIZE + (SIZE >> 1) + (mix(h)[inside] >> np.uint64(64 - BITS)).astype(np.int64))
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return key // SIZE, key % SIZE


def fit(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float, float, float]:
    """(weight of each indicator, bias, slope, offset) from the indicators of each row and labels 0 or 1."""
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return np.zeros(SIZE), 0.0, 1.0, float(np.log(p / (1 - p)))
    share = []
    for c in (1, 0):
        n = np.bincount(np.concatenate([x for x, t in zip(rows, y) if t == c] or [np.zeros(0, np.int64)]), minlength=SIZE) + 1.0
        share.append(np.log(n / n.sum()))
    ratio = share[0] - share[1]
    sign = np.where(y == 1, 1.0, -1.0)
    cost = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) * COST
    values = [ratio[x] / max(1.0, np.sqrt(len(x))) for x in rows]
    norm = np.array([float(v @ v) + 1.0 for v in values])
    w, bias, alpha, order = np.zeros(SIZE), 0.0, np.zeros(len(y)), np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(y)):
            x, v, s = rows[i], values[i], sign[i]
            new = min(max(alpha[i] - (s * (w[x] @ v + bias) - 1) / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * s
                w[x] += step * v
                bias += step
                alpha[i] = new
    margin = np.array([w[x] @ v for x, v in zip(rows, values)]) + bias
    a, b, target = 1.0, 0.0, (y * y.sum() + y + (1 - y)) / (y.sum() + 2)  # smoothed targets of a logistic fit
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = np.array([(p - target) @ margin, (p - target).sum()]), p * (1 - p)
        m = np.array([[(h * margin) @ margin, h @ margin], [h @ margin, h.sum()]]) + 1e-6 * np.eye(2)
        a, b = np.array([a, b]) - np.linalg.solve(m, g)
    return w * ratio, bias, float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float, float, float]:
    """Fit a model on at most ``sample`` rows of ``docs`` that ``labels`` (doc_id, y) marks:
    of rows that share a doc_id the one whose indicators have the least hash."""
    chosen = labels.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    marked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("y", "text", F.col("doc_id").cast("long").alias("doc_id"))

    @tidy
    def run(batches):
        for batch in batches:
            y = batch.column(0)
            for lo, n, data, starts in slices(batch.column(1)):
                row, at = indicators(data, starts)
                cuts = np.searchsorted(row, np.arange(n + 1))
                found = [at[a:b].astype("<i4").tobytes() for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(lo, n), y.slice(lo, n).cast(pa.int32()), pa.array(found, pa.binary())], names=["doc_id", "y", "at"])

    one = marked.mapInArrow(run, "doc_id long, y int, at binary").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("at").alias("h"), "at", "y")).alias("v"))
    got = sorted((r["y"], bytes(r["at"])) for r in one.select("v.y", "v.at").toLocalIterator())
    return fit([np.frombuffer(x, "<i4").astype(np.int64) for _, x in got], np.array([y for y, _ in got], float))


def score(docs: DataFrame, model: tuple[np.ndarray, float, float, float], least: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches):
        weight, bias, slope, offset = held.value
        for batch in batches:
            for lo, n, data, starts in slices(batch.column(1)):
                row, at = indicators(data, starts)
                total = np.bincount(row, weight[at], n) / np.maximum(1.0, np.sqrt(np.bincount(row, minlength=n)))
                p = 1 / (1 + np.exp(-np.clip(slope * (total + bias) + offset, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(p)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double").withColumn(
        "predicted", (F.col("score") >= least).cast("int")
    )


def held_out(doc_id):
    """Whether a row is kept from learning: crc32 of its doc_id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    learnt = labels.select("doc_id", F.col("quality").alias("y")).where(~held_out(F.col("doc_id")))
    return score(docs, train(docs, learnt)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
