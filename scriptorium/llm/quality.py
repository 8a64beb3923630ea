"""Quality classifier: naive Bayes support vectors over hashed n-grams.

Features are indicators of n-grams at three levels: byte-class 4-grams (how a text
is written), word-shape 3-grams with a mark where a word repeats the one before it
(how it runs on), and words (what it says). Indicators are scaled by the class
log-count ratio, a linear hinge-loss model is fitted by dual coordinate descent, and
its margin is mapped to a probability on rows that the fit has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark
from ._arrays import SpanHash, bounded, counts_to_offsets, list_column, spans, text_buffer

_CLASSES, _SHAPES, _WORDS = 1 << 16, 1 << 12, 1 << 16
DIMENSIONS = _CLASSES + _SHAPES + _WORDS


def _byte_classes() -> np.ndarray:
    kind = np.full(256, 15, np.uint16)  # beyond ASCII
    kind[:128] = 14  # other signs
    for i, group in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!?", "|", "$%&#*@", "<>/\\=_{}[]", "'\"`", "()-+~^")):
        kind[[ord(c) for c in group]] = i
    return kind


_KIND = _byte_classes()
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def indicator_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct feature numbers of all texts in turn, offsets)."""
    data, offsets = text_buffer(column)
    n, parts = len(offsets) - 1, []
    key = lambda row, feature: row * DIMENSIONS + feature
    if len(data) >= 4:
        kind = _KIND[data]
        four = (kind[:-3] << 12) | (kind[1:-2] << 8) | (kind[2:-1] << 4) | kind[3:]
        for i in range(n):  # counting each text's 4-grams is cheaper than sorting those of all
            a, b = int(offsets[i]), int(offsets[i + 1]) - 3
            if b > a:
                parts.append(key(i, np.flatnonzero(np.bincount(four[a:b]))))
    starts, ends, row = spans(~_SPACE[data], offsets)
    if len(starts):
        word = SpanHash.of_bytes(data)(starts, ends)
        parts.append(key(row, _CLASSES + _SHAPES + (word % np.uint64(_WORDS)).astype(np.int64)))
        again = np.zeros(len(word), np.int64)
        again[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
        first, last = _KIND[data[starts]].astype(np.int64), _KIND[data[ends - 1]].astype(np.int64)
        shape = (np.minimum(first, 2) * 3 + np.minimum(np.maximum(last - 5, 0), 2)) % 8 * 2 + again
        if len(shape) >= 3:
            same = row[2:] == row[:-2]
            parts.append(key(row[2:][same], _CLASSES + (shape[:-2][same] << 8 | shape[1:-1][same] << 4 | shape[2:][same])))
    if not parts:
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    keys = np.unique(np.concatenate(parts))
    return (keys % DIMENSIONS).astype(np.int32), counts_to_offsets(keys // DIMENSIONS, n)


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # of each feature, float32; log-count ratios are folded in
    bias: float
    slope: float
    shift: float

    def margins(self, features: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        counts = np.diff(offsets)
        sums = np.concatenate(([0.0], np.cumsum(self.weights[features], dtype=np.float64)))
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.sqrt(np.maximum(counts, 1)) + self.bias

    def scores(self, features: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(features, offsets) + self.shift, -30, 30)))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, dimensions: int, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of an L1-loss linear support vector machine; y is -1 or 1, `cost` bounds each dual variable."""
    w, bias, alpha = np.zeros(dimensions), 0.0, np.zeros(len(y))
    norms = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1.0
            fresh = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            if step := (fresh - alpha[i]) * y[i]:
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = fresh
        if moved < 1e-6:
            break
    return w, bias


def fit_quality(sample: DataFrame, c: float = 1.0, smoothing: float = 1.0, min_documents: int = 3) -> QualityModel:
    """Model from (text, y) of a bounded sample; it is gathered to the driver as feature numbers.

    With one label only, every text scores that label's smoothed share.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            found, offsets = indicator_features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), list_column(found, offsets, pa.int32())], names=["doc_id", "y", "f"])

    got = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "y", "text").mapInArrow(features, "doc_id long, y int, f array<int>").toArrow().sort_by("doc_id")
    y = got.column("y").to_numpy().astype(np.float64) if got.num_rows else np.zeros(0)
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    if not 0 < y.sum() < len(y):
        return QualityModel(np.zeros(DIMENSIONS, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    rows = [np.asarray(x.values.to_numpy(), np.int64) for x in got.column("f")]
    fit = np.arange(len(y)) % 5 != 0  # every fifth row of the id order calibrates
    if len(set(y[fit])) < 2 or len(set(y[~fit])) < 2:
        fit[:] = True
    pos, neg = (np.bincount(np.concatenate([rows[i] for i in np.flatnonzero(fit & (y == k))]), minlength=DIMENSIONS) for k in (1, 0))
    p, q = pos + smoothing, neg + smoothing
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[pos + neg < min_documents] = 0.0
    sign = np.where(y == 1, 1.0, -1.0)
    balance = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    values = [ratio[x] / np.sqrt(max(len(x), 1)) for x in rows]
    chosen = np.flatnonzero(fit)
    w, bias = dual_coordinate_descent([rows[i] for i in chosen], [values[i] for i in chosen], sign[chosen], c * balance[chosen], DIMENSIONS)
    model = QualityModel((w * ratio).astype(np.float32), float(bias), 1.0, 0.0)
    seen = np.flatnonzero(~fit) if not fit.all() else chosen
    flat, offsets = np.concatenate([rows[i] for i in seen]), np.concatenate(([0], np.cumsum([len(rows[i]) for i in seen])))
    slope, shift = _platt(model.margins(flat, offsets), y[seen])
    return QualityModel(model.weights, model.bias, slope, shift)


def _platt(margin: np.ndarray, y: np.ndarray, ridge: float = 0.01, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins, with smoothed targets."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    x, w = np.stack([margin, np.ones(len(y))], 1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([ridge, 1e-6]), x.T @ (p - target) + np.array([ridge * (w[0] - 1), 0.0]))
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 0.05)), float(w[1])


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score (0 to 1) of every text.

    Null and empty texts have no features and score by the bias alone; null doc_ids
    and repeated rows are kept; an empty table gives no rows. Only doc_id and text are
    read. A text's features are found whole, and equal texts score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 0.5 MB whatever the corpus

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(*indicator_features(batch.column("text"))))], names=["doc_id", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double")


def fit_and_score(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, fold_by: int = 3) -> DataFrame:
    """`score_quality` with a model of at most `max_rows` rows of `labels` outside the held-out fold."""
    train = _spark.crc32_remainder(F.col("doc_id"), fold_by) != 1
    return score_quality(docs, fit_quality(_spark.labelled_sample(docs, labels, "quality", train, max_rows)))
