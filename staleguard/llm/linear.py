"""Hashed n-gram features and small linear models, fitted on the driver from a bounded sample of labelled rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from staleguard.llm.arrowtext import byte_pieces, mix, range_hashes, row_of, window_hashes, word_ranges

ROWS = 512  # rows of a dense feature block


class HashedNgrams:
    """Square roots of the shares of hashed word and byte n-grams, a block of dimensions for each order."""

    def __init__(self, word_orders=(), char_orders=(), bits: int = 12):
        self.word_orders, self.char_orders, self.bits = tuple(word_orders), tuple(char_orders), bits
        self.dims = (len(self.word_orders) + len(self.char_orders)) << bits

    def _counts(self, rows: np.ndarray, hashes: np.ndarray, n_rows: int) -> np.ndarray:
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        got = np.bincount((rows << self.bits) + at, minlength=n_rows << self.bits).reshape(n_rows, -1).astype(np.float32)
        return np.sqrt(got / np.maximum(got.sum(axis=1, keepdims=True), 1), dtype=np.float32)

    def matrix(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Features of the rows of one piece; rows without n-grams are zero."""
        n, blocks = len(offsets) - 1, []
        if self.word_orders:
            starts, ends, first = word_ranges(data, offsets)
            words = range_hashes(data, starts, ends)
        for k in self.word_orders:
            hashes, wfirst = window_hashes(words, first, k)
            blocks.append(self._counts(row_of(wfirst), hashes, n))
        owner = row_of(offsets)
        for k in self.char_orders:
            code = np.zeros(max(len(data) - k + 1, 0), np.uint64)
            for i in range(k):
                code = (code << np.uint64(8)) | data[i:i + len(code)]
            inside = owner[:len(code)] == owner[k - 1:k - 1 + len(code)]
            blocks.append(self._counts(owner[:len(code)][inside], mix(code[inside] + np.uint64(k << 40)), n))
        return np.concatenate(blocks, axis=1)

    def blocks(self, col: pa.Array):
        """(first row, features, bytes, offsets) of bounded blocks of a null-free string column."""
        for a, _, data, offsets in byte_pieces(col):
            for i in range(0, len(offsets) - 1, ROWS):
                own = offsets[i:i + ROWS + 1]
                part = data[own[0]:own[-1]]
                yield a + i, self.matrix(part, own - own[0]), part, own - own[0]

    def all_rows(self, texts: list[str]) -> np.ndarray:
        """Features of all texts in one matrix that is filled block by block."""
        out = np.zeros((len(texts), self.dims), np.float32)
        for first, x, _, _ in self.blocks(pa.array(texts, pa.large_string())):
            out[first:first + len(x)] = x
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-4, steps: int = 150, rate: float = 0.3):
    """(w, b) of one logistic regression per column of ``y`` (0 or 1), by full-batch Adam steps."""
    y, weight = y.reshape(len(x), -1).astype(np.float32), (weight / weight.sum()).astype(np.float32)[:, None]
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for t in range(1, steps + 1):
        off = (sigmoid(x @ w + b) - y) * weight
        for k, (p, g) in enumerate(((w, x.T @ off + l2 * w), (b, off.sum(axis=0)))):
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * g
            state[2 * k + 1] = 0.99 * state[2 * k + 1] + 0.01 * g * g
            p -= rate * (state[2 * k] / (1 - 0.9 ** t)) / (np.sqrt(state[2 * k + 1] / (1 - 0.99 ** t)) + 1e-8)
    return w, b


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_platt(logit: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(a, b) with sigmoid(a * logit + b) calibrated for ``y``; Newton steps on softened targets."""
    pos, neg = (weight * y).sum(), (weight * (1 - y)).sum()
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, theta = np.stack([logit, np.ones(len(logit))], axis=1), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = sigmoid(x @ theta)
        grad = x.T @ (weight * (p - goal)) + 1e-6 * theta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                    per_class: int, max_classes: int = 200) -> tuple[list[tuple], dict]:
    """([(id, text, label)], {label: rows in all}) with at most ``per_class`` documents of each label, in order of a hash of the id.

    Rows with a null id or label teach nothing; of an id with several labels the largest counts. At most
    ``max_classes`` labels, the most frequent, are learned, so the sample is bounded.
    """
    marked = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label")).dropna()
    counts = {r["__label"]: r["count"] for r in marked.groupBy("__label").count()
              .orderBy(F.desc("count"), "__label").limit(max_classes).collect()}
    if not counts:
        return [], {}
    key = F.md5(F.col("__id").cast("string"))
    # the least hashes of a label surely lie below twice their expected share, so few rows are dealt out and ranked
    share = F.create_map(*(F.lit(v) for c, n in counts.items() for v in (c, 2 * per_class / n)))[F.col("__label")]
    order = Window.partitionBy("__label").orderBy(key, "__id")
    picked = marked.filter(F.col("__label").isin(list(counts)) & (F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / (1 << 32) < share + 1e-4)) \
        .withColumn("__n", F.row_number().over(order)) \
        .filter(F.col("__n") <= per_class).groupBy("__id").agg(F.max("__label").alias("__label"))
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    got = texts.join(F.broadcast(picked), "__id").select("__id", "__text", "__label").collect()
    return sorted((tuple(r) for r in got), key=lambda r: (r[0], str(r[2]), r[1])), counts
