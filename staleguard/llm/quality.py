"""Quality rules: text statistics, fixed limits, and a calibrated logistic regression on hashed n-grams (operator 6).

The model is fitted on the driver from at most ``per_class`` labelled documents of each class (a documented bound), on
hashed word and byte n-grams; two folds give the held-out scores for Platt's calibration, weighted back to the classes'
true shares. All documents are then scored in Arrow batches. A document passes when no base rule fails and the
calibrated probability of good quality is at least ``KEEP_AT``; without labelled rows of both classes the base rules
decide alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from staleguard.llm.arrowtext import (SPACE_BYTES, mix, range_hashes, row_of, texts_of, window_hashes,
                                      word_ranges)
from staleguard.llm.linear import HashedNgrams, fit_logistic, fit_platt, labelled_sample, sigmoid
from staleguard.llm.shared import text_batches

MIN_WORDS = 50
MAX_REPEAT_SHARE = 50  # per cent of the words
KEEP_AT = 0.5
PER_CLASS = 1000
SYMBOLS = b"#*$%&|<>"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _own_keys(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Keys that are equal only for equal hashes of the same row."""
    return mix(hashes + mix(rows.astype(np.uint64) + np.uint64(1)))


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base statistics of every row of a piece."""
    solid = np.ones(256, bool)
    solid[list(SPACE_BYTES)] = False
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    inside = solid[data]
    starts, ends, first = word_ranges(data, offsets)
    out = {"n_words": np.diff(first), "word_chars": _per_row(inside & ((data & 0xC0) != 0x80), offsets),
           "n_symbols": _per_row(symbol[data], offsets)}

    n_rows = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    owner = np.searchsorted(offsets[1:], begin, side="right")
    begin, owner = begin[owner < n_rows], owner[owner < n_rows]
    stop = np.minimum(np.concatenate([begin[1:], [len(data)]]), offsets[owner + 1])
    stop = np.where((stop > begin) & (data[np.maximum(stop - 1, 0)] == 10) if len(data) else False, stop - 1, stop)
    filled = np.concatenate([[0], np.cumsum(inside)])
    wordy = (stop > begin) & (filled[stop] > filled[begin])
    begin, stop, owner = begin[wordy], stop[wordy], owner[wordy]
    _, seen = np.unique(_own_keys(range_hashes(data, begin, stop), owner), return_index=True)
    out["n_dup_lines"] = np.bincount(owner, minlength=n_rows) - np.bincount(owner[seen], minlength=n_rows)

    windows, wfirst = window_hashes(range_hashes(data, starts, ends), first, 3)
    rows = row_of(wfirst)
    _, back, times = np.unique(_own_keys(windows, rows), return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[back] > 1)
    at = again + (first[:-1] - wfirst[:-1])[rows[again]]
    covered = np.zeros(len(starts), bool)
    for i in range(3):
        covered[at + i] = True
    out["n_repeat_words"] = _per_row(covered, first)
    return {k: v.astype(np.int64) for k, v in out.items()}


def fails_base(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Too few words, or too many of them in repeated three-word windows."""
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_SHARE * stats["n_words"])


@dataclass
class QualityModel:
    """Probability of good quality; ``weights`` is None when there was nothing to learn from."""
    grams: HashedNgrams
    weights: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.ones(len(features))
        return sigmoid(self.slope * (features @ self.weights + self.bias) + self.shift).astype(float)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality", per_class: int = PER_CLASS) -> QualityModel:
    """The model from at most ``per_class`` labelled documents of each class (label 1: good)."""
    grams = HashedNgrams(word_orders=(1, 2), char_orders=(3,), bits=11)
    rows, counts = labelled_sample(docs, labels, id_col, text_col, label_col, per_class)
    y = np.array([int(r[2]) for r in rows])
    if len(set(y.tolist())) < 2:
        return QualityModel(grams)
    x = grams.all_rows([r[1] for r in rows])
    share = np.array([counts.get(c, 1) / max((y == c).sum(), 1) for c in (0, 1)])
    even = 1 / np.bincount(y, minlength=2)[y]
    fold, held = np.arange(len(y)) % 2, np.zeros(len(y))
    for k in (0, 1):
        if len(set(y[fold != k].tolist())) == 2:
            w, b = fit_logistic(x[fold != k], y[fold != k], even[fold != k])
            held[fold == k] = (x[fold == k] @ w + b)[:, 0]
    w, b = fit_logistic(x, y, even)
    weight = share[y] / share[y].mean()
    slope, shift = fit_platt(held, y, weight)
    if slope <= 0:  # nothing learned that holds outside its fold
        return QualityModel(grams)
    return QualityModel(grams, w[:, 0], float(b[0]), slope, shift)


def judge(col: pa.Array, model: QualityModel) -> dict[str, np.ndarray]:
    """Statistics, base_failed, score and kept of every text of a null-free column."""
    found = []
    for _, features, data, offsets in model.grams.blocks(col):
        stats = statistics(data, offsets)
        failed, score = fails_base(stats), model.score(features)
        found.append({**stats, "base_failed": failed, "score": score, "kept": ~failed & (score >= KEEP_AT)})
    if not found:
        return {k: np.zeros(0, float if k == "score" else bool if k in ("base_failed", "kept") else np.int64)
                for k in (*STATISTICS, "base_failed", "score", "kept")}
    return {k: np.concatenate([f[k] for f in found]) for k in found[0]}


def score_quality(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, the statistics, base_failed, score, kept. A null text has no words and fails."""
    def run(batches):
        for batch in batches:
            got = judge(texts_of(batch, batch.schema.names[1]), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v) for v in got.values())], names=[id_col, *got])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return text_batches(df).select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, {', '.join(f'{k} long' for k in STATISTICS)}, base_failed boolean, score double, kept boolean")


def keep_good(df: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that pass, with all their columns (also repeated rows; an empty table stays empty)."""
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(judge(texts_of(batch, text_col), model)["kept"]))

    return text_batches(df).mapInArrow(run, df.schema)
