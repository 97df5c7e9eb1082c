"""Toxicity by compression distance: windows are compressed with a toxic and an ordinary zstandard dictionary (operator 7).

The ordinary dictionary is trained on windows of ordinary text. The toxic dictionary is a lexicon, another method than a
second trained dictionary (README has both methods' figures): the ordinary content and, before it, the runs of letters
that toxic text has far more often: word stems whose log-likelihood ratio between the two
classes exceeds that expected of the most extreme of as many chance stems, cut to the runs of four bytes that ordinary text
lacks. Where toxic text has no such stem, a dictionary trained on its windows takes the lexicon's place. A window that the toxic dictionary compresses further than the ordinary one speaks for toxicity. The greatest
gain, the mean of the three greatest, the share of gain and the number of gaining windows are turned into a
probability by a logistic regression that is fitted on documents that the dictionaries didn't see (two folds).

Dictionaries are built on the driver from at most ``per_class`` labelled documents of each class, and trained on at most
40 * ORDINARY_BYTES bytes of windows, drawn evenly from all of them (documented bounds).
All windows of whole texts are compressed in the tasks.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from staleguard.llm.arrowtext import byte_pieces, texts_of
from staleguard.llm.linear import fit_logistic, labelled_sample, sigmoid
from staleguard.llm.shared import text_batches

PER_CLASS = 1200
WINDOW, STEP = 64, 32
ORDINARY_BYTES = 32768
STEM, LONGEST, RUN, TIMES = 4, 16, 4, 8

_word = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def _prefixes(texts: list[bytes]) -> tuple[Counter, int]:
    """(number of distinct (previous word, word) pairs for every word prefix, pairs in all); copies of a text count once."""
    seen: set[int] = set()  # hashes of the pairs: a third of the memory
    out: Counter = Counter()
    for t in texts:
        before = b""
        for m in _word.finditer(t):
            w = m[0]
            key = hash((before, w))
            before = w
            if key not in seen:
                seen.add(key)
                for k in range(STEM, min(len(w), LONGEST) + 1):
                    out[w[:k]] += 1
    return out, len(seen)


def toxic_runs(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Byte runs that mark toxic text, the most frequent last."""
    (ct, nt), (co, no) = _prefixes(toxic), _prefixes(ordinary)
    if not nt or not no:
        return []
    bar = 2 * math.log(max(len(ct), 2))

    def ratio(a: int, b: int) -> float:
        both = a + b
        return 2 * (a * math.log(a * (nt + no) / (both * nt)) + (b * math.log(b * (nt + no) / (both * no)) if b else 0))

    marked = {s for s, a in ct.items() if a * no > TIMES * co[s] * nt and ratio(a, co[s]) >= bar}
    longer: dict[bytes, list[bytes]] = {}
    for s in sorted(marked):
        longer.setdefault(s[:-1], []).append(s)
    stems = []
    for s in sorted(marked):
        if s[:-1] in marked:
            continue
        while grown := [t for t in longer.get(s, []) if ct[t] >= 0.8 * ct[s]]:
            s = grown[0]
        stems.append(s)
    all_t, all_o, runs = b"\n".join(toxic), b"\n".join(ordinary), Counter()
    for s in stems:
        padded, start = b" " + s, None
        for i in range(len(padded) - RUN + 2):
            g = padded[i:i + RUN]
            own = i <= len(padded) - RUN and all_t.count(g) * len(all_o) > TIMES * all_o.count(g) * len(all_t)
            if own and start is None:
                start = i
            if not own and start is not None:
                runs[padded[start:i + RUN - 1]] += ct[s]
                start = None
    return [r for r, _ in sorted(runs.items(), key=lambda x: (x[1], x[0]))]


def spread_windows(texts: list[bytes], most: int) -> list[bytes]:
    """About ``most`` windows: all of the short texts, and equally many of the others, spread evenly over each."""
    counts = [-(-len(t) // WINDOW) for t in texts]
    share = max(most // max(len(texts), 1), 1)
    while share < max(counts, default=0) and sum(min(n, share + 1) for n in counts) <= most:
        share += 1
    return [t[i * WINDOW:(i + 1) * WINDOW] for t, n in zip(texts, counts) for i in (k * n // min(n, share) for k in range(min(n, share)))]


def trained(texts: list[bytes]) -> bytes:
    """The content of a dictionary trained on windows of all the texts, at most 40 * ORDINARY_BYTES bytes of them."""
    windows = spread_windows(texts, 40 * ORDINARY_BYTES // WINDOW)
    try:
        return zstandard.train_dictionary(ORDINARY_BYTES, windows).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their text itself
        return b" ".join(windows)[:ORDINARY_BYTES] or b"ordinary"


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """(ordinary, lexicon) dictionary contents; both are the same where toxic text has no stem of its own."""
    base, runs = trained(ordinary), toxic_runs(toxic, ordinary)
    return base, (b"\0".join(runs) + b"\0" + base if runs else base)


def trained_pair(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionary contents, each trained on its own class."""
    return trained(ordinary), trained(toxic)


@functools.lru_cache(maxsize=8)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters(
        window_log=18, chain_log=17, hash_log=17, search_log=4, min_match=5, target_length=32,
        strategy=zstandard.STRATEGY_GREEDY, write_checksum=0, write_content_size=0, write_dict_id=0)
    own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    own.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=own, compression_params=how)


def gains(data: bytes, starts: np.ndarray, sizes: np.ndarray, base: bytes, toxic: bytes) -> np.ndarray:
    """Bytes that the toxic dictionary saves over the ordinary one in every window."""
    if len(starts) == 0 or toxic == base:
        return np.zeros(len(starts), np.int64)
    cut = np.stack([starts, sizes], axis=1).astype("<u8").tobytes()
    size = []
    for content in (base, toxic):
        done = _compressor(content).multi_compress_to_buffer(zstandard.BufferWithSegments(data, cut), threads=0)
        size.append(np.fromiter(map(len, done), np.int64, len(done)))
    return size[0] - size[1]


def evidence(col: pa.Array, base: bytes, toxic: bytes) -> np.ndarray:
    """Four numbers for every text of a null-free column; a text without windows has zeros."""
    found = [np.zeros((0, 4))]
    for a, b, data, offsets in byte_pieces(col):
        n = np.diff(offsets)
        count = np.where(n > 0, 1 + np.maximum(-(-(n - WINDOW) // STEP), 0), 0)
        first = np.concatenate([[0], np.cumsum(count)])
        starts = np.repeat(offsets[:-1] - STEP * first[:-1], count) + STEP * np.arange(first[-1])
        sizes = np.minimum(WINDOW, np.repeat(offsets[1:], count) - starts)
        gain = gains(data.tobytes().lower(), starts, sizes, base, toxic)
        out = np.zeros((b - a, 4))
        row = np.repeat(np.arange(b - a), count)
        order = np.lexsort((-gain, row))
        ranked = gain[order]
        place = np.arange(len(gain)) - np.repeat(first[:-1], count)
        out[row[place == 0], 0] = ranked[place == 0]
        np.add.at(out[:, 1], row[place < 3], ranked[place < 3] / 3)
        np.add.at(out[:, 2], row, np.maximum(gain, 0) / np.maximum(count, 1)[row])
        out[:, 3] = np.log1p(np.bincount(row, gain > 0, b - a))
        found.append(out)
    return np.concatenate(found)


@dataclass
class ToxicityModel:
    base: bytes = b""
    toxic: bytes = b""
    weights: tuple[float, ...] = (0.0,) * 4
    bias: float = -30.0

    def score(self, col: pa.Array) -> np.ndarray:
        if not self.base:
            return np.zeros(len(col))
        return sigmoid(evidence(col, self.base, self.toxic) @ np.array(self.weights) + self.bias)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "toxic", per_class: int = PER_CLASS) -> ToxicityModel:
    """The model from at most ``per_class`` labelled documents of each class; without both classes every score is 0."""
    rows, counts = labelled_sample(docs, labels, id_col, text_col, label_col, per_class)
    y = np.array([int(r[2]) for r in rows])
    if len(set(y.tolist())) < 2:
        return ToxicityModel()
    lower = [r[1].encode("utf-8").lower() for r in rows]
    pick = lambda want, fold: [t for k, t in enumerate(lower) if y[k] == want and (fold is None or k % 2 == fold)]
    make, final = dictionaries, dictionaries(pick(1, None), pick(0, None))
    if final[0] == final[1]:
        make, final = trained_pair, trained_pair(pick(1, None), pick(0, None))
    seen = np.zeros((len(y), 4))
    for fold in (0, 1):
        base, toxic = make(pick(1, 1 - fold), pick(0, 1 - fold))
        own = np.arange(len(y)) % 2 == fold
        seen[own] = evidence(pa.array([r[1] for k, r in enumerate(rows) if own[k]], pa.large_string()), base, toxic)
    share = np.array([counts.get(c, 1) / (y == c).sum() for c in (0, 1)])
    w, b = fit_logistic(seen.astype(np.float32), y, share[y], steps=400, rate=0.1)
    return ToxicityModel(*final, tuple(w[:, 0].astype(float)), float(b[0]))


def score_toxicity(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, score, predicted (1 from 0.5). Null and empty texts have no windows."""
    def run(batches):
        for batch in batches:
            score = model.score(texts_of(batch, batch.schema.names[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                                             names=[id_col, "score", "predicted"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return text_batches(df).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")


def keep_ordinary(df: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that aren't predicted toxic, with all their columns."""
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.score(texts_of(batch, text_col)) < 0.5))

    return text_batches(df).mapInArrow(run, df.schema)
