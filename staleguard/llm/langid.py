"""Language identification by error-correcting output codes (operator 8).

Every language has a codeword; one binary classifier on hashed byte n-grams per bit predicts the codeword of a text.
Decoding adds up, for each language, the logistic losses of the predicted bits against its codeword, each bit weighted by
how well it did on rows that it wasn't fitted on, and takes the least. Up to six languages use the exhaustive
code (all 2^(k-1) - 1 splits), more use the best of seeded random codes. The classifiers are fitted on the driver from
at most ``per_class`` documents of each language (a documented bound).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from staleguard.llm.arrowtext import texts_of
from staleguard.llm.linear import HashedNgrams, fit_logistic, labelled_sample, sigmoid
from staleguard.llm.shared import text_batches

PER_CLASS = 500
MAX_LANGUAGES = 200
AMBIGUOUS_BELOW = 0.7
UNKNOWN = "und"

_letter = regex.compile(r"\p{L}")
_ascii_letter = np.zeros(256, bool)
_ascii_letter[[*range(65, 91), *range(97, 123)]] = True


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of bits (0 or 1) that differ in many places; no column is constant."""
    if k <= 1:
        return np.zeros((k, 0), int)
    if k <= 6:
        splits = np.arange(1, 2 ** (k - 1))
        return np.array([[(s >> i) & 1 for s in splits] for i in range(k)])
    rng, bits, best, least = np.random.default_rng(seed), 8 * int(np.ceil(np.log2(k))), None, -1
    for _ in range(50):
        code = rng.integers(0, 2, (k, bits))
        code[0, code.min(axis=0) == code.max(axis=0)] ^= 1
        apart = (code[:, None, :] != code[None, :, :]).sum(axis=2) + bits * np.eye(k, dtype=int)
        if apart.min() > least:
            best, least = code, apart.min()
    return best


@dataclass
class LanguageModel:
    grams: HashedNgrams
    languages: list[str] = field(default_factory=list)
    code: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    trust: np.ndarray | None = None

    def decode(self, features: np.ndarray) -> np.ndarray:
        """Probabilities over the languages from the weighted losses of the predicted bits."""
        if len(self.languages) < 2:
            return np.ones((len(features), len(self.languages)))
        margin = features @ self.weights + self.bias
        loss = np.logaddexp(0, -margin) @ (self.trust * self.code).T + np.logaddexp(0, margin) @ (self.trust * (1 - self.code)).T
        odds = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return odds / odds.sum(axis=1, keepdims=True)


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  per_class: int = PER_CLASS) -> LanguageModel:
    """The model from the rows of ``docs`` with a language; rows with a null or empty text teach nothing."""
    grams = HashedNgrams(char_orders=(1, 2, 3), bits=11)
    rows, _ = labelled_sample(docs, docs.filter(docs[text_col].isNotNull()), id_col, text_col, lang_col, per_class, MAX_LANGUAGES)
    rows = [r for r in rows if _letter.search(r[1])]
    languages = sorted({r[2] for r in rows})
    if len(languages) < 2:
        return LanguageModel(grams, languages)
    code = codewords(len(languages))
    own = np.array([languages.index(r[2]) for r in rows])
    x, y = grams.all_rows([r[1] for r in rows]), code[own]
    even = 1 / np.bincount(own)[own]
    held = np.arange(len(own)) % 4 == 0
    w, b = fit_logistic(x[~held], y[~held], even[~held], steps=100)
    right = ((sigmoid(x[held] @ w + b) > 0.5) == y[held]).mean(axis=0) if held.any() else np.full(code.shape[1], 0.9)
    trust = np.log((right + 0.01) / (1.01 - right)).clip(0.05)
    w, b = fit_logistic(x, y, even, steps=100)
    return LanguageModel(grams, languages, code, w, b, trust / trust.sum() * len(trust))


def identify(col: pa.Array, model: LanguageModel) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, ambiguous) of every text of a null-free column; ``und`` with score 0 where it has no letter."""
    names, score, doubt = [], [], []
    for a, features, data, offsets in model.grams.blocks(col):
        p = model.decode(features)
        if p.shape[1] == 0:
            p = np.zeros((len(features), 1))
        letters = np.concatenate([[0], np.cumsum(_ascii_letter[data])])
        lettered = letters[offsets[1:]] > letters[offsets[:-1]]
        for i in np.flatnonzero(~lettered):
            lettered[i] = _letter.search(col[a + int(i)].as_py()) is not None
        best = p.argmax(axis=1)
        known = lettered & (len(model.languages) > 0)
        top = np.where(known, p.max(axis=1), 0.0)
        names += [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, known)]
        score.append(top)
        doubt.append(known & (top < AMBIGUOUS_BELOW))
    return names, np.concatenate(score or [np.zeros(0)]), np.concatenate(doubt or [np.zeros(0, bool)])


def identify_languages(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, lang_pred, score, ambiguous. Null texts are ``und``."""
    def run(batches):
        for batch in batches:
            names, score, doubt = identify(texts_of(batch, batch.schema.names[1]), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(doubt)],
                                             names=[id_col, "lang_pred", "score", "ambiguous"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return text_batches(df).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, ambiguous boolean")
