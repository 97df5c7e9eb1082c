"""Personal data: exact base rules, and a skip-chain conditional random field that adds spans (operator 10).

Base spans are found by rule in whole texts. The field then labels the words that could belong to personal data (those
with a digit or an at sign) with one of O, email, ip, card, phone. Its potentials:

* words: a softmax regression on hashed features of the word's shape and its neighbours';
* chain edges between adjacent such words;
* skip edges from a word to the previous one of the same document with equal digits or letters, or with the same last
  seven digits, however far apart; and to the first such word inside a base span of each kind, so that every repeat gets
  a base span's evidence over one edge.

All three are fitted piecewise on a bounded sample of documents, whose base spans serve as labels; edge potentials are
the smoothed log ratios of label pairs to independence. In a document the words of base spans are held at their
label, and loopy sum-product messages carry it along the edges until none of a document's changes by more than ``SETTLED``
(documents whose loops don't settle in ``LIMIT`` rounds stop there). Words that reach ``ADD_AT`` for a label are added as spans. All
other words are O by definition (the field is sparse, not cut off: every word with a digit or at sign has a node).
"""

from __future__ import annotations

import bisect
import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staleguard.llm.arrowtext import byte_pieces, texts_of, word_ranges
from staleguard.llm.shared import text_batches

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 4000
ADD_AT = 0.95
BITS = 13
FEATURES = 8  # of each word
SETTLED = 1e-4
LIMIT = 2000
HELD = 12.0  # log odds that hold a base span's words at their label

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_not_digit = re.compile(r"[^0-9]+")


# --- base rules ----------------------------------------------------------------------------------------------

def emails(text: str):
    """Leftmost non-overlapping addresses, an at sign at a time, in linear time."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = floor + len(text[floor:at].rstrip(_LOCAL))
        found = _domain.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        floor = found.end() if found else at + 1
        at = text.find("@", max(floor, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d *= 1 + k % 2
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _digits(text: str) -> str:
    return _not_digit.sub("", text)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order of start, then kind."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in _ip.finditer(text):
        if all(map(_small, m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _card.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _phone.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- nodes, features and edges -----------------------------------------------------------------------------

_PUNCTUATION = ".,;:!?\"'()[]{}<>|*&%$#"


def shape(word: str) -> str:
    """Digits as 9, letters as a, runs of letters shortened; long words by their start and length."""
    got = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]", "9", word))
    return got if len(got) <= 40 else f"{got[:40]}~{len(got).bit_length()}"


def _hashed(text: str) -> int:
    value = 0xCBF29CE484222325
    for b in text.encode("utf-8", "surrogatepass"):
        value = ((value ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return (value ^ value >> 29) % (1 << BITS)


def features(word: str, before: str, after: str) -> list[int]:
    """Hashed feature numbers of one word; neighbours count by their shape or, without digits, by themselves."""
    bare, digits = word.strip(_PUNCTUATION), _digits(word)
    near = lambda w: shape(w) if re.search(r"[0-9@]", w) else w.lower().strip(_PUNCTUATION)[:20]
    told = [f"s={shape(word)}", f"b={shape(bare)}", f"n={min(len(digits), 24)}", f"at={'@' in word},{'.' in bare},{word[:1] == '+'}",
            f"l={len(digits) >= 12 and luhn(digits)}", f"p={near(before)}", f"f={near(after)}", f"bs={shape(before)},{shape(bare)}"]
    return [_hashed(t) for t in told]


def links(word: str) -> list[str]:
    """Keys under which distant words count as the same or similar."""
    digits, bare = _digits(word), word.strip(_PUNCTUATION).lower()
    keys = [f"w{bare}"] if len(bare) >= 4 else []
    if len(digits) >= 7:
        keys += [f"d{digits}", f"e{digits[-7:]}"]
    if "@" in bare:
        keys.append(f"a{bare.split('@')[0]}")
    return keys


@dataclass
class Nodes:
    """The nodes of many documents together: positions are code points, edges are pairs of node numbers."""
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    base: np.ndarray  # label of the base span that covers the word, or 0
    features: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    hub: np.ndarray  # skip edges to the first words of base spans that aren't also the previous words


def nodes_of(col: pa.Array):
    """Yields (first row, number of rows, base spans by row, Nodes) for each piece of a null-free column."""
    for a, b, data, offsets in byte_pieces(col):
        starts, ends, first = word_ranges(data, offsets)
        mark = np.zeros(256, bool)
        mark[[*range(48, 58), 64]] = True
        marks = np.concatenate([[0], np.cumsum(mark[data])])
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        live = np.flatnonzero(marks[ends] > marks[starts])
        row = np.searchsorted(first, live, side="right") - 1
        raw = data.tobytes()
        word = lambda k: raw[starts[k]:ends[k]].decode("utf-8")  # noqa: B023,E731
        spans, feats, chain, skip, base = [[] for _ in range(b - a)], [], [], [], np.zeros(len(live), int)
        begin, stop = points[starts[live]] - points[offsets[row]], points[ends[live]] - points[offsets[row]]
        groups: dict[tuple, list[int]] = {}
        for r in np.unique(row):
            spans[r] = base_spans(raw[offsets[r]:offsets[r + 1]].decode("utf-8"))
        for n, (k, r) in enumerate(zip(live, row)):
            own = word(k)
            feats.append(features(own, word(k - 1) if k > first[r] else "", word(k + 1) if k + 1 < first[r + 1] else ""))
            if n and live[n - 1] == k - 1 and row[n - 1] == r:
                chain.append((n - 1, n))
            for key in links(own):
                same = groups.setdefault((r, key), [])
                if same and (not skip or skip[-1] != (same[-1], n)):
                    skip.append((same[-1], n))
                same.append(n)
        for r in np.unique(row):
            lo, hi = np.searchsorted(row, [r, r + 1])
            for s, kind, e in reversed(spans[r]):  # words are in order and apart, so those inside a span are a range
                base[lo + np.searchsorted(stop[lo:hi], s, "right"):lo + np.searchsorted(begin[lo:hi], e)] = kind + 1
        hub, near = set(), set(skip)
        for same in groups.values():
            first_of = {base[n]: n for n in reversed(same) if base[n]}
            hub.update((h, n) for h in first_of.values() for n in same if not base[n] and (h, n) not in near and (n, h) not in near)
        pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
        yield a, b - a, spans, Nodes(row, begin, stop, base, np.array(feats, np.int64).reshape(-1, FEATURES), pairs(chain), pairs(skip), pairs(sorted(hub)))


# --- the field -------------------------------------------------------------------------------------------------

@dataclass
class Field:
    weights: np.ndarray  # 2^BITS x labels
    chain: np.ndarray  # labels x labels
    skip: np.ndarray

    def marginals(self, nodes: Nodes) -> np.ndarray:
        """Label probabilities of all nodes by loopy sum-product messages; base words are held."""
        unary, held = self.weights[nodes.features].sum(axis=1), nodes.base > 0
        unary[held] = HELD * np.eye(unary.shape[1])[nodes.base[held]]
        skip = np.concatenate([nodes.skip, nodes.hub])
        edges = np.concatenate([nodes.chain, skip])
        if len(edges):
            psi = np.concatenate([np.broadcast_to(self.chain, (len(nodes.chain), *self.chain.shape)),
                                  np.broadcast_to(self.skip, (len(skip), *self.skip.shape))])
            source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
            psi = np.concatenate([psi, psi.transpose(0, 2, 1)])
            back = np.roll(np.arange(len(source)), len(edges))
            message = np.zeros((len(source), unary.shape[1]))
            live, row = np.flatnonzero(~held[target]), nodes.row[target]  # nothing is sent to held words
            for _ in range(LIMIT):
                belief = unary.copy()
                np.add.at(belief, target, message)
                sent = _logsum((belief[source[live]] - message[back[live]])[:, :, None] + psi[live], axis=1)
                step = 0.5 * (sent - _logsum(sent, axis=1)[:, None] - message[live])
                message[live] += step
                moving = np.unique(row[live[np.abs(step).max(axis=1) > SETTLED]])
                if len(moving) == 0:
                    break
                live = live[np.isin(row[live], moving)]
            np.add.at(unary, target, message)
        return np.exp(unary - _logsum(unary, axis=1)[:, None])


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _edge_potential(labels: np.ndarray, edges: np.ndarray, k: int, prior: np.ndarray) -> np.ndarray:
    """Smoothed log ratio of the joint frequency of label pairs to independence, within [-3, 3]."""
    joint = prior.copy()
    np.add.at(joint, (labels[edges[:, 0]], labels[edges[:, 1]]), 1)
    joint = (joint + joint.T) / 2
    joint /= joint.sum()
    own = joint.sum(axis=1)
    return np.log(joint / np.outer(own, own)).clip(-3, 3)


def fit_field(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, steps: int = 300) -> Field:
    """The field from at most ``sample`` documents, in order of a hash of their id (a documented bound)."""
    key = F.md5(F.col("__id").cast("string"))
    ids = docs.select(F.col(id_col).alias("__id")).dropna().distinct().orderBy(key, "__id").limit(sample)
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")) \
        .join(F.broadcast(ids), "__id").collect()
    col = pa.array([r["__text"] for r in sorted(rows, key=lambda r: (r["__id"], r["__text"]))], pa.large_string())
    k, feats, labels, chain, skip, at = len(KINDS) + 1, [], [], [], [], 0
    for _, _, _, nodes in nodes_of(col):
        feats.append(nodes.features)
        labels.append(nodes.base)
        chain.append(nodes.chain + at)
        skip.append(nodes.skip + at)
        at += len(nodes.base)
    weights = np.zeros((1 << BITS, k))
    weights[:, 0] = 0.05  # unseen features speak for O
    even = np.ones((k, k)) + 4 * np.eye(k)
    if not at:
        return Field(weights, np.log(even / even.mean()).clip(-3, 3), np.log(even / even.mean()).clip(-3, 3))
    x, y = np.concatenate(feats), np.concatenate(labels)
    goal, pace = np.eye(k)[y], np.full_like(weights, 1e-6)
    for _ in range(steps):
        off = np.exp((z := weights[x].sum(axis=1)) - _logsum(z, axis=1)[:, None]) - goal
        grad = 1e-4 * weights
        for c in range(k):
            grad[:, c] += np.bincount(x.ravel(), np.repeat(off[:, c] / len(y), x.shape[1]), 1 << BITS)
        pace += grad * grad
        weights -= 0.2 * grad / np.sqrt(pace)
    return Field(weights, _edge_potential(y, np.concatenate(chain), k, even), _edge_potential(y, np.concatenate(skip), k, even))


def spans_of(col: pa.Array, field: Field) -> list[tuple[list, list]]:
    """(base spans, all spans) of every text of a null-free column, each (start, kind, end) in order."""
    out: list[tuple[list, list]] = [([], []) for _ in range(len(col))]
    for a, n, spans, nodes in nodes_of(col):
        added: list[list] = [[] for _ in range(n)]
        if len(nodes.row):
            p = field.marginals(nodes)
            label = np.where((p.max(axis=1) >= ADD_AT) & (nodes.base == 0), p.argmax(axis=1), 0)
            joined = {int(j) for i, j in nodes.chain if label[i] == label[j] and label[i]}
            for i in np.flatnonzero(label):
                r, start, end, kind = int(nodes.row[i]), int(nodes.start[i]), int(nodes.end[i]), int(label[i]) - 1
                if int(i) in joined:
                    added[r][-1] = (added[r][-1][0], kind, end)
                else:
                    added[r].append((start, kind, end))
        for r in range(n):
            fresh = []
            if added[r]:
                text, starts = col[a + r].as_py(), [s for s, _, _ in spans[r]]
                reach = [0, *itertools.accumulate((e for _, _, e in spans[r]), max)]
                fresh = [t for s in added[r] if (t := _trimmed(s, text)) and reach[bisect.bisect_left(starts, t[2])] <= t[0]]
            out[a + r] = (spans[r], sorted(spans[r] + fresh))
    return out


def _trimmed(span: tuple, text: str) -> tuple | None:
    """The span without punctuation around it."""
    start, kind, end = span
    own = text[start:end]
    left = len(own) - len(own.lstrip(_PUNCTUATION.replace("(", "")))
    right = len(own) - len(own.rstrip(_PUNCTUATION))
    return (start + left, kind, end - right) if left + right < len(own) else None


def told(spans: list[tuple]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def masked(text: str, spans: list[tuple]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_personal_data(df: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, base_spans, spans (both as told). A null text has none."""
    def run(batches):
        for batch in batches:
            got = spans_of(texts_of(batch, batch.schema.names[1]), field)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([told(b) for b, _ in got], pa.string()), pa.array([told(s) for _, s in got], pa.string())],
                names=[id_col, "base_spans", "spans"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return text_batches(df).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, base_spans string, spans string")


def mask_personal_data(df: DataFrame, field: Field, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns of ``df`` with the spans in the text masked; ``size_col`` follows where the text changed."""
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            got, texts = spans_of(texts_of(batch, text_col), field), batch.column(at).to_pylist()
            new = [masked(t, s) if s else t for t, (_, s) in zip(texts, got, strict=True)]
            columns = batch.columns
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if size_col in batch.schema.names:
                k = batch.schema.get_field_index(size_col)
                sizes = [len(n) if s else old for n, (_, s), old in zip(new, got, columns[k].to_pylist(), strict=True)]
                columns[k] = pa.array(sizes, batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return text_batches(df).mapInArrow(run, df.schema)
