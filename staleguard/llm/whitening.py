"""Whitening of embeddings by Chebyshev-filtered subspace iteration (operator 12).

Every vector becomes whole numbers x = floor(scale * c). The fit list holds each distinct x vector once, packed into binary blocks in the
shared folder; its size n and per-dimension sums S are exact. With V the list's covariance (divisor n), a product V Q with
a thin block Q is one pass: each task adds up its blocks' Xc' (Xc Q), Xc being x - S / n, and sends one d x m matrix. A
round sends Q through the Chebyshev polynomial of V that is small on [0, b], b being the block's least Ritz value, so the unwanted
spectrum is damped and the wanted part grows; QR makes the block orthonormal again, and Rayleigh-Ritz turns it to Ritz
vectors. The rounds end when the residual norms of the wanted pairs certify them.

The driver holds d x m matrices; tasks per pass are bounded so that the matrices they send stay within ``PARTIAL_BYTES`` together.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staleguard.llm.shared import written

GUARD = 16  # block columns beyond the wanted components
DEGREE = 8
ROUNDS = 200
CERTIFIED = 2e-14  # residual norm by the largest eigenvalue
SETTLED = 1e-11  # accepted where rounding keeps the residuals from falling any further
BLOCK_ROWS = 8192
PARTIAL_BYTES = 64 << 20
_WIDTHS = ("<i2", "<i4", "<i8")


@dataclass(frozen=True)
class Whitening:
    """n and sums are exact; ``basis`` (d x k) and ``values`` (k) are the leading eigenpairs of the covariance, ``total`` its trace.

    ``identity_error`` is the largest absolute entry of the whitened fit list's covariance minus the identity, over the components
    whose eigenvalue isn't zero; ``residuals`` are the certified residual norms.
    """
    scale: float
    n: int
    sums: tuple[int, ...]
    basis: np.ndarray
    values: np.ndarray
    total: float
    identity_error: float | None
    residuals: np.ndarray
    rounds: int

    @property
    def proper(self) -> np.ndarray:
        """Which components have a spread that is more than rounding."""
        return self.values > len(self.sums) * np.finfo(float).eps * max(self.values.max(initial=0.0), 0.0)


def whole_vectors(col: pa.Array, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, x): the rows of a list column that hold ``dim`` finite numbers, and these as 64-bit whole numbers (held to their range)."""
    col = col.cast(pa.large_list(pa.float64()))
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    rows = np.flatnonzero((np.diff(offsets) == dim) & ~col.is_null().to_numpy(zero_copy_only=False))
    values = col.values.fill_null(np.nan).to_numpy(zero_copy_only=False)
    c = values[offsets[rows][:, None] + np.arange(dim)] if len(rows) else np.zeros((0, dim))
    fit = np.isfinite(c).all(axis=1)
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(scale * c[fit]), -float(1 << 63), float((1 << 63) - 1024))
    return rows[fit], x.astype(np.int64)


def _width(x: np.ndarray) -> np.ndarray:
    """The narrowest of ``_WIDTHS`` for each row."""
    far = np.maximum(x.max(axis=1), ~x.min(axis=1))
    return np.searchsorted([1 << 15, 1 << 31], far, side="right")


def _packed(x: np.ndarray) -> list[bytes]:
    """One byte string per row, equal for equal rows: the width's number and the numbers."""
    out, width = [b""] * len(x), _width(x)
    for k, kind in enumerate(_WIDTHS):
        at = np.flatnonzero(width == k)
        raw, step = x[at].astype(kind).tobytes(), x.shape[1] * int(kind[2])
        for i, row in enumerate(at.tolist()):
            out[row] = b"%d" % k + raw[i * step:(i + 1) * step]
    return out


def fit_list(df: DataFrame, vec_col: str, dim: int, scale: float) -> DataFrame:
    """The distinct x vectors as a written table of blocks (kind, data), each of up to ``BLOCK_ROWS`` rows of ``dim`` numbers."""
    def pack(batches):
        for batch in batches:
            x = whole_vectors(batch.column(0), dim, scale)[1]
            yield pa.RecordBatch.from_arrays([pa.array(_packed(x) if len(x) else [], pa.binary())], names=["x"])

    def block(rows):
        wide = max(r[0] for r in rows) - 48
        x = np.concatenate([np.frombuffer(r, _WIDTHS[r[0] - 48], offset=1) for r in rows]).astype(_WIDTHS[wide])
        return pa.RecordBatch.from_arrays([pa.array([_WIDTHS[wide]]), pa.array([x.tobytes()], pa.binary())], names=["kind", "data"])

    def blocks(batches):
        held = []
        for batch in batches:
            held += batch.column(0).to_pylist()
            while len(held) >= BLOCK_ROWS:
                yield block(held[:BLOCK_ROWS])
                held = held[BLOCK_ROWS:]
        if held:
            yield block(held)

    each = df.select(vec_col).mapInArrow(pack, "x binary").distinct()
    return written(each.mapInArrow(blocks, "kind string, data binary"), "fit-list")


def summed(blocks: DataFrame, dim: int, fn, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of ``fn(x)``, an array of ``shape``, over all blocks: one pass, one array per task."""
    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            for kind, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                total += fn(np.frombuffer(data.as_buffer(), kind).reshape(-1, dim))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    tasks = max(1, PARTIAL_BYTES // max(1, 8 * int(np.prod(shape))))
    parts = blocks.coalesce(tasks).mapInArrow(run, "part binary").collect()
    return np.sum([np.frombuffer(p["part"], np.float64) for p in parts], axis=0).reshape(shape) if parts else np.zeros(shape)


def size_and_sums(blocks: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Exact: numbers are added as high and low halves, and these as whole numbers without a bound."""
    def run(batches):
        n, sums = 0, [0] * dim
        for batch in batches:
            for kind, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(data.as_buffer(), kind).reshape(-1, dim).astype(np.int64)
                high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
                n, sums = n + len(x), [s + (h << 32) + w for s, h, w in zip(sums, high, low)]
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps([n, sums])])], names=["part"])

    parts = [json.loads(p["part"]) for p in blocks.coalesce(max(1, PARTIAL_BYTES // (24 * dim))).mapInArrow(run, "part string").collect()]
    return sum(p[0] for p in parts), [sum(s) for s in zip(*(p[1] for p in parts))]


def chebyshev(times, q: np.ndarray, vq: np.ndarray, edge: float, top: float, degree: int) -> np.ndarray:
    """The block through the Chebyshev polynomial of the given degree on [0, edge], scaled to about 1 at ``top``; ``vq`` is V q."""
    half = edge / 2
    first = scale = half / (top - half)
    before, now = q, (vq - half * q) * (scale / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - scale)
        before, now = now, (times(now) - half * now) * (2 * after / half) - before * (scale * after)
        scale = after
    return now


def leading_pairs(times, dim: int, k: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(eigenvalues, vectors, residual norms, rounds) of the k largest pairs of a positive semi-definite operator ``times``."""
    m = min(dim, k + max(k, GUARD))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, m)))[0]
    best, stale = np.inf, 0
    for rounds in range(1, ROUNDS + 1):
        vq = times(q)
        values, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        turn = turn[:, ::-1]
        values, q, vq = values[::-1], q @ turn, vq @ turn
        residuals = np.linalg.norm(vq - q * values, axis=0)[:k]
        worst = residuals.max() / max(values[0], np.finfo(float).tiny)
        stale = 0 if worst < best / 2 else stale + 1
        best = min(best, worst)
        if worst <= CERTIFIED or (worst <= SETTLED and stale >= 2) or values[0] <= 0:
            return np.maximum(values[:k], 0.0), q[:, :k], residuals, rounds
        edge = max(values[-1], 1e-8 * values[0])
        q = np.linalg.qr(chebyshev(times, q, vq, edge, values[0], DEGREE))[0]
    raise RuntimeError(f"subspace iteration isn't certified after {ROUNDS} rounds: residual {worst:.1e}")


def usual_dimension(df: DataFrame, vec_col: str) -> int:
    """The commonest length of vectors without null and non-finite entries (of several the longest); 0 where there are none."""
    c = F.col(vec_col).cast("array<double>")
    fit = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    top = df.select(c.alias(vec_col)).filter(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)).filter(fit) \
        .groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top["d"] if top else 0


def fit_whitening(df: DataFrame, vec_col: str, components: int = 4, scale: float = 256.0) -> Whitening | None:
    """Learned from all rows of ``df``; None where no row has a vector.

    Rows whose vector is null, holds a null or non-finite entry, or isn't of the commonest length are left out. A
    component without spread (n = 1, constant columns) has the eigenvalue 0.
    """
    dim = usual_dimension(df, vec_col)
    if not dim:
        return None
    blocks = fit_list(df, vec_col, dim, scale)
    n, sums = size_and_sums(blocks, dim)
    mean = np.array([s / n for s in sums])

    def times(q):
        def product(x):
            centred = x - mean
            return centred.T @ (centred @ q)
        return summed(blocks, dim, product, q.shape) / n

    total = float(summed(blocks, dim, lambda x: np.square(x - mean).sum(axis=0), (dim,)).sum() / n)
    k = min(components, dim)
    if total > 0:
        values, basis, residuals, rounds = leading_pairs(times, dim, k)
    else:
        values, basis, residuals, rounds = np.zeros(k), np.eye(dim)[:, :k], np.zeros(k), 0
    model = Whitening(scale, n, tuple(sums), basis, values, total, None, residuals, rounds)
    r = int(model.proper.sum())
    if r == 0:
        return model
    turn = basis[:, :r] / np.sqrt(values[:r])
    centre = summed(blocks, dim, lambda x: ((x - mean) @ turn).sum(axis=0), (r,)) / n

    def spread(x):
        w = (x - mean) @ turn - centre
        return w.T @ w

    error = np.abs(summed(blocks, dim, spread, (r, r)) / n - np.eye(r)).max()
    return Whitening(scale, n, tuple(sums), basis, values, total, float(error), residuals, rounds)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None beyond 64 bits."""
    far = n * int(max(x.max(initial=0), -int(x.min(initial=0)))) + max(map(abs, sums))
    if len(sums) * far * far < 1 << 63:
        return np.square(n * x - np.array(sums, np.int64)).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in exact]


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, id_col: str, vec_col: str, model: Whitening | None) -> DataFrame:
    """A row per fit row of ``df`` and component (``WHITENED``); nothing without a model.

    ``whitened`` is null in components without spread, ``explained`` null where the trace is 0, ``deviation`` null beyond
    64 bits. Ids may be null or repeat.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col))
    if model is None:
        return df.sparkSession.createDataFrame([], WHITENED)
    dim, k, proper = len(model.sums), len(model.values), model.proper
    mean = np.array([s / model.n for s in model.sums])
    turn = model.basis[:, proper] / np.sqrt(model.values[proper])
    share = [float(v / model.total) if model.total > 0 else None for v in model.values]

    def run(batches):
        for batch in batches:
            at, x = whole_vectors(batch.column(1), dim, model.scale)
            white = np.full((len(x), k), np.nan)
            white[:, proper] = (x - mean) @ turn
            white = pa.array(white.ravel(), mask=np.tile(~proper, len(x)))
            m = len(x) * k
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(m, model.n, np.int64)), pa.array([v for v in _deviations(x, model.n, model.sums) for _ in range(k)], pa.int64()),
                white, pa.array(share * len(x), pa.float64()), pa.array([model.identity_error] * m, pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, WHITENED)
