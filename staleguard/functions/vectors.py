"""Vector maths on ``ARRAY<DOUBLE>`` columns with higher-order functions.

Everything stays in the JVM; no Python UDF. Inputs stored as ``ARRAY<FLOAT>``
must go through :func:`as_double` first so both sides of a comparison use the
same precision.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    return _c(v).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l1_norm(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + F.abs(x))


def l2_normalize(v) -> Column:
    """Row L2 normalisation; the zero vector stays zero.

    The norm is accumulated once and the division happens in ``aggregate``'s
    finish function, so the cost is O(dim) (a norm referenced inside the
    element lambda would be recomputed for every element).
    """
    a = _c(v)
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x,
                       lambda acc: F.when(acc > 0, F.transform(a, lambda x: x / F.sqrt(acc))).otherwise(a))


def l1_normalize(v) -> Column:
    """Row L1 normalisation (O(dim), see ``l2_normalize``); the zero vector stays zero."""
    a = _c(v)
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.abs(x),
                       lambda acc: F.when(acc > 0, F.transform(a, lambda x: x / acc)).otherwise(a))


def cosine_distance(a, b, norm_a=None, norm_b=None) -> Column:
    """1 - a.b / (|a||b|), clipped to [0, 2], null without both vectors. Pass precomputed norms to avoid recomputation."""
    na = l2_norm(a) if norm_a is None else _c(norm_a)
    nb = l2_norm(b) if norm_b is None else _c(norm_b)
    d = F.lit(1.0) - dot(a, b) / (na * nb)
    return F.when(d.isNotNull(), F.least(F.greatest(d, F.lit(0.0)), F.lit(2.0)))  # greatest() skips nulls


def squared_euclidean(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                       lambda acc, x: acc + x)


def euclidean_distance(a, b) -> Column:
    return F.sqrt(squared_euclidean(a, b))
