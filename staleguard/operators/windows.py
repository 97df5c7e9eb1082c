"""Window-style operators (E1, E2, E3, E4) and exact top-k (F1)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _sorted_components(prob_col: str, tie_high_first: str) -> str:
    """SQL: the components as (p, k) structs sorted by p descending; ties by k descending when
    ``tie_high_first`` (a SQL boolean) holds, else ascending."""
    return (f"array_sort(transform({prob_col}, (x, i) -> named_struct('p', x, 'k', i)), "
            f"(l, r) -> CASE WHEN l.p > r.p THEN -1 WHEN l.p < r.p THEN 1 "
            f"WHEN l.k = r.k THEN 0 WHEN ({tie_high_first}) = (l.k > r.k) THEN -1 ELSE 1 END)")


def cumulative_select(df: DataFrame, id_col: str, prob_col: str, threshold: float) -> DataFrame:
    """Smallest top-probability prefix whose sum reaches ``threshold``.

    Components are ordered by probability descending, ties by higher index
    first; a component is kept when the sum of the components before it is
    still below the threshold, so the first is always kept and a threshold
    above the total keeps all. Row-local array functions: no explode and no
    shuffle. Returns (id, selected ARRAY<INT>) in selection order.
    """
    t = float(threshold)
    # running sums in one left-to-right pass: acc = (sum so far, kept ks)
    sel = F.expr(
        f"aggregate(_srt, named_struct('s', 0D, 'ks', CAST(array() AS ARRAY<INT>)), "
        f"(acc, x) -> named_struct('s', acc.s + x.p, "
        f"'ks', CASE WHEN size(acc.ks) = 0 OR acc.s < CAST({t!r} AS DOUBLE) "
        f"THEN concat(acc.ks, array(x.k)) ELSE acc.ks END), acc -> acc.ks)")
    return df.select(F.col(id_col), F.expr(_sorted_components(prob_col, "true")).alias("_srt")) \
        .select(F.col(id_col), sel.alias("selected"))


def top_topics(df: DataFrame, id_col: str, vec_col: str, orig_col: str, multi_k: int = 10) -> DataFrame:
    """Argmax topic, or the top ``multi_k`` topics for documents with several originals.

    Argmax keeps the lowest index among ties; the top list orders ties by
    higher index first. Row-local array functions.
    """
    multi = f"coalesce(size({orig_col}), 0) > 1"
    srt = _sorted_components(vec_col, multi)
    top = F.expr(f"transform(slice({srt}, 1, CASE WHEN {multi} THEN {int(multi_k)} ELSE 1 END), y -> y.k)")
    return df.select(F.col(id_col), top.alias("topics"))


MAX_BLOCKS = 100_000


def sequential_offsets(df: DataFrame, order_col: str, count_col: str, block: int = 4096) -> DataFrame:
    """Add ``offset`` = sum of ``count_col`` over all rows with a smaller ``order_col``.

    Two levels so no window sees the whole table: block totals (one row per
    block of about ``block`` keys) get a running sum, and rows get a running sum
    inside their block; both windows are bounded (N/block rows and block rows).
    Dense keys are blocked by value (``floor(key / block)``); sparse keys (span
    much larger than the row count) by approximate quantile boundaries applied
    with a ``Bucketizer`` (binary search in the JVM), so blocks stay near
    ``block`` rows either way.
    """
    st = df.agg(F.count("*").alias("n"), F.min(order_col).alias("lo"), F.max(order_col).alias("hi")).collect()[0]
    n = int(st["n"] or 0)
    span = (float(st["hi"]) - float(st["lo"]) + 1.0) if n else 0.0
    dense = n == 0 or span <= 4.0 * n
    # at most MAX_BLOCKS blocks: the block-offset window and the quantile list stay bounded
    block = max(block, -(-n // MAX_BLOCKS))
    if dense:
        width = max(block, int(-(-span // MAX_BLOCKS)))
        x = df.withColumn("_b", F.floor(F.col(order_col) / F.lit(width)))
    else:
        from pyspark.ml.feature import Bucketizer
        nb = max(1, n // block)
        qs = df.approxQuantile(order_col, [i / nb for i in range(1, nb)], 1.0 / (4 * nb)) if nb > 1 else []
        splits = [-float("inf")] + sorted(set(float(q) for q in qs)) + [float("inf")]
        x = Bucketizer(splits=splits, inputCol="_k", outputCol="_b") \
            .transform(df.withColumn("_k", F.col(order_col).cast("double"))).drop("_k")
    blocks = x.groupBy("_b").agg(F.sum(count_col).alias("_bt"))
    bw = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_b", F.coalesce(F.sum("_bt").over(bw), F.lit(0)).alias("_boff"))
    iw = Window.partitionBy("_b").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_ioff", F.coalesce(F.sum(count_col).over(iw), F.lit(0)))
    return x.join(blocks, "_b").withColumn("offset", (F.col("_boff") + F.col("_ioff")).cast("bigint")) \
        .drop("_b", "_boff", "_ioff")


# --- exact top-k nearest vectors for a bounded set of query vectors (F1) -------

MAX_QUERY_VECTORS = 4096
DIGITS = 9  # distances are rounded to these, so that equal ones tie whatever the order of summation


def _nearest_scorer(queries: list[tuple[int, list[float]]], k: int, id_col: str, vec_col: str):
    qids = np.array([q[0] for q in queries], dtype=np.int64)
    Q = np.array([q[1] for q in queries], dtype=np.float64)
    nq = np.linalg.norm(Q, axis=1, keepdims=True)
    Qn = Q / np.where(nq > 0, nq, 1.0)

    def score(it):
        import pandas as pd
        best_d, best_i = np.full((0, len(qids)), np.inf), np.zeros((0, len(qids)), np.int64)
        for pdf in it:
            if len(pdf) == 0:
                continue
            ids = pdf[id_col].to_numpy(dtype=np.int64)
            X = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vec_col]])
            nx = np.linalg.norm(X, axis=1, keepdims=True)
            D = np.round(np.clip(1.0 - (X / np.where(nx > 0, nx, 1.0)) @ Qn.T, 0.0, 2.0), DIGITS)  # rows x queries
            D, I = np.concatenate([best_d, D]), np.concatenate([best_i, np.broadcast_to(ids[:, None], D.shape)])
            if len(D) > k:
                # the k-th distance of each query: everything below it stays, ties at it go by id
                order = np.lexsort((I, D), axis=0)[:k]
                D, I = np.take_along_axis(D, order, axis=0), np.take_along_axis(I, order, axis=0)
            best_d, best_i = D, I
        yield pd.DataFrame({"query_id": np.tile(qids, len(best_d)), "id": best_i.ravel(), "dist": best_d.ravel()})
    return score


def topk_nearest(corpus: DataFrame, id_col: str, vec_col: str, queries: DataFrame, k: int,
                 qid_col: str = "query_id", qvec_col: str = "vec") -> DataFrame:
    """(query_id, rank, id, dist): the ``k`` nearest corpus vectors by cosine distance (F1).

    Query vectors are streamed from the executors in passes of at most
    ``MAX_QUERY_VECTORS``; a pass travels with the task, each corpus partition
    keeps a running ``k`` best per query over its batches' matrix products and emits them once, and a window keeps the global top ``k`` (ties by id).
    Several passes are materialised one at a time, so the driver holds one
    pass. The corpus is never shuffled whole nor joined pairwise.
    """
    from staleguard.session import materialize
    src = corpus.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias(id_col), F.col(vec_col).cast("array<double>"))
    w = Window.partitionBy("query_id").orderBy("dist", "id")
    parts, batch = [], []

    def flush(b, last):
        part = src.mapInPandas(_nearest_scorer(b, k, id_col, vec_col), "query_id bigint, id bigint, dist double")
        part = part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        return part if (last and not parts) else part.transform(materialize)

    for r in queries.select(F.col(qid_col).cast("bigint").alias("q"), F.col(qvec_col)).orderBy("q").toLocalIterator():
        batch.append((int(r["q"]), list(r[qvec_col])))
        if len(batch) >= MAX_QUERY_VECTORS:
            parts.append(flush(batch, False))
            batch = []
    if batch:
        parts.append(flush(batch, True))
    if not parts:
        return corpus.sparkSession.createDataFrame([], "query_id bigint, id bigint, dist double, rank int")
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return out
