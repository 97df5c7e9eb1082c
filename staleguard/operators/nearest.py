"""Exact k nearest vectors by cells with a shrinking radius (F1, K3).

The corpus lies in balls (``pairs.deal_out``). Every query first probes its nearest balls, as many as hold k vectors; the k-th
distance it finds there is its radius. Then it probes just the balls that may hold something nearer: those with
angle(query, centre) - radius of the ball <= the angle of that distance. Query and corpus rows meet by ball in a cogroup, both
cut into slices by a hash, so neither a large ball nor a ball that many queries probe is one group; a group gives back the k best
of each of its queries. Queries are a table like any other: none are collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staleguard.operators.pairs import CELLS, SLACK, Balls, _measure, _unit, distances, prepare, radius_for, read_vectors
from staleguard.session import materialize

DIGITS = 9  # distances are rounded to these, so that equal ones tie whatever the order of summation
CORPUS_BALL = 1024  # corpus vectors of a ball, about, as ``deal_out(balls=...)`` is given here, up to ``pairs.MAX_BALLS`` balls
BLOCK = 8192  # rows per side of a group

FOUND = "query_id long, id long, dist double"


def _probed(angles: np.ndarray, members: np.ndarray, k: int) -> np.ndarray:
    """Per query (row) which balls are probed first: the nearest ones, until they hold k vectors."""
    order = np.argsort(angles, axis=1, kind="stable")
    before = np.cumsum(members[order], axis=1) - members[order]
    out = np.zeros(angles.shape, bool)
    np.put_along_axis(out, order, before < k, axis=1)
    return out


def _asked(balls: Balls, queries: DataFrame, k: int, further: bool) -> DataFrame:
    """(qid, qv, c): the balls that each query probes, first or (``further``, with a column ``u``, its radius so far) after that."""
    shared = queries.sparkSession.sparkContext.broadcast((balls.centres, balls.radius, balls.members))
    metric = balls.metric

    def run(batches):
        centres, radius, members = shared.value
        for batch in batches:
            lists = batch.column(1)
            x = _unit(lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.zeros((0, centres.shape[1])), metric)
            step = max(1, CELLS // max(1, len(centres)))
            for a in range(0, len(x), step):
                part = x[a:a + step]
                angles = _measure(part, centres, metric)
                probed = _probed(angles, members, k)
                if further:
                    u = batch.column(2).to_numpy(zero_copy_only=False)[a:a + step]
                    reach = np.array([radius_for(v + 10.0 ** -DIGITS, metric) if np.isfinite(v) else np.inf for v in u])
                    near = angles - radius[None, :] <= reach[:, None] + SLACK * (1.0 + np.abs(angles))
                    if metric == "cosine":
                        near[~part.any(axis=1)] = True  # a zero vector has no angle and is as far from everything
                    probed = near & ~probed & (members > 0)[None, :]
                q, c = np.nonzero(probed)
                raw = [part[i].tobytes() for i in range(len(part))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, step).take(pa.array(q)), pa.array([raw[i] for i in q], pa.binary()),
                                                  pa.array(c.astype(np.int32))], names=["qid", "qv", "c"])

    columns = [F.col("id").alias("qid"), "v"] + (["u"] if further else [])
    return queries.select(*columns).mapInArrow(run, "qid long, qv binary, c int")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("dist", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(balls: Balls, asked: DataFrame, k: int) -> DataFrame:
    """The k best of every query in every slice of every ball that it asks."""
    spark, metric, dim = asked.sparkSession, balls.metric, balls.centres.shape[1]
    asking = asked.groupBy("c").count().collect()  # at most a row per ball
    slices = [(r["c"], int(max(1, -(-balls.members[r["c"]] // BLOCK))), -(-r["count"] // BLOCK)) for r in asking]
    if not slices:
        return spark.createDataFrame([], FOUND)
    cut = F.broadcast(spark.createDataFrame(slices, "c int, s int, t int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    q = asked.join(cut, "c").select("qid", "qv", "c", each("s").alias("a"), part("qid", "t").alias("b"))
    x = balls.rows.join(cut, "c").select("id", "v", F.col("c").alias("x_c"), part("id", "s").alias("x_a"), each("t").alias("x_b"))

    def best(qt: pa.Table, xt: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query_id", "id", "dist"])
        if not qt.num_rows or not xt.num_rows:
            return empty
        ids = xt.column(0).to_numpy()
        y = read_vectors(xt.column(1), dim, metric)
        qid = qt.column(0).to_numpy()
        v = np.frombuffer(b"".join(qt.column(1).to_pylist()), np.float64).reshape(len(qid), -1)
        by = np.argsort(ids)  # ties go to the smaller id
        ids, y = ids[by], y[by]
        out, step = [], max(1, CELLS // len(ids))
        for s in range(0, len(qid), step):
            d = np.round(distances(v[s:s + step], y, metric), DIGITS)
            m = min(k, len(ids))
            limit = np.partition(d, m - 1, axis=1)[:, m - 1]
            row, col = np.nonzero(d <= limit[:, None])  # more than m where distances tie
            order = np.lexsort((col, d[row, col], row))
            row, col = row[order], col[order]
            first = np.searchsorted(row, np.arange(len(d)))
            kept = np.arange(len(row)) - first[row] < m
            row, col = row[kept], col[kept]
            out.append((qid[s + row], ids[col], d[row, col]))
        return pa.table([np.concatenate(c) for c in zip(*out)], names=["query_id", "id", "dist"])

    return q.groupBy("c", "a", "b").cogroup(x.groupBy("x_c", "x_a", "x_b")).applyInArrow(best, FOUND)


def nearest(balls: Balls, queries: DataFrame, k: int, qid_col: str = "query_id", qvec_col: str = "vec") -> DataFrame:
    """(query_id, id, dist, rank): the k nearest corpus vectors of every query, ties by the smaller id.

    Rows without a whole vector, in either table, have no distance. A corpus of fewer than k vectors gives all of them; query ids must differ.
    """
    wanted = prepare(queries, qid_col, qvec_col)
    if balls.n == 0:
        return queries.sparkSession.createDataFrame([], f"{FOUND}, rank int")
    first = materialize(_best(_search(balls, materialize(_asked(balls, wanted, k, False)), k), k))
    radius = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("dist")).otherwise(F.lit(float("inf"))).alias("u"))
    further = materialize(_asked(balls, wanted.join(radius, wanted["id"] == radius["query_id"]), k, True))
    return _best(first.drop("rank").unionByName(_search(balls, further, k)), k)
