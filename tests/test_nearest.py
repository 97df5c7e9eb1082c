"""k nearest vectors by balls against brute force."""

import numpy as np
import pytest

from staleguard.operators import nearest as N
from staleguard.operators import pairs as P


def tables(spark, x, q):
    vec = lambda rows: [(i, [float(a) for a in v], "clash") for i, v in enumerate(rows)]
    return (spark.createDataFrame(vec(x), "id long, e array<double>, c string").repartition(4),
            spark.createDataFrame(vec(q), "query_id long, vec array<double>, dist string"))


def brute(x, q, k, metric):
    if metric == "cosine":
        unit = lambda a: a / np.where((n := np.linalg.norm(a, axis=1, keepdims=True)) > 0, n, 1)
        d = np.clip(1 - unit(q) @ unit(x).T, 0, 2)
    else:
        d = np.sqrt(np.square(q[:, None] - x[None]).sum(axis=2))
    d = np.round(d, 9)
    return {(i, r + 1): int(j) for i in range(len(q)) for r, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:k])}


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_clustered_vectors_with_ties_and_zero_vectors(spark, monkeypatch, metric):
    rng = np.random.default_rng(0)
    middle = rng.normal(size=(15, 12)) * 3
    x = middle[np.arange(900) % 15] + 0.2 * rng.normal(size=(900, 12))
    x[100:140] = x[100]
    x[7] = 0
    q = np.concatenate([middle + 0.1, rng.normal(size=(5, 12)), x[100:101], np.zeros((1, 12))])
    corpus, queries = tables(spark, x, q)
    monkeypatch.setattr(N, "BLOCK", 50)
    balls = P.deal_out(corpus, "id", "e", metric, balls=30)
    got = {(r["query_id"], r["rank"]): r["id"] for r in N.nearest(balls, queries, 6).collect()}
    assert got == brute(x, q, 6, metric)


def test_few_balls_are_probed(spark):
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(40, 16))
    x = middle[np.arange(4000) % 40] + 0.02 * rng.normal(size=(4000, 16))
    corpus, queries = tables(spark, x, middle[:10])
    balls = P.deal_out(corpus, "id", "e", balls=60)
    found = N._best(N._search(balls, N._asked(balls, P.prepare(queries, "query_id", "vec"), 5, False), 5), 5)
    radius = found.groupBy("query_id").agg({"dist": "max"}).toDF("query_id", "u")
    further = N._asked(balls, P.prepare(queries, "query_id", "vec").join(radius, N.F.col("id") == radius["query_id"]), 5, True)
    assert further.count() + 10 < 10 * 60 / 10


def test_small_and_empty_tables(spark):
    x = np.random.default_rng(2).normal(size=(3, 4))
    corpus, queries = tables(spark, x, x[:2])
    balls = P.deal_out(corpus, "id", "e")
    assert N.nearest(balls, queries, 5).count() == 6
    assert N.nearest(balls, queries.limit(0), 5).count() == 0
    assert N.nearest(P.deal_out(corpus.limit(0), "id", "e"), queries, 5).count() == 0
    odd = queries.withColumn("vec", N.F.when(N.F.col("query_id") == 1, N.F.col("vec")))
    assert {r["query_id"] for r in N.nearest(balls, odd, 2).collect()} == {1}
