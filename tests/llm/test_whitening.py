"""Whitening against numpy's eigendecomposition of the distinct vectors."""

import numpy as np
import pytest

from conftest import SF
from staleguard.llm import queries, whitening


def reference(vectors, k=4, scale=256.0):
    x = np.floor(scale * np.asarray(vectors, float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    v = np.cov(fit.T.astype(float), bias=True).reshape(x.shape[1], -1)
    e, b = np.linalg.eigh(v)
    e, b = e[::-1][:k], b[:, ::-1][:, :k]
    return x, n, s, np.square(n * x.astype(object) - s).sum(axis=1), ((x - s / n) @ b) / np.sqrt(e), e / np.trace(v)


def check(got, ids, vectors, k=4):
    x, n, s, deviation, white, share = reference(vectors, k)
    assert len(got) == len(ids) * k
    at = {i: j for j, i in enumerate(ids)}
    mine = np.full((len(ids), k), np.nan)
    for r in got:
        j, c = at[r["vec_id"]], r["component"] - 1
        mine[j, c] = r["whitened"]
        assert (r["n"], r["deviation"]) == (n, deviation[j]) and abs(r["explained"] / share[c] - 1) < 1e-9 and r["identity_error"] < 1e-9
    sign = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine * sign - white).max() < 1e-7


def test_query_on_the_test_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = queries.QUERIES["op12_whitening"](spark, SF)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(got.collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_odd_rows_are_left_out_and_copies_count_once(spark):
    rng = np.random.default_rng(2)
    good = (rng.normal(size=(300, 6)) * [5, 3, 2, 1.5, 0.1, 0.05]).tolist()
    rows = [(i, v, 1) for i, v in enumerate(good)] + [(1000 + i, good[0], 1) for i in range(500)]
    odd = [(2000, None, 1), (2001, [1.0] * 5 + [None], 1), (2002, [float("nan")] + [0.0] * 5, 1), (2003, [0.0] * 5 + [float("-inf")], 1), (2004, [1.0, 2.0], 1), (2005, [], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, n int").repartition(6)
    got = whitening.whiten(df, "vec_id", "embedding", whitening.fit_whitening(df, "embedding")).collect()
    check(got, [r[0] for r in rows], [r[1] for r in rows])


def test_null_and_repeated_ids(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i if i % 3 else None, v) for i, v in enumerate(rng.normal(size=(30, 5)).tolist())], "vec_id long, embedding array<double>")
    got = whitening.whiten(df, "vec_id", "embedding", whitening.fit_whitening(df, "embedding", components=9)).collect()
    assert len(got) == 150 and sum(r["vec_id"] is None for r in got) == 50


@pytest.mark.parametrize("rows", [[[1.0, 2.0]], [[0.5, 0.5], [0.5, 0.5]], [[-0.0, 0.0]]])
def test_no_spread(spark, rows):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = whitening.whiten(df, "vec_id", "embedding", whitening.fit_whitening(df, "embedding")).collect()
    assert len(got) == 2 * len(rows) and all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (1, 0, None, None, None) for r in got)


def test_a_rank_below_the_components(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(50)], "vec_id long, embedding array<double>")
    got = whitening.whiten(df, "vec_id", "embedding", whitening.fit_whitening(df, "embedding")).collect()
    assert len(got) == 150 and all((r["whitened"] is None) == (r["component"] > 1) for r in got)
    assert abs(next(r["explained"] for r in got if r["component"] == 1) - 1) < 1e-12 and got[0]["identity_error"] < 1e-9


def test_nothing(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")
    assert whitening.whiten(df, "vec_id", "embedding", whitening.fit_whitening(df, "embedding")).collect() == []


def test_huge_numbers_stay_exact(spark):
    v = [[2.0 ** 40, 0.0], [-(2.0 ** 40), 1.0], [3.0, 5.0]]
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    model = whitening.fit_whitening(df, "embedding")
    assert model.sums == (3 * 256, 6 * 256)
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(df, "vec_id", "embedding", model).collect()}
    assert got == {0: None, 1: None, 2: (3 * 768 - 768) ** 2 + (3 * 1280 - 1536) ** 2}


def test_near_ties_are_certified():
    rng = np.random.default_rng(0)
    u = np.linalg.qr(rng.normal(size=(200, 200)))[0]
    e = np.concatenate([[1.0, 1 - 1e-3, 1 - 2e-3, 1 - 3e-3], np.linspace(0.99, 0, 196)])
    v = (u * e) @ u.T
    values, basis, residuals, _ = whitening.leading_pairs(lambda q: v @ q, 200, 4)
    assert np.abs(values - e[:4]).max() < 1e-12 and residuals.max() < 1e-11
    assert np.abs(np.abs((u[:, :4] * basis).sum(axis=0)) - 1).max() < 1e-12
