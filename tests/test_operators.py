"""Operators against brute force / hand-made fixtures (C2/C3, C11, K1, D1, D6, J3, E3, sampling)."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from staleguard.operators import chunks as CH
from staleguard.operators import evaluate as EV
from staleguard.operators import lineage as LN
from staleguard.operators import pairs as P
from staleguard.operators import retrieve as RT
from staleguard.operators import sampling as SM
from staleguard.operators import windows as W


def test_pairs_match_brute_force(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(120, 8))
    X[5] = X[4]  # an exact duplicate: distance 0 is excluded
    rows = [(i, [float(x) for x in X[i]]) for i in range(len(X))]
    df = spark.createDataFrame(rows, "id long, e array<double>")
    for t in (0.3, 0.8, 1.2):
        got = {(r.id1, r.id2) for r in P.related_pairs(df, "id", "e", t, block_rows=16).collect()}
        U = X / np.linalg.norm(X, axis=1, keepdims=True)
        want = set()
        for i, j in itertools.combinations(range(len(X)), 2):
            d = min(max(1 - U[i] @ U[j], 0.0), 2.0)
            if 0 < d <= t:
                want.add((i, j))
        assert got == want, t
    # euclidean and include_exact
    got = {(r.id1, r.id2) for r in P.related_pairs(df, "id", "e", 0.5, metric="euclidean",
                                                   include_exact=True).collect()}
    assert (4, 5) in got


def test_closure_cycles_and_missing_ids(spark):
    chunks = spark.createDataFrame(
        [(1, [2]), (2, [3]), (3, []), (10, [11]), (11, [10]), (20, [99])], "chunk_id long, outdated_by array<bigint>")
    seeds = spark.createDataFrame([(1, 1), (2, 10), (3, 20)], "query_id long, chunk_id long")
    got = {(r.query_id, r.chunk_id, r["round"]) for r in RT.newer_closure(seeds, chunks).collect()}
    assert got == {(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 10, 0), (2, 11, 1), (3, 20, 0)}


def test_flag_outdated_last_conflict_wins_and_clears(spark):
    docs = spark.createDataFrame([(1, "2000-01-01"), (2, "2005-01-01"), (3, "2005-01-01")],
                                 "doc_id long, d string").select("doc_id", F.to_date("d").alias("creation_date"))
    chunks = spark.createDataFrame([(1, 0, "Old fact A."), (2, 1, "new fact b"), (3, 2, "unrelated")],
                                   "doc_id long, chunk_id long, text string")
    conflicts = spark.createDataFrame(
        [(1, 2, "old fact a", "New fact B", 1), (1, 3, "old fact a", "nothing like it", 2)],
        "id1 long, id2 long, conflicting_passage_doc1 string, conflicting_passage_doc2 string, ord int")
    got = {r.chunk_id: r.outdated_by for r in CH.flag_outdated(chunks, conflicts, docs).collect()}
    assert got == {0: []}  # the second conflict (no new chunk) clears the flag
    got = {r.chunk_id: r.outdated_by for r in CH.flag_outdated(chunks, conflicts.where("ord = 1"), docs).collect()}
    assert got == {0: [1]}


def test_a_document_with_many_conflicts_is_cut_into_slices(spark, monkeypatch):
    monkeypatch.setattr(CH, "PASSAGE_SLICE", 5)
    monkeypatch.setattr(CH, "CHUNK_SLICE", 3)
    docs = spark.createDataFrame([(i, f"20{i:02d}-01-01") for i in range(60)], "doc_id long, d string").select("doc_id", F.to_date("d").alias("creation_date"))
    text = {(d, k): f"Fact {d} of part {k}! and" for d in range(60) for k in range(10 if d == 0 else 1)}
    ids = {key: i for i, key in enumerate(text)}
    chunks = spark.createDataFrame([(d, ids[d, k], t, "x") for (d, k), t in text.items()], "doc_id long, chunk_id long, text string, number string")
    rows = [(0, j, f"fact 0 of part {j % 10}", f"fact {j} of part 0", j) for j in range(1, 60)] + [(0, 5, "", "fact 5", 100), (0, 6, None, "x", 101), (0, 7, "nowhere", "fact 7", 102)]
    conflicts = spark.createDataFrame(rows, "id1 long, id2 long, conflicting_passage_doc1 string, conflicting_passage_doc2 string, ord int")
    got = {r.chunk_id: r.outdated_by for r in CH.flag_outdated(chunks, conflicts.where("ord < 100"), docs).collect()}
    assert got == {ids[0, k]: [ids[max(j for j in range(1, 60) if j % 10 == k), 0]] for k in range(10)}
    both = {r.chunk_id: r.outdated_by for r in CH.flag_outdated(chunks, conflicts.where("ord < 100"), docs, "union").collect()}
    assert both[ids[0, 3]] == [ids[j, 0] for j in range(3, 60, 10)]
    empty = {r.chunk_id: r.outdated_by for r in CH.flag_outdated(chunks, conflicts.where("ord >= 100"), docs).collect()}
    assert empty == {**{ids[0, k]: [] for k in range(10)}, ids[5, 0]: []}  # the empty passage is in every chunk of both


def test_cluster_recall_per_link(spark):
    docs = spark.createDataFrame([(1, [], [0]), (2, [], [1]), (3, [1, 2], [0]), (4, [1], [5])],
                                 "doc_id long, original_doc_ids array<bigint>, clusters array<int>")
    _, rep = EV.cluster_recall(docs, "clusters")
    r = rep.collect()[0]
    assert abs(r.recall - 1 / 3) < 1e-12 and r.n_links == 3


def test_avg_related_inclusion_exclusion(spark):
    docs = spark.createDataFrame([(1, [0]), (2, [0, 1]), (3, [1]), (4, [2])], "doc_id long, clusters array<int>")
    got = EV.avg_related(docs, "clusters").collect()[0].avg_related_docs
    # related incl. self: 1->{1,2}, 2->{1,2,3}, 3->{2,3}, 4->{4}
    assert abs(got - (2 + 3 + 2 + 1) / 4) < 1e-12
    per = {r.doc_id: r.n_related for r in EV.shared_cluster_counts(docs, "clusters").collect()}
    assert per == {1: 2, 2: 3, 3: 2, 4: 1}


def test_recursive_splitter_properties():
    text = ("Alpha beta gamma. " * 40 + "\n\n") * 3 + "x" * 700
    parts = CH.split_recursive(text)
    assert parts and all(0 < len(p) <= 512 for p in parts)
    assert all(p == p.strip() for p in parts)
    assert CH.split_recursive("") == []


def test_sequential_offsets(spark):
    df = spark.createDataFrame([(i, (i % 3) + 1) for i in range(50)], "k long, n long")
    got = {r.k: r.offset for r in W.sequential_offsets(df, "k", "n", block=7).collect()}
    run, want = 0, {}
    for i in range(50):
        want[i] = run
        run += (i % 3) + 1
    assert got == want


def test_sampling_is_reproducible_and_stratified(spark):
    df = spark.createDataFrame([(i, ["Finance", "Medical", "Law"][i % 3]) for i in range(90)], "id long, domain string")
    a = {r.id for r in SM.stratified_sample(df, "id", "domain", 30, 7).collect()}
    b = {r.id for r in SM.stratified_sample(df, "id", "domain", 30, 7).collect()}
    assert a == b and len(a) == 30
    assert SM.round_robin_quota(30) == {"Finance": 10, "Medical": 10, "Law": 10}


def test_pairs_on_bench_scale_vectors_match_numpy(spark):
    """The sf0.1 embeddings (2,000 vectors): exact pair counts at several thresholds."""
    import os

    import pyarrow.parquet as pq
    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        return
    t = pq.read_table(path).to_pydict()
    X = np.array(t["embedding"], dtype=np.float64)
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    d = np.clip(1 - U @ U.T, 0, 2)[np.triu_indices(len(X), 1)]
    df = spark.read.parquet(path)
    for thr in (0.6, 0.75, 1.1):
        want = int(((d > 0) & (d <= thr)).sum())
        got = P.related_pairs(df, "vec_id", "embedding", thr, block_rows=700).count()
        assert got == want, (thr, got, want)


def test_sequential_offsets_sparse_keys(spark):
    keys = [i * 1_000_003 + (i % 7) for i in range(300)]  # span far larger than the row count
    df = spark.createDataFrame([(k, (k % 3) + 1) for k in keys], "k long, n long")
    got = {r.k: r.offset for r in W.sequential_offsets(df, "k", "n", block=16).collect()}
    run, want = 0, {}
    for k in sorted(keys):
        want[k] = run
        run += (k % 3) + 1
    assert got == want


def test_related_counts_large_label_sets(spark, monkeypatch):
    rng = np.random.default_rng(4)
    sets = [list(rng.choice(40, size=int(rng.integers(0, 4)), replace=False)) for _ in range(60)]
    sets[0] = list(range(15))  # more labels than inclusion-exclusion handles
    docs = spark.createDataFrame([(i, [int(x) for x in s]) for i, s in enumerate(sets)], "doc_id long, clusters array<int>")
    want = {i: sum(1 for t in sets if set(s) & set(t)) for i, s in enumerate(sets)}
    got = {r.doc_id: r.n_related for r in EV.shared_cluster_counts(docs, "clusters").collect()}
    assert got == want
    avg = EV.avg_related(docs, "clusters").collect()[0].avg_related_docs
    assert abs(avg - sum(want.values()) / len(sets)) < 1e-12
    # other limits and many blocks give the same counts
    monkeypatch.setattr(EV, "SMALL_SET", 2)
    monkeypatch.setattr(EV, "SET_BLOCK", 7)
    got2 = {r.doc_id: r.n_related for r in EV.shared_cluster_counts(docs, "clusters").collect()}
    assert got2 == want


def test_null_vectors_and_level_counts(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(150, 6))
    rows = [(i, [float(x) for x in X[i]]) for i in range(150)] + [(500, None), (501, None)]
    df = spark.createDataFrame(rows, "id long, e array<double>").repartition(3)
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    dist = {"cosine": np.clip(1 - U @ U.T, 0, 2), "euclidean": np.sqrt(((X[:, None] - X[None]) ** 2).sum(axis=2))}
    for metric, levels in (("cosine", [0.2, 0.5, 1.0, 2.0]), ("euclidean", [1.0, 2.5, 4.0])):
        d = dist[metric][np.triu_indices(150, 1)]
        want, low = {}, 0.0
        for k, t in enumerate(levels):
            want[k] = int(((d > low) & (d <= t)).sum())
            low = t
        got = {r.gi: r.np for r in P.level_counts(df, "id", "e", levels, metric).collect()}
        assert got == {k: n for k, n in want.items() if n}
        pairs = P.related_pairs(df, "id", "e", levels[1], metric, block_rows=16).collect()
        assert len(pairs) == len({(r.id1, r.id2) for r in pairs}) == want[0] + want[1] and all(r.id1 < r.id2 for r in pairs)
    links = spark.createDataFrame([(0, 1), (0, 500)], "doc_id long, orig long")
    got = {r.orig: r.dist for r in P.link_distances(links, df, "id", "e").collect()}
    assert abs(got[1] - dist["cosine"][0, 1]) < 1e-9 and got[500] is None


def test_known_conflict_counts_are_those_of_the_pairs(spark):
    from staleguard.operators import lineage as LN
    rows = [(1, "original", []), (2, "original", None)] + [(10 + i, "single_textual", [1]) for i in range(5)] \
        + [(20, "single_textual", [2, 1]), (30, "tabular", [1, 2]), (31, "tabular", [1]), (32, "tabular", []), (40, "multi_textual", [2])]
    docs = spark.createDataFrame(rows, "doc_id long, kind string, original_doc_ids array<long>")
    got = {r.original: (r.lineage_pairs, r.tabular_pairs) for r in LN.known_conflict_counts(docs).collect()}
    first = {d: o[0] for d, _, o in rows if o}
    pairs = [(r.id1, r.id2, r.why) for r in LN.known_conflict_pairs(docs).collect()]
    want = {o: (sum(w == "lineage" and b == o for _, b, w in pairs), sum(w == "tabular" and first[a] == o for a, _, w in pairs)) for o in (1, 2)}
    assert got == want == {1: (8, 10), 2: (3, 1)}
    assert LN.known_conflict_counts(docs.where("doc_id < 3")).count() == 0


@pytest.mark.parametrize("kind", ["unique", "repeated rows", "torn ids"])
@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_recall_of_vectors_is_that_of_their_pairs(spark, monkeypatch, kind, metric):
    rows = [(i, [float((i * k) % 7) - 3.0 for k in (1, 2, 3)], [] if i % 5 == 0 else [i - i % 5, 3]) for i in range(1, 60)]
    rows += [(300, [0.0, 0.0, 0.0], [5]), (301, [2.0, 4.0, 6.0], [302, 999]), (302, [1.0, 2.0, 3.0], []), (303, None, [302, None])]
    rows += {"unique": [], "repeated rows": rows[:9], "torn ids": [(1, [9.0, 1.0, 1.0], [2])]}[kind]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<double>, original_doc_ids array<long>").repartition(3)
    vecs = df.select(F.col("doc_id").alias("vec_id"), "embedding")
    related = P.related_pairs
    if kind != "torn ids":
        monkeypatch.setattr(P, "related_pairs", lambda *a: pytest.fail("a row per pair"))
    t = 0.7 if metric == "cosine" else 4.2
    got = EV.distance_recall_of_vectors(df, vecs, t, metric).first()
    assert tuple(got) == tuple(EV.distance_recall(df, related(vecs, "vec_id", "embedding", t, metric)).first()) and 0 < got["recall"] < 1


def test_candidate_pairs_are_turned_round_after_the_joins(spark):
    docs = spark.createDataFrame([(1, []), (2, [1]), (3, None), (4, [2])], "doc_id long, original_doc_ids array<long>")
    pairs = spark.createDataFrame([(1, 2, 0.1), (1, 3, 0.2), (2, 4, 0.3), (1, 9, 0.4)], "id1 long, id2 long, dist double")
    out = LN.candidate_pairs(pairs, docs)
    assert sorted(map(tuple, out.collect())) == [(1, 2, True), (1, 3, False), (2, 1, True), (2, 4, True), (3, 1, False), (4, 2, True)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")  # a pair travels once; both orientations did before
