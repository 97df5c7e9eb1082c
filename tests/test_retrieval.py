"""Containment and lexical top-k against brute force; factorisations on a tiny matrix."""

import re

import numpy as np

from staleguard.operators import containment as C
from staleguard.operators import retrieve as RT
from staleguard.operators import textml as TM


def test_containment_matches_python(spark):
    texts = [(1, "the quick brown fox"), (2, "jumps over the lazy dog"), (3, "Quick!"), (4, None)]
    pats = [(10, "quick"), (11, "the "), (12, "dog"), (13, "zebra"), (14, "the ")]
    t = spark.createDataFrame(texts, "doc_id long, text string")
    p = spark.createDataFrame(pats, "item_id long, text string")
    got = {(r.id, r.pid) for r in C.passage_hits(t, "doc_id", "text", p, "item_id", "text").collect()}
    want = {(d, q) for d, s in texts if s for q, x in pats if x in s}
    assert got == want
    got_l = {(r.id, r.pid) for r in C.passage_hits(t, "doc_id", "text", p, "item_id", "text", lower=True).collect()}
    assert (3, 10) in got_l


def test_lexical_topk_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(30)]
    chunks = [(i, " ".join(rng.choice(vocab, size=int(rng.integers(0, 8))))) for i in range(40)]
    queries = [(100 + j, " ".join(rng.choice(vocab, size=3))) for j in range(6)] + [(200, "nothing here")]
    cdf = spark.createDataFrame(chunks, "chunk_id long, text string")
    qdf = spark.createDataFrame(queries, "query_id long, content string")
    got = {}
    for r in RT.lexical_topk(qdf, cdf, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id))

    def toks(s):
        return set(re.findall(r"\w+", s.lower()))
    for qid, q in queries:
        qt = toks(q)
        scored = []
        for cid, c in chunks:
            ct = toks(c)
            s = len(qt & ct)
            scored.append((-(s / (len(qt) + len(ct) - s)) if s else 0.0, cid))
        want = [cid for _, cid in sorted(scored)[:5]]
        assert [c for _, c in sorted(got[qid])] == want, qid


def test_nmf_and_lsa_shapes(spark):
    rows = [(d, f"t{t}", float(1 + (d * t) % 3)) for d in range(12) for t in range(8) if (d + t) % 3]
    w = spark.createDataFrame(rows, "doc_id long, term string, weight double")
    W = {r.doc_id: r.w for r in TM.nmf(w, 3, updates=5).collect()}
    assert len(W) == 12 and all(len(v) == 3 and min(v) >= 0 for v in W.values())
    L = {r.doc_id: r.vec for r in TM.lsa(w, 2, oversample=3, power_iterations=1).collect()}
    A = np.zeros((12, 8))
    for d, t, x in rows:
        A[d, int(t[1:])] = x
    s = np.linalg.svd(A, compute_uv=False)[:2]
    got = np.array([L[d] for d in range(12)])
    assert np.allclose(np.sort(np.linalg.norm(got, axis=0))[::-1], s, rtol=1e-6)


def test_topk_nearest_matches_brute_force(spark):
    from staleguard.operators import windows as W
    rng = np.random.default_rng(3)
    X = rng.normal(size=(200, 8))
    Q = rng.normal(size=(3, 8))
    df = spark.createDataFrame([(i, [float(x) for x in X[i]]) for i in range(len(X))], "id long, e array<double>")
    got = {}
    qdf = spark.createDataFrame([(j, [float(x) for x in Q[j]]) for j in range(3)], "query_id long, vec array<double>")
    for r in W.topk_nearest(df.repartition(4), "id", "e", qdf, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    Xn = X / np.linalg.norm(X, axis=1, keepdims=True)
    for j in range(3):
        d = 1 - Xn @ (Q[j] / np.linalg.norm(Q[j]))
        want = list(np.lexsort((np.arange(len(X)), d))[:5])
        assert [i for _, i in sorted(got[j])] == want


def test_tfidf_formula(spark):
    docs = spark.createDataFrame([(1, "aa bb bb"), (2, "bb cc"), (3, "dd")], "doc_id long, content string")
    w = {(r.doc_id, r.term): r.weight for r in TM.tfidf(docs, max_df=1.0, stop_words=()).collect()}
    n = 3
    idf = {t: np.log((1 + n) / (1 + df)) + 1 for t, df in {"aa": 1, "bb": 2, "cc": 1, "dd": 1}.items()}
    raw1 = np.array([1 * idf["aa"], 2 * idf["bb"]])
    raw1 = raw1 / np.linalg.norm(raw1)
    assert abs(w[(1, "aa")] - raw1[0]) < 1e-12 and abs(w[(1, "bb")] - raw1[1]) < 1e-12
    assert abs(w[(3, "dd")] - 1.0) < 1e-12
    # max_df drops terms in more than 95% of documents
    w2 = {(r.doc_id, r.term) for r in TM.tfidf(docs.where("doc_id < 3"), max_df=0.95, stop_words=()).collect()}
    assert (1, "bb") not in w2


def _brute_topk(queries, chunks, k):
    toks = lambda s: set(re.findall(r"\w+", (s or "").lower()))
    out = []
    for qid, q in queries:
        qt = toks(q)
        scored = []
        for cid, c in chunks:
            ct = toks(c)
            s = len(qt & ct)
            scored.append((-(s / (len(qt) + len(ct) - s)) if s else 0.0, cid))
        out += [(qid, r, cid, -s) for r, (s, cid) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def test_lexical_topk_prunes_and_stays_exact(spark, monkeypatch):
    """Zipf-like words, one in nearly every chunk; few seeds, ties, empty and null texts, words no chunk has."""
    monkeypatch.setattr(RT, "SEED_TOKENS", 2)
    monkeypatch.setattr(RT, "SEED_POSTINGS", 4)
    rng = np.random.default_rng(5)
    vocab = np.array([f"w{i}" for i in range(200)])
    p = 1 / np.arange(1, 201)
    p /= p.sum()
    text = lambda n: " ".join(rng.choice(vocab, size=n, p=p))
    chunks = [(i, text(int(rng.integers(1, 30)))) for i in range(300)] + [(300 + i, "w0 w1 same text") for i in range(12)] \
        + [(400, ""), (401, None), (402, "w150 w151")]
    queries = [(j, text(12)) for j in range(25)] + [(50, "w0"), (51, "same text"), (52, "absent"), (53, ""), (54, None),
                                                  (55, "w150 absent words"), (56, "w199 w198 w0")]
    cdf = spark.createDataFrame(chunks, "chunk_id long, text string").repartition(5)
    qdf = spark.createDataFrame(queries, "query_id long, content string")
    for k in (1, 4, 7):
        got = sorted(tuple(r) for r in RT.lexical_topk(qdf, cdf, k).collect())
        want = _brute_topk(queries, chunks, k)
        assert [g[:3] for g in got] == [w[:3] for w in want], k
        assert all(abs(g[3] - w[3]) < 1e-12 for g, w in zip(got, want))


def test_lexical_topk_empty_tables(spark):
    none_c = spark.createDataFrame([], "chunk_id long, text string")
    none_q = spark.createDataFrame([], "query_id long, content string")
    some_q = spark.createDataFrame([(1, "a b")], "query_id long, content string")
    assert RT.lexical_topk(some_q, none_c, 3).collect() == []
    assert RT.lexical_topk(none_q, spark.createDataFrame([(1, "a")], "chunk_id long, text string"), 3).collect() == []


def test_containment_in_several_batches(spark, monkeypatch):
    """Several passage batches give the same results as one."""
    t = spark.createDataFrame([(1, "abc def"), (2, "xyz abc")], "doc_id long, text string")
    p = spark.createDataFrame([(10, "abc"), (11, "xyz"), (12, "def")], "item_id long, text string")
    want = {(r.id, r.pid) for r in C.passage_hits(t, "doc_id", "text", p, "item_id", "text").collect()}
    monkeypatch.setattr(C, "MAX_PATTERNS_PER_BATCH", 1)
    got = {(r.id, r.pid) for r in C.passage_hits(t, "doc_id", "text", p, "item_id", "text").collect()}
    assert got == want == {(1, 10), (1, 12), (2, 10), (2, 11)}


def test_topk_nearest_multi_pass(spark, monkeypatch):
    from staleguard.operators import windows as W
    rng = np.random.default_rng(8)
    X = rng.normal(size=(50, 4))
    df = spark.createDataFrame([(i, [float(x) for x in X[i]]) for i in range(50)], "id long, e array<double>")
    q = spark.createDataFrame([(j, [float(x) for x in rng.normal(size=4)]) for j in range(5)], "query_id long, vec array<double>")
    one = sorted((r.query_id, r["rank"], r.id) for r in W.topk_nearest(df, "id", "e", q, 3).collect())
    monkeypatch.setattr(W, "MAX_QUERY_VECTORS", 2)
    many = sorted((r.query_id, r["rank"], r.id) for r in W.topk_nearest(df, "id", "e", q, 3).collect())
    assert one == many and len(one) == 15


def test_lexical_topk_is_the_same_with_and_without_broadcast_queries(spark, monkeypatch):
    """Few query tokens go to the chunks, which are scored where they lie; many meet them in shuffles."""
    rng = np.random.default_rng(9)
    vocab = np.array([f"w{i}" for i in range(60)])
    p = 1 / np.arange(1, 61)
    text = lambda n: " ".join(rng.choice(vocab, size=n, p=p / p.sum()))
    chunks = [(i, text(int(rng.integers(1, 25)))) for i in range(150)] + [(200, ""), (201, None)]
    queries = [(j, text(8)) for j in range(12)] + [(20, "w0"), (21, "absent"), (22, None)]
    cdf = spark.createDataFrame(chunks, "chunk_id long, text string").repartition(3)
    qdf = spark.createDataFrame(queries, "query_id long, content string")
    want = _brute_topk(queries, chunks, 4)
    for most in (RT.BROADCAST_TOKENS, 0):
        monkeypatch.setattr(RT, "BROADCAST_TOKENS", most)
        got = sorted(tuple(r) for r in RT.lexical_topk(qdf, cdf, 4).collect())
        assert [g[:3] for g in got] == [w[:3] for w in want], most
        assert all(abs(g[3] - w[3]) < 1e-12 for g, w in zip(got, want))


def test_ordered_context_is_the_same_with_and_without_broadcast_rows(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, f"t{i}", [], f"20{10 + i}-01-01") for i in range(6)],
                                   "chunk_id long, text string, outdated_by array<long>, creation_date string")
    got = spark.createDataFrame([(1, 1, 4, 0), (1, 2, 2, 0), (2, 1, 4, 0), (2, 2, 99, 0)], "query_id long, rank int, chunk_id long, round int")
    for most in (RT.BROADCAST_CONTEXT, 0):
        monkeypatch.setattr(RT, "BROADCAST_CONTEXT", most)
        rows = sorted((r.query_id, r.position, r.text) for r in RT.ordered_context(got, chunks, False).collect())
        assert rows == [(1, 1, "t4"), (1, 2, "t2"), (2, 1, "t4")]


def test_chunks_are_cut_from_stretches(spark, monkeypatch):
    """Windows are cut from stretches of a text, and none differs from the window of the whole text."""
    from staleguard.operators import chunks as CH
    monkeypatch.setattr(CH, "STRETCH", 3)
    texts = [(n, "".join(chr(97 + (i * 7 + n) % 26) if i % 5 else "é𝄞"[i % 2] for i in range(n))) for n in (0, 1, 9, 10, 11, 16, 17, 28, 29, 30, 34, 35, 100)]
    docs = spark.createDataFrame(texts + [(500, None)], "doc_id long, content string")
    got = sorted((r.doc_id, r.pos, r.text) for r in CH.fixed_chunks(docs, size=10, overlap=4).collect())
    count = lambda n: 1 if n <= 10 else -(-(n - 10) // 6) + 1
    assert got == sorted((d, k, t[6 * k:6 * k + 10]) for d, t in texts for k in range(count(len(t))))
    first = docs.selectExpr("doc_id", "content", "doc_id * 1000 AS o")
    assert sorted((r.doc_id, r.chunk_id) for r in CH.fixed_chunks(first, size=10, overlap=4, first_id="o").collect()) == [(d, 1000 * d + k) for d, k, _ in got]


def test_conflicts_of_documents(spark):
    """First and last lines are cut before the documents meet their lineage."""
    from staleguard.sources import testdata as TD
    docs = spark.createDataFrame([(3, "a\nb"), (1, "a\nb"), (2, " x\ny\nz "), (5, " x\ny\nz "), (4, None), (6, "alone")], "doc_id long, content string")
    c = TD.conflicts(docs)
    assert sorted((r.id1, r.id2, r.conflicting_passage_doc1, r.conflicting_passage_doc2) for r in c.collect()) == [(1, 3, "a", "b"), (2, 5, "x", "z")]
