"""Property tests: I6, F6/F7/K8, J3, and scalar functions against their Python definitions."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF
from staleguard.functions import text as T
from staleguard.operators import chunks as CH
from staleguard.operators import textml as TM


def test_fuzzy_cmeans_memberships(spark):
    rng = np.random.default_rng(5)
    X = np.concatenate([rng.normal(0, 0.1, (30, 4)), rng.normal(3, 0.1, (30, 4))])
    df = spark.createDataFrame([(i, [float(x) for x in X[i]]) for i in range(len(X))], "id long, e array<double>")
    mem, fpc = TM.fuzzy_cmeans(df, "id", "e", 2, max_iter=100)
    rows = mem.collect()
    assert len(rows) == 60
    assert all(abs(sum(r.membership) - 1.0) < 1e-9 for r in rows)
    assert 0.5 - 1e-9 <= fpc <= 1.0 + 1e-9 and fpc > 0.9  # two well separated groups


def test_selection_disjoint_and_reproducible(spark):
    import __spark_entry__ as E
    q = E.queries()["select_for_alteration"]
    a = {tuple(r) for r in q(spark, SF).collect()}
    b = {tuple(r) for r in q(spark, SF).collect()}
    assert a == b
    textual = {r[0] for r in a if r[1]}
    tabular = {r[0] for r in a if r[2]}
    multi = {r[0] for r in a if r[3]}
    assert tabular <= textual and not (multi & textual)


def test_splitter_examples():
    assert CH.split_recursive("a\n\nb") == ["a\n\nb"]
    assert [len(c) for c in CH.split_recursive("x" * 700)] == [512, 316]
    words = " ".join(f"w{i:03d}" for i in range(300))  # 1,199 characters, split on spaces
    parts = CH.split_recursive(words)
    assert all(len(p) <= 512 for p in parts)
    # consecutive chunks overlap by at most 128 characters and together cover every word in order
    seen = []
    for p in parts:
        for w in p.split(" "):
            if not seen or w > seen[-1]:
                seen.append(w)
    assert seen == words.split(" ")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400), st.sampled_from([(16, 4), (10, 0), (7, 3)]))
def test_splitter_keeps_its_contract(text, how):
    size, overlap = how
    chunks = CH.split_recursive(text, size, overlap)
    assert all(c and c == c.strip() and len(c) <= size and c in text for c in chunks)
    at = 0
    for c in chunks:  # in text order
        at = text.index(c, max(0, at - overlap))
    assert "".join(chunks).count("a") >= text.count("a") and bool(chunks) == bool(text.strip())


NORMALIZED = [  # written by hand
    ("  Hello, World!  ", "hello world"), ("A-B_c", "abc"), ("", ""), ("   ", ""), ("ÄÖ ü.", "äö ü"), ("$5 & up", "5  up"),
    ("tab\tkept", "tab\tkept"), ("(x)[y]{z}", "xyz"), ("don't", "dont"), ("1.5%", "15"),
]
DERIVED = [(7, 1, 100007), (12345, 3, 312345), (123456, 4, 4123456), (0, 1, 100000), (99999, 4, 499999)]


def test_normalize_examples(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NORMALIZED)], "i long, t string")
    got = {r.i: r.n for r in df.select("i", T.normalize("t").alias("n")).collect()}
    assert [got[i] for i in range(len(NORMALIZED))] == [n for _, n in NORMALIZED]


def test_derived_id_examples(spark):
    df = spark.createDataFrame([(i, p) for i, p, _ in DERIVED], "i long, p int")
    got = {(r.i, r.p): r.r for r in df.select("i", "p", T.derived_id("i", F.col("p")).alias("r")).collect()}
    assert got == {(i, p): r for i, p, r in DERIVED}


def test_terms_of_any_script(spark):
    df = spark.createDataFrame([("Für größere Änderungen año niño x 日本",)], "t string")
    assert df.select(T.term_tokens("t").alias("w")).first().w == ["für", "größere", "änderungen", "año", "niño", "日本"]
