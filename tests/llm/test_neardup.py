"""Near-duplicate groups and fingerprints against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from staleguard.llm import fingerprint, neardup
from staleguard.llm.shared import components


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < k else [tuple(words[i:i + k]) for i in range(len(words) - k + 1)])


def brute_groups(texts, k, num, den):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def family(r, base, n, share):
    out = []
    for _ in range(n):
        words = list(base)
        for k in range(len(words)):
            if r.random() < share:
                words[k] = f"w{r.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def fixture(seed):
    r, texts = random.Random(seed), []
    for size, share in ((60, 0.004), (90, 0.012), (40, 0.03), (3, 0.0)):
        base = [f"b{r.randrange(10**6)}" for _ in range(120)]
        texts += family(r, base, size, share)
    texts += ["", None, " \n\t", "one two", "One  two", "one", "x" * 5000] + [f"alone {r.random()} and {r.random()} more" for _ in range(30)]
    texts += texts[:20] * 3
    r.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("small", [False, True])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, small):
    if small:  # many slices and blocks, also in a chain-like family
        for name, value in (("SLICE", 7), ("BLOCK", 5)):
            monkeypatch.setattr(neardup, name, value)
    texts = fixture(5)
    df = spark.createDataFrame([(i, t, "rep", 1) for i, t in texts.items()], "doc_id long, text string, root string, n int").repartition(6)
    got = {r[0]: tuple(r)[1:] for r in neardup.near_duplicates(df, k=3, num=85, den=100).collect()}
    assert got == brute_groups(texts, 3, 85, 100)


def test_one_of_each_group_is_kept(spark):
    texts = {3: "a b c d e f g", 9: "a b c d e f g", 4: None, 5: "", 6: "z y x"}
    rows = [(i, t, "en") for i, t in texts.items()] + [(3, "a b c d e f g", "en"), (None, "a b c d e f g", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 3), (False, 4), (False, 5), (False, 6), (True, 0)]
    assert neardup.keep_one(df.limit(0)).count() == 0


def test_odd_sketches_tell_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    for share in (0.95, 0.85, 0.8):
        cut = int(len(base) * (1 - share) / (1 + share))
        a, b = base[cut:], np.concatenate([base[:len(base) - 2 * cut], rng.integers(0, 1 << 63, cut, dtype=np.uint64), base[len(base) - cut:]])
        like = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = neardup.odd_sketches(neardup.minhashes([np.unique(a), np.unique(b)])).view(np.uint64)
        apart = int(np.bitwise_count(x ^ y).sum())
        told = 1 + neardup.SKETCH_BITS / (4 * neardup.HASHES) * np.log(1 - 2 * apart / neardup.SKETCH_BITS)
        assert abs(told - like) < 0.1 and apart <= neardup.furthest(like)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 160)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketches(spark):
    long = " ".join(f"w{k}" for k in range(4000))
    rows = [(1, long), (2, " ".join(f"w{k}" for k in range(2000))), (3, None), (4, ""), (5, " \t\n"), (6, "one"), (7, "one"), (8, "a b c d e f")]
    df = fingerprint.with_sketch(spark.createDataFrame(rows, "id long, text string"), "text", "s")
    got = {r["id"]: r["s"] for r in df.collect()}
    assert got[3] == got[4] == got[5] == [] and got[6] == got[7] and len(got[6]) == 1 and len(got[8]) >= 1
    assert abs(len(got[1]) - 500) < 100 and got[1] == sorted(set(got[1]))
    a, b = df.filter("id = 1").select(F.col("s").alias("a")), df.filter("id = 2").select(F.col("s").alias("b"))
    pair = a.crossJoin(b).select(fingerprint.containment(F.col("b"), F.col("a")).alias("c"), fingerprint.likeness(F.col("a"), F.col("b")).alias("l"),
                                 fingerprint.merged(F.col("a"), F.col("b")).alias("m")).first()
    assert pair["c"] == 1.0 and abs(pair["l"] - 0.5) < 0.1 and pair["m"] == got[1]


def test_edited_texts_and_ring(spark):
    texts = {5: "abcdefghi", 3: "xyz", 9: "é" * 30, 1: "", 2: None}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(None, "free", "x")], "doc_id long, text string, sketch string")
    got = {r["doc_id"]: r for r in fingerprint.edited_pairs(df).collect()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        own, nxt = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        n = len(own) // 3
        assert got[i]["edited"] == own[:len(own) - n] + nxt[:n] and got[i]["n_chars"] == len(own)
    assert got[None]["edited"] == "free"
    assert fingerprint.edited_pairs(df.limit(0)).count() == 0


def test_components_end_with_the_round_that_settles_them(spark, monkeypatch):
    from staleguard.llm import shared
    wrote, cleaned, written = [], [], shared.written
    monkeypatch.setattr(shared, "written", lambda df, name: (wrote.append(name), written(df, name))[1])
    monkeypatch.setattr(shared, "clean_up", lambda spark: cleaned.append(1))
    star = spark.createDataFrame([(1, v) for v in range(2, 40)] + [(70, 60), (80, 70)], "a long, b long")
    got = {r["id"]: r["root"] for r in shared.components(star).collect()}
    assert got == {**{v: 1 for v in range(1, 40)}, 60: 60, 70: 60, 80: 60}
    assert len(wrote) <= 3 and len(cleaned) == len(wrote) - 1  # the edges and their rounds; one more round before, and plans stayed
