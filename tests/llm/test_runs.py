"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from conftest import SF
from staleguard.llm import queries, runs


def all_runs(w):
    """Every (start, length, period) by comparing words a period apart, for each period in turn."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            m = j + q - i
            if m >= max(6, 4 * q) and not any(all(w[x] == w[x + p] for x in range(i, i + m - p)) for p in range(1, q)):
                out.append((i, m, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repeating_words(r):
    k, d = r.choice([1, 2, 3, 5, 50]), []
    for _ in range(r.randrange(0, 12)):
        unit = [f"w{r.randrange(k)}" for _ in range(r.randrange(1, 5))]
        d += unit * r.randrange(1, 9) if r.random() < 0.6 else unit[:1] * r.randrange(1, 4)
    return d


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_many_rows_at_once_are_those_of_brute_force(seed):
    r = random.Random(seed)
    for _ in range(60):
        docs = [repeating_words(r) for _ in range(r.randrange(1, 6))]
        names = {w: i for i, w in enumerate(sorted({w for d in docs for w in d}))}
        first = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(int)
        got = runs.word_runs(np.array([names[w] for d in docs for w in d], np.uint64), first)
        assert got == {i: want for i, d in enumerate(docs) if (want := all_runs(d))}


def test_lcp_of_sorted_suffixes():
    r = random.Random(9)
    w = np.array([r.randrange(3) for _ in range(120)])
    row = np.repeat([0, 1], [70, 50])
    stop = np.array([70, 120])[row]
    a, b, lcp = runs.neighbours(row, stop, w, 2)
    assert len(a)
    for x, y, m in zip(a, b, lcp):
        assert row[x] == row[y] and (w[x:x + m] == w[y:y + m]).all()
        assert x + m == stop[x] or y + m == stop[y] or w[x + m] != w[y + m]


def test_odd_rows(spark):
    long = "ab cd ef " * 4000
    rows = [(1, None, 5), (2, "", 5), (3, " \t\n", 5), (3, "a a a a a", 5), (None, "a\x0ba a a a\xa0 a a\ta a a a a a", 5), (4, long, 5), (4, long, 5)]
    df = spark.createDataFrame(rows, "id long, text string, runs int")
    got = sorted(((r["id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.periodic_runs(df, "id", "text").collect()), key=repr)
    w = re.findall(r"[^\x20\x09-\x0D]+", rows[4][1])
    want = [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (3, 5, [], "a a a a a"), (None, 13, all_runs(w), collapsed(w, all_runs(w))),
            (4, 12000, [(0, 12000, 3)], "ab cd ef"), (4, 12000, [(0, 12000, 3)], "ab cd ef")]
    assert got == sorted(want, key=repr) and all_runs(w) == [(5, 8, 1)]
    assert runs.periodic_runs(df.limit(0), "id", "text").count() == 0


def test_ties_of_the_strongest_run(spark):
    df = spark.createDataFrame([(1, [(9, 8, 2), (5, 12, 3), (5, 8, 2)]), (2, []), (3, [(0, 9, 2), (4, 8, 1)])], f"id long, runs array<{runs.RUN}>")
    got = {r["id"]: r["t"] and tuple(r["t"]) for r in df.withColumn("t", runs.strongest(df["runs"])).collect()}
    assert got == {1: (5, 8, 2), 2: None, 3: (4, 8, 1)}


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = all_runs(w)
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    return (doc_id, len(found), *top, 1000 * top[1] // top[2] if found else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
            hashlib.sha256(collapsed(w, found).encode()).hexdigest())


def test_query_against_brute_force_on_short_documents(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, " ".join(repeating_words(r)), "en", "web", 0) for i in range(80)] + [(80, None, "en", "web", 0), (81, "x " * 7, None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(expected(d, t) for d, t, *_ in rows)


def test_query_on_the_test_table_by_its_short_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r[0]: tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, SF).collect()}
    assert set(got) == set(docs)
    short = [i for i, t in docs.items() if len(t or "") < 4000]
    assert len(short) > 100 and any(got[i][1] for i in short)
    for i in short:
        assert got[i] == expected(i, docs[i])
