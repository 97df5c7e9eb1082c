"""Cuts found in review: each of these once lost a part of the whole job."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from staleguard.llm import neardup, pii, toxicity


def test_each_of_fifty_repeats_gets_the_base_spans_evidence():
    k = len(pii.KINDS) + 1
    weights, even = np.zeros((1 << pii.BITS, k)), np.ones((k, k)) + 30 * np.eye(k)
    field = pii.Field(weights, np.zeros((k, k)), np.log(even / even.mean()).clip(-3, 3))
    text = "Call +1 (988) 555-2485 now. " + "some quiet words and 555.2485 again " * 50
    col = pa.array([text, text[28:], "plain 17"], pa.large_string())
    (_, _, _, nodes), = pii.nodes_of(col)
    p = field.marginals(nodes)
    own = np.flatnonzero((nodes.row == 0) & (nodes.base == 0))
    assert len(own) == 50 and (p[own, 4] > pii.ADD_AT).all()
    assert np.allclose(p[nodes.row > 0], 1 / k)  # without a base span nothing is told
    (base, spans), *others = pii.spans_of(col, field)
    assert len(spans) - len(base) == 50 and others == [([], []), ([], [])]


def test_messages_are_passed_until_they_settle():
    """A chain of unlike words: the evidence at its end is that of exact inference."""
    k = len(pii.KINDS) + 1
    weights, even = np.zeros((1 << pii.BITS, k)), np.ones((k, k)) + 60 * np.eye(k)
    field = pii.Field(weights, np.log(even), np.zeros((k, k)))
    (_, _, _, nodes), = pii.nodes_of(pa.array(["a@b.co " + " ".join(f"x{i}" for i in range(30))], pa.large_string()))
    want = np.linalg.matrix_power(even / even.sum(axis=1), 30)[1]
    assert np.allclose(field.marginals(nodes)[30], want, atol=0.01)


def test_toxic_text_without_word_stems_is_learned(spark):
    r = random.Random(5)
    calm = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    phrase = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(48))
    rows = [(i, calm(300) + (phrase + calm(40)) * 3 * (i % 3 == 0), int(i % 3 == 0)) for i in range(240)]  # one word each
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(df.filter("doc_id < 160"), df.select("doc_id", "toxic"))
    got = toxicity.score_toxicity(df.filter("doc_id >= 160"), model).join(df, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p"))
    share = {x["toxic"]: x["p"] for x in got.collect()}
    assert share[1] > 0.9 and share[0] < 0.1


def test_dictionaries_learn_from_every_document():
    texts = [b"x" * 5_000_000, *(f"{k} ".encode() * 500 for k in range(300, 500)), b"", b"short"]
    got = toxicity.spread_windows(texts, 20480)
    assert len(got) <= 20480 and all(any(f"{k} ".encode() in w for w in got) for k in range(300, 500)) and b"short" in got
    assert sorted(toxicity.spread_windows(texts[1:], 20480)) == sorted(t[i:i + 64] for t in texts[1:] for i in range(0, len(t), 64))


def test_different_texts_under_one_id_are_all_kept(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    rows = [(3, one), (3, one), (3, two), (3, two + " more"), (5, two), (7, three), (9, one), (9, None), (None, one)]
    got = [tuple(r) for r in neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) in [sorted([(3, one), (3, t), (7, three), (9, None), (None, one)], key=str) for t in (two, two + " more")]
