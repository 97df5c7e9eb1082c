"""Packing: the plan over histograms, and the Spark job against the library's ids."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from staleguard.llm import packing

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_plan_uses_every_length_once(lengths):
    plan = packing.pack_histogram(Counter(lengths), 64, groups=6)
    used = Counter()
    for pattern, n in plan:
        assert sum(pattern) <= 64 and n > 0
        for x in pattern:
            used[x] += n
    assert used == Counter(lengths)
    assert sum(n for _, n in plan) <= best_fit_decreasing(lengths, 64)


def test_configurations_beat_plain_best_fit_where_sizes_are_few():
    lengths = [44] * 30 + [24] * 30 + [32] * 60  # 44+24+32 fill 100; longest first pairs 44+44
    plan = packing.pack_histogram(Counter(lengths), 100, groups=3)
    assert sum(n for _, n in plan) <= best_fit_decreasing(lengths, 100)
    assert sum(n for _, n in plan) >= -(-sum(lengths) // 100)


def check_packing(rows, texts, capacity):
    ids = {k: e.ids + [2] for k, e in zip(texts, Tokenizer.from_file(BYTE).encode_batch([t or "" for t in texts.values()], add_special_tokens=False))}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for d, own in by_doc.items():
        at = 0
        for k, r in enumerate(sorted(own, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[d][at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids[d]) and len(own) == -(-at // capacity)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    assert sorted(by_seq) == list(range(len(by_seq)))


def test_documents_are_packed_whole(spark):
    texts = {1: None, 2: "", 3: "the thing " * 900, 4: "a b c", None: "no id"} | {10 + k: "same length" for k in range(300)}
    df = spark.createDataFrame([(i, t, 1.5) for i, t in texts.items()], "doc_id long, text string, length double").repartition(3)
    rows = packing.pack_documents(df, "doc_id", "text", BYTE, 2, 64).collect()
    check_packing(rows, texts, 64)


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    rows = packing.pack_documents(df, "doc_id", "text", BYTE, 2).collect()
    assert len(rows) == 3 and {r["sequence_id"] for r in rows} == {0} and len({r["offset"] for r in rows}) == 3
    assert packing.pack_documents(df.limit(0), "doc_id", "text", BYTE, 2).count() == 0
