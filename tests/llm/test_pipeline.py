"""The pipeline's stages against plain Python over the same rows, and the registry."""

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from staleguard.llm import pii, quality, queries
from staleguard.llm.shared import written
from staleguard.sources.tables import load

from test_neardup import brute_groups

SF = "/root/testdata/sf0.001"


def test_registry():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert {"op1_scaled_fingerprint", "op2_minhash_near_dedup"} <= set(__spark_entry__.oracle_sql())


def test_stages(spark):
    docs = load(spark, SF, "documents")
    stage = dict(corpus_pipeline.STAGES)
    good = written(stage["quality rules"](spark, docs, SF))
    model = quality.fit_quality(docs, load(spark, SF, "labels", "doc_id", "quality"))
    rows = docs.collect()
    keep = quality.judge(pa.array([r["text"] or "" for r in rows], pa.large_string()), model)["kept"]
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r, ok in zip(rows, keep) if ok}

    calm = written(stage["toxicity"](spark, good, SF))
    score = queries.toxicity_model(spark, good, SF)
    rows = good.collect()
    p = score.score(pa.array([r["text"] for r in rows], pa.large_string()))
    assert {r["doc_id"] for r in calm.collect()} == {r["doc_id"] for r, x in zip(rows, p) if x < 0.5}

    single = written(stage["near-duplicates"](spark, calm, SF))
    groups = brute_groups({r["doc_id"]: r["text"] for r in calm.collect()}, 5, 4, 5)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i, (_, _, kept) in groups.items() if kept)

    clean = written(stage["personal data"](spark, single, SF))
    assert clean.columns == good.columns == calm.columns == single.columns == docs.columns
    learned, old = pii.fit_field(single), {r["doc_id"]: r["text"] for r in single.collect()}
    for r in clean.collect():
        (_, spans), = pii.spans_of(pa.array([old[r["doc_id"]]], pa.large_string()), learned)
        assert r["text"] == pii.masked(old[r["doc_id"]], spans) and (not spans or r["n_chars"] == len(r["text"]))

    placed = stage["best-fit packing"](spark, clean, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch(list(texts.values()), add_special_tokens=False)
    assert sum(r["length"] for r in placed) == sum(len(e.ids) + 1 for e in ids) and {r["doc_id"] for r in placed} == set(texts)


def test_empty_input(spark):
    docs = load(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
