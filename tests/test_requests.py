"""Request tables that are answered where they are rendered."""

import hashlib

from pyspark.sql import functions as F

from staleguard.operators import requests as RQ
from staleguard.sources import prompts as PR


def test_answered_requests_hold_the_digest_of_the_prompt_and_not_its_text(spark):
    docs = spark.createDataFrame([(1, "first " * 50), (2, "second " * 50), (3, None)], "doc_id long, content string")
    pairs = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (1, 9)], "id1 long, id2 long")  # a repeated pair, a null text, no document
    whole = RQ.pair_requests(pairs, docs, "comparison/check_for_contradictions", ("m1", "m2"))
    reqs, responses = RQ.answered(whole, F.concat(F.lit("to "), "model"))
    assert "user_prompt" not in reqs.columns and "system_prompt" not in reqs.columns
    want = sorted((r.id1, r.id2, r.model, r.request_id, r.user_prompt and hashlib.sha256(r.user_prompt.encode()).hexdigest()) for r in whole.collect())
    got = sorted((r.id1, r.id2, r.model, r.request_id, r.prompt_sha256 and r.prompt_sha256.hex()) for r in reqs.collect())
    assert got == want and len(got) == 6 and "first first" in whole.where("id2 = 2").first().user_prompt
    assert responses.columns == ["request_id", "response"] and {r.response for r in responses.collect()} == {"to m1", "to m2"}


def test_a_text_travels_once_per_pair_whatever_the_number_of_models(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, content string")
    pairs = spark.createDataFrame([(1, 2)], "id1 long, id2 long")
    plan = RQ.pair_requests(pairs, docs, "comparison/check_for_contradictions", ("m1", "m2"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join")  # the models are told apart above the joins
    assert PR.get("comparison/check_for_contradictions")[1]


def test_pairs_meet_answers_and_texts_once_for_all_models(spark):
    from staleguard.operators import requests as RQ
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(1, 6)], "doc_id long, content string")
    pairs = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (2, 4), (4, 5), (1, 9), (None, 3)], "id1 long, id2 long")
    done = spark.createDataFrame([(2, 1, "m1"), (2, 1, "m1"), (1, 3, "m1"), (3, 1, "m2"), (4, 2, None), (None, 3, "m1")], "id1 long, id2 long, model string")
    out = RQ.pair_requests(pairs, docs, "comparison/check_for_contradictions", ("m1", "m2"), done).select("id1", "id2", "model")
    assert sorted(map(tuple, out.collect())) == [(1, 2, "m2"), (1, 2, "m2"), (2, 4, "m1"), (2, 4, "m2"), (4, 5, "m1"), (4, 5, "m2")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("Join")  # a row per model met both before


def test_digests_of_cells_are_those_of_the_joined_texts(spark, monkeypatch):
    """Every pair moved a text through a join, and all requests were written."""
    import itertools
    from staleguard.operators import resume as RS
    monkeypatch.setattr(RS, "SLICE_BYTES", 100)
    texts = [(i, f"text {i} ü " * (1 + i % 3)) for i in range(30)] + [(4, "another four"), (5, None), (None, "nobody")]
    docs = spark.createDataFrame(texts, "doc_id long, content string").repartition(3)
    pairs = spark.createDataFrame([*itertools.combinations(range(25), 2), (1, 2), (3, 99), (None, 3), (7, 6)], "id1 long, id2 long").repartition(4)
    for template in ("comparison/check_for_contradictions", "comparison/extract_contradictions"):
        whole = RQ.pair_requests(pairs, docs, template, ("m1", "m2"))
        want = sorted((r.id1, r.id2, r.model, r.request_id, r.user_prompt and hashlib.sha256(r.user_prompt.encode()).hexdigest() or "") for r in whole.collect())
        short = RQ.pair_requests(pairs, docs, template, ("m1", "m2"), digest=True)
        got = sorted((r.id1, r.id2, r.model, r.request_id, r.prompt_sha256 and r.prompt_sha256.hex() or "") for r in short.collect())
        assert got == want and any(not g[4] for g in got)
    plan = short._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning(_p" in plan


def test_responses_stay_with_requests_that_come_once(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, content string")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "id1 long, id2 long")
    reqs = RQ.pair_requests(pairs, docs, "comparison/check_for_contradictions", ("m1", "m2"), digest=True)
    answer = F.to_json(F.struct((F.col("id2") == 2).alias("contradictory_info_found")))
    rows = [sorted(map(tuple, RQ.verdict_rows(RQ.decode_responses(*RQ.answered(reqs, answer, once=o), "check")).collect())) for o in (False, True)]
    assert rows[0] == rows[1] and len(rows[1]) == 4 and RQ.answered(reqs, answer, once=True)[1] is None


def test_pair_check_writes_no_table_of_requests(spark, tmp_path):
    import os
    import numpy as np
    from staleguard.plans.p6_jobs import THRESHOLD, pair_check
    from staleguard.session import checkpoint_dir
    x = np.random.default_rng(5).normal(size=(220, 6)).astype(float)
    spark.createDataFrame([(i, [float(v) for v in row], i % 4) for i, row in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, f"text {i} " * 30, "en", f"s{i}") for i in range(300)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    size = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(checkpoint_dir(spark).removeprefix("file:")) for f in files)
    before = size()
    got = {r["model"]: r["count"] for r in pair_check(spark, str(tmp_path)).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    d = (1 - u @ u.T)[np.triu_indices(220, 1)]
    assert got == {"m1": int(((d > 0) & (d <= THRESHOLD)).sum()), "m2": int(((d > 0) & (d <= THRESHOLD)).sum())}
    assert size() - before < 100 * 220 + 10 * got["m1"]  # the dealt vectors; requests took 200 bytes and more each
