"""Sources and sinks: prompt scan (A4), list-literal decode (A3), CSV round trip (A2/A5), quota check."""

import json
import os
import tempfile

import pytest

from pyspark.sql import functions as F

from staleguard.functions import json as J
from staleguard.operators import sampling as SM
from staleguard.sources import files as FS
from staleguard.sources import prompts as PR


def test_prompt_scan_and_lookup(spark):
    base = tempfile.mkdtemp(prefix="sg-prompts-")
    for name, (system, user) in PR.DEFAULTS.items():
        folder, file = name.split("/")
        os.makedirs(os.path.join(base, folder), exist_ok=True)
        with open(os.path.join(base, folder, file + ".json"), "w") as f:
            json.dump({"prompt_name": name, "system_prompt": system, "user_prompt": user}, f, indent=2)
    p = PR.scan(spark, os.path.join(base, "*", "*.json"))
    assert p.count() == len(PR.DEFAULTS) and p.where(F.col("user_prompt").isNull()).count() == 0
    req = spark.createDataFrame([(1, "qa/qa_with_dq")], "id long, prompt_name string")
    got = PR.lookup(req, p).collect()[0]
    assert got.user_prompt == PR.DEFAULTS["qa/qa_with_dq"][1]
    assert PR.get("manipulations/keypoints") == PR.DEFAULTS["keypoints/keypoints_generation"]


def test_list_literals_mixed_quotes(spark):
    df = spark.createDataFrame([("['a', \"it's\", 'b\\'c']", "[1, 2]")], "s string, n string")
    r = df.select(J.decode_list_literal("s").alias("l"), J.decode_list_literal("n", "bigint").alias("m")).collect()[0]
    assert r.l == ["a", "it's", "b'c"] and r.m == [1, 2]


def test_csv_round_trip_multiline(spark):
    df = spark.createDataFrame([(1, 'line one\nline "two"', ["x", "y"])], "id long, content string, refs array<string>")
    path = os.path.join(tempfile.mkdtemp(prefix="sg-csv-"), "t")
    FS.write_csv_table(df, path, ["refs"])
    back = FS.decode_lists(FS.read_csv_table(spark, path, "id BIGINT, content STRING, refs STRING"), {"refs": "string"})
    r = back.collect()[0]
    assert r.content == 'line one\nline "two"' and r.refs == ["x", "y"]


def test_quota_check(spark):
    flags = spark.createDataFrame([(1, True, False), (2, True, True)], "doc_id long, a boolean, b boolean")
    assert SM.enough_selected(flags, {"a": 2, "b": 1})
    assert not SM.enough_selected(flags, {"a": 3, "b": 1})


def test_append_new_raises_on_a_missing_key(spark, tmp_path):
    from staleguard.sources import files as FS
    path = str(tmp_path / "store")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    assert FS.append_new(first, path, ["id"]).count() == 2
    FS.append_new(spark.createDataFrame([(2, "b"), (3, "c")], "id long, x string"), path, ["id"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    other = spark.createDataFrame([(1, "m")], "id long, model string")
    with pytest.raises(Exception, match="model"):
        FS.append_new(other, path, ["id", "model"])
    assert spark.read.parquet(path).count() == 3


def test_short_quota_raises(spark):
    rows = spark.createDataFrame([(i, "fr" if i else "de") for i in range(9)], "id long, domain string")
    with pytest.raises(RuntimeError, match="de"):
        SM.stratified_sample(rows, "id", "domain", 6, 1, ["fr", "de"])
    assert SM.stratified_sample(rows, "id", "domain", 6, 1, ["fr", "de"], strict=False).count() == 4
