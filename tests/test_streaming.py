"""Incremental stream: replays and duplicates never append a key twice."""

import os
import tempfile

from staleguard.streaming.incremental import run_incremental


def test_incremental_resume(spark):
    base = tempfile.mkdtemp(prefix="sg-stream-")
    src, sink = os.path.join(base, "src"), os.path.join(base, "sink")
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string").write.parquet(os.path.join(src, "p1"))
    run_incremental(spark, os.path.join(src, "*"), "id long, v string", sink, ["id"], name=f"t{os.getpid()}")
    spark.createDataFrame([(2, "b"), (3, "c")], "id long, v string").write.parquet(os.path.join(src, "p2"))
    run_incremental(spark, os.path.join(src, "*"), "id long, v string", sink, ["id"], name=f"t{os.getpid()}")
    got = sorted(r.id for r in spark.read.parquet(sink).collect())
    assert got == [1, 2, 3]
