"""Phase 7: sources and sinks round trips (A1-A9, A12, A13), checked on the re-read rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from staleguard.plans.p4_chunks import CHUNKS_SQL, chunk_table
from staleguard.plans.registry import query
from staleguard.sources import files as FS
from staleguard.sources import testdata as TD
from staleguard.sources.store import Store


@query("csv_roundtrip", TD.ctes("queries") + """
SELECT query_id, md5(content) AS content_md5, len("references") AS n_references, query_type FROM queries""")
def csv_roundtrip(spark, d):
    """Queries -> CSV (multi-line text, list columns as list text) -> typed CSV scan -> decoded lists."""
    q = TD.queries(spark, d)
    path = FS.scratch_path(spark, "queries-csv")
    FS.write_csv_table(q, path, ["references"])
    back = FS.read_csv_table(spark, path, "query_id BIGINT, content STRING, query_type STRING, `references` STRING")
    back = FS.decode_lists(back, {"references": "string"})
    return back.select("query_id", F.md5("content").alias("content_md5"),
                       F.size("references").cast("bigint").alias("n_references"), "query_type")


@query("json_scan", TD.ctes("docs") + """
SELECT doc_id, md5(content) AS content_md5 FROM docs WHERE domain = 'en'""")
def json_scan(spark, d):
    """Documents -> JSON lines with a ``language`` key -> dynamic-schema scan filtered to English."""
    docs = TD.documents(spark, d).select("doc_id", "content", F.col("domain").alias("language"))
    path = FS.scratch_path(spark, "docs-json")
    docs.write.mode("overwrite").json(path)
    back = FS.read_jsonl(spark, path, "en")
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("content").alias("content_md5"))


@query("append_resume", TD.ctes("docs") + CHUNKS_SQL + """
SELECT doc_id, count(*) AS n_chunks FROM ch GROUP BY doc_id""")
def append_resume(spark, d):
    """Create-only write of the chunk table, then two resumable appends that add nothing new."""
    ch = FS.chunk_table_for_store(chunk_table(spark, d))
    store = Store(spark, FS.scratch_path(spark, "chunks"), ("chunk_id",))
    store.create(ch)
    store.append(ch)
    store.append(ch)
    return store.read().groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
