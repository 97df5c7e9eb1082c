"""Phase 4: chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from staleguard.operators import chunks as CH
from staleguard.plans import sqlutil as S
from staleguard.plans.registry import query
from staleguard.sources import testdata as TD

CHUNKS_SQL = """
, chunks AS (SELECT doc_id, pos, substring(content, pos * 384 + 1, 512) AS text FROM (
    SELECT doc_id, content, unnest(range(0, n)) AS pos FROM (
      SELECT doc_id, content, CASE WHEN length(content) <= 512 THEN 1
             ELSE CAST(ceil((length(content) - 512) / 384.0) AS BIGINT) + 1 END AS n FROM docs)))
, ch AS (SELECT *, row_number() OVER (ORDER BY doc_id, pos) - 1 AS chunk_id FROM chunks)"""

FLAGS_SQL = f"""
, oc AS (SELECT c.id1, c.id2,
           CASE WHEN a.creation_date < b.creation_date THEN c.id1 ELSE c.id2 END AS old_id,
           CASE WHEN a.creation_date < b.creation_date THEN c.id2 ELSE c.id1 END AS new_id,
           CASE WHEN a.creation_date < b.creation_date THEN c.conflicting_passage_doc1
                ELSE c.conflicting_passage_doc2 END AS p_old,
           CASE WHEN a.creation_date < b.creation_date THEN c.conflicting_passage_doc2
                ELSE c.conflicting_passage_doc1 END AS p_new
         FROM conflicts c JOIN docs a ON a.doc_id = c.id1 JOIN docs b ON b.doc_id = c.id2
         WHERE c.conflicting_passage_doc1 IS NOT NULL AND c.conflicting_passage_doc2 IS NOT NULL)
, sides AS (SELECT DISTINCT id1, id2, p_old, p_new, old_id AS doc_id FROM oc
            UNION SELECT DISTINCT id1, id2, p_old, p_new, new_id AS doc_id FROM oc)
, m AS (SELECT s.id1, s.id2, ch.chunk_id,
               contains({S.normalize('ch.text')}, {S.normalize('s.p_old')}) AS old,
               NOT contains({S.normalize('ch.text')}, {S.normalize('s.p_old')})
                 AND contains({S.normalize('ch.text')}, {S.normalize('s.p_new')}) AS new
        FROM sides s JOIN ch ON ch.doc_id = s.doc_id)
, pc AS (SELECT id1, id2, coalesce(list_sort(list_distinct(list(chunk_id) FILTER (WHERE new))), []) AS new_ids
         FROM m GROUP BY id1, id2)
, olds AS (SELECT DISTINCT id1, id2, chunk_id FROM m WHERE old)
, flags AS (SELECT o.chunk_id, arg_max(pc.new_ids, struct_pack(a := o.id1, b := o.id2)) AS outdated_by
            FROM olds o JOIN pc USING (id1, id2) GROUP BY o.chunk_id)"""


def chunk_table(spark, d):
    docs = TD.documents(spark, d)
    return CH.numbered_chunks(docs)


def conflict_table(spark, d):
    docs = TD.documents(spark, d)
    return TD.conflicts(docs).withColumn("ord", F.struct("id1", "id2"))


def flagged_chunks(spark, d):
    docs = TD.documents(spark, d)
    ch = chunk_table(spark, d)
    flags = CH.flag_outdated(ch, conflict_table(spark, d), docs)
    return CH.apply_flags(ch, flags)


@query("fixed_chunks", TD.ctes("docs") + CHUNKS_SQL + """
SELECT doc_id, pos, md5(text) AS text_md5, length(text) AS n_chars FROM chunks""")
def fixed_chunks(spark, d):
    c = CH.fixed_chunks(TD.documents(spark, d))
    return c.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.md5("text").alias("text_md5"),
                    F.length("text").alias("n_chars"))


@query("chunk_ids", TD.ctes("docs") + CHUNKS_SQL + """
SELECT chunk_id, doc_id, pos FROM ch""")
def chunk_ids(spark, d):
    return chunk_table(spark, d).select("chunk_id", "doc_id", F.col("pos").cast("bigint").alias("pos"))


@query("flag_outdated", TD.ctes("docs", "docs_lin", "conflicts") + CHUNKS_SQL + FLAGS_SQL + """
SELECT chunk_id, len(outdated_by) AS n_outdated_by, array_to_string(outdated_by, ',') AS outdated_by FROM flags""")
def flag_outdated(spark, d):
    docs = TD.documents(spark, d)
    f = CH.flag_outdated(chunk_table(spark, d), conflict_table(spark, d), docs)
    return f.select("chunk_id", F.size("outdated_by").cast("bigint").alias("n_outdated_by"),
                    F.array_join("outdated_by", ",").alias("outdated_by"))


@query("current_vs_outdated", TD.ctes("docs", "docs_lin", "conflicts") + CHUNKS_SQL + FLAGS_SQL + """
SELECT CASE WHEN len(coalesce(f.outdated_by, [])) > 0 THEN 'outdated' ELSE 'current' END AS status, count(*) AS n
FROM ch LEFT JOIN flags f USING (chunk_id) GROUP BY 1""")
def current_vs_outdated(spark, d):
    cur, old = CH.split_current_outdated(flagged_chunks(spark, d))
    return cur.select(F.lit("current").alias("status")).unionByName(old.select(F.lit("outdated").alias("status"))) \
        .groupBy("status").agg(F.count("*").alias("n"))


@query("recursive_chunks")
def recursive_chunks(spark, d):
    """Recursive splitter (no SQL twin): (doc_id, pos, n_chars, text_md5)."""
    c = CH.recursive_chunks(TD.documents(spark, d))
    return c.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.length("text").alias("n_chars"),
                    F.md5("text").alias("text_md5"))
