"""Phase 5: retrieval, closure and RAG scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from staleguard.config import CONTEXT_DELIMITER
from staleguard.functions import arrays as A
from staleguard.functions import text as T
from staleguard.operators import nearest as NN
from staleguard.operators import pairs as P
from staleguard.operators import requests as RQ
from staleguard.operators import retrieve as RT
from staleguard.plans import sqlutil as S
from staleguard.operators import textml as TM
from staleguard.plans.p4_chunks import CHUNKS_SQL, FLAGS_SQL, chunk_table, flagged_chunks
from staleguard.plans.registry import query, r6
from staleguard.sources import prompts as PR
from staleguard.sources import testdata as TD
from staleguard.session import materialize

K = 5
MODES = (("with_dq", True), ("without_dq", False))


def _chunks(spark, d):
    docs = TD.documents(spark, d).select("doc_id", "creation_date")
    return flagged_chunks(spark, d).join(docs, "doc_id")


def contexts(spark, d, with_dq: bool):
    return RT.retrieve_context(TD.queries(spark, d), _chunks(spark, d), K, with_dq)


def contexts_both(spark, d) -> dict:
    """Both modes from one checkpointed chunk table and one top-k."""
    ch = _chunks(spark, d).transform(materialize)
    top = RT.lexical_topk(TD.queries(spark, d), ch, K).transform(materialize)
    return {name: RT.contexts_from_top(top, ch, dq) for name, dq in MODES}


def _both(spark, d, fn):
    out = None
    for name, ctx in contexts_both(spark, d).items():
        part = fn(ctx).withColumn("mode", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


_BASE = CHUNKS_SQL + FLAGS_SQL + f"""
, chd AS (SELECT ch.chunk_id, ch.doc_id, ch.text, coalesce(f.outdated_by, []) AS outdated_by, d.creation_date
          FROM ch LEFT JOIN flags f USING (chunk_id) JOIN docs d ON d.doc_id = ch.doc_id)
, qt AS (SELECT query_id, list_distinct(regexp_extract_all(lower(content), '([\\p{{L}}\\p{{N}}_]+)', 1)) AS t FROM queries)
, ctk AS (SELECT chunk_id, list_distinct(regexp_extract_all(lower(text), '([\\p{{L}}\\p{{N}}_]+)', 1)) AS t FROM chd)
, sc AS (SELECT qt.query_id, ctk.chunk_id, len(list_intersect(qt.t, ctk.t)) AS s, len(qt.t) AS nq, len(ctk.t) AS nc
         FROM qt, ctk)
, scored AS (SELECT query_id, chunk_id, CASE WHEN s = 0 THEN 0.0 ELSE s / (nq + nc - s) END AS score FROM sc)
, top AS (SELECT query_id, chunk_id, rank FROM (
           SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored)
          WHERE rank <= {K})
, edges AS (SELECT chunk_id, nid FROM (SELECT chunk_id, unnest(outdated_by) AS nid FROM chd)
            WHERE nid IN (SELECT chunk_id FROM chd))
, walk(query_id, chunk_id, depth) AS (
    SELECT query_id, chunk_id, 0 FROM top
    UNION SELECT w.query_id, e.nid, w.depth + 1 FROM walk w JOIN edges e ON e.chunk_id = w.chunk_id
    WHERE w.depth < 64)
, cl AS (SELECT query_id, chunk_id, min(depth) AS round FROM walk GROUP BY query_id, chunk_id)
, ctx_with AS (SELECT 'with_dq' AS mode, c.query_id, c.chunk_id, x.text,
                 row_number() OVER (PARTITION BY c.query_id ORDER BY x.creation_date DESC, c.round,
                   CASE WHEN c.round = 0 THEN t.rank ELSE c.chunk_id END) AS position
               FROM cl c JOIN chd x USING (chunk_id) LEFT JOIN top t USING (query_id, chunk_id))
, ctx_without AS (SELECT 'without_dq' AS mode, t.query_id, t.chunk_id, x.text, t.rank AS position
                  FROM top t JOIN chd x USING (chunk_id))
, ctx AS (SELECT * FROM ctx_with UNION ALL SELECT * FROM ctx_without)
, modes AS (SELECT 'with_dq' AS mode UNION ALL SELECT 'without_dq')"""


def _sql(body: str, base: str = _BASE) -> str:
    head = TD.ctes("docs", "docs_lin", "conflicts", "queries")
    return head.replace("WITH ", "WITH RECURSIVE ", 1) + base + body


@query("newer_closure", _sql("""
SELECT query_id, chunk_id, round FROM cl"""))
def newer_closure(spark, d):
    ch = _chunks(spark, d).transform(materialize)
    top = RT.lexical_topk(TD.queries(spark, d), ch, K).transform(materialize)
    return RT.newer_closure(top.select("query_id", "chunk_id"), ch.select("chunk_id", "outdated_by")) \
        .select("query_id", "chunk_id", F.col("round").cast("bigint").alias("round"))


@query("retrieve_context", _sql(f"""
SELECT mode, query_id, count(*) AS n_chunks,
       md5(string_agg(text, {S.lit(CONTEXT_DELIMITER)} ORDER BY position)) AS context_md5
FROM ctx GROUP BY mode, query_id"""))
def retrieve_context(spark, d):
    return _both(spark, d, lambda ctx: RT.context_strings(ctx).select(
        "query_id", F.col("n_chunks").cast("bigint").alias("n_chunks"), F.md5("context").alias("context_md5")))


_REFS_SQL = f"""
, qr AS (SELECT m.mode, q.query_id, q."references" AS refs FROM queries q, modes m)
, cs AS (SELECT mode, query_id, lower(string_agg(text, chr(10) ORDER BY position)) AS c FROM ctx GROUP BY mode, query_id)
, rc AS (SELECT qr.mode, qr.query_id,
                list_bool_and(list_transform(qr.refs, lambda r: contains(coalesce(cs.c, ''), {S.strip('lower(r)')})))
                  AS hit
         FROM qr LEFT JOIN cs USING (mode, query_id))
, pq AS (SELECT x.mode, x.query_id,
                avg(CASE WHEN list_bool_or(list_transform(qr.refs, lambda r: contains(lower(x.text),
                      {S.strip('lower(r)')}))) THEN 1.0 ELSE 0.0 END) AS precision
         FROM ctx x JOIN qr USING (mode, query_id) GROUP BY x.mode, x.query_id)"""


@query("context_recall", _sql(_REFS_SQL + """
SELECT mode, round(avg(CAST(hit AS DOUBLE)), 6) AS recall, count(*) AS n_queries FROM rc GROUP BY mode"""))
def context_recall(spark, d):
    refs = TD.queries(spark, d).select("query_id", "references")
    r = _both(spark, d, lambda ctx: RT.context_recall(ctx, refs))
    return r.groupBy("mode").agg(r6(F.avg(F.col("hit").cast("double"))).alias("recall"),
                                 F.count("*").alias("n_queries"))


@query("context_precision", _sql(_REFS_SQL + """
SELECT mode, round(avg(precision), 6) AS precision FROM pq GROUP BY mode"""))
def context_precision(spark, d):
    refs = TD.queries(spark, d).select("query_id", "references")
    p = _both(spark, d, lambda ctx: RT.context_precision(ctx, refs))
    return p.groupBy("mode").agg(r6(F.avg("precision")).alias("precision"))


_QA_DQ = PR.get("qa/qa_with_dq")
_QA_NO = PR.get("qa/qa_without_dq")


@query("qa_requests", _sql(f"""
, cs2 AS (SELECT mode, query_id, string_agg(text, {S.lit(CONTEXT_DELIMITER)} ORDER BY position) AS context
          FROM ctx GROUP BY mode, query_id)
SELECT cs2.mode, cs2.query_id,
       CASE WHEN cs2.mode = 'with_dq' THEN 'qa/qa_with_dq' ELSE 'qa/qa_without_dq' END AS prompt_name,
       md5(CASE WHEN cs2.mode = 'with_dq' THEN {S.render(_QA_DQ[1], context='cs2.context', question='q.content')}
                ELSE {S.render(_QA_NO[1], context='cs2.context', question='q.content')} END) AS user_prompt_md5
FROM cs2 JOIN queries q USING (query_id)"""))
def qa_requests(spark, d):
    q = TD.queries(spark, d).select("query_id", "content")
    out = None
    both = contexts_both(spark, d)
    for name, dq in MODES:
        tmpl = _QA_DQ if dq else _QA_NO
        cs = RT.context_strings(both[name]).join(q, "query_id")
        part = cs.select(F.lit(name).alias("mode"), "query_id",
                         F.lit("qa/qa_with_dq" if dq else "qa/qa_without_dq").alias("prompt_name"),
                         F.md5(T.render(tmpl[1], context="context", question="content")).alias("user_prompt_md5"))
        out = part if out is None else out.unionByName(part)
    return out


_SCORE_SQL = f"""
, resp AS (SELECT m.mode, q.query_id, len(string_split(q.content, '. ')) AS n,
                  CASE WHEN m.mode = 'with_dq' THEN 1 ELSE 2 END AS tag FROM queries q, modes m)
, cov AS (SELECT mode, {S.coverage("query_id * 10 + tag", "n")} AS c,
                 {S.coverage("query_id * 10 + tag + 5", "n")} AS h FROM resp)"""


@query("scorecard", TD.ctes("queries") + """
, modes AS (SELECT 'with_dq' AS mode UNION ALL SELECT 'without_dq')""" + _SCORE_SQL + f"""
SELECT mode, round(avg({S.bool_mean('c')}), 6) AS completeness, round(avg({S.bool_mean('h')}), 6) AS hallucination,
       round(1 - avg({S.bool_mean('c')}) - avg({S.bool_mean('h')}), 6) AS irrelevancy
FROM cov GROUP BY mode""")
def scorecard(spark, d):
    """Per (query, mode) and metric a rendered request, a response, its decoded flags, and their means.

    The responses (keypoint coverage and contradiction flags) are derived from the ids, so both engines agree.
    """
    q = TD.queries(spark, d)
    asked = q.select("query_id", "content", F.split("content", r"\. ").alias("keypoints"),
                     F.explode(F.array(F.lit("with_dq"), F.lit("without_dq"))).alias("mode"))
    means = None
    for metric, field, shift in (("completeness", "keypoint_coverage", 0), ("hallucination", "keypoint_contradiction", 5)):
        system, user = PR.get(f"metrics/{metric}")
        reqs = asked.select("query_id", "mode", F.size("keypoints").alias("n"), F.lit(system).alias("system_prompt"),
                            T.render(user, question="content", keypoints=T.bullets("keypoints"), generated_answer="content").alias("user_prompt"),
                            RQ.request_id("query_id", "mode", F.lit(metric)).alias("request_id"))
        tag = F.when(F.col("mode") == "with_dq", F.lit(1)).otherwise(F.lit(2)) + F.lit(shift)
        resp = reqs.select("request_id", F.to_json(F.struct(A.coverage(F.col("query_id") * 10 + tag, F.col("n")).alias(field))).alias("response"))
        part = RQ.decode_responses(reqs, resp, metric).where(F.col("user_prompt").isNotNull()) \
            .select("mode", F.lit(metric).alias("metric"), A.bool_mean(F.col("decoded")[field]).alias("mean"))
        means = part if means is None else means.unionByName(part)
    of = lambda m: F.avg(F.when(F.col("metric") == m, F.col("mean"))).alias(m)
    g = means.groupBy("mode").agg(of("completeness"), of("hallucination"))
    return g.select("mode", r6("completeness").alias("completeness"), r6("hallucination").alias("hallucination"),
                    r6(F.lit(1.0) - F.col("completeness") - F.col("hallucination")).alias("irrelevancy"))


_DIMS = 64
_WORDS = "regexp_extract_all(lower({}), '([\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_]+)', 1)"


_NEAREST_SQL = f"""
, cb AS (SELECT chunk_id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % {_DIMS} AS b, count(*) AS n
         FROM (SELECT chunk_id, unnest({_WORDS.format('text')}) AS t FROM ch) GROUP BY 1, 2)
, qb AS (SELECT query_id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % {_DIMS} AS b, count(*) AS n
         FROM (SELECT query_id, unnest({_WORDS.format('content')}) AS t FROM queries) GROUP BY 1, 2)
, cn AS (SELECT chunk_id, sqrt(sum(n * n)) AS nrm FROM cb GROUP BY chunk_id)
, qn AS (SELECT query_id, sqrt(sum(n * n)) AS nrm FROM qb GROUP BY query_id)
, dots AS (SELECT query_id, chunk_id, sum(qb.n * cb.n) AS dot FROM qb JOIN cb USING (b) GROUP BY query_id, chunk_id)
, dist AS (SELECT q.query_id, c.chunk_id, round(least(greatest(1.0 - coalesce(dot / (qn.nrm * cn.nrm), 0.0), 0.0), 2.0), 9) AS dist
           FROM queries q CROSS JOIN ch c LEFT JOIN dots d ON d.query_id = q.query_id AND d.chunk_id = c.chunk_id
           LEFT JOIN qn ON qn.query_id = q.query_id LEFT JOIN cn ON cn.chunk_id = c.chunk_id)
, near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, chunk_id) AS rank FROM dist) WHERE rank <= {K})"""


def nearest_chunks(spark, d, chunks):
    """(query_id, id, dist, rank): the ``K`` nearest chunks of every query by the cosine distance of their text vectors."""
    vectors = materialize(TM.md5_text_vectors(chunks, "chunk_id", "text", _DIMS))
    balls = P.deal_out(vectors, "chunk_id", "vec", balls=min(P.MAX_BALLS, -(-vectors.count() // NN.CORPUS_BALL) or 1))
    return NN.nearest(balls, TM.md5_text_vectors(TD.queries(spark, d), "query_id", "content", _DIMS), K)


@query("topk_chunks_vector", TD.ctes("docs", "queries") + CHUNKS_SQL + _NEAREST_SQL + """
SELECT query_id, chunk_id, rank, round(dist, 6) AS dist FROM near""")
def topk_chunks_vector(spark, d):
    """K3 / F1: the nearest chunks of every query by the cosine distance of their text vectors."""
    got = nearest_chunks(spark, d, chunk_table(spark, d))
    return got.select("query_id", F.col("id").alias("chunk_id"), F.col("rank").cast("bigint").alias("rank"), r6("dist").alias("dist"))


# the same context job with the top-k of the vectors in place of the lexical one
_VECTOR_BASE = CHUNKS_SQL + _NEAREST_SQL + FLAGS_SQL + _BASE[len(CHUNKS_SQL + FLAGS_SQL):_BASE.index(", qt AS")] \
    + "\n, top AS (SELECT query_id, chunk_id, rank FROM near)\n" + _BASE[_BASE.index(", edges AS"):]


@query("retrieve_context_vector", _sql(f"""
SELECT mode, query_id, count(*) AS n_chunks,
       md5(string_agg(text, {S.lit(CONTEXT_DELIMITER)} ORDER BY position)) AS context_md5
FROM ctx GROUP BY mode, query_id""", _VECTOR_BASE))
def retrieve_context_vector(spark, d):
    """K3: chunks retrieved by vector, with the quality step (closure to newer chunks, newest first) and without."""
    ch = _chunks(spark, d).transform(materialize)
    top = materialize(nearest_chunks(spark, d, ch).select("query_id", "rank", F.col("id").alias("chunk_id"), F.lit(0.0).alias("score")))
    out = None
    for name, dq in MODES:
        part = RT.context_strings(RT.contexts_from_top(top, ch, dq)).select(
            F.lit(name).alias("mode"), "query_id", F.col("n_chunks").cast("bigint").alias("n_chunks"), F.md5("context").alias("context_md5"))
        out = part if out is None else out.unionByName(part)
    return out
