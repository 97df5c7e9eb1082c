"""Phase 3: windows, top-k and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from staleguard.functions import vectors as V
from staleguard.operators import sampling as SM
from staleguard.operators import windows as W
from staleguard.plans.p1_sets import HITS_SQL, doc_query_hits
from staleguard.plans.registry import query, r6
from staleguard.sources import testdata as TD

SEED = 42
CUM_THRESHOLD = 0.5
LANG_DOMAINS = ["en", "de", "fr"]  # stand-ins for the three sampling domains, in order


def memberships(spark, d):
    """Per vector a probability vector: |x_i| / sum |x| (rows sum to one)."""
    v = TD.with_vector_lineage(TD.vectors(spark, d))
    return v.withColumn("membership", V.l1_normalize(F.transform("embedding", lambda x: F.abs(x))))


_MEMB_SQL = """
, memb AS (SELECT doc_id, original_doc_ids,
                  list_transform(embedding, lambda x: abs(x) / list_sum(list_transform(embedding, lambda y: abs(y))))
                    AS membership FROM vecs_lin)
, ex AS (SELECT doc_id, original_doc_ids, k - 1 AS k, membership[k] AS p
         FROM (SELECT doc_id, original_doc_ids, membership, generate_subscripts(membership, 1) AS k FROM memb))"""


@query("cumulative_select", TD.ctes("vecs", "vecs_lin") + _MEMB_SQL + f"""
, w AS (SELECT doc_id, k, p, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, k DESC) AS rn,
               coalesce(sum(p) OVER (PARTITION BY doc_id ORDER BY p DESC, k DESC
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM ex)
SELECT doc_id, count(*) AS n_selected, string_agg(CAST(k AS VARCHAR), ',' ORDER BY rn) AS selected
FROM w WHERE rn = 1 OR prev < {CUM_THRESHOLD} GROUP BY doc_id""")
def cumulative_select(spark, d):
    m = memberships(spark, d)
    s = W.cumulative_select(m, "doc_id", "membership", CUM_THRESHOLD)
    return s.select("doc_id", F.size("selected").cast("bigint").alias("n_selected"),
                    F.array_join("selected", ",").alias("selected"))


@query("argmax_top10", TD.ctes("vecs", "vecs_lin") + _MEMB_SQL + """
, w AS (SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC,
               CASE WHEN len(original_doc_ids) > 1 THEN -k ELSE k END) AS rn,
               len(original_doc_ids) > 1 AS multi FROM ex)
SELECT doc_id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY rn) AS topics FROM w
WHERE rn <= CASE WHEN multi THEN 10 ELSE 1 END GROUP BY doc_id""")
def argmax_top10(spark, d):
    m = memberships(spark, d)
    t = W.top_topics(m, "doc_id", "membership", "original_doc_ids")
    return t.select("doc_id", F.array_join("topics", ",").alias("topics"))


@query("topk_chunks", TD.ctes("vecs") + """
, ex AS (SELECT label, pos, avg(x) AS x FROM (
           SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM vecs)
         GROUP BY label, pos)
, cen AS (SELECT label AS query_id, list(x ORDER BY pos) AS c FROM ex GROUP BY label)
, nv AS (SELECT vec_id, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: x * x))) AS n FROM vecs)
, sc AS (SELECT q.query_id, v.vec_id,
                least(greatest(1.0 - list_dot_product(v.e, q.c)
                  / (v.n * sqrt(list_sum(list_transform(q.c, lambda x: x * x)))), 0.0), 2.0) AS dist
         FROM cen q, nv v)
SELECT query_id, rank, vec_id, round(dist, 6) AS dist FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM sc) WHERE rank <= 5""")
def topk_chunks(spark, d):
    """Top-5 nearest vectors to each label centroid (the query set is derived from the table)."""
    v = TD.vectors(spark, d)
    cen = (v.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos")
           .agg(F.avg("x").alias("x")).groupBy("label")
           .agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c"))
           .select("label", F.transform("c", lambda s: s["x"]).alias("c")))
    t = W.topk_nearest(v, "vec_id", "embedding", cen, 5, qid_col="label", qvec_col="c")
    return t.select("query_id", F.col("rank").cast("bigint").alias("rank"), F.col("id").alias("vec_id"),
                    r6("dist").alias("dist"))


_STRAT_SQL = f"""
, cand AS (SELECT doc_id, domain FROM docs WHERE kind = 'original' AND domain IN ('en', 'de', 'fr'))
, rk AS (SELECT doc_id, domain, row_number() OVER (PARTITION BY domain ORDER BY md5('{SEED}-' || CAST(doc_id AS VARCHAR)),
                doc_id) AS rank FROM cand)"""


def _quota_sql(n: int) -> str:
    q = SM.round_robin_quota(n, LANG_DOMAINS)
    return "CASE domain " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in q.items()) + " END"


@query("stratified_sample", TD.ctes("docs") + _STRAT_SQL + f"""
SELECT doc_id, domain, rank FROM rk WHERE rank <= {_quota_sql(30)}""")
def stratified_sample(spark, d):
    docs = TD.documents(spark, d).where(F.col("kind") == "original")
    s = SM.stratified_sample(docs, "doc_id", "domain", 30, SEED, LANG_DOMAINS, strict=False)
    return s.select("doc_id", "domain", F.col("rank").cast("bigint").alias("rank"))


@query("two_queries_per_doc", TD.ctes("queries") + HITS_SQL + f"""
, f AS (SELECT h.doc_id, h.query_id FROM hits h JOIN queries q USING (query_id) WHERE q.query_type = 'Factual Question')
, r AS (SELECT doc_id, query_id, row_number() OVER (PARTITION BY doc_id
          ORDER BY md5('{SEED}-' || CAST(query_id AS VARCHAR)), query_id) AS rank FROM f)
SELECT doc_id, max(CASE WHEN rank = 1 THEN query_id END) AS query_id_textual_manipulation,
       max(CASE WHEN rank = 2 THEN query_id END) AS query_id_tabular_manipulation,
       count(*) < 2 AS short FROM r WHERE rank <= 2 GROUP BY doc_id""")
def two_queries_per_doc(spark, d):
    q = TD.queries(spark, d).where(F.col("query_type") == "Factual Question").select("query_id")
    f = doc_query_hits(spark, d).join(q, "query_id", "left_semi")
    r = SM.k_per_group(f, "doc_id", "query_id", 2, SEED)
    out = r.groupBy("doc_id").agg(F.max(F.when(F.col("rank") == 1, F.col("query_id"))).alias("query_id_textual_manipulation"),
                                  F.max(F.when(F.col("rank") == 2, F.col("query_id"))).alias("query_id_tabular_manipulation"),
                                  (F.count("*") < 2).alias("short"))
    return out.orderBy(F.col("doc_id").cast("string"))


@query("seeded_sample", TD.ctes("docs") + f"""
SELECT doc_id FROM docs WHERE kind <> 'tabular'
ORDER BY md5('{SEED}-' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 10""")
def seeded_sample(spark, d):
    docs = TD.documents(spark, d).where(F.col("kind") != "tabular").select("doc_id")
    return SM.seeded_sample(docs, "doc_id", 10, SEED)


@query("select_for_alteration", TD.ctes("docs") + _STRAT_SQL + f"""
, st AS (SELECT doc_id FROM rk WHERE rank <= {_quota_sql(30)})
, tb AS (SELECT doc_id FROM st ORDER BY md5('{SEED + 1}-' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 15)
, rest AS (SELECT doc_id, domain FROM cand WHERE doc_id NOT IN (SELECT doc_id FROM st))
, rk2 AS (SELECT doc_id, domain, row_number() OVER (PARTITION BY domain
            ORDER BY md5('{SEED + 2}-' || CAST(doc_id AS VARCHAR)), doc_id) AS rank FROM rest)
, mt AS (SELECT doc_id FROM rk2 WHERE rank <= {_quota_sql(12)})
SELECT doc_id, doc_id IN (SELECT doc_id FROM st) AS single_textual_manipulation,
       doc_id IN (SELECT doc_id FROM tb) AS single_tabular_manipulation,
       doc_id IN (SELECT doc_id FROM mt) AS multi_textual_manipulation
FROM (SELECT doc_id FROM st UNION SELECT doc_id FROM mt)""")
def select_for_alteration(spark, d):
    """K8: 30 single-textual ids (stratified), 15 tabular ids drawn from them, 12 multi-textual ids
    (stratified, disjoint from the textual ones) -> one flag row per selected id."""
    docs = TD.documents(spark, d).where(F.col("kind") == "original")
    st = SM.stratified_sample(docs, "doc_id", "domain", 30, SEED, LANG_DOMAINS, strict=False).select("doc_id")
    tb = SM.seeded_sample(st, "doc_id", 15, SEED + 1)
    mt = SM.stratified_sample(docs, "doc_id", "domain", 12, SEED + 2, LANG_DOMAINS, exclude=st, strict=False).select("doc_id")
    ids = st.unionByName(mt).distinct()
    out = ids.join(st.withColumn("single_textual_manipulation", F.lit(True)), "doc_id", "left") \
        .join(tb.withColumn("single_tabular_manipulation", F.lit(True)), "doc_id", "left") \
        .join(mt.withColumn("multi_textual_manipulation", F.lit(True)), "doc_id", "left")
    return out.select("doc_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in
                                  ["single_textual_manipulation", "single_tabular_manipulation",
                                   "multi_textual_manipulation"]])
