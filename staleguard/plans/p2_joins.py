"""Phase 2: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from staleguard.functions import vectors as V
from staleguard.operators import evaluate as EV
from staleguard.operators import lineage as LN
from staleguard.operators import pairs as P
from staleguard.operators import resume as RS
from staleguard.plans.p0_pairs import _PAIRS_SQL, THRESHOLD
from staleguard.plans.p1_sets import MAPPING_SQL, doc_query_mapping
from staleguard.session import SLIM_TABLE, stored
from staleguard.plans.registry import query, r6
from staleguard.sources import testdata as TD
from staleguard.sources.tables import load


@query("left_join_vectors", TD.ctes("docs", "vecs") + """
SELECT d.doc_id, v.vec_id IS NOT NULL AS has_vector,
       round(sqrt(list_sum(list_transform(v.embedding, lambda x: x * x))), 6) AS norm
FROM docs d LEFT JOIN vecs v ON v.vec_id = d.doc_id""")
def left_join_vectors(spark, d):
    docs = TD.documents(spark, d).select("doc_id")
    v = TD.vectors(spark, d).select(F.col("vec_id").alias("doc_id"), "embedding")
    j = docs.join(v, "doc_id", "left")
    return j.select("doc_id", F.col("embedding").isNotNull().alias("has_vector"),
                    r6(V.l2_norm("embedding")).alias("norm"))


def _vec_pairs(spark, d):
    return P.related_pairs(TD.vectors(spark, d), "vec_id", "embedding", THRESHOLD)


_TRUTH_SQL = """
, both_o AS (SELECT id1, id2 FROM p UNION ALL SELECT id2 AS id1, id1 AS id2 FROM p)
, cand AS (SELECT b.id1, b.id2,
                  coalesce(list_contains(a1.original_doc_ids, b.id2) OR list_contains(a2.original_doc_ids, b.id1)
                           OR list_has_any(a1.original_doc_ids, a2.original_doc_ids), false) AS expected
           FROM both_o b JOIN vecs_lin a1 ON a1.doc_id = b.id1 JOIN vecs_lin a2 ON a2.doc_id = b.id2)"""


@query("candidate_pairs", TD.ctes("vecs", "vecs_lin") + _PAIRS_SQL + f"""
, p AS (SELECT id1, id2 FROM allp WHERE dist > 0 AND dist <= {THRESHOLD})""" + _TRUTH_SQL + """
SELECT id1, id2, expected FROM cand""")
def candidate_pairs(spark, d):
    vl = TD.with_vector_lineage(TD.vectors(spark, d))
    return LN.candidate_pairs(_vec_pairs(spark, d), vl).select("id1", "id2", "expected")


@query("unordered_anti", TD.ctes("vecs") + _PAIRS_SQL + f"""
, req AS (SELECT id1, id2, m.model FROM allp, (SELECT 'm1' AS model UNION ALL SELECT 'm2') m
          WHERE dist > 0 AND dist <= {THRESHOLD})
, done AS (SELECT id2 AS id1, id1 AS id2, 'm1' AS model FROM allp WHERE dist > 0 AND dist <= 0.7)
SELECT r.id1, r.id2, r.model FROM req r WHERE NOT EXISTS (
  SELECT 1 FROM done x WHERE least(x.id1, x.id2) = least(r.id1, r.id2)
    AND greatest(x.id1, x.id2) = greatest(r.id1, r.id2) AND x.model = r.model)""")
def unordered_anti(spark, d):
    pairs, _ = stored(_vec_pairs(spark, d), SLIM_TABLE)  # the stored pair table; both sides below read it
    # request table: every related pair under each of two models
    req = pairs.select("id1", "id2", F.explode(F.array(F.lit("m1"), F.lit("m2"))).alias("model"))
    # processed before: closer pairs, stored in reverse order, for model m1
    done = pairs.where(F.col("dist") <= F.lit(0.7)).select(F.col("id2").alias("id1"), F.col("id1").alias("id2"),
                                                          F.lit("m1").alias("model"))
    return RS.unordered_pair_anti(req, done, with_model=True)


@query("id_anti", """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def id_anti(spark, d):
    docs = load(spark, d, "documents", "doc_id")
    done = load(spark, d, "labels", "doc_id")
    return RS.id_anti(docs, done, "doc_id")


@query("pair_texts", TD.ctes("docs", "docs_lin", "conflicts") + """
SELECT c.id1, c.id2, md5(a.content) AS text1_md5, md5(b.content) AS text2_md5
FROM conflicts c JOIN docs a ON a.doc_id = c.id1 JOIN docs b ON b.doc_id = c.id2""")
def pair_texts(spark, d):
    docs = TD.documents(spark, d)
    c = TD.conflicts(docs)
    return RS.pair_texts(c, docs, "doc_id", "content").select(
        "id1", "id2", F.md5("text1").alias("text1_md5"), F.md5("text2").alias("text2_md5"))


@query("lineage_hits", TD.ctes("docs", "docs_lin") + """
SELECT l.doc_id, l.orig, o.domain AS orig_domain, o.kind AS orig_kind
FROM (SELECT doc_id, unnest(original_doc_ids) AS orig FROM docs_lin) l JOIN docs o ON o.doc_id = l.orig""")
def lineage_hits(spark, d):
    dl = TD.with_text_lineage(TD.documents(spark, d)).select("doc_id", "domain", "kind", "original_doc_ids")
    return LN.lineage_join(dl).select("doc_id", "orig", "orig_domain", "orig_kind")


def vector_clusters(spark, d):
    """Cluster labels as arrays: the stored label, label-0 vectors also in cluster 1."""
    vl = TD.with_vector_lineage(TD.vectors(spark, d))
    cl = F.when(F.col("label") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.col("label")))
    return vl.withColumn("clusters", cl)


_CLUSTERS_SQL = """
, cl AS (SELECT doc_id, original_doc_ids, CASE WHEN label = 0 THEN [0, 1] ELSE [label] END AS clusters FROM vecs_lin)"""


@query("shared_cluster", TD.ctes("vecs", "vecs_lin") + _CLUSTERS_SQL + """
SELECT a.doc_id, count(*) AS n_related FROM cl a JOIN cl b ON list_has_any(a.clusters, b.clusters)
GROUP BY a.doc_id""")
def shared_cluster(spark, d):
    return EV.shared_cluster_counts(vector_clusters(spark, d), "clusters")


@query("conflict_pairs", TD.ctes("docs", "docs_lin") + """
SELECT doc_id AS id1, unnest(original_doc_ids) AS id2, 'lineage' AS why FROM docs_lin
UNION ALL
SELECT s.doc_id AS id1, t.doc_id AS id2, 'tabular' AS why
FROM docs_lin s JOIN docs_lin t ON list_contains(t.original_doc_ids, s.original_doc_ids[1])
WHERE s.kind = 'single_textual' AND len(s.original_doc_ids) > 0 AND t.kind = 'tabular'""")
def conflict_pairs(spark, d):
    dl = TD.with_text_lineage(TD.documents(spark, d))
    return LN.known_conflict_pairs(dl)


@query("conflict_counts", TD.ctes("docs", "docs_lin") + """
, lin AS (SELECT unnest(original_doc_ids) AS original FROM docs_lin)
, tab AS (SELECT s.original_doc_ids[1] AS original
          FROM docs_lin s JOIN docs_lin t ON list_contains(t.original_doc_ids, s.original_doc_ids[1])
          WHERE s.kind = 'single_textual' AND len(s.original_doc_ids) > 0 AND t.kind = 'tabular')
SELECT l.original, l.n AS lineage_pairs, coalesce(t.n, 0) AS tabular_pairs
FROM (SELECT original, count(*) AS n FROM lin GROUP BY original) l
LEFT JOIN (SELECT original, count(*) AS n FROM tab GROUP BY original) t USING (original)""")
def conflict_counts(spark, d):
    """C17 as counts per original, without the pairs."""
    return LN.known_conflict_counts(TD.with_text_lineage(TD.documents(spark, d)))


@query("qa_match", TD.ctes("qa") + f"""
, resp AS (SELECT conv_id, turn AS pos, '  ' || question || chr(10) AS q FROM qa)
, m AS (SELECT r.conv_id, r.pos, q.turn,
               row_number() OVER (PARTITION BY r.conv_id, r.pos ORDER BY q.turn) AS rn
        FROM resp r JOIN qa q ON q.conv_id = r.conv_id
         AND lower(trim(r.q, {TD.WS_SQL})) = lower(trim(q.question, {TD.WS_SQL})))
SELECT conv_id, pos, turn AS matched_turn FROM m WHERE rn = 1""")
def qa_match(spark, d):
    qa = TD.qa_pairs(spark, d)
    resp = qa.select("conv_id", F.col("turn").alias("pos"),
                     F.concat(F.lit("  "), F.col("question"), F.lit("\n")).alias("q"))
    return RS.match_first(resp, qa, "q", "question", ["conv_id"], "pos", "turn") \
        .select("conv_id", "pos", F.col("turn").alias("matched_turn"))


_DOMAIN_IDS = [("en", 300001), ("de", 300002), ("fr", 300003)]


@query("doc_query_map", TD.ctes("docs", "queries") + MAPPING_SQL + """
, dom AS (SELECT 'en' AS domain, 300001 AS tabular_id UNION ALL SELECT 'de', 300002 UNION ALL SELECT 'fr', 300003)
SELECT m.doc_id, m.query_id_textual_manipulation AS query_id, q.query_type, d.domain, dom.tabular_id
FROM mapping m JOIN docs d USING (doc_id) JOIN queries q ON q.query_id = m.query_id_textual_manipulation
LEFT JOIN dom ON dom.domain = d.domain""")
def doc_query_map(spark, d):
    m = doc_query_mapping(spark, d).select("doc_id", F.col("query_id_textual_manipulation").alias("query_id"))
    docs = TD.documents(spark, d).select("doc_id", "domain")
    q = TD.queries(spark, d).select("query_id", "query_type")
    dom = spark.createDataFrame(_DOMAIN_IDS, "domain string, tabular_id bigint")
    # fixed 3-row dictionary: broadcast is size-bounded by construction
    return m.join(docs, "doc_id").join(q, "query_id").join(F.broadcast(dom), "domain", "left") \
        .select("doc_id", "query_id", "query_type", "domain", "tabular_id")


@query("semi_lookup", TD.ctes("docs", "docs_lin", "conflicts") + """
SELECT doc_id, kind FROM docs WHERE doc_id IN (SELECT id2 FROM conflicts)""")
def semi_lookup(spark, d):
    docs = TD.documents(spark, d)
    ids = TD.conflicts(docs).select(F.col("id2").alias("doc_id"))
    return RS.lookup_ids(docs, ids, "doc_id").select("doc_id", "kind")

