"""Phase 2: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from staleguard.operators import evaluate as EV
from staleguard.plans.p1_sets import VERDICTS_SQL, verdicts
from staleguard.plans.p2_joins import _CLUSTERS_SQL, vector_clusters
from staleguard.plans.registry import query, r6
from staleguard.operators import lineage as LN
from staleguard.sources import testdata as TD
from staleguard.sources.tables import load


@query("cluster_recall", TD.ctes("vecs", "vecs_lin") + _CLUSTERS_SQL + """
, links AS (SELECT doc_id, unnest(original_doc_ids) AS orig FROM cl)
, h AS (SELECT l.doc_id, CAST(coalesce(list_has_any(a.clusters, b.clusters), false) AS DOUBLE) AS hit
        FROM links l JOIN cl a ON a.doc_id = l.doc_id JOIN cl b ON b.doc_id = l.orig)
SELECT round(avg(hit), 6) AS recall,
       round(avg(CASE WHEN NOT starts_with(CAST(doc_id AS VARCHAR), '3') THEN hit END), 6) AS recall_without_tabular,
       count(*) AS n_links,
       round((SELECT avg(hr) FROM (SELECT doc_id, avg(hit) AS hr FROM h GROUP BY doc_id)), 6) AS mean_doc_hitrate
FROM h""")
def cluster_recall(spark, d):
    rep = EV.cluster_recall_report(vector_clusters(spark, d), "clusters")
    return rep.select(r6("recall").alias("recall"), r6("recall_without_tabular").alias("recall_without_tabular"),
                      "n_links", r6("mean_doc_hitrate").alias("mean_doc_hitrate"))


@query("docs_per_cluster", TD.ctes("vecs", "vecs_lin") + _CLUSTERS_SQL + """
SELECT round(avg(n), 6) AS avg_docs_per_cluster, count(*) AS n_clusters
FROM (SELECT c, count(*) AS n FROM (SELECT unnest(clusters) AS c FROM cl) GROUP BY c)""")
def docs_per_cluster(spark, d):
    r = EV.docs_per_cluster(vector_clusters(spark, d), "clusters")
    return r.select(r6("avg_docs_per_cluster").alias("avg_docs_per_cluster"), "n_clusters")


@query("avg_related", TD.ctes("vecs", "vecs_lin") + _CLUSTERS_SQL + """
SELECT round(avg(n), 6) AS avg_related_docs FROM (
  SELECT a.doc_id, count(*) AS n FROM cl a JOIN cl b ON list_has_any(a.clusters, b.clusters) GROUP BY a.doc_id)""")
def avg_related(spark, d):
    return EV.avg_related(vector_clusters(spark, d), "clusters").select(r6("avg_related_docs").alias("avg_related_docs"))


@query("model_accuracy", TD.ctes("docs", "docs_lin") + VERDICTS_SQL + """
SELECT model, round(avg(CAST(conflicts = ground_truth AS DOUBLE)), 6) AS accuracy, count(*) AS count
FROM truth GROUP BY model""")
def model_accuracy(spark, d):
    dl = TD.with_text_lineage(TD.documents(spark, d))
    t = LN.with_ground_truth(verdicts(spark, d), dl)
    r = EV.model_accuracy(t)
    return r.select("model", r6("accuracy").alias("accuracy"), "count").orderBy(F.desc("accuracy"), "model")


@query("domain_rollup", """
WITH t AS (SELECT conv_id, turn, role, text,
                  CASE WHEN role = 'user' THEN 'u' || CAST(conv_id AS VARCHAR) END AS asker FROM conversations)
SELECT conv_id, min(turn) AS first_turn, md5(string_agg(text, chr(10) ORDER BY turn)) AS content_md5,
       CASE WHEN count(asker) = 0 THEN '' ELSE
         array_to_string(list_transform(list(asker ORDER BY turn), lambda x: coalesce(x, '<null>')), ',') END AS askers,
       count(*) AS n_rows
FROM t GROUP BY conv_id""")
def domain_rollup(spark, d):
    """One combined record per group (D9/D10): rows of a conversation ordered by turn.

    The group is a conversation, so its size is bounded by one dialogue.
    """
    c = load(spark, d, "conversations", "conv_id", "turn", "role", "text")
    c = c.withColumn("asker", F.when(F.col("role") == "user", F.concat(F.lit("u"), F.col("conv_id").cast("string"))))
    g = c.groupBy("conv_id").agg(
        F.min("turn").alias("first_turn"),
        F.array_sort(F.collect_list(F.struct("turn", "text", "asker"))).alias("rows"),
        F.count("asker").alias("_n_ask"), F.count("*").alias("n_rows"))
    askers = F.when(F.col("_n_ask") == 0, F.lit("")).otherwise(
        F.array_join(F.transform("rows", lambda r: F.coalesce(r["asker"], F.lit("<null>"))), ","))
    return g.select("conv_id", "first_turn", F.md5(F.array_join(F.transform("rows", lambda r: r["text"]), "\n"))
                    .alias("content_md5"), askers.alias("askers"), "n_rows")


@query("ids_by_domain", TD.ctes("docs") + """
SELECT domain, count(*) AS n_ids, min(doc_id) AS min_id, max(doc_id) AS max_id,
       sum(doc_id) AS id_sum FROM docs GROUP BY domain""")
def ids_by_domain(spark, d):
    """Ids grouped by domain (D14), reported as counts and bounds; the id list itself stays long-form."""
    docs = TD.documents(spark, d)
    return docs.groupBy("domain").agg(F.count("*").alias("n_ids"), F.min("doc_id").alias("min_id"),
                                      F.max("doc_id").alias("max_id"), F.sum("doc_id").alias("id_sum"))
