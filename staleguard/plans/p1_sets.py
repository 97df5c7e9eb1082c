"""Phase 1: filters, predicates and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from staleguard.functions import arrays as A
from staleguard.operators import containment as C
from staleguard.operators import lineage as LN
from staleguard.plans.registry import query
from staleguard.sources import testdata as TD
from staleguard.sources.tables import load


def doc_query_hits(spark, d):
    """(doc_id, query_id): the query's reference passage occurs in the document."""
    docs = load(spark, d, "documents", "doc_id", "text")
    bench = load(spark, d, "benchmark", "item_id", "text")
    return C.passage_hits(docs, "doc_id", "text", bench, "item_id", "text") \
        .select(F.col("id").alias("doc_id"), F.col("pid").alias("query_id"))


HITS_SQL = """
, hits AS (SELECT d.doc_id, b.item_id AS query_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))"""


def doc_query_mapping(spark, d):
    """Mapping table: per document the smallest / largest query whose passage it holds."""
    return doc_query_hits(spark, d).groupBy("doc_id").agg(
        F.min("query_id").alias("query_id_textual_manipulation"),
        F.max("query_id").alias("query_id_tabular_manipulation"))


MAPPING_SQL = HITS_SQL + """
, mapping AS (SELECT doc_id, min(query_id) AS query_id_textual_manipulation,
                     max(query_id) AS query_id_tabular_manipulation FROM hits GROUP BY doc_id)"""


def flags(spark, d):
    docs = TD.documents(spark, d)
    return docs.select("doc_id", (F.col("kind") == "single_textual").alias("single_textual_manipulation"),
                       (F.col("kind") == "tabular").alias("single_tabular_manipulation"),
                       (F.col("kind") == "multi_textual").alias("multi_textual_manipulation"))


@query("with_lineage", TD.ctes("docs", "docs_lin") + """
SELECT doc_id, original_doc_ids[1] AS orig FROM docs_lin WHERE len(original_doc_ids) > 0 AND content IS NOT NULL""")
def with_lineage(spark, d):
    dl = TD.with_text_lineage(TD.documents(spark, d))
    return dl.where((F.size("original_doc_ids") > 0) & F.col("content").isNotNull()) \
        .select("doc_id", F.get(F.col("original_doc_ids"), 0).alias("orig"))


@query("flag_select", TD.ctes("docs") + MAPPING_SQL + """
SELECT d.doc_id, m.query_id_textual_manipulation AS query_id
FROM docs d JOIN mapping m USING (doc_id) WHERE d.kind = 'single_textual'""")
def flag_select(spark, d):
    ids = flags(spark, d).where(F.col("single_textual_manipulation")).select("doc_id")
    m = doc_query_mapping(spark, d).select("doc_id", F.col("query_id_textual_manipulation").alias("query_id"))
    return ids.join(m, "doc_id")


@query("contains_type", TD.ctes("queries") + HITS_SQL + """
SELECT h.doc_id, h.query_id FROM hits h JOIN queries q USING (query_id) WHERE q.query_type IN ('Factual Question')""")
def contains_type(spark, d):
    q = TD.queries(spark, d).where(F.col("query_type").isin("Factual Question")).select("query_id")
    return doc_query_hits(spark, d).join(q, "query_id", "left_semi").select("doc_id", "query_id")


@query("in_list", TD.ctes("docs", "docs_lin") + """
SELECT doc_id FROM docs_lin
WHERE original_doc_ids[1] IN (SELECT doc_id FROM docs WHERE domain = 'fr')
   OR domain IN ('es')""")
def in_list(spark, d):
    docs = TD.documents(spark, d)
    dl = TD.with_text_lineage(docs)
    fr = docs.where(F.col("domain") == "fr").select(F.col("doc_id").alias("_o"))
    by_orig = dl.join(fr, F.get(dl["original_doc_ids"], 0) == fr["_o"], "left_semi").select("doc_id")
    by_domain = dl.where(F.col("domain").isin("es")).select("doc_id")
    return by_orig.unionByName(by_domain).distinct()


@query("prefix_filter", TD.ctes("docs", "docs_lin", "conflicts") + """
SELECT 'doc' AS what, doc_id AS id FROM docs WHERE NOT starts_with(CAST(doc_id AS VARCHAR), '3')
UNION ALL
SELECT 'pair' AS what, id1 AS id FROM conflicts
WHERE starts_with(CAST(id1 AS VARCHAR), '1') OR starts_with(CAST(id2 AS VARCHAR), '1')""")
def prefix_filter(spark, d):
    docs = TD.documents(spark, d)
    a = docs.where(~F.col("doc_id").cast("string").startswith("3")).select(F.lit("doc").alias("what"),
                                                                             F.col("doc_id").alias("id"))
    c = TD.conflicts(docs)
    b = c.where(F.col("id1").cast("string").startswith("1") | F.col("id2").cast("string").startswith("1")) \
        .select(F.lit("pair").alias("what"), F.col("id1").alias("id"))
    return a.unionByName(b)


@query("scalar_to_array", TD.ctes("docs") + """
, wide AS (SELECT doc_id, CASE WHEN domain IN ('de', 'fr') THEN 'court-' || source END AS court_name FROM docs)
SELECT doc_id, len(l) AS n_names, array_to_string(l, ',') AS names FROM (
  SELECT doc_id, CASE WHEN court_name IS NULL THEN CAST([] AS VARCHAR[]) ELSE [court_name] END AS l FROM wide)""")
def scalar_to_array(spark, d):
    docs = TD.documents(spark, d)
    court = F.when(F.col("domain").isin("de", "fr"), F.concat(F.lit("court-"), F.col("source")))
    arr = A.empty_if_null(A.singleton_or_empty(court), "string")
    return docs.select("doc_id", arr.alias("l")).select(
        "doc_id", F.size("l").cast("bigint").alias("n_names"), F.array_join("l", ",").alias("names"))


@query("flatten", TD.ctes("queries") + """
SELECT content AS "ground_truth.content", query_id AS "query.query_id", content AS "query.content",
       query_type AS "query.query_type" FROM queries""")
def flatten(spark, d):
    q = TD.queries(spark, d)
    nested = q.select(F.struct("query_id", "content", "query_type").alias("query"),
                      F.struct(F.col("content"), F.col("references")).alias("ground_truth"))
    return LN.flatten_structs(nested, ["query", "ground_truth"]).drop("ground_truth.references")


@query("corpus_union", TD.ctes("docs") + """
SELECT kind, count(*) AS n FROM docs GROUP BY ROLLUP (kind)""")
def corpus_union(spark, d):
    docs = TD.documents(spark, d)
    parts = [docs.where(F.col("kind") == k).select("doc_id", "content", "kind") for k in TD.KINDS]
    corpus = LN.union_corpus(parts)
    return corpus.rollup("kind").agg(F.count("*").alias("n"))


@query("sym_diff", TD.ctes("docs", "docs_lin") + """
, a AS (SELECT DISTINCT original_doc_ids[1] AS id FROM docs_lin WHERE len(original_doc_ids) > 0)
, b AS (SELECT doc_id AS id FROM docs WHERE kind = 'original')
SELECT 'only_referenced' AS side, id FROM (SELECT id FROM a EXCEPT SELECT id FROM b)
UNION ALL
SELECT 'only_original' AS side, id FROM (SELECT id FROM b EXCEPT SELECT id FROM a)""")
def sym_diff(spark, d):
    docs = TD.documents(spark, d)
    dl = TD.with_text_lineage(docs)
    a = dl.where(F.size("original_doc_ids") > 0).select(F.get(F.col("original_doc_ids"), 0).alias("id")).distinct()
    b = docs.where(F.col("kind") == "original").select(F.col("doc_id").alias("id")).distinct()
    return LN.symmetric_difference(a, b, "only_referenced", "only_original")


@query("set_diff", TD.ctes("docs", "docs_lin") + """
, used AS (SELECT DISTINCT original_doc_ids[1] AS id FROM docs_lin WHERE len(original_doc_ids) > 0)
SELECT 'unused' AS what, doc_id AS id FROM docs WHERE kind = 'original' AND doc_id NOT IN (SELECT id FROM used)
UNION ALL
SELECT 'union' AS what, id FROM (SELECT id FROM used UNION SELECT doc_id FROM docs WHERE kind = 'tabular')""")
def set_diff(spark, d):
    docs = TD.documents(spark, d)
    dl = TD.with_text_lineage(docs)
    used = dl.where(F.size("original_doc_ids") > 0).select(F.get(F.col("original_doc_ids"), 0).alias("id"))
    cand = docs.where(F.col("kind") == "original").select(F.col("doc_id").alias("id"))
    unused = cand.join(used, "id", "left_anti").select(F.lit("unused").alias("what"), "id")
    tab = docs.where(F.col("kind") == "tabular").select(F.col("doc_id").alias("id"))
    uni = used.union(tab).distinct().select(F.lit("union").alias("what"), "id")
    return unused.unionByName(uni)


def verdicts(spark, d):
    """Pair verdicts: labelled doc vs its text original (else the next id); model = language;
    predicted conflict = quality 1, null when toxic and low quality."""
    docs = TD.documents(spark, d)
    dl = TD.with_text_lineage(docs)
    lab = load(spark, d, "labels", "doc_id", "quality", "toxic")
    j = lab.join(dl.select("doc_id", "domain", "original_doc_ids"), "doc_id")
    pred = F.when((F.col("toxic") == 1) & (F.col("quality") == 0), F.lit(None).cast("boolean")) \
        .otherwise(F.col("quality") == 1)
    return j.select(F.col("doc_id").alias("id1"),
                    F.coalesce(F.get(F.col("original_doc_ids"), 0), F.col("doc_id") + 1).alias("id2"),
                    pred.alias("conflicts"), F.col("domain").alias("model"))


VERDICTS_SQL = """
, verdicts AS (SELECT l.doc_id AS id1, coalesce(d.original_doc_ids[1], l.doc_id + 1) AS id2,
                      CASE WHEN l.toxic = 1 AND l.quality = 0 THEN NULL ELSE l.quality = 1 END AS conflicts,
                      d.domain AS model
               FROM labels l JOIN docs_lin d USING (doc_id))
, truth AS (SELECT v.*, coalesce(list_contains(a.original_doc_ids, v.id2) OR list_contains(b.original_doc_ids, v.id1)
                   OR list_has_any(a.original_doc_ids, b.original_doc_ids), false) AS ground_truth
            FROM verdicts v JOIN docs_lin a ON a.doc_id = v.id1 JOIN docs_lin b ON b.doc_id = v.id2)"""


@query("pair_truth", TD.ctes("docs", "docs_lin") + VERDICTS_SQL + """
SELECT id1, id2, model, conflicts, ground_truth FROM truth""")
def pair_truth(spark, d):
    dl = TD.with_text_lineage(TD.documents(spark, d))
    return LN.with_ground_truth(verdicts(spark, d), dl).select("id1", "id2", "model", "conflicts", "ground_truth")
