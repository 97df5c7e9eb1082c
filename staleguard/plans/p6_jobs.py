"""Phase 6: request/response jobs with deterministic response tables.

The response of a request is derived from its ids with md5 so both engines
agree; in production the response table comes from the model batch.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from staleguard.functions import json as J
from staleguard.functions import text as T
from staleguard.operators import lineage as LN
from staleguard.operators import requests as RQ
from staleguard.operators import resume as RS
from staleguard.plans import sqlutil as S
from staleguard.plans.p0_pairs import _PAIRS_SQL, THRESHOLD
from staleguard.plans.p2_joins import _TRUTH_SQL, _vec_pairs
from staleguard.plans.p1_scalars import _WIDE_SQL, _wide_docs
from staleguard.plans.p1_sets import HITS_SQL, MAPPING_SQL, doc_query_hits, doc_query_mapping
from staleguard.plans.p3_windows import select_for_alteration
from staleguard.plans.registry import query, r6
from staleguard.sources import prompts as PR
from staleguard.sources import testdata as TD

MODELS = ("m1", "m2")
FEW = 400_000  # documents whose lineage, about 100 bytes each, is broadcast


def _flag(model_col, a, b, cut="8"):
    return F.substring(F.md5(F.concat(model_col, F.lit(":"), F.col(a).cast("string"), F.lit("-"),
                                      F.col(b).cast("string"))), 1, 1) < F.lit(cut)


@query("pair_check", TD.ctes("vecs", "vecs_lin") + _PAIRS_SQL + f"""
, p AS (SELECT id1, id2 FROM allp WHERE dist > 0 AND dist <= {THRESHOLD})""" + _TRUTH_SQL + """
, req AS (SELECT c.id1, c.id2, m.model, c.expected FROM cand c, (SELECT 'm1' AS model UNION ALL SELECT 'm2') m
          WHERE c.id1 < c.id2 AND c.id1 IN (SELECT doc_id FROM documents) AND c.id2 IN (SELECT doc_id FROM documents))
, v AS (SELECT model, expected,
               substr(md5(model || ':' || CAST(id1 AS VARCHAR) || '-' || CAST(id2 AS VARCHAR)), 1, 1) < '8' AS conflicts
        FROM req)
SELECT model, round(avg(CAST(conflicts = expected AS DOUBLE)), 6) AS accuracy, count(*) AS count FROM v
GROUP BY model""")
def pair_check(spark, d):
    """K9: related pairs -> requests (both texts rendered) -> responses -> verdicts -> accuracy per model.

    Pairs are found, requests answered and verdicts counted on the way: where no id comes twice, which two aggregates tell, no table
    of pairs or requests is written.
    """
    vecs = TD.vectors(spark, d)
    docs = RS.lookup_ids(TD.documents(spark, d), vecs.select(F.col("vec_id").alias("doc_id")), "doc_id")
    vl = TD.with_vector_lineage(vecs)
    ids = [df.groupBy(c).count().agg(F.max("count"), F.count("*")).first() for df, c in ((vecs, "vec_id"), (docs, "doc_id"))]  # two numbers each
    pairs = _vec_pairs(spark, d).select("id1", "id2")
    flag = _flag(F.col("model"), "id1", "id2")
    reqs, responses = RQ.answered(RQ.pair_requests(pairs, docs, "comparison/check_for_contradictions", MODELS, digest=True),
                                  F.to_json(F.struct(flag.alias("contradictory_info_found"))), once=all((most or 0) <= 1 for most, _ in ids))
    verdicts = RQ.verdict_rows(RQ.decode_responses(reqs, responses, "check"))
    truth = LN.with_ground_truth(verdicts, vl, few=ids[0][1] <= FEW)
    return truth.groupBy("model").agg(
        r6(F.avg((F.col("conflicts") == F.col("ground_truth")).cast("double"))).alias("accuracy"),
        F.count("*").alias("count"))


@query("extract_conflicts", TD.ctes("docs", "docs_lin") + f"""
, kp AS (SELECT doc_id AS id1, unnest(original_doc_ids) AS id2 FROM docs_lin
         UNION ALL
         SELECT s.doc_id AS id1, t.doc_id AS id2 FROM docs_lin s
         JOIN docs_lin t ON list_contains(t.original_doc_ids, s.original_doc_ids[1])
         WHERE s.kind = 'single_textual' AND len(s.original_doc_ids) > 0 AND t.kind = 'tabular')
, r AS (SELECT kp.id1, kp.id2,
               substr(md5('x:' || CAST(kp.id1 AS VARCHAR) || '-' || CAST(kp.id2 AS VARCHAR)), 1, 1) < 'c' AS found,
               string_split(trim(a.content, {S.WS}), chr(10))[1] AS q1,
               string_split(trim(b.content, {S.WS}), chr(10))[-1] AS q2
        FROM kp JOIN docs a ON a.doc_id = kp.id1 JOIN docs b ON b.doc_id = kp.id2)
SELECT id1, id2, CASE WHEN found THEN 1 ELSE 0 END AS n_contradictions,
       CASE WHEN found THEN md5(q1) END AS passage1_md5, CASE WHEN found THEN md5(q2) END AS passage2_md5,
       found AS conflicts_found FROM r""")
def extract_conflicts(spark, d):
    """Known-conflict pairs -> extraction requests -> responses -> one row per contradiction."""
    docs = TD.documents(spark, d)
    dl = TD.with_text_lineage(docs)
    pairs = LN.known_conflict_pairs(dl).select("id1", "id2")
    reqs = RQ.pair_requests(pairs, docs, "comparison/extract_contradictions", "x")
    t = reqs.join(docs.select(F.col("doc_id").alias("id1"), TD.first_line(F.col("content")).alias("q1")), "id1") \
        .join(docs.select(F.col("doc_id").alias("id2"), TD.last_line(F.col("content")).alias("q2")), "id2")
    found = _flag(F.col("model"), "id1", "id2", "c")
    quotes = F.when(found, F.array(F.struct(F.col("q1").alias("quote_from_document1"),
                                            F.col("q2").alias("quote_from_document2"))))
    resp = t.select("request_id", F.to_json(F.struct(found.alias("contradictory_info_found"),
                                                     F.coalesce(quotes, F.array()).alias("contradictions")))
                    .alias("response"))
    rows = RQ.conflict_rows(RQ.decode_responses(reqs, resp, "extract"))
    return rows.select("id1", "id2", F.col("n_contradictions").cast("bigint").alias("n_contradictions"),
                       F.md5("conflicting_passage_doc1").alias("passage1_md5"),
                       F.md5("conflicting_passage_doc2").alias("passage2_md5"), "conflicts_found")


@query("keypoints", TD.ctes("queries") + """
SELECT query_id, len(string_split(content, '. ')) AS n_keypoints,
       md5(array_to_string(list_transform(string_split(content, '. '), lambda x: '- ' || x), chr(10))) AS keypoints_md5
FROM queries""")
def keypoints(spark, d):
    """Overwrite ``keypoints`` from a response table joined on the query id."""
    q = TD.queries(spark, d)
    resp = q.select("query_id", F.to_json(F.struct(F.split("content", r"\. ").alias("keypoints"))).alias("response"))
    dec = resp.select("query_id", J.decode("response", "keypoints")["keypoints"].alias("keypoints"))
    out = q.join(dec, "query_id", "left")
    return out.select("query_id", F.size("keypoints").cast("bigint").alias("n_keypoints"),
                      F.md5(T.bullets("keypoints")).alias("keypoints_md5"))


@query("manipulate_textual", TD.ctes("docs") + """
SELECT CAST('1' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(5, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0')
            AS BIGINT) AS new_doc_id, doc_id AS original_doc_id,
       md5(content || chr(10) || 'Revised on 2005-01-01.') AS content_md5
FROM docs WHERE kind = 'single_textual'""")
def manipulate_textual(spark, d):
    """K5: altered copies of single-textual documents with lineage."""
    docs = TD.documents(spark, d).where(F.col("kind") == "single_textual")
    resp = docs.select("doc_id", F.to_json(F.struct(
        F.concat("content", F.lit("\nRevised on 2005-01-01.")).alias("text_new"),
        F.lit("").alias("answer_new"), F.array().cast("array<string>").alias("references_new"))).alias("response"))
    dec = resp.select("doc_id", J.decode("response", "single_textual").alias("decoded"))
    new = RQ.altered_documents(docs, dec, 1)
    return new.select(F.col("doc_id").alias("new_doc_id"), F.get(F.col("original_doc_ids"), 0).alias("original_doc_id"),
                      F.md5("content").alias("content_md5"))


@query("manipulate_tabular", TD.ctes("docs") + f"""
, cand AS (SELECT doc_id, domain FROM docs WHERE kind = 'original' AND domain IN ('en', 'de', 'fr'))
, rk AS (SELECT doc_id, domain, row_number() OVER (PARTITION BY domain ORDER BY md5('42-' || CAST(doc_id AS VARCHAR)),
                doc_id) AS rank FROM cand)
, st AS (SELECT doc_id FROM rk WHERE rank <= 10)
, tb AS (SELECT doc_id FROM st ORDER BY md5('43-' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 15)
, rows AS (SELECT d.domain, d.doc_id, d.doc_id AS ord,
                  'fact of ' || CAST(d.doc_id AS VARCHAR) || ' | ' || d.source AS content,
                  CASE WHEN d.domain <> 'fr' THEN 'company-' || d.source END AS company_name
           FROM docs d JOIN tb USING (doc_id))
, dom AS (SELECT 'en' AS domain, 300001 AS tabular_id UNION ALL SELECT 'de', 300002 UNION ALL SELECT 'fr', 300003)
SELECT r.domain, dom.tabular_id, md5(string_agg(content, chr(10) ORDER BY ord)) AS content_md5,
       CASE WHEN count(company_name) = 0 THEN '' ELSE
         array_to_string(list_transform(list(company_name ORDER BY ord), lambda x: coalesce(x, '<null>')), ',') END
         AS company_names,
       array_to_string(list_sort(list(doc_id)), ',') AS original_doc_ids
FROM rows r LEFT JOIN dom USING (domain) GROUP BY r.domain, dom.tabular_id""")
def manipulate_tabular(spark, d):
    """K6: one fact row per sampled document ('description | value', H10), then one tabular
    document per domain with ordered content, entity lists (nulls kept) and lineage (D9, D10)."""
    docs = TD.documents(spark, d)
    tb = select_for_alteration(spark, d).where("single_tabular_manipulation").select("doc_id")
    rows = docs.join(tb, "doc_id").select(
        "domain", "doc_id", F.col("doc_id").alias("ord"),
        T.table_row_text(F.concat(F.lit("fact of "), F.col("doc_id").cast("string")), F.col("source")).alias("content"),
        F.when(F.col("domain") != "fr", F.concat(F.lit("company-"), F.col("source"))).alias("company_name"),
        F.lit(None).cast("string").alias("court_name"), F.lit(None).cast("string").alias("hospital_patient_name"))
    dom = spark.createDataFrame([("en", 300001), ("de", 300002), ("fr", 300003)], "domain string, tabular_id bigint")
    t = RQ.tabular_documents(rows, dom)
    names = F.when(F.size("company_names") == 0, F.lit("")).otherwise(
        F.array_join(F.transform("company_names", lambda x: F.coalesce(x, F.lit("<null>"))), ","))
    return t.select("domain", F.col("tabular_id").cast("int").alias("tabular_id"), F.md5("content").alias("content_md5"),
                    names.alias("company_names"), F.array_join("original_doc_ids", ",").alias("original_doc_ids"))


_MULTI_USER = PR.get("manipulations/manipulation_multi_textual")[1]


@query("manipulate_multi", TD.ctes("docs", "queries") + _WIDE_SQL + HITS_SQL + f"""
, qa AS (SELECT h.doc_id, h.query_id, q.content AS question, q.content AS answer
         FROM hits h JOIN queries q USING (query_id) WHERE q.query_type = 'Factual Question')
, num AS (SELECT doc_id, count(*) AS n_pairs,
                 string_agg('question_' || i || ': ' || question || chr(10) || 'answer_' || i || ': ' || answer
                            || chr(10), '' ORDER BY query_id) AS questions
          FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY query_id) AS i FROM qa) GROUP BY doc_id)
SELECT {S.derived_id('w.doc_id', '4')} AS new_doc_id, num.n_pairs, num.n_pairs AS n_matched,
       md5({S.render(_MULTI_USER, text='w.content', entity="coalesce(coalesce(nullif(w.hospital_patient_name, ''), "
                      "nullif(w.court_name, ''), nullif(w.company_name, '')), '')", questions='num.questions')})
         AS prompt_md5
FROM num JOIN wide w USING (doc_id)""")
def manipulate_multi(spark, d):
    """K7: documents holding reference passages -> their factual QA pairs (B5, H8) -> numbered prompt
    (H7, B14) -> response with new text and QA pairs -> returned pairs matched back to the queries
    (C12) -> altered document ids (prefix 4); ``on_exist='skip'`` against an empty store."""
    from staleguard.functions import text as _T
    q = TD.queries(spark, d).where(F.col("query_type") == "Factual Question") \
        .select("query_id", F.col("content").alias("question"), F.col("content").alias("answer"))
    qa = doc_query_hits(spark, d).join(q, "query_id")
    docs = _wide_docs(spark, d).select(
        "doc_id", "content", T.first_entity("hospital_patient_name", "court_name", "company_name").alias("entity"))
    req = RQ.multi_textual_requests(docs, qa)
    pairs_new = F.transform("qa", lambda x: F.struct(F.concat(F.lit("  "), x["question"], F.lit("\n")).alias("question"),
                                                     F.concat(F.lit("updated: "), x["answer"]).alias("answer"),
                                                     x["question"].alias("quote")))
    resp = req.select("request_id", F.to_json(F.struct(F.concat("content", F.lit("\n[multi]")).alias("text_new"),
                                                       pairs_new.alias("qa_pairs_new"))).alias("response"))
    dec = RQ.decode_responses(req.select("request_id", "doc_id", "qa", "user_prompt"), resp, "multi_textual")
    matched = RQ.match_returned_pairs(dec, qa).groupBy("doc_id").agg(F.count("*").alias("n_matched"))
    out = dec.select("doc_id", F.size("qa").cast("bigint").alias("n_pairs"), F.md5("user_prompt").alias("prompt_md5")) \
        .join(matched, "doc_id", "left")
    new = RQ.apply_on_exist(out.withColumn("new_doc_id", T.derived_id("doc_id", 4)), None, "new_doc_id", "skip")
    return new.select("new_doc_id", "n_pairs", F.coalesce("n_matched", F.lit(0)).cast("bigint").alias("n_matched"),
                      "prompt_md5")


@query("manipulate_textual_queries", TD.ctes("docs") + MAPPING_SQL + f"""
SELECT {S.derived_id('m.query_id_textual_manipulation', '1')} AS query_id,
       m.query_id_textual_manipulation AS original_query_id,
       CAST({S.derived_id('d.doc_id', '1')} AS VARCHAR) AS doc_ids,
       md5('revised: ' || b.text) AS answer_md5, 1 AS n_references, 0 AS n_keypoints
FROM mapping m JOIN docs d USING (doc_id) JOIN benchmark b ON b.item_id = m.query_id_textual_manipulation
WHERE d.kind = 'single_textual'""")
def manipulate_textual_queries(spark, d):
    """Altered query rows for single-textual documents: new id, back-pointer, new answer and
    references, the altered document as the only doc id, empty keypoints."""
    from staleguard.functions import text as _T
    m = doc_query_mapping(spark, d).select("doc_id", F.col("query_id_textual_manipulation").alias("query_id"))
    docs = TD.documents(spark, d).where(F.col("kind") == "single_textual").select("doc_id")
    q = TD.queries(spark, d)
    todo = m.join(docs, "doc_id").join(q.select("query_id", "content"), "query_id")
    resp = todo.select("query_id", "doc_id", F.to_json(F.struct(
        F.lit("").alias("text_new"), F.concat(F.lit("revised: "), F.col("content")).alias("answer_new"),
        F.array(T.py_strip(F.col("content"))).alias("references_new"))).alias("response"))
    dec = resp.select("query_id", "doc_id", J.decode("response", "single_textual").alias("decoded"))
    new = RQ.altered_queries(q, dec, 1)
    return new.select("query_id", "original_query_id", F.array_join("doc_ids", ",").alias("doc_ids"),
                      F.md5("answer").alias("answer_md5"), F.size("references").alias("n_references"),
                      F.size("keypoints").alias("n_keypoints"))


_ENTITY_SQL = ("coalesce(coalesce(nullif(w.hospital_patient_name, ''), nullif(w.court_name, ''), nullif(w.company_name, '')), '')")


def _requests_sql(prompt: str, prefix: int) -> str:
    user = PR.get(prompt)[1]
    new_doc, new_query = S.derived_id("m.doc_id", str(prefix)), S.derived_id("m.query_id_textual_manipulation", str(prefix))
    shown = S.render(user, text="w.content", question="q.content", answer="q.content", references='to_json(q."references")', entity=_ENTITY_SQL)
    return TD.ctes("docs", "queries") + _WIDE_SQL + MAPPING_SQL + f"""
SELECT m.doc_id, m.query_id_textual_manipulation AS query_id, {new_doc} AS new_doc_id, md5({shown}) AS prompt_md5
FROM mapping m JOIN wide w USING (doc_id) JOIN queries q ON q.query_id = m.query_id_textual_manipulation
WHERE m.doc_id % 7 <> 0 AND m.query_id_textual_manipulation % 5 <> 0"""


def _alteration_requests(spark, d, prompt: str, prefix: int):
    m = doc_query_mapping(spark, d).select("doc_id", F.col("query_id_textual_manipulation").alias("query_id"))
    docs = _wide_docs(spark, d).select("doc_id", "content", T.first_entity("hospital_patient_name", "court_name", "company_name").alias("entity"))
    q = TD.queries(spark, d).select("query_id", F.col("content").alias("question"), F.col("content").alias("answer"), "references")
    stored = m.select(T.derived_id("doc_id", prefix).alias("doc_id")).where(m["doc_id"] % 7 == 0)
    stored_queries = m.select(T.derived_id("query_id", prefix).alias("query_id")).where(m["query_id"] % 5 == 0)
    r = RQ.single_alteration_requests(m, docs, q, prompt, prefix, stored, stored_queries)
    return r.select("doc_id", "query_id", "new_doc_id", F.md5("user_prompt").alias("prompt_md5"))


@query("textual_requests", _requests_sql("manipulations/manipulation_single_textual", 1))
def textual_requests(spark, d):
    """K5: the single-textual job's requests, rendered from its template; what is stored under the derived ids isn't asked again."""
    return _alteration_requests(spark, d, "manipulations/manipulation_single_textual", 1)


@query("tabular_requests", _requests_sql("manipulations/manipulation_single_tabular", 3))
def tabular_requests(spark, d):
    """K6: the single-tabular job's requests, with the document's first entity."""
    return _alteration_requests(spark, d, "manipulations/manipulation_single_tabular", 3)
