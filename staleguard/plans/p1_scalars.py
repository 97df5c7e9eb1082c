"""Phase 1: scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from staleguard.functions import arrays as A
from staleguard.functions import json as J
from staleguard.functions import text as T
from staleguard.functions import vectors as V
from staleguard.plans import sqlutil as S
from staleguard.plans.registry import query, r6
from staleguard.sources import prompts as PR
from staleguard.sources import testdata as TD
from staleguard.sources.tables import load

PREFIX_BY_KIND = {"single_textual": 1, "tabular": 3, "multi_textual": 4}


def _prefix_col():
    e = None
    for k, p in PREFIX_BY_KIND.items():
        e = F.when(F.col("kind") == k, F.lit(p)) if e is None else e.when(F.col("kind") == k, F.lit(p))
    return e


_PREFIX_SQL = "CASE kind WHEN 'single_textual' THEN 1 WHEN 'tabular' THEN 3 WHEN 'multi_textual' THEN 4 END"


@query("normalize_text", TD.ctes("docs") + f"""
SELECT doc_id, md5({S.normalize('content')}) AS norm_md5, length({S.normalize('content')}) AS norm_len FROM docs""")
def normalize_text(spark, d):
    n = T.normalize("content")
    return TD.documents(spark, d).select("doc_id", F.md5(n).alias("norm_md5"), F.length(n).alias("norm_len"))


@query("derived_id", TD.ctes("docs") + f"""
SELECT doc_id, kind, {S.derived_id('doc_id', _PREFIX_SQL)} AS new_id FROM docs WHERE kind <> 'original'""")
def derived_id(spark, d):
    docs = TD.documents(spark, d).where(F.col("kind") != "original")
    return docs.select("doc_id", "kind", T.derived_id("doc_id", _prefix_col()).alias("new_id"))


@query("prefix_date", TD.ctes("docs") + f"""
, a AS (SELECT doc_id, CASE WHEN kind = 'original' THEN doc_id ELSE {S.derived_id('doc_id', _PREFIX_SQL)} END
               AS alias_id FROM docs)
SELECT doc_id, alias_id, {S.prefix_date('alias_id')} AS creation_date FROM a""")
def prefix_date(spark, d):
    docs = TD.documents(spark, d)
    alias = F.when(F.col("kind") == "original", F.col("doc_id")).otherwise(T.derived_id("doc_id", _prefix_col()))
    return docs.select("doc_id", alias.alias("alias_id")).select(
        "doc_id", "alias_id", T.prefix_date("alias_id").alias("creation_date"))


_QA_TEMPLATE = PR.get("qa/qa_without_dq")[1]


@query("render_prompt", TD.ctes("qa") + f"""
, r AS (SELECT conv_id, turn, {S.render(_QA_TEMPLATE, context='answer', question='question')} AS p FROM qa)
SELECT conv_id, turn, md5(p) AS prompt_md5, length(p) AS prompt_len FROM r""")
def render_prompt(spark, d):
    p = T.render(_QA_TEMPLATE, context="answer", question="question")
    return TD.qa_pairs(spark, d).select("conv_id", "turn", p.alias("p")).select(
        "conv_id", "turn", F.md5("p").alias("prompt_md5"), F.length("p").alias("prompt_len"))


@query("bullets", """
SELECT conv_id, turn,
       md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x: '- ' || x), chr(10))) AS bullets_md5,
       len(string_split(text, chr(10))) AS n_items
FROM conversations WHERE role = 'assistant'""")
def bullets(spark, d):
    c = load(spark, d, "conversations", "conv_id", "turn", "role", "text").where(F.col("role") == "assistant")
    items = F.split("text", "\n")
    return c.select("conv_id", "turn", F.md5(T.bullets(items)).alias("bullets_md5"), F.size(items).alias("n_items"))


@query("numbered_qa", TD.ctes("qa") + """
, n AS (SELECT conv_id, turn, question, answer, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM qa)
SELECT conv_id, count(*) AS n_pairs,
       md5(string_agg('question_' || i || ': ' || question || chr(10) || 'answer_' || i || ': ' || answer || chr(10),
                      '' ORDER BY turn)) AS qa_md5
FROM n GROUP BY conv_id""")
def numbered_qa(spark, d):
    """One numbered QA block per conversation (group size = turns of one conversation)."""
    qa = TD.qa_pairs(spark, d)
    g = qa.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "question", "answer"))).alias("qa"))
    return g.select("conv_id", F.size("qa").cast("bigint").alias("n_pairs"), F.md5(T.numbered_qa("qa")).alias("qa_md5"))


@query("qa_pairs", TD.ctes("qa") + """
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pair_no,
       md5(question) AS question_md5, md5(answer) AS answer_md5 FROM qa""")
def qa_pairs(spark, d):
    from pyspark.sql import Window as W
    qa = TD.qa_pairs(spark, d)
    return qa.select("conv_id", "turn", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).alias("pair_no"),
                     F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"))


@query("l1_l2", TD.ctes("vecs") + """
, n AS (SELECT vec_id, embedding AS e, list_sum(list_transform(embedding, lambda x: abs(x))) AS l1,
               sqrt(list_sum(list_transform(embedding, lambda x: x * x))) AS l2 FROM vecs)
SELECT vec_id, round(l1, 6) AS l1, round(l2, 6) AS l2, round(e[1] / l1, 6) AS l1_first, round(e[1] / l2, 6) AS l2_first
FROM n""")
def l1_l2(spark, d):
    v = TD.vectors(spark, d)
    return v.select("vec_id", r6(V.l1_norm("embedding")).alias("l1"), r6(V.l2_norm("embedding")).alias("l2"),
                    r6(F.get(V.l1_normalize("embedding"), 0)).alias("l1_first"),
                    r6(F.get(V.l2_normalize("embedding"), 0)).alias("l2_first"))


@query("bool_array_mean", f"""
WITH c AS (SELECT doc_id, {S.coverage('doc_id', 'length(CAST(doc_id AS VARCHAR)) + quality + toxic')} AS cov
           FROM labels)
SELECT doc_id, len(cov) AS n, round({S.bool_mean('cov')}, 6) AS coverage FROM c""")
def bool_array_mean(spark, d):
    lab = load(spark, d, "labels", "doc_id", "quality", "toxic")
    n = F.length(F.col("doc_id").cast("string")) + F.col("quality") + F.col("toxic")
    c = lab.select("doc_id", A.coverage("doc_id", n).alias("cov"))
    return c.select("doc_id", F.size("cov").cast("bigint").alias("n"), r6(A.bool_mean("cov")).alias("coverage"))


@query("json_decode", """
SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def json_decode(spark, d):
    e = load(spark, d, "events", "event_id", "props")
    return e.select("event_id", J.decode("props", "k INT")["k"].alias("k"))


def _wide_docs(spark, d):
    docs = TD.documents(spark, d)
    patient = F.when(F.col("domain") == "de", F.concat(F.lit("patient-"), F.col("doc_id").cast("string"))) \
        .when(F.col("domain") == "es", F.lit(""))
    court = F.when(F.col("domain").isin("de", "fr"), F.concat(F.lit("court-"), F.col("source")))
    company = F.when(F.col("domain") != "fr", F.concat(F.lit("company-"), F.col("source")))
    return docs.select("*", patient.alias("hospital_patient_name"), court.alias("court_name"),
                       company.alias("company_name"))


_WIDE_SQL = """
, wide AS (SELECT *,
     CASE WHEN domain = 'de' THEN 'patient-' || CAST(doc_id AS VARCHAR) WHEN domain = 'es' THEN '' END
       AS hospital_patient_name,
     CASE WHEN domain IN ('de', 'fr') THEN 'court-' || source END AS court_name,
     CASE WHEN domain <> 'fr' THEN 'company-' || source END AS company_name
   FROM docs)"""


@query("entity", TD.ctes("docs") + _WIDE_SQL + """
SELECT doc_id, coalesce(nullif(hospital_patient_name, ''), nullif(court_name, ''), nullif(company_name, ''))
       AS entity FROM wide""")
def entity(spark, d):
    w = _wide_docs(spark, d)
    return w.select("doc_id", T.first_entity("hospital_patient_name", "court_name", "company_name").alias("entity"))


@query("text_stats", TD.ctes("docs") + f"""
SELECT domain, count(*) AS n_docs, round(avg(length(content)), 6) AS avg_chars,
       round(avg(len({S.words('content')})), 6) AS avg_tokens
FROM docs GROUP BY ROLLUP (domain)""")
def text_stats(spark, d):
    docs = TD.documents(spark, d)
    return docs.rollup("domain").agg(F.count("*").alias("n_docs"), r6(F.avg(F.length("content"))).alias("avg_chars"),
                                     r6(F.avg(F.size(T.word_tokens("content")))).alias("avg_tokens"))
