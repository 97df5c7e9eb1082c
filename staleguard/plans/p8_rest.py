"""Phase 8: remaining sources, sinks, selectors and row reports."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from staleguard.functions import json as J
from staleguard.functions import text as T
from staleguard.operators import evaluate as EV
from staleguard.operators import lineage as LN
from staleguard.operators import pairs as P
from staleguard.operators import requests as RQ
from staleguard.operators import resume as RS
from staleguard.operators import sampling as SM
from staleguard.plans import sqlutil as S
from staleguard.plans.p0_pairs import _PAIRS_SQL, THRESHOLD
from staleguard.plans.p1_sets import MAPPING_SQL, doc_query_mapping
from staleguard.plans.p2_aggregates import _CLUSTERS_SQL, vector_clusters
from staleguard.plans.p3_windows import LANG_DOMAINS, SEED, _STRAT_SQL
from staleguard.plans.registry import query, r6
from staleguard.session import SLIM_TABLE, stored
from staleguard.sources import files as FS
from staleguard.sources import prompts as PR
from staleguard.sources import testdata as TD
from staleguard.sources.store import Store

SELECTORS = ("all", "original_only", "manipulated_only")


@query("corpus_select", TD.ctes("docs") + """
SELECT 'all' AS which, doc_id FROM docs
UNION ALL SELECT 'original_only', doc_id FROM docs WHERE kind = 'original'
UNION ALL SELECT 'manipulated_only', doc_id FROM docs WHERE kind <> 'original'""")
def corpus_select(spark, d):
    """The three corpus selections, each id under the selections that hold it."""
    docs = TD.documents(spark, d).select("doc_id", "kind")
    return LN.union_corpus([LN.select_corpus(docs, None if w == "all" else w).select(F.lit(w).alias("which"), "doc_id") for w in SELECTORS])


@query("delete_prefix", TD.ctes("docs") + """
SELECT doc_id, domain FROM docs WHERE NOT starts_with(CAST(doc_id AS VARCHAR), '3')
UNION ALL SELECT doc_id, 'rewritten' FROM docs WHERE starts_with(CAST(doc_id AS VARCHAR), '3')""")
def delete_prefix(spark, d):
    """Rows whose id starts with a prefix are deleted, then written anew."""
    docs = TD.documents(spark, d).select("doc_id", "domain")
    kept = RS.delete_by_prefix(docs, "doc_id", "3")
    anew = RS.id_anti(docs, kept, "doc_id").withColumn("domain", F.lit("rewritten"))
    path = FS.scratch_path(spark, "rewritten")
    FS.write_once(kept, path)
    FS.append_new(anew, path, ["doc_id"])
    return spark.read.parquet(path)


PREVIEW = 10


@query("table_preview", TD.ctes("docs") + f"""
SELECT doc_id, domain, kind, (SELECT count(*) FROM docs) AS n_rows FROM docs ORDER BY doc_id LIMIT {PREVIEW}""")
def table_preview(spark, d):
    """The first rows of a table with its row count."""
    docs = TD.documents(spark, d).select("doc_id", "domain", "kind")
    return docs.orderBy("doc_id").limit(PREVIEW).withColumn("n_rows", F.lit(docs.count()).cast("bigint"))


@query("csv_subset", TD.ctes("queries") + """
SELECT query_id, query_type FROM queries""")
def csv_subset(spark, d):
    """Export of two columns only; the file holds no others."""
    path = FS.scratch_path(spark, "subset")
    FS.write_csv_table(TD.queries(spark, d).select("query_id", "query_type"), path)
    back = spark.read.option("header", True).csv(path)
    return back.select(*[F.col(c).cast("bigint") if c == "query_id" else F.col(c) for c in back.columns])


@query("create_if_absent", TD.ctes("docs") + """
SELECT doc_id, 'first' AS writer FROM docs WHERE kind = 'original'""")
def create_if_absent(spark, d):
    """The second write finds the table and leaves it alone."""
    docs = TD.documents(spark, d)
    path = FS.scratch_path(spark, "once")
    FS.write_once(docs.where("kind = 'original'").select("doc_id", F.lit("first").alias("writer")), path, fail_if_exists=False)
    FS.write_once(docs.select("doc_id", F.lit("second").alias("writer")), path, fail_if_exists=False)
    return spark.read.parquet(path)


@query("hit_rate_rows", TD.ctes("vecs", "vecs_lin") + _CLUSTERS_SQL + """
, links AS (SELECT doc_id, unnest(original_doc_ids) AS orig FROM cl)
, h AS (SELECT l.doc_id, CAST(coalesce(list_has_any(a.clusters, b.clusters), false) AS DOUBLE) AS hit
        FROM links l JOIN cl a ON a.doc_id = l.doc_id JOIN cl b ON b.doc_id = l.orig)
SELECT cl.doc_id, round(r.hitrate, 6) AS hitrate FROM cl LEFT JOIN (SELECT doc_id, avg(hit) AS hitrate FROM h GROUP BY doc_id) r USING (doc_id)""")
def hit_rate_rows(spark, d):
    """The hit rate of every document, null for originals."""
    per_doc, _ = EV.cluster_recall(vector_clusters(spark, d), "clusters")
    return per_doc.select("doc_id", r6("hitrate").alias("hitrate"))


@query("domain_ids", TD.ctes("docs") + """
SELECT domain, doc_id FROM docs""")
def domain_ids(spark, d):
    """The ids of every domain, one row each (a domain may hold a third of all ids, so they aren't gathered in one row)."""
    return TD.documents(spark, d).select("domain", "doc_id")


_QUOTA = SM.round_robin_quota(30, LANG_DOMAINS)


@query("quota_report", TD.ctes("docs") + _STRAT_SQL + """
, quota AS (""" + " UNION ALL ".join(f"SELECT '{k}' AS domain, CAST({v} AS BIGINT) AS quota" for k, v in _QUOTA.items()) + """)
SELECT q.domain, q.quota, count(rk.doc_id) AS available, count(rk.doc_id) >= q.quota AS enough
FROM quota q LEFT JOIN rk ON rk.domain = q.domain GROUP BY q.domain, q.quota""")
def quota_report(spark, d):
    """quota and candidates of every domain."""
    docs = TD.documents(spark, d).where(F.col("kind") == "original")
    quota = spark.createDataFrame(list(_QUOTA.items()), "domain string, quota long")
    have = docs.groupBy("domain").agg(F.count("*").alias("available"))
    return F.broadcast(quota).join(have, "domain", "left").select(
        "domain", "quota", F.coalesce("available", F.lit(0)).alias("available"),
        (F.coalesce("available", F.lit(0)) >= F.col("quota")).alias("enough"))


def _ranked_sql(name: str, seed: int, source: str) -> str:
    return f"""
, {name} AS (SELECT doc_id, domain, row_number() OVER (PARTITION BY domain
               ORDER BY md5('{seed}-' || CAST(doc_id AS VARCHAR)), doc_id) AS rank FROM {source})"""


def _case(quota: dict) -> str:
    return "CASE domain " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in quota.items()) + " ELSE 0 END"


@query("selection_top_up", TD.ctes("docs") + f"""
, cand AS (SELECT doc_id, domain FROM docs WHERE kind = 'original' AND domain IN ({", ".join(f"'{x}'" for x in LANG_DOMAINS)}))"""
       + _ranked_sql("r1", SEED + 5, "cand") + f"""
, old AS (SELECT doc_id, domain FROM r1 WHERE rank <= {_case(SM.round_robin_quota(12, LANG_DOMAINS))})
, rest AS (SELECT * FROM cand WHERE doc_id NOT IN (SELECT doc_id FROM old))""" + _ranked_sql("r2", SEED + 6, "rest") + f"""
SELECT r2.doc_id, r2.domain, r2.rank FROM r2 LEFT JOIN (SELECT domain AS d, count(*) AS have FROM old GROUP BY domain) ON d = r2.domain
WHERE r2.rank <= {_case(_QUOTA)} - coalesce(have, 0)""")
def selection_top_up(spark, d):
    """K8: a selection of 12 is filled up to 30; the ids it has stay and count."""
    docs = TD.documents(spark, d).where(F.col("kind") == "original").select("doc_id", "domain")
    old = SM.stratified_sample(docs, "doc_id", "domain", 12, SEED + 5, LANG_DOMAINS, strict=False).select("doc_id", "domain")
    return SM.top_up(docs, old, "doc_id", "domain", 30, SEED + 6, LANG_DOMAINS) \
        .select("doc_id", "domain", F.col("rank").cast("bigint").alias("rank"))


@query("element_cast", TD.ctes("vecs", "vecs_lin") + """
SELECT doc_id, len(original_doc_ids) AS n, list_sum(original_doc_ids) AS id_sum FROM vecs_lin""")
def element_cast(spark, d):
    """Ids stored as text in a list come back as numbers, element by element."""
    vl = TD.with_vector_lineage(TD.vectors(spark, d))
    path = FS.scratch_path(spark, "text-ids")
    FS.write_once(vl.select("doc_id", F.col("original_doc_ids").cast("array<string>").alias("ids")), path)
    back = spark.read.parquet(path).withColumn("ids", F.transform("ids", lambda x: x.cast("bigint")))
    total = F.when(F.size("ids") > 0, F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x))
    return back.select("doc_id", F.size("ids").cast("bigint").alias("n"), total.alias("id_sum"))


@query("decode_errors", TD.ctes("queries") + """
, r AS (SELECT query_id, CASE query_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '{"keypoints": [' WHEN 2 THEN 'no json' ELSE '{"keypoints": ["a"]}' END AS response FROM queries)
SELECT query_id, CASE WHEN response IS NULL THEN NULL ELSE NOT json_valid(response) END AS decode_error,
       CASE WHEN response IS NOT NULL AND json_valid(response) THEN 1 ELSE 0 END AS n_keypoints FROM r""")
def decode_errors(spark, d):
    """Responses cut off or without JSON are flagged; missing ones are neither right nor wrong."""
    k = F.col("query_id") % 4
    req = TD.queries(spark, d).select("query_id", F.col("query_id").cast("string").alias("request_id"))
    resp = req.select("request_id", F.when(k == 1, F.lit('{"keypoints": [')).when(k == 2, F.lit("no json"))
                      .when(k == 3, F.lit('{"keypoints": ["a"]}')).alias("response"))
    got = RQ.decode_responses(req, resp, "keypoints ARRAY<STRING>")
    return got.select("query_id", "decode_error", F.coalesce(F.when(~F.col("decode_error"), F.size("decoded.keypoints")), F.lit(0)).alias("n_keypoints"))


_NAMES = sorted(PR.DEFAULTS)


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query("prompt_lookup", TD.ctes("queries") + ", p AS (" + " UNION ALL ".join(
    f"SELECT {k} AS k, {_text(n)} AS prompt_name, {_text(PR.DEFAULTS[n][0])} AS s, {_text(PR.DEFAULTS[n][1])} AS u" for k, n in enumerate(_NAMES)) + f""")
SELECT q.query_id, p.prompt_name, md5(p.s) AS system_md5, md5(p.u) AS user_md5 FROM queries q JOIN p ON p.k = q.query_id % {len(_NAMES)}""")
def prompt_lookup(spark, d):
    """A4: templates written as JSON files, scanned, and attached to requests by name."""
    path = FS.scratch_path(spark, "prompts")
    PR.defaults(spark).write.json(path)
    names = F.array(*map(F.lit, _NAMES))
    requests = TD.queries(spark, d).select("query_id", F.element_at(names, (F.col("query_id") % len(_NAMES) + 1).cast("int")).alias("prompt_name"))
    table = spark.read.schema(PR.PROMPT_SCHEMA).json(path)
    return PR.lookup(requests, table).select("query_id", "prompt_name", F.md5("system_prompt").alias("system_md5"), F.md5("user_prompt").alias("user_md5"))


def _slots(name: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", PR.DEFAULTS[name][1])))


def _rendered_sql(name: str) -> str:
    out = _text(PR.DEFAULTS[name][1])
    for s in _slots(name):
        out = f"replace({out}, '{{{s}}}', '{s}: ' || content)"
    return f"SELECT query_id, {_text(name)} AS prompt_name, md5({out}) AS prompt_md5 FROM queries"


@query("render_templates", TD.ctes("queries") + " UNION ALL ".join(_rendered_sql(n) for n in _NAMES))
def render_templates(spark, d):
    """H5: all ten built-in templates, every placeholder filled."""
    q = TD.queries(spark, d).select("query_id", "content")
    parts = []
    for n in _NAMES:
        filled = q.withColumns({s: F.concat(F.lit(f"{s}: "), F.col("content")) for s in _slots(n)})
        parts.append(filled.select("query_id", F.lit(n).alias("prompt_name"), F.md5(T.render(PR.DEFAULTS[n][1], **{s: s for s in _slots(n)})).alias("prompt_md5")))
    return LN.union_corpus(parts)


@query("manipulate_tabular_queries", TD.ctes("docs") + MAPPING_SQL + f"""
SELECT {S.derived_id('m.query_id_tabular_manipulation', '3')} AS query_id, m.query_id_tabular_manipulation AS original_query_id,
       CAST({S.derived_id('m.doc_id', '3')} AS VARCHAR) AS doc_ids, md5('table: ' || b.text) AS answer_md5
FROM mapping m JOIN benchmark b ON b.item_id = m.query_id_tabular_manipulation""")
def manipulate_tabular_queries(spark, d):
    """Altered query rows of the tabular job, prefix 3."""
    q = TD.queries(spark, d)
    todo = doc_query_mapping(spark, d).select("doc_id", F.col("query_id_tabular_manipulation").alias("query_id")) \
        .join(q.select("query_id", "content"), "query_id")
    resp = todo.select("query_id", "doc_id", F.to_json(F.struct(F.lit("").alias("text_new"), F.concat(F.lit("table: "), F.col("content")).alias("answer_new"),
                                                                F.array().cast("array<string>").alias("references_new"))).alias("response"))
    dec = resp.select("query_id", "doc_id", J.decode("response", "single_textual").alias("decoded"))
    return RQ.altered_queries(q, dec, 3).select("query_id", "original_query_id", F.array_join("doc_ids", ",").alias("doc_ids"), F.md5("answer").alias("answer_md5"))


def _altered(docs, run: str):
    """Rows of the multi-textual job (prefix 4) whose response marks the run."""
    resp = docs.select("doc_id", F.to_json(F.struct(F.concat("content", F.lit(f"\n[{run}]")).alias("text_new"))).alias("response"))
    dec = resp.select("doc_id", J.decode("response", "text_new STRING").alias("decoded"))
    return RQ.altered_documents(docs, dec, 4).withColumn("run", F.lit(run))


@query("multi_altered_store", TD.ctes("docs") + f"""
, m AS (SELECT doc_id, content, domain, CASE domain WHEN 'en' THEN 'first' WHEN 'de' THEN 'third' ELSE 'second' END AS run
        FROM docs WHERE kind = 'multi_textual')
SELECT {S.derived_id('doc_id', '4')} AS doc_id, doc_id AS original_doc_id, run, md5(content || chr(10) || '[' || run || ']') AS content_md5 FROM m""")
def multi_altered_store(spark, d):
    """Three runs into one store. The first writes one domain; the second, with ``skip``, leaves those rows and adds
    the rest; the third, with ``override``, replaces another domain's rows."""
    docs = TD.documents(spark, d).where(F.col("kind") == "multi_textual").select("doc_id", "domain", "content")
    store = Store(spark, FS.scratch_path(spark, "multi"), ("doc_id",))
    store.create(_altered(docs.where("domain = 'en'"), "first"))
    store.append(_altered(docs, "second"), "skip")
    store.append(_altered(docs.where("domain = 'de'"), "third"), "override")
    out = store.read()
    return out.select("doc_id", F.get(F.col("original_doc_ids"), 0).alias("original_doc_id"), "run", F.md5("content").alias("content_md5"))


@query("pair_check_resumed", TD.ctes("vecs") + _PAIRS_SQL + f"""
, related AS (SELECT id1, id2, dist FROM allp WHERE dist > 0 AND dist <= {THRESHOLD}
              AND id1 IN (SELECT doc_id FROM documents) AND id2 IN (SELECT doc_id FROM documents))
SELECT id1, id2, model FROM related, (SELECT 'm1' AS model UNION ALL SELECT 'm2')
WHERE NOT (model = 'm1' AND dist <= 0.7)""")
def pair_check_resumed(spark, d):
    """Requests of a resumed pair check; what model m1 has answered, stored in reverse order, isn't asked again."""
    docs = TD.documents(spark, d)
    pairs, _ = stored(P.related_pairs(TD.vectors(spark, d), "vec_id", "embedding", THRESHOLD), SLIM_TABLE)
    done = pairs.where("dist <= 0.7").select(F.col("id2").alias("id1"), F.col("id1").alias("id2"), F.lit("m1").alias("model"))
    reqs = RQ.pair_requests(pairs.select("id1", "id2"), docs, "comparison/check_for_contradictions", ("m1", "m2"), done)
    return reqs.select("id1", "id2", "model")
