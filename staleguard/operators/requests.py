"""Model work as request / response tables.

No network: a job emits a request table ``(request_id, model, prompt_name,
system_prompt, user_prompt, ...)``; whatever answers it (an external batch
process, or a ``scorer`` run with ``mapInPandas``) returns
``(request_id, response)`` JSON text, which is decoded with ``from_json``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staleguard.functions import json as J
from staleguard.functions import text as T
from staleguard.operators import resume as RS
from staleguard.session import materialize
from staleguard.sources import prompts as PR


def request_id(*cols) -> "F.Column":
    return F.sha2(F.concat_ws("|", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]), 256)


def pair_requests(pairs: DataFrame, docs: DataFrame, prompt_name: str, model: str | tuple[str, ...],
                  done: DataFrame | None = None, digest: bool = False) -> DataFrame:
    """Pair-check / extraction requests for unprocessed unordered pairs (K9, K10 front half).

    With several models every pair row becomes one row per model, so the pairs are computed once. That is after the pair has met
    ``done`` and its texts, so that both travel once per pair. ``digest`` gives ``prompt_sha256`` in place of the prompt: where
    documents have many pairs each, no text is moved per pair then (``resume.pair_digests``).
    """
    models = F.array(*map(F.lit, (model,) if isinstance(model, str) else model))
    system, user = PR.get(prompt_name)
    asked = pairs.withColumn("_models", models) if done is None else RS.open_models(pairs, done, models)
    if digest:
        t = RS.pair_digests(asked, docs, "doc_id", "content", T.template_parts(user), "prompt_sha256").withColumn("model", F.explode("_models"))
        return t.select("id1", "id2", "model", F.lit(prompt_name).alias("prompt_name"), "prompt_sha256", request_id("id1", "id2", "model").alias("request_id"))
    t = RS.pair_texts(asked, docs, "doc_id", "content").withColumn("model", F.explode("_models"))
    return t.select("id1", "id2", "model", F.lit(prompt_name).alias("prompt_name"),
                    F.lit(system).alias("system_prompt"),
                    T.render(user, text1="text1", text2="text2").alias("user_prompt"),
                    request_id("id1", "id2", "model").alias("request_id"))


def answered(requests: DataFrame, response, once: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(requests, responses) of a job that answers each request where it is rendered: the tables are written with the SHA-256 of
    the prompt in place of its text, so that what lies on disk doesn't hold both texts of every pair.

    ``once`` says that no request comes twice: then the responses stay with their requests, nothing is written, and there is no
    second table. Pairs grow with the square of the documents, and so would both tables and the shuffles of their join.
    """
    kept = [c for c in requests.columns if c not in ("system_prompt", "user_prompt")]
    digest = [] if "prompt_sha256" in kept else [F.unhex(F.sha2("user_prompt", 256)).alias("prompt_sha256")]
    both = requests.select(*kept, *digest, response.alias("response"))
    if once:
        return both, None
    both = materialize(both)
    return both.drop("response"), both.select("request_id", "response")


def run_scorer(requests: DataFrame, scorer: Callable, schema: str = "request_id string, response string") -> DataFrame:
    """Optional in-cluster scorer: ``scorer(pandas_df) -> pandas_df(request_id, response)`` per Arrow batch."""
    def fn(it):
        for pdf in it:
            yield scorer(pdf)
    return requests.mapInPandas(fn, schema)


def decode_responses(requests: DataFrame, responses: DataFrame | None, shape: str) -> DataFrame:
    """Join responses to requests (unless they hold them: None) and decode; undecodable responses give null fields and ``decode_error``."""
    met = requests if responses is None else requests.join(responses, "request_id", "left")
    return met.withColumn("decoded", J.decode("response", shape)) \
        .withColumn("decode_error", J.undecodable("response"))


def verdict_rows(decoded: DataFrame) -> DataFrame:
    """(id1, id2, conflicts, model, prompt) from decoded pair-check responses (K9)."""
    return decoded.select("id1", "id2", F.col("decoded.contradictory_info_found").alias("conflicts"), "model",
                          F.col("prompt_name").alias("prompt"))


def conflict_rows(decoded: DataFrame) -> DataFrame:
    """Explode extracted contradictions.

    A pair with no contradiction keeps one sentinel row with null passages and
    ``conflicts_found = false`` so the pair counts as processed.
    """
    c = F.coalesce(F.col("decoded.contradictions"),
                   F.array().cast("array<struct<quote_from_document1:string,quote_from_document2:string>>"))
    x = decoded.select("id1", "id2", "model", c.alias("c"))
    return x.select("id1", "id2", "model", F.size("c").alias("n_contradictions"),
                    F.explode_outer("c").alias("q")).select(
        "id1", "id2", "model", "n_contradictions",
        F.col("q.quote_from_document1").alias("conflicting_passage_doc1"),
        F.col("q.quote_from_document2").alias("conflicting_passage_doc2"),
        (F.col("n_contradictions") > 0).alias("conflicts_found"))


def altered_documents(src: DataFrame, decoded: DataFrame, prefix: int) -> DataFrame:
    """New document rows from single-textual responses (B16): new id, new text, lineage."""
    j = src.join(decoded.select("doc_id", "decoded"), "doc_id")
    return j.select(T.derived_id("doc_id", prefix).alias("doc_id"), "domain",
                    F.col("decoded.text_new").alias("content"),
                    F.array(F.col("doc_id").cast("bigint")).alias("original_doc_ids"))


def altered_queries(queries: DataFrame, decoded: DataFrame, prefix: int) -> DataFrame:
    """New query rows (B17): new id, new answer and references, empty keypoints, back-pointer."""
    j = queries.join(decoded.select("query_id", "doc_id", "decoded"), "query_id")
    return j.select(T.derived_id("query_id", prefix).alias("query_id"), F.col("query_id").alias("original_query_id"),
                    "content", F.col("decoded.answer_new").alias("answer"),
                    F.array(T.derived_id("doc_id", prefix)).alias("doc_ids"),
                    F.col("decoded.references_new").alias("references"),
                    F.array().cast("array<string>").alias("keypoints"))


def tabular_documents(rows: DataFrame, domain_ids: DataFrame) -> DataFrame:
    """One document per domain from its fact rows.

    Rows: (domain, doc_id, ord, content, company_name, court_name, hospital_patient_name).
    The group is the bounded set of rows produced for one domain by the job.
    Entity lists keep nulls and are [] when every value is null.
    """
    def keep_nulls(c):
        return F.when(F.count(c) == 0, F.array().cast("array<string>")).otherwise(
            F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col(c).alias("v")))), lambda s: s["v"]))
    g = rows.groupBy("domain").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda s: s["content"]),
                     "\n").alias("content"),
        keep_nulls("company_name").alias("company_names"), keep_nulls("court_name").alias("court_names"),
        keep_nulls("hospital_patient_name").alias("hospital_patient_names"),
        F.array_sort(F.collect_list("doc_id")).alias("original_doc_ids"))
    return g.join(F.broadcast(domain_ids), "domain", "left")


def single_alteration_requests(mapping: DataFrame, docs: DataFrame, queries: DataFrame, prompt_name: str, prefix: int,
                               done_docs: DataFrame | None = None, done_queries: DataFrame | None = None) -> DataFrame:
    """Front half of the single-textual and single-tabular jobs (K5, K6): a rendered request per (doc_id, query_id) of ``mapping``.

    ``docs``: doc_id, content, entity; ``queries``: query_id, question, answer, references. The templates take what they name of
    text, question, answer, references (as a JSON list) and entity. Pairs whose altered document or query (the id with ``prefix``)
    is in ``done_docs`` (doc_id) or ``done_queries`` (query_id) aren't asked again; either table may be absent.
    """
    system, user = PR.get(prompt_name)
    asked = mapping.select("doc_id", "query_id", T.derived_id("doc_id", prefix).alias("new_doc_id"), T.derived_id("query_id", prefix).alias("new_query_id"))
    if done_docs is not None:
        asked = asked.join(done_docs.select(F.col("doc_id").alias("new_doc_id")), "new_doc_id", "left_anti")
    if done_queries is not None:
        asked = asked.join(done_queries.select(F.col("query_id").alias("new_query_id")), "new_query_id", "left_anti")
    full = asked.join(docs.select("doc_id", F.col("content").alias("text"), "entity"), "doc_id") \
        .join(queries.select("query_id", "question", "answer", F.to_json("references").alias("references")), "query_id")
    return full.select("doc_id", "query_id", "new_doc_id", "new_query_id", F.lit(prompt_name).alias("prompt_name"), F.lit(system).alias("system_prompt"),
                       T.render(user, text="text", question="question", answer="answer", references="references", entity="entity").alias("user_prompt"),
                       request_id("doc_id", "query_id", F.lit(prompt_name)).alias("request_id"))


def multi_textual_requests(docs: DataFrame, qa: DataFrame, entity_col: str = "entity") -> DataFrame:
    """K7 front half: per document its QA pairs (H8, ordered by query id), numbered (H7) and rendered.

    ``qa``: (doc_id, query_id, question, answer). The group is one document's
    queries (bounded by the queries that reference the document).
    """
    g = qa.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("query_id", "question", "answer"))).alias("qa"))
    system, user = PR.get("manipulations/manipulation_multi_textual")
    j = docs.join(g, "doc_id")
    return j.select("doc_id", "content", "qa", F.lit(system).alias("system_prompt"),
                    T.render(user, text="content", entity=F.coalesce(F.col(entity_col), F.lit("")),
                             questions=T.numbered_qa("qa")).alias("user_prompt"),
                    request_id("doc_id", F.lit("multi")).alias("request_id"))


def match_returned_pairs(decoded: DataFrame, qa: DataFrame) -> DataFrame:
    """C12 for K7: returned QA pairs matched to the document's queries on case-folded,
    stripped question text; the first returned pair wins per query."""
    from pyspark.sql import Window
    ret = decoded.select("doc_id", F.posexplode("decoded.qa_pairs_new").alias("pos", "p")).select(
        "doc_id", "pos", F.lower(T.py_strip(F.col("p.question"))).alias("_k"),
        F.col("p.answer").alias("answer_new"), F.col("p.quote").alias("quote"))
    q = qa.select("doc_id", "query_id", F.lower(T.py_strip(F.col("question"))).alias("_k"))
    j = q.join(ret, ["doc_id", "_k"])
    w = Window.partitionBy("doc_id", "query_id").orderBy("pos")
    return j.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn", "_k")


def apply_on_exist(new_rows: DataFrame, existing: DataFrame | None, key: str, on_exist: str) -> DataFrame:
    """``skip``: keep only rows whose key is not stored yet; ``override``: keep all (the stored
    rows with these keys are replaced by the caller's delete + append)."""
    if existing is None or on_exist == "override":
        return new_rows
    if on_exist == "skip":
        return new_rows.join(existing.select(key), key, "left_anti")
    raise ValueError(on_exist)
