"""Registered queries of this package and their DuckDB SQL: one per operator, over the whole of its table."""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staleguard.llm import bpe, chat, fingerprint, langid, neardup, packing, pii, quality, runs, tokenfile, toxicity, warc, whitening
from staleguard.llm.shared import text_batches
from staleguard.session import checkpoint_dir
from staleguard.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2


def query(name: str, sql: str | None = None):
    """Registers ``fn(spark, sf_dir)``."""
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            checkpoint_dir(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return deco


FINGERPRINT_SQL = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
ring AS (
  SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text FROM docs),
edits AS (
  SELECT doc_id, text, next_text,
         substr(text, 1, length(text) - length(text) // 3) || substr(next_text, 1, length(text) // 3) AS edited FROM ring),
texts AS (
  SELECT doc_id, 1 AS part, text AS t FROM edits UNION ALL SELECT doc_id, 2, edited FROM edits UNION ALL SELECT doc_id, 3, next_text FROM edits),
hashed AS (
  SELECT doc_id, part, list_transform(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 4, 1) END),
                                      lambda i: substr(md5(array_to_string(w[i + 1:i + 5], ' ')), 1, 16)) AS h
  FROM (SELECT doc_id, part, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM texts)),
low AS (SELECT doc_id, part, h, list_filter(h, lambda x: x < '2') AS l FROM hashed),
sketches AS (SELECT doc_id, part, list_sort(list_distinct(CASE WHEN len(l) > 0 OR len(h) = 0 THEN l ELSE [list_min(h)] END)) AS s FROM low),
three AS (
  SELECT e.doc_id, e.text, e.edited, a.s AS own, b.s AS ed, c.s AS nx
  FROM edits e JOIN sketches a ON a.doc_id = e.doc_id AND a.part = 1
  JOIN sketches b ON b.doc_id = e.doc_id AND b.part = 2 JOIN sketches c ON c.doc_id = e.doc_id AND c.part = 3)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
       array_to_string(own, ',') AS fingerprint, array_to_string(ed, ',') AS edited_fingerprint,
       CASE WHEN len(own) + len(ed) = 0 THEN 1.0 ELSE len(list_intersect(own, ed))::DOUBLE / len(list_distinct(own || ed)) END AS near_edited,
       CASE WHEN len(own) + len(nx) = 0 THEN 1.0 ELSE len(list_intersect(own, nx))::DOUBLE / len(list_distinct(own || nx)) END AS near_next,
       CASE WHEN len(own) = 0 THEN 1.0 ELSE len(list_intersect(own, ed))::DOUBLE / len(own) END AS contained_in_edited
FROM three
"""


@query("op1_scaled_fingerprint", FINGERPRINT_SQL)
def scaled_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprint.edited_pairs(load(spark, sf_dir, "documents", "doc_id", "text"))
    own, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return pairs.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint.fingerprint_text(own).alias("fingerprint"), fingerprint.fingerprint_text(edited).alias("edited_fingerprint"),
        fingerprint.likeness(own, edited).alias("near_edited"), fingerprint.likeness(own, following).alias("near_next"),
        fingerprint.containment(own, edited).alias("contained_in_edited"))


NEAR_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(0, len(w) - 2), lambda i: array_to_string(w[i + 1:i + 3], ' ')) END) AS s FROM w),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, c.component_id, sets.doc_id = c.component_id AS kept
FROM sets JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = sets.doc_id
"""


@query("op2_minhash_near_dedup", NEAR_SQL)
def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    return neardup.near_duplicates(docs, "doc_id", "text", k=3, num=85, den=100)


@query("op3_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack_documents(docs, "doc_id", "text", BYTE_BPE, END_ID)


@query("op4_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")

    def digest(batches):
        own = bpe.word_bpe(WORD_BPE)
        for batch in batches:
            out = [[], [], []]
            for text in batch.column(1).to_pylist():
                ids = own.encode(text or "")
                back = own.decode(ids)
                for col, v in zip(out, (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode("utf-8")).hexdigest())):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()),
                                              pa.array(out[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return text_batches(docs).mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op5_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    folder = tokenfile.write_token_files(docs, "doc_id", "text", WORD_BPE, END_ID)

    def checksums(ids, starts, sizes, arrays):
        crc = [zlib.crc32(np.asarray(a).astype("<u4").tobytes()) for a in arrays]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(starts), pa.array(sizes), pa.array(crc, pa.int64())],
                                          names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokenfile.read_token_files(spark, folder, checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op6_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    model = quality.fit_quality(docs, load(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.score_quality(docs, model)


def fold_of(n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.ToxicityModel:
    """Learned from the labels outside the held-out fold."""
    labels = load(spark, sf_dir, "labels", "doc_id", "toxic").filter(fold_of(5) != 0)
    return toxicity.fit_toxicity(docs, labels)


@query("op7_compression_toxicity")
def compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    scored = toxicity.score_toxicity(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", (fold_of(5) == 0).alias("held_out"), "score", "predicted")


@query("op8_language_codes")
def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.fit_languages(docs.filter(fold_of(3) != 1))
    return langid.identify_languages(docs, model) \
        .select("doc_id", (fold_of(3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


SPOKEN = "</s>[INST] ok [/INST]"


@query("op9_chat_format")
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", SPOKEN), (-1, 1, "assistant", SPOKEN)], rows.schema)
    turns = chat.format_turns(rows.unionAll(extra), BYTE_BPE)
    return chat.conversation_digests(turns, BYTE_BPE).withColumnRenamed("conv", "conv_id")


@query("op10_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    found = pii.find_personal_data(docs, pii.fit_field(docs))
    base = F.filter(F.split("base_spans", ","), lambda s: s != "")
    number = lambda kind: F.size(F.filter(base, lambda s: s.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, pii.KINDS), F.sha2("base_spans", 256).alias("base_sha256"), "spans")


PAYLOAD_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
held AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS holder FROM p),
said AS (SELECT *, payload_bytes >= 1000 AND page_id IS DISTINCT FROM holder AS again FROM held)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN holder END AS refers_to FROM said
"""


@query("op11_capture_index", PAYLOAD_SQL)
def capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives and index are written, every page is looked up in the index by its URL and id, and its record read."""
    pages = load(spark, sf_dir, "pages", "page_id", "url", "html")
    folder = warc.write_index(warc.write_archives(pages, "page_id", "url", "html"))
    records = warc.read_records(warc.lookup(warc.keys_of(pages, "page_id", "url"), folder))
    return records.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


@query("op12_whitening")
def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return whitening.whiten(rows, "vec_id", "embedding", whitening.fit_whitening(rows, "embedding"))


def with_planted_tail(docs: DataFrame) -> DataFrame:
    """The texts of ids whose crc32 is divisible by 10 with their words from some place on made periodic; the others as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    split = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    n = F.size("w")
    placed = split.select("doc_id", "text", "w", F.when(n > 0, F.struct(
        (F.col("g") % n).alias("a"), (1 + F.floor((n - F.col("g") % n) / (3 + F.col("g") % 8))).alias("p"))).alias("tail"))
    a, p = F.col("tail.a"), F.col("tail.p")
    again = F.transform("w", lambda w, i: F.when(i < a, w).otherwise(F.element_at("w", (a + (i - a) % p + 1).cast("int"))))
    return placed.select("doc_id", F.when(F.col("tail").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_planted_tail(load(spark, sf_dir, "documents", "doc_id", "text")), "doc_id", "text")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    top = found.withColumn("top", runs.strongest(F.col("runs")))
    return top.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
                      F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
                      F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
