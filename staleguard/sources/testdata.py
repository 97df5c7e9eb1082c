"""Adapters from the bundled test tables to the toolkit's concepts.

Each adapter is a Spark builder plus its DuckDB twin (a CTE body in ``SQL``);
the oracle queries in ``staleguard.plans`` are composed from the same CTEs so
both engines derive identical inputs.

Rules (stated once):
- documents: ``domain = lang``, ``content = text``; ``kind`` from the number
  in ``source`` mod 4 (0 original, 1 single_textual, 2 tabular, 3 multi_textual);
  ``creation_date`` by kind (2000-01-01, 2005-01-01, 2015-01-01, 2010-01-01).
- text lineage: the smallest ``doc_id`` among documents with the same text is
  the original; the others list it in ``original_doc_ids``.
- vector lineage: the smallest ``vec_id`` of a label is that label's original;
  every other vector points to it, and label-0 vectors also to label 1's.
- queries: one per ``benchmark`` item; its text is the question, the ground
  truth and the single reference; ``query_type`` is 'Multi-hop Question' for
  texts with a line break, else 'Factual Question'.
- question/answer pairs: a user turn followed by an assistant turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staleguard.config import PY_WHITESPACE
from staleguard.functions import text as T
from staleguard.sources.tables import load

KINDS = ["original", "single_textual", "tabular", "multi_textual"]
KIND_DATES = {"original": "2000-01-01", "single_textual": "2005-01-01",
              "tabular": "2015-01-01", "multi_textual": "2010-01-01"}


def _kind_col():
    n = F.pmod(F.regexp_extract("source", r"([0-9]+)$", 1).cast("int"), F.lit(4))
    expr = F.when(n == 0, F.lit(KINDS[0]))
    for i in range(1, 4):
        expr = expr.when(n == i, F.lit(KINDS[i]))
    return expr


def _date_col(kind):
    expr = None
    for k, d in KIND_DATES.items():
        expr = F.when(kind == k, F.to_date(F.lit(d))) if expr is None else expr.when(kind == k, F.to_date(F.lit(d)))
    return expr


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    kind = _kind_col()
    return d.select("doc_id", F.col("lang").alias("domain"), F.col("text").alias("content"), "source",
                    kind.alias("kind")).withColumn("creation_date", _date_col(F.col("kind")))


def with_text_lineage(docs: DataFrame, *kept) -> DataFrame:
    """Add ``original_doc_ids``: [] for originals, [min id with the same text] for copies; of ``docs`` the id and ``kept``, by default all columns.

    Copies are found on (id, SHA-256 of the text) rows alone: the aggregate is partial per partition, so a huge group
    of copies costs one row per partition, and the join back moves no text. The texts then meet their lineage by
    document id, a key without hot values.
    """
    keyed = docs.select("doc_id", F.sha2(F.col("content"), 256).alias("_tk"))
    first = keyed.groupBy("_tk").agg(F.min("doc_id").alias("_orig"))
    out = (docs.select("doc_id", *kept) if kept else docs).join(keyed.join(first, "_tk").select("doc_id", "_orig"), "doc_id")
    lineage = F.when(F.col("doc_id") == F.col("_orig"), F.array().cast("array<bigint>")) \
        .otherwise(F.array(F.col("_orig")))
    return out.withColumn("original_doc_ids", lineage).drop("_orig")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings", "vec_id", "embedding", "label") \
        .withColumn("embedding", F.col("embedding").cast("array<double>"))


def with_vector_lineage(vecs: DataFrame) -> DataFrame:
    """Add ``original_doc_ids`` (see module rules); ``vec_id`` becomes ``doc_id``.

    The per-label table is an aggregate joined back on ``label``; AQE
    broadcasts it from its runtime size or splits a hot label's partition.
    """
    first = vecs.groupBy("label").agg(F.min("vec_id").alias("_first"))
    # label 0 also points to label 1's first vector: shift the key (an expression, not a literal,
    # so the join stays an equi-join instead of being folded into a nested loop)
    second = first.select((F.col("label") - 1).cast(vecs.schema["label"].dataType).alias("label"),
                          F.col("_first").alias("_first1")).where(F.col("label") == 0)
    out = vecs.join(first, "label", "inner").join(second, "label", "left")
    lineage = (F.when(F.col("vec_id") == F.col("_first"), F.array().cast("array<bigint>"))
               .when(F.col("_first1").isNotNull(), F.array(F.col("_first"), F.col("_first1")))
               .otherwise(F.array(F.col("_first"))))
    return out.withColumn("original_doc_ids", lineage).drop("_first", "_first1") \
        .withColumnRenamed("vec_id", "doc_id")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = load(spark, sf_dir, "benchmark", "item_id", "text")
    qtype = F.when(F.col("text").contains("\n"), F.lit("Multi-hop Question")).otherwise(F.lit("Factual Question"))
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("content"),
                    qtype.alias("query_type"), F.array(F.col("text")).alias("references"))


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, question, answer): a user turn and the assistant turn after it."""
    from pyspark.sql import Window as W
    c = load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    w = W.partitionBy("conv_id").orderBy("turn")
    nxt = c.withColumn("_nrole", F.lead("role").over(w)).withColumn("_ntext", F.lead("text").over(w))
    return nxt.where((F.col("role") == "user") & (F.col("_nrole") == "assistant")) \
        .select("conv_id", "turn", F.col("text").alias("question"), F.col("_ntext").alias("answer"))


def first_line(c):
    return F.substring_index(T.py_strip(c), "\n", 1)


def last_line(c):
    return F.substring_index(T.py_strip(c), "\n", -1)


def conflicts(docs: DataFrame) -> DataFrame:
    """Conflict rows between each copy and its original.

    (id1 = original, id2 = copy, passage1 = first line of the original,
    passage2 = last line of the copy). Only linear pairs (copy, original) are
    emitted, never all pairs inside a group of copies. The lines are cut before
    the documents meet their lineage, so that no whole text is moved.
    """
    lined = with_text_lineage(docs, last_line(F.col("content")).alias("conflicting_passage_doc2"), first_line(F.col("content")).alias("conflicting_passage_doc1"))
    copies = lined.where(F.size("original_doc_ids") > 0) \
        .select(F.col("doc_id").alias("id2"), F.get(F.col("original_doc_ids"), 0).alias("id1"), "conflicting_passage_doc2")
    orig = lined.select(F.col("doc_id").alias("id1"), "conflicting_passage_doc1")
    return copies.join(orig, "id1", "inner").select(
        "id1", "id2", F.lit("fixture").alias("model"), "conflicting_passage_doc1", "conflicting_passage_doc2")


# --- DuckDB twins ------------------------------------------------------------
_WS = " || ".join(f"chr({ord(ch)})" for ch in PY_WHITESPACE)

SQL = {
    "docs": """
        SELECT doc_id, lang AS domain, text AS content, source,
               CASE (CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 4)
                    WHEN 0 THEN 'original' WHEN 1 THEN 'single_textual'
                    WHEN 2 THEN 'tabular' ELSE 'multi_textual' END AS kind,
               CASE (CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 4)
                    WHEN 0 THEN DATE '2000-01-01' WHEN 1 THEN DATE '2005-01-01'
                    WHEN 2 THEN DATE '2015-01-01' ELSE DATE '2010-01-01' END AS creation_date
        FROM documents""",
    "docs_lin": """
        SELECT d.*, CASE WHEN d.doc_id = m.orig THEN CAST([] AS BIGINT[]) ELSE [m.orig] END AS original_doc_ids
        FROM docs d JOIN (SELECT content, min(doc_id) AS orig FROM docs GROUP BY content) m USING (content)""",
    "vecs": """
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings""",
    "vecs_lin": """
        SELECT v.vec_id AS doc_id, v.embedding, v.label,
               CASE WHEN v.vec_id = f.m THEN CAST([] AS BIGINT[])
                    WHEN v.label = 0 AND f1.m IS NOT NULL THEN [f.m, f1.m]
                    ELSE [f.m] END AS original_doc_ids
        FROM vecs v JOIN (SELECT label, min(vec_id) AS m FROM vecs GROUP BY label) f USING (label)
        LEFT JOIN (SELECT 0 AS label, min(vec_id) AS m FROM vecs WHERE label = 1 HAVING count(*) > 0) f1
          ON v.label = f1.label""",
    "queries": """
        SELECT item_id AS query_id, text AS content,
               CASE WHEN contains(text, chr(10)) THEN 'Multi-hop Question' ELSE 'Factual Question' END AS query_type,
               [text] AS "references"
        FROM benchmark""",
    "qa": """
        SELECT conv_id, turn, question, answer FROM (
          SELECT conv_id, turn, role, text AS question,
                 lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nrole,
                 lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer
          FROM conversations) WHERE role = 'user' AND nrole = 'assistant'""",
    "conflicts": f"""
        SELECT c.original_doc_ids[1] AS id1, c.doc_id AS id2, 'fixture' AS model,
               string_split(trim(o.content, {_WS}), chr(10))[1] AS conflicting_passage_doc1,
               string_split(trim(c.content, {_WS}), chr(10))[-1] AS conflicting_passage_doc2
        FROM docs_lin c JOIN docs_lin o ON o.doc_id = c.original_doc_ids[1]
        WHERE len(c.original_doc_ids) > 0""",
}

WS_SQL = _WS


def ctes(*names: str) -> str:
    """WITH clause holding the named adapters (dependencies first)."""
    deps = {"docs_lin": ["docs"], "vecs_lin": ["vecs"], "conflicts": ["docs", "docs_lin"]}
    order: list[str] = []

    def add(n):
        for d in deps.get(n, []):
            add(d)
        if n not in order:
            order.append(n)
    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
