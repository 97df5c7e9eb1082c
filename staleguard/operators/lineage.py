"""Lineage, corpus and pair-truth operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staleguard.functions import arrays as A


def union_corpus(parts: list[DataFrame]) -> DataFrame:
    """Bag union by column name; columns missing in a part become null (G1)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def select_corpus(corpus: DataFrame, which: str | None, kind_col: str = "kind") -> DataFrame:
    """``None`` (all), ``'original_only'`` or ``'manipulated_only'``."""
    if which is None:
        return corpus
    if which == "original_only":
        return corpus.where(F.col(kind_col) == "original")
    if which == "manipulated_only":
        return corpus.where(F.col(kind_col) != "original")
    raise ValueError(which)


def flatten_structs(df: DataFrame, struct_cols: list[str]) -> DataFrame:
    """Replace struct columns by ``parent.child`` columns, all columns sorted by name."""
    cols = []
    for f in df.schema.fields:
        if f.name in struct_cols:
            for c in f.dataType.fields:
                cols.append(F.col(f"`{f.name}`.`{c.name}`").alias(f"{f.name}.{c.name}"))
        else:
            cols.append(F.col(f"`{f.name}`"))
    out = df.select(*cols)
    return out.select(*[F.col(f"`{c}`") for c in sorted(out.columns)])


def symmetric_difference(a: DataFrame, b: DataFrame, a_tag: str, b_tag: str) -> DataFrame:
    """Rows only in ``a`` and rows only in ``b`` (tagged); empty means the sets agree."""
    a, b = a.distinct(), b.distinct()
    return a.exceptAll(b).select(F.lit(a_tag).alias("side"), "*") \
        .unionByName(b.exceptAll(a).select(F.lit(b_tag).alias("side"), "*"))


def with_ground_truth(pairs: DataFrame, docs: DataFrame, id_col: str = "doc_id",
                      orig_col: str = "original_doc_ids", few: bool = False) -> DataFrame:
    """Add ``ground_truth``: the two documents are lineage-related.

    Two equi-joins on the document id; no per-row lookup. ``few`` documents are broadcast, so that the pairs aren't moved.
    """
    side = F.broadcast if few else lambda df: df
    a = side(docs.select(F.col(id_col).alias("id1"), F.col(orig_col).alias("_o1")))
    b = side(docs.select(F.col(id_col).alias("id2"), F.col(orig_col).alias("_o2")))
    j = pairs.join(a, "id1").join(b, "id2")
    return j.withColumn("ground_truth", A.related_pair("id1", "_o1", "id2", "_o2")).drop("_o1", "_o2")


def lineage_join(docs: DataFrame, id_col: str = "doc_id", orig_col: str = "original_doc_ids") -> DataFrame:
    """(doc_id, orig, <original's columns prefixed orig_>) for every lineage link."""
    links = docs.select(F.col(id_col).alias("doc_id"), F.explode(orig_col).alias("orig"))
    o = docs.select([F.col(id_col).alias("orig")] +
                    [F.col(c).alias(f"orig_{c}") for c in docs.columns if c not in (id_col, orig_col)])
    return links.join(o, "orig")


def candidate_pairs(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(id1, id2, expected) for both orientations of every related pair (C4).

    The truth is the same for both, so a pair meets its documents once and is turned round afterwards.
    """
    known = with_ground_truth(pairs.select("id1", "id2"), docs).withColumnRenamed("ground_truth", "expected")
    return known.select(F.inline(F.array(F.struct("id1", "id2", "expected"), F.struct(F.col("id2").alias("id1"), F.col("id1").alias("id2"), "expected"))))


def known_conflict_pairs(docs: DataFrame, kind_col: str = "kind", id_col: str = "doc_id",
                         orig_col: str = "original_doc_ids") -> DataFrame:
    """Pairs that must conflict (C17): every (copy, original) link, plus every
    single-textual copy with each tabular document built from its first original."""
    links = docs.select(F.col(id_col).alias("id1"), F.explode(orig_col).alias("id2"), F.lit("lineage").alias("why"))
    single = docs.where(F.col(kind_col) == "single_textual").where(F.size(orig_col) > 0) \
        .select(F.col(id_col).alias("id1"), F.get(F.col(orig_col), 0).alias("_first"))
    tab = docs.where(F.col(kind_col) == "tabular") \
        .select(F.col(id_col).alias("id2"), F.explode(orig_col).alias("_first"))
    cross = single.join(tab, "_first").select("id1", "id2", F.lit("tabular").alias("why"))
    return links.unionByName(cross)


def known_conflict_counts(docs: DataFrame, kind_col: str = "kind", orig_col: str = "original_doc_ids") -> DataFrame:
    """(original, lineage_pairs, tabular_pairs): how many pairs of ``known_conflict_pairs`` come from each original (C17).

    Copies times tabular documents of one original is a product of two counts, so that one partial aggregation over the
    links gives it and no pair is ever a row, however many copies an original has. Null and empty lists add nothing.
    """
    links = docs.select(F.col(kind_col).alias("_kind"), F.posexplode(orig_col).alias("_pos", "original"))
    n = links.groupBy("original").agg(F.count("*").alias("lineage_pairs"),
                                      F.count_if((F.col("_kind") == "single_textual") & (F.col("_pos") == 0)).alias("_single"),
                                      F.count_if(F.col("_kind") == "tabular").alias("_tab"))
    return n.select("original", "lineage_pairs", (F.col("_single") * F.col("_tab")).alias("tabular_pairs"))
