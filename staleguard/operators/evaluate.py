"""Scoring aggregates.

Scalar reports are built by *union-then-aggregate*: every source contributes
rows tagged with indicator columns and one global aggregate (partial per
partition, a single tiny final merge) produces the report row. No scalar is
pulled to the driver and no one-row tables are cross joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staleguard.functions import arrays as A
from staleguard.operators import pairs as P
from staleguard.session import materialize


def _not_tabular(id_col) -> "F.Column":
    """Ids whose decimal text starts with '3' are tabular documents."""
    return ~F.col(id_col).cast("string").startswith("3")


def lineage_links(docs: DataFrame, id_col: str = "doc_id", orig_col: str = "original_doc_ids") -> DataFrame:
    """(doc_id, orig): one row per lineage link (originals contribute none)."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(orig_col).alias("orig"))


def _links_with_pairs(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id1, id2, nl, nlt, found, nd): lineage links of a pair (all, not tabular), and whether the pair is related.

    Links and pairs meet in one aggregation, so the pair table, the costly input, is read once. The key (null, null)
    holds the number of documents.
    """
    null, zero = F.lit(None).cast("bigint"), F.lit(0).cast("bigint")
    links = lineage_links(docs).select(F.least("doc_id", "orig").alias("id1"), F.greatest("doc_id", "orig").alias("id2"),
                                       F.lit(1).cast("bigint").alias("l"), _not_tabular("doc_id").cast("bigint").alias("lt"),
                                       F.lit(None).cast("int").alias("g"), zero.alias("d"))
    found = pairs.select("id1", "id2", zero.alias("l"), zero.alias("lt"), F.lit(1).alias("g"), zero.alias("d"))
    size = docs.select(null.alias("id1"), null.alias("id2"), zero.alias("l"), zero.alias("lt"), F.lit(None).cast("int").alias("g"),
                       F.lit(1).cast("bigint").alias("d"))
    return links.unionByName(found).unionByName(size).groupBy("id1", "id2").agg(
        F.sum("l").alias("nl"), F.sum("lt").alias("nlt"), F.min("g").alias("found"), F.sum("d").alias("nd"))


def distance_recall(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """recall, recall_without_tabular (per lineage link) and avg_comparisons (mean related docs)."""
    met = _links_with_pairs(docs, pairs)
    hit = F.col("found").isNotNull()
    share = lambda c: F.try_divide(F.sum(F.when(hit, F.col(c)).otherwise(0)).cast("double"), F.sum(c).cast("double"))
    return met.agg(share("nl").alias("recall"), share("nlt").alias("recall_without_tabular"),
                   F.try_divide(F.lit(2.0) * F.count("found"), F.sum("nd").cast("double")).alias("avg_comparisons"))


def distance_recall_of_vectors(docs: DataFrame, vecs: DataFrame, threshold: float, metric: str = "cosine",
                               id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``distance_recall`` of the related pairs of ``vecs``, without a row per pair.

    The links get their own distances by two joins, all other pairs are counted inside their distance block. Where an id is
    null or names several vectors, a pair may be found more than once and counts once, which only its rows can tell:
    then the pairs themselves are related.
    """
    prep = P.prepare(vecs, id_col, vec_col)
    repeated = lambda df: df.groupBy("id").count().where("count > 1 OR id IS NULL")
    if not repeated(prep).isEmpty():
        prep = materialize(prep.distinct())  # copies of whole rows say nothing new
        if not repeated(prep).isEmpty():
            return distance_recall(docs, P.related_pairs(vecs, id_col, vec_col, threshold, metric))
    zero = F.lit(0).cast("bigint")
    links = P.link_distances(lineage_links(docs), prep, "id", "v", metric, as_blocks=True)
    hit = F.coalesce((F.col("dist") > 0) & (F.col("dist") <= float(threshold)), F.lit(False)).cast("bigint")
    rows = links.select(F.lit(1).cast("bigint").alias("l"), _not_tabular("doc_id").cast("bigint").alias("lt"), hit.alias("h"), zero.alias("np"), zero.alias("nd")) \
        .unionByName(P.level_counts(prep, "id", "v", [float(threshold)], metric).select(zero.alias("l"), zero.alias("lt"), zero.alias("h"), "np", zero.alias("nd"))) \
        .unionByName(docs.select(zero.alias("l"), zero.alias("lt"), zero.alias("h"), zero.alias("np"), F.lit(1).cast("bigint").alias("nd")))
    share = lambda c: F.try_divide(F.sum(F.col(c) * F.col("h")).cast("double"), F.sum(c).cast("double"))
    return rows.agg(share("l").alias("recall"), share("lt").alias("recall_without_tabular"),
                    F.try_divide(F.lit(2.0) * F.sum("np"), F.sum("nd").cast("double")).alias("avg_comparisons"))


def threshold_sweep(docs: DataFrame, vecs: DataFrame, grid: list[float], target: float = 0.99,
                    metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Recall and comparisons for the thresholds of ``grid`` up to the first whose recall reaches ``target`` (``selected``).

    Two phases. The lineage links get their own distances by two joins, which fixes every recall and so the level at which the
    sweep stops (the last of the grid, if none reaches the target). Only then all other pairs are counted, per level and
    inside their distance block, in a join with that level as its radius: no pair is a row, and none beyond it is looked for.
    """
    spark = docs.sparkSession
    levels = [float(t) for t in grid]
    links = P.link_distances(lineage_links(docs), vecs, id_col, vec_col, metric)
    at = F.when(F.col("dist") > 0, F.expr(f"array_position(transform(array({', '.join(map(repr, levels))}), t -> dist <= t), true)") - 1)
    per = {r["gi"]: r for r in links.select(at.alias("gi"), _not_tabular("doc_id").cast("bigint").alias("nt"))
           .groupBy("gi").agg(F.count("*").alias("n"), F.sum("nt").alias("nt")).collect()}  # at most a row per level, and two for the rest
    n, nt = sum(r["n"] for r in per.values()), sum(r["nt"] for r in per.values())
    rows, got, got_nt = [], 0, 0
    for i, t in enumerate(levels):
        got, got_nt = got + (per[i]["n"] if i in per else 0), got_nt + (per[i]["nt"] if i in per else 0)
        done = n > 0 and got / n >= target
        rows.append((i, t, got / n if n else None, got_nt / nt if nt else None, done))
        if done:
            break
    counts = P.level_counts(vecs, id_col, vec_col, levels[:len(rows)], metric).select("gi", "np", F.lit(0).cast("bigint").alias("nd"))
    size = docs.select(F.lit(None).cast("int").alias("gi"), F.lit(0).cast("bigint").alias("np"), F.lit(1).cast("bigint").alias("nd"))
    steps = spark.createDataFrame(rows, "gi int, threshold double, recall double, recall_without_tabular double, selected boolean")
    added = counts.unionByName(size).unionByName(steps.select("gi", F.lit(0).cast("bigint").alias("np"), F.lit(0).cast("bigint").alias("nd"))) \
        .groupBy("gi").agg(F.sum("np").alias("np"), F.sum("nd").alias("nd"))
    everything = Window.partitionBy(F.lit(0))  # at most len(grid) + 1 rows
    run = everything.orderBy("gi").rowsBetween(Window.unboundedPreceding, 0)
    summed = added.select("gi", F.try_divide(F.lit(2.0) * F.sum("np").over(run), F.sum("nd").over(everything).cast("double")).alias("avg_comparisons"))
    return steps.join(F.broadcast(summed.where("gi IS NOT NULL")), "gi") \
        .select("threshold", "recall", "recall_without_tabular", "avg_comparisons", "selected")


def cluster_recall(docs: DataFrame, cluster_col: str, id_col: str = "doc_id",
                   orig_col: str = "original_doc_ids") -> tuple[DataFrame, DataFrame]:
    """Cluster-membership recall per lineage link.

    Returns ``(per_doc, report)``: per-document hit rate (null for originals)
    and the report row (recall, recall_without_tabular, n_links).
    """
    links = lineage_links(docs, id_col, orig_col)
    mine = docs.select(F.col(id_col).alias("doc_id"), F.col(cluster_col).alias("c1"))
    theirs = docs.select(F.col(id_col).alias("orig"), F.col(cluster_col).alias("c2"))
    hits = links.join(mine, "doc_id").join(theirs, "orig") \
        .select("doc_id", "orig", A.overlap_strict("c1", "c2").cast("double").alias("hit"))
    per_doc = docs.select(F.col(id_col).alias("doc_id")).join(
        hits.groupBy("doc_id").agg(F.avg("hit").alias("hitrate")), "doc_id", "left")
    report = hits.agg(F.avg("hit").alias("recall"),
                      F.avg(F.when(_not_tabular("doc_id"), F.col("hit"))).alias("recall_without_tabular"),
                      F.count("*").alias("n_links"))
    return per_doc, report


def cluster_recall_report(docs: DataFrame, cluster_col: str, id_col: str = "doc_id",
                          orig_col: str = "original_doc_ids") -> DataFrame:
    """One row: per-link recall, recall without tabular ids, link count and mean per-document hit
    rate (union-then-aggregate over one set of link hits, no joins of one-row frames)."""
    links = lineage_links(docs, id_col, orig_col)
    mine = docs.select(F.col(id_col).alias("doc_id"), F.col(cluster_col).alias("c1"))
    theirs = docs.select(F.col(id_col).alias("orig"), F.col(cluster_col).alias("c2"))
    hits = links.join(mine, "doc_id").join(theirs, "orig") \
        .select("doc_id", A.overlap_strict("c1", "c2").cast("double").alias("hit"))
    per_doc = hits.groupBy("doc_id").agg(F.avg("hit").alias("hr"))
    u = hits.select("hit", _not_tabular("doc_id").alias("nt"), F.lit(None).cast("double").alias("hr")) \
        .unionByName(per_doc.select(F.lit(None).cast("double").alias("hit"), F.lit(None).cast("boolean").alias("nt"),
                                    "hr"))
    return u.agg(F.avg("hit").alias("recall"), F.avg(F.when(F.col("nt"), F.col("hit"))).alias("recall_without_tabular"),
                 F.count("hit").alias("n_links"), F.avg("hr").alias("mean_doc_hitrate"))


def docs_per_cluster(docs: DataFrame, cluster_col: str) -> DataFrame:
    """Mean number of documents per cluster label."""
    return docs.select(F.explode(cluster_col).alias("label")).groupBy("label").count() \
        .agg(F.avg("count").alias("avg_docs_per_cluster"), F.count("*").alias("n_clusters"))


SMALL_SET = 12  # labels up to which a set's subsets are listed (at most 2^12 - 1 each)
SET_BLOCK = 1024  # distinct sets per side of a block


def _label_sets(docs: DataFrame, cluster_col: str) -> DataFrame:
    """(s, c): the distinct non-empty label sets and how many documents have each."""
    return docs.select(F.array_sort(F.array_distinct(cluster_col)).alias("s")).where(F.size("s") > 0) \
        .groupBy("s").agg(F.count("*").alias("c"))


def _sharing(sets: DataFrame) -> DataFrame:
    """(s, c, n): for every distinct label set the number of documents that share a label with it.

    Every pair of sets is counted once, by what suits the pair. Two small sets meet by inclusion-exclusion over the
    subsets of their labels (c(U) documents contain U; the union of the label members is the signed sum). A pair with a
    large set meets in a block of distinct sets, where the hits are marked label by label. So one document with many
    labels adds the work of its own set and changes nothing for the others. No pair is ever a row.
    """
    sets = sets.withColumn("k", F.xxhash64("s"))
    small, large = F.size("s") <= SMALL_SET, F.size("s") > SMALL_SET
    sub = F.expr("transform(sequence(1, (1 << size(s)) - 1), m -> filter(s, (x, i) -> ((m >> i) & 1) = 1))")
    subsets = sets.where(small).select("s", "c", F.explode(sub).alias("u"))
    holds = subsets.groupBy("u").agg(F.sum("c").alias("h"))
    sign = F.when(F.size("u") % 2 == 1, F.lit(1)).otherwise(F.lit(-1))
    by_subsets = subsets.join(holds, "u").groupBy("s").agg(F.sum(sign * F.col("h")).alias("n"))

    sizes = sets.agg(F.ceil(F.count("*") / SET_BLOCK).cast("int").alias("a"),
                     F.ceil(F.sum(F.when(large, 1).otherwise(0)) / SET_BLOCK).cast("int").alias("b")).first()  # two numbers
    slices, others = max(1, sizes["a"] or 0), sizes["b"] or 0
    if not others:
        return sets.join(by_subsets, "s").select("s", "c", "n")
    own = lambda n: F.pmod("k", F.lit(n)).cast("int")
    to = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = sets.select("s", "c", F.lit(0).alias("side"), own(slices).alias("i"), to(others).alias("j"))
    right = sets.where(large).select("s", "c", F.lit(1).alias("side"), to(slices).alias("i"), own(others).alias("j"))
    most = SMALL_SET
    by_blocks = left.unionByName(right).groupBy("i", "j").applyInPandas(lambda block: _meet(block, most), "s array<long>, n long")
    parts = by_blocks.unionByName(by_subsets.select(F.col("s").cast("array<long>").alias("s"), "n"))
    total = parts.groupBy("s").agg(F.sum("n").alias("n"))
    return sets.withColumn("s", F.col("s").cast("array<long>")).join(total, "s").select("s", "c", "n")


def _meet(block, most: int):
    """Documents of the other side that share a label: for all left sets among the large ones, and back among the small ones."""
    import numpy as np
    import pandas as pd
    left, right = block[block.side == 0], block[block.side == 1]
    hits = np.zeros((len(left), len(right)), bool)
    at: dict = {}
    for k, labels in enumerate(right.s):
        for x in labels:
            at.setdefault(x, ([], []))[1].append(k)
    for k, labels in enumerate(left.s):
        for x in labels:
            if x in at:
                at[x][0].append(k)
    for rows, cols in at.values():
        if rows:
            hits[np.ix_(rows, cols)] = True
    small = left.s.map(len).to_numpy() <= most
    n = [*(hits @ right.c.to_numpy(np.int64)), *(hits[small].T @ left.c.to_numpy(np.int64)[small])]
    return pd.DataFrame({"s": [*left.s, *right.s], "n": np.array(n, np.int64)})


def shared_cluster_counts(docs: DataFrame, cluster_col: str, id_col: str = "doc_id") -> DataFrame:
    """Per document: how many documents share at least one label with it, itself included."""
    met = _sharing(_label_sets(docs, cluster_col)).select(F.col("s").cast("array<long>").alias("s"), "n")
    own = docs.select(F.col(id_col).alias("doc_id"), F.array_sort(F.array_distinct(cluster_col)).cast("array<long>").alias("s"))
    return own.join(met, "s", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_related"))


def avg_related(docs: DataFrame, cluster_col: str, id_col: str = "doc_id") -> DataFrame:
    """Mean number of documents sharing a label with each document, self included (D6), from the distinct sets alone."""
    met = _sharing(_label_sets(docs, cluster_col)).select((F.col("c") * F.col("n")).cast("double").alias("t"), F.lit(0).alias("n"))
    n = docs.select(F.lit(None).cast("double").alias("t"), F.lit(1).alias("n"))
    return met.unionByName(n).agg((F.coalesce(F.sum("t"), F.lit(0.0)) / F.sum("n")).alias("avg_related_docs"))


def model_accuracy(verdicts: DataFrame) -> DataFrame:
    """Accuracy (null verdicts skipped) and row count per model, best first."""
    return verdicts.groupBy("model").agg(
        F.avg((F.col("conflicts") == F.col("ground_truth")).cast("double")).alias("accuracy"),
        F.count("*").alias("count"))
