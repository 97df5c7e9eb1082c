"""Retrieval with data-quality expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staleguard.config import CONTEXT_DELIMITER, SCORING_DELIMITER
from staleguard.functions import text as T
from staleguard.session import checkpoint_dir, materialize


def tokens(c):
    """Distinct lower-case word tokens of any script."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"({T.WORD_CHAR}+)"), 1))


SEED_TOKENS, SEED_POSTINGS = 8, 64
ORDER_SAMPLE = 16
BROADCAST_QUERIES, BROADCAST_TOKENS = 10_000, 1_000_000  # queries, and tokens of all queries, that are broadcast at most
BROADCAST_CONTEXT = 100_000  # context rows (ids and ranks) that are broadcast at most


def _by_rarity(sets: DataFrame, id_col: str, words: DataFrame) -> DataFrame:
    """(id, n, arr): ``n`` tokens a row of (id, n, token) names, ``arr`` the ids of those in ``words``, rarest first (as the ids are given)."""
    j = sets.join(words, "token")
    return j.groupBy(id_col).agg(F.first("n").alias("n"), F.sort_array(F.collect_list("tid")).alias("arr"))


def _overlap(j: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) of rows (query_id, nq, qa, chunk_id, nc, ca, bound) that reach their bound: exact Jaccard on the full sets.

    The bound is tested without a quotient, so that the overlap is computed once a row, and 1e-9 below it.
    """
    s = F.size(F.array_intersect("ca", "qa")).cast("double")
    both = F.col("nq") + F.col("nc")
    return j.where(s * (1 + F.col("bound")) >= F.col("bound") * both - 1e-9).select("query_id", "chunk_id", (s / (both - s)).alias("score"))


def _scored(pairs: DataFrame, qsets: DataFrame, csets: DataFrame) -> DataFrame:
    """``_overlap`` of the pairs (query_id, chunk_id, bound)."""
    return _overlap(pairs.join(csets.select("chunk_id", F.col("n").alias("nc"), F.col("arr").alias("ca")), "chunk_id")
                    .join(qsets.select("query_id", F.col("n").alias("nq"), F.col("arr").alias("qa")), "query_id"))


def lexical_topk(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Top-``k`` chunks per query by token Jaccard, ties by smaller ``chunk_id``; exact.

    Both sides' sets are put in one order, rarest token first, over the tokens that queries name. Any fixed order gives the
    same rows; the frequencies behind it are counted on every ``ORDER_SAMPLE``-th chunk by a hash of its id.

    1. Seeds: each query scores the shortest ``SEED_POSTINGS`` chunks (at least ``k``) of its ``SEED_TOKENS`` rarest
       tokens and of its commonest one. The k-th score found bounds the true one from below; a query whose
       commonest token has fewer than ``k`` chunks may be left without a bound (0).
    2. Candidates: a query meets the postings of a token only while the tokens from there on could still reach the
       bound. At the first shared token, position i of the query and j of the chunk, the overlap is at
       most o = min(remaining query tokens, remaining chunk tokens), so a chunk whose o / (nq + nc - o) misses the bound
       is dropped in the join. The commonest tokens fall out first, so hot posting lists are hardly met. Where the queries hold
       at most ``BROADCAST_TOKENS`` tokens, these go to the chunks and a chunk is scored where it lies.
    3. Candidates are scored on the full sets and ranked; a query with fewer than ``k`` sharing chunks is filled up
       with the smallest other chunk ids at score 0.

    The texts are tokenised once, and chunk tokens that no query names end in the join with the words. Nothing passes through the driver but the
    2 ``k`` smallest chunk ids. A null text is empty; ``query_id`` and ``chunk_id`` are unique and not null.
    Result: (query_id, rank, chunk_id, score).
    """
    def sets(df, id_col, text_col):
        t = df.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>")).alias("t"))
        return t.select(id_col, F.size("t").alias("n"), "t")

    def rows(df, id_col):
        # the outer form: for the inner one the optimiser adds a filter on the array, and every text is tokenised again
        return df.select(id_col, "n", F.explode_outer("t").alias("token")).where("token is not null")

    qt = materialize(sets(queries, "query_id", "content"))
    qtok = rows(qt, "query_id")
    sampled = chunks.where(F.pmod(F.xxhash64(F.col("chunk_id").cast("long")), F.lit(ORDER_SAMPLE)) == 0)
    freq = rows(sets(sampled, "chunk_id", "text"), "chunk_id").groupBy("token").agg(F.count("*").alias("df"))
    words = qtok.select("token").distinct().join(freq, "token", "left") \
        .orderBy(F.coalesce("df", F.lit(0)), "token").select("token", F.monotonically_increasing_id().alias("tid"))
    words = materialize(words)  # fixes the ids, which rise with the frequency
    qsets = materialize(_by_rarity(qtok, "query_id", words))
    csets = materialize(_by_rarity(rows(sets(chunks, "chunk_id", "text"), "chunk_id"), "chunk_id", words))
    few = qsets.count() <= BROADCAST_QUERIES and (qsets.agg(F.sum(F.size("arr"))).first()[0] or 0) <= BROADCAST_TOKENS
    hint = F.broadcast if few else lambda df: df
    posts = csets.select("chunk_id", F.col("n").alias("nc"), F.size("arr").alias("mc"), F.posexplode("arr").alias("j", "tid"))

    shortest = Window.partitionBy("tid").orderBy("nc", "chunk_id")
    probes = qsets.select("query_id", F.explode(F.array_union(F.slice("arr", 1, SEED_TOKENS), F.slice("arr", -1, 1))).alias("tid"))
    heads = posts.select("tid", "nc", "chunk_id").join(hint(probes.select("tid").distinct()), "tid", "left_semi") \
        .withColumn("_r", F.row_number().over(shortest)).where(F.col("_r") <= max(SEED_POSTINGS, k)).select("tid", "chunk_id")
    seeds = _scored(hint(probes.join(heads, "tid").select("query_id", "chunk_id", F.lit(0.0).alias("bound")).distinct()), qsets, csets)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    bounds = ranked(seeds).groupBy("query_id").agg(F.count("*").alias("found"), F.min("score").alias("low")) \
        .select("query_id", F.when(F.col("found") >= k, F.col("low")).otherwise(0.0).alias("bound"))
    bounds = materialize(qt.select("query_id").join(bounds, "query_id", "left").select("query_id", F.coalesce("bound", F.lit(0.0)).alias("bound")))

    prefix = qsets.join(bounds, "query_id").select("query_id", F.col("n").alias("nq"), F.size("arr").alias("mq"), "bound",
                                                   F.posexplode("arr").alias("i", "tid")) \
        .where((F.col("mq") - F.col("i")) / F.col("nq") >= F.col("bound"))
    o = F.least(F.col("mq") - F.col("i"), F.col("mc") - F.col("j"))
    within = o / (F.col("nq") + F.col("nc") - o) >= F.col("bound")
    if few:
        # the chunks stay where they are: the queries' tokens and sets come to them, and what reaches its bound is all that is moved
        sets_here = csets.where("chunk_id is not null").select("chunk_id", F.col("n").alias("nc"), F.size("arr").alias("mc"), F.col("arr").alias("ca"),
                                                               F.posexplode("arr").alias("j", "tid"))
        near = sets_here.join(F.broadcast(prefix), "tid").where(within)
        scored = _overlap(near.join(F.broadcast(qsets.select("query_id", F.col("arr").alias("qa"))), "query_id")).distinct()
    else:
        scored = _scored(prefix.join(posts, "tid").where(within).select("query_id", "chunk_id", "bound").distinct(), qsets, csets)
    # what misses its bound can't be in the top k: about k rows a query are left to store
    scored = materialize(scored)

    open_ = bounds.where("bound = 0").select("query_id")
    if open_.isEmpty():
        return ranked(scored).select("query_id", "rank", "chunk_id", "score")
    first = [r[0] for r in chunks.select(F.col("chunk_id").cast("long")).orderBy("chunk_id").limit(2 * k).collect()]
    rest = open_.select("query_id", F.explode(F.array(*map(F.lit, first)).cast("array<bigint>")).alias("chunk_id")) \
        .join(scored, ["query_id", "chunk_id"], "left_anti").withColumn("score", F.lit(0.0))
    return ranked(scored.unionByName(rest)).select("query_id", "rank", "chunk_id", "score")


def newer_closure(seeds: DataFrame, chunks: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Expand each query's chunks along ``outdated_by`` until nothing new is reached.

    ``seeds``: (query_id, chunk_id). ``chunks``: (chunk_id, outdated_by).
    Returns (query_id, chunk_id, round) with round 0 for the seeds and the
    breadth-first round in which a chunk was first reached otherwise. Each
    round is a frontier join plus an anti join against the seen set; ids
    missing from the chunk table are dropped (so the loop ends), cycles end
    because seen ids are never revisited. The seen set is checkpointed to the
    shared checkpoint folder every round to cut lineage.
    """
    checkpoint_dir(seeds.sparkSession)
    edges = chunks.select("chunk_id", F.explode("outdated_by").alias("nid"))
    known = chunks.select(F.col("chunk_id").alias("nid"))
    edges = edges.join(known, "nid", "left_semi").transform(materialize)
    seen = seeds.select("query_id", "chunk_id", F.lit(0).alias("round")).distinct().transform(materialize)
    frontier = seen
    r = 0
    while max_rounds is None or r < max_rounds:
        r += 1
        nxt = frontier.join(edges, "chunk_id").select("query_id", F.col("nid").alias("chunk_id")).distinct() \
            .join(seen.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti") \
            .select("query_id", "chunk_id", F.lit(r).alias("round")).transform(materialize)
        if nxt.isEmpty():
            break
        seen = seen.unionByName(nxt)  # a union of checkpointed rounds: shallow lineage
        frontier = nxt
    return seen


def ordered_context(retrieved: DataFrame, chunks: DataFrame, with_dq: bool) -> DataFrame:
    """Per query the chunk list in context order.

    Without DQ: retrieval rank. With DQ: newest ``creation_date`` first, ties in
    arrival order (retrieval rank, then expansion round, inside a round by
    chunk id). Result: (query_id, position, chunk_id, text, outdated_by).
    """
    c = chunks.select("chunk_id", "text", "outdated_by", "creation_date")
    # few rows go to the chunks, so that the texts of all the others stay where they are
    j = (F.broadcast(retrieved) if retrieved.count() <= BROADCAST_CONTEXT else retrieved).join(c, "chunk_id")
    if with_dq:
        arrival = F.when(F.col("round") == 0, F.col("rank")).otherwise(F.col("chunk_id"))
        order = [F.desc("creation_date"), F.col("round"), arrival]
    else:
        order = [F.col("rank")]
    w = Window.partitionBy("query_id").orderBy(*order)
    return j.withColumn("position", F.row_number().over(w)).select("query_id", "position", "chunk_id", "text",
                                                                   "outdated_by")


def contexts_from_top(top: DataFrame, chunks: DataFrame, with_dq: bool) -> DataFrame:
    """Context rows from a retrieved top-k table (query_id, rank, chunk_id, ...)."""
    if with_dq:
        cl = newer_closure(top.select("query_id", "chunk_id"), chunks.select("chunk_id", "outdated_by"))
        ret = cl.join(top.select("query_id", "chunk_id", "rank"), ["query_id", "chunk_id"], "left")
    else:
        ret = top.select("query_id", "chunk_id", "rank", F.lit(0).alias("round"))
    return ordered_context(ret, chunks, with_dq)


def retrieve_context(queries: DataFrame, chunks: DataFrame, k: int, with_dq: bool) -> DataFrame:
    """K3: top-k, optional expansion to newer chunks, ordering. Long form, one row per context chunk.

    The chunk table and the top-k are checkpointed once (shared checkpoint
    folder): the closure loop and the ordering read them several times.
    """
    checkpoint_dir(chunks.sparkSession)
    chunks = chunks.transform(materialize)
    top = lexical_topk(queries, chunks, k).transform(materialize)
    return contexts_from_top(top, chunks, with_dq)


def context_strings(ctx: DataFrame, delimiter: str = CONTEXT_DELIMITER) -> DataFrame:
    """(query_id, n_chunks, context): texts joined in position order (H9); group = one query's context."""
    g = ctx.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("_c"))
    return g.select("query_id", F.size("_c").alias("n_chunks"),
                    F.array_join(F.transform("_c", lambda s: s["text"]), delimiter).alias("context"))


def context_recall(ctx: DataFrame, refs: DataFrame) -> DataFrame:
    """D15 per query: every stripped, lower-cased reference occurs in the lower-cased joined context.

    ``refs``: (query_id, references ARRAY<STRING>); zero references is a hit.
    """
    cs = context_strings(ctx, SCORING_DELIMITER)
    j = refs.join(cs, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    hit = F.forall("references", lambda r: F.contains(F.lower("context"), T.py_strip(F.lower(r))))
    return j.select("query_id", hit.alias("hit"))


def context_precision(ctx: DataFrame, refs: DataFrame) -> DataFrame:
    """D16 per query: share of context chunks holding any reference (C16); null without chunks."""
    j = ctx.join(refs, "query_id")
    rel = F.exists("references", lambda r: F.contains(F.lower("text"), T.py_strip(F.lower(r))))
    per = j.groupBy("query_id").agg(F.avg(rel.cast("double")).alias("precision"))
    return refs.select("query_id").join(per, "query_id", "left")
