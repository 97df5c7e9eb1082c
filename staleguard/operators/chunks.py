"""Chunking and outdated-chunk flagging."""

from __future__ import annotations

import itertools
import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TT

from staleguard.config import CHUNK_OVERLAP, CHUNK_SIZE, SPLIT_SEPARATORS
from staleguard.functions import text as T
from staleguard.operators.windows import sequential_offsets
from staleguard.session import materialize


# --- native fixed-window chunks ---------------------------------------------

def _chunk_count(text_col: str, size: int, overlap: int):
    n = F.length(text_col)
    return F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / F.lit(size - overlap)).cast("int") + 1)


STRETCH = 16  # windows that are cut from one stretch of a text


def fixed_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "content",
                 size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, first_id: str | None = None) -> DataFrame:
    """Windows of ``size`` characters every ``size - overlap`` characters, JVM-only.

    (doc_id, pos, text); the last window ends at or after the end of the text. With ``first_id``, a column of ``docs``, also chunk_id.
    A substring walks its UTF-8 text from the start, so a text is first cut into stretches of ``STRETCH`` windows and these into windows:
    the work on a text no longer grows with the square of its length.
    """
    step = size - overlap
    ids = [F.col(first_id).alias("_o")] if first_id else []
    named = [(F.col("_o") + F.col("pos")).alias("chunk_id")] if first_id else []
    kept = ["doc_id", *["_o"] * len(ids)]
    whole = docs.select(F.col(id_col).alias("doc_id"), *ids, F.col(text_col).alias("_w"), _chunk_count(text_col, size, overlap).alias("_n")) \
        .select(*kept, "_w", "_n", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / F.lit(STRETCH)).cast("int"))).alias("_s"))
    part = whole.select(*kept, (F.col("_s") * STRETCH).alias("_at"), F.least(F.lit(STRETCH), F.col("_n") - F.col("_s") * STRETCH).alias("_m"),
                        F.substring("_w", F.col("_s") * (STRETCH * step) + 1, F.lit((STRETCH - 1) * step + size)).alias("_t"))
    ex = part.select(*kept, "_at", "_t", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("_i")) \
        .select(*kept, (F.col("_at") + F.col("_i")).alias("pos"), F.substring("_t", F.col("_i") * step + 1, F.lit(size)).alias("text"))
    return ex.select("doc_id", "pos", "text", *named)


BROADCAST_DOCS = 1_000_000  # documents whose offsets (16 bytes each) are broadcast at most


def numbered_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "content",
                    size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``fixed_chunks`` with a global sequential ``chunk_id`` in (doc_id, pos) order (E3), for unique document ids that aren't null.

    A text's length gives its number of chunks, so the offsets are running sums over (id, number) rows alone. They meet the
    documents before the chunks are made: by broadcast, or beyond ``BROADCAST_DOCS`` in a join on the id that moves each
    text once; no chunk is shuffled.
    """
    counts = docs.select(F.col(id_col).alias("_d"), _chunk_count(text_col, size, overlap).alias("_n")).where("_n IS NOT NULL")
    offsets = sequential_offsets(counts, "_d", "_n").select("_d", F.col("offset").alias("_first"))
    if docs.count() <= BROADCAST_DOCS:
        offsets = F.broadcast(offsets)
    return fixed_chunks(docs.join(offsets, docs[id_col] == F.col("_d")), id_col, text_col, size, overlap, "_first")


# --- recursive character splitter (per-row helper, Arrow batches) -----------

def _parts(text: str, start: int, stop: int, separator: str, step: int) -> list[tuple[int, int]]:
    """Non-empty ranges of ``text`` between separators; runs of ``step`` characters for the empty separator."""
    if not separator:
        return [(a, min(a + step, stop)) for a in range(start, stop, step)]
    out = []
    while start <= stop:
        at = text.find(separator, start, stop)
        end = stop if at < 0 else at
        if end > start:
            out.append((start, end))
        start = end + len(separator)
    return out


def _windows(parts: list[tuple[int, int]], size: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of as many neighbouring parts as ``size`` holds; the next one steps back over what lies within ``overlap``."""
    out, first = [], 0
    while first < len(parts):
        last = first
        while last + 1 < len(parts) and parts[last + 1][1] - parts[first][0] <= size:
            last += 1
        out.append((parts[first][0], parts[last][1]))
        after = last + 1
        if after == len(parts):
            break
        back = after
        while back - 1 > first and parts[back - 1][0] >= parts[last][1] - overlap and parts[after][1] - parts[back - 1][0] <= size:
            back -= 1
        first = back
    return out


def split_recursive(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                    separators: list[str] = SPLIT_SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that is present.

    A range is cut at the first separator it contains. Neighbouring parts that fit are put together again up to
    ``size``, stepping back by at most ``overlap``; a part that is too long is cut by the finer separators on its own.
    Chunks are slices of the text without white space at their ends, in text order; empty ones are dropped.
    """
    step = math.gcd(size, overlap) if overlap else size
    out, todo = [], [(0, len(text or ""), 0)]
    while todo:
        start, stop, level = todo.pop()
        if level < 0:  # a finished window
            out.append(text[start:stop].strip())
            continue
        level = next((k for k in range(level, len(separators)) if separators[k] in text[start:stop]), len(separators) - 1)
        found = []
        parts = _parts(text, start, stop, separators[level], step)
        for fits, run in itertools.groupby(parts, key=lambda p: p[1] - p[0] <= size):
            run = list(run)
            last = level + 1 == len(separators)
            found += [(a, b, -1) for a, b in _windows(run, size, overlap)] if fits or last else [(a, b, level + 1) for a, b in run]
        todo += reversed(found)
    return [c for c in out if c]


@F.pandas_udf(TT.ArrayType(TT.StringType()))
def _split_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: split_recursive(t) if t is not None else [])


def recursive_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "content") -> DataFrame:
    """(doc_id, pos, text) from the recursive splitter; one Arrow-batched UDF call per batch."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(_split_udf(F.col(text_col))).alias("pos", "text"))


# --- flag chunks outdated by newer conflicting passages (K1) -----------------

def orient_conflicts(conflicts: DataFrame, docs: DataFrame) -> DataFrame:
    """Old/new sides of each conflict by creation date (C15): doc2 is newer only when strictly later."""
    d1 = docs.select(F.col("doc_id").alias("id1"), F.col("creation_date").alias("_d1"))
    d2 = docs.select(F.col("doc_id").alias("id2"), F.col("creation_date").alias("_d2"))
    j = conflicts.join(d1, "id1").join(d2, "id2")
    newer2 = F.col("_d1") < F.col("_d2")
    return j.select(
        "ord",
        F.when(newer2, F.col("id1")).otherwise(F.col("id2")).alias("old_id"),
        F.when(newer2, F.col("id2")).otherwise(F.col("id1")).alias("new_id"),
        F.when(newer2, F.col("conflicting_passage_doc1")).otherwise(F.col("conflicting_passage_doc2")).alias("p_old"),
        F.when(newer2, F.col("conflicting_passage_doc2")).otherwise(F.col("conflicting_passage_doc1")).alias("p_new"))


PASSAGE_SLICE, CHUNK_SLICE = 2_000, 1_000  # passages and chunks of one document that meet in one group
DOCS_A_GROUP = 64  # documents of a group, about


def _scan_group(passages: pa.Table, chunks: pa.Table) -> pa.Table:
    """(ord, old, chunk_id) of every passage of a document that a chunk of it contains; each chunk is scanned once."""
    import ahocorasick
    patterns: dict[int, dict[str, list]] = {}
    for doc, number, old, text in zip(*(passages.column(i).to_pylist() for i in range(4))):
        patterns.setdefault(doc, {}).setdefault(text, []).append((number, old))
    machines = {}
    for doc, by_text in patterns.items():
        everywhere, machine = by_text.pop("", []), None
        if by_text:
            machine = ahocorasick.Automaton()
            for text, marks in by_text.items():
                machine.add_word(text, (text, marks))
            machine.make_automaton()
        machines[doc] = everywhere, machine
    out = []
    for doc, chunk, text in zip(*(chunks.column(i).to_pylist() for i in range(3))):
        if doc not in machines or text is None:
            continue
        everywhere, machine = machines[doc]
        met = {t: marks for _, (t, marks) in machine.iter(text)} if machine else {}
        out += [(number, old, chunk) for marks in (everywhere, *met.values()) for number, old in marks]
    numbers, olds, ids = zip(*out) if out else ((), (), ())
    return pa.table([pa.array(numbers, pa.int64()), pa.array(olds, pa.bool_()), pa.array(ids, pa.int64())], names=["number", "old", "chunk_id"])


def passages_in_chunks(sides: DataFrame, chunks: DataFrame) -> DataFrame:
    """(number, old, chunk_id): which passages (doc_id, number, old, passage) lie in which chunks (doc_id, chunk_id, text) of the same document.

    Documents are dealt out in groups; one with many passages or chunks is cut into slices of both, and every slice of its
    passages, compiled into one automaton, meets every slice of its chunks. So a chunk is scanned once for each
    ``PASSAGE_SLICE`` passages, however many conflicts name its document, and a hot document is spread over tasks.
    """
    p, c = sides.groupBy("doc_id").agg(F.count("*").alias("np")), chunks.groupBy("doc_id").agg(F.count("*").alias("nc"))
    sizes = materialize(p.join(c, "doc_id").select("doc_id", F.ceil(F.col("np") / PASSAGE_SLICE).cast("int").alias("ps"),
                                                   F.ceil(F.col("nc") / CHUNK_SLICE).cast("int").alias("cs")))
    groups = max(1, sizes.count() // DOCS_A_GROUP)
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("g")
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = sides.join(sizes, "doc_id").select("doc_id", "number", "old", "passage", bucket, own("number", "ps").alias("a"), each("cs").alias("b"))
    right = chunks.join(sizes, "doc_id").select(F.col("doc_id").alias("c_doc"), F.col("chunk_id").alias("c_id"), F.col("text").alias("c_text"),
                                                bucket.alias("c_g"), own("chunk_id", "cs").alias("c_b"), each("ps").alias("c_a"))
    return left.groupBy("g", "a", "b").cogroup(right.groupBy("c_g", "c_a", "c_b")) \
        .applyInArrow(lambda lt, rt: _scan_group(lt, rt), "number long, old boolean, chunk_id long")


def flag_outdated(chunks: DataFrame, conflicts: DataFrame, docs: DataFrame, mode: str = "last") -> DataFrame:
    """Chunks whose ``outdated_by`` was set by a conflict (K1).

    ``conflicts`` carries a sortable ``ord`` (its row order). For every
    conflict the chunks of *both* documents are tested: a chunk containing the
    normalised old passage is old, otherwise one containing the new passage is
    new. Each old chunk takes the new-chunk list of the *last* conflict that
    matched it, even when that list is empty (which clears the flag);
    ``mode='union'`` unions the lists instead. Conflicts with a null passage
    are skipped. Returns (chunk_id, outdated_by ARRAY<BIGINT>).
    """
    if mode not in ("last", "union"):
        raise ValueError(mode)
    oc = orient_conflicts(conflicts.where(F.col("conflicting_passage_doc1").isNotNull() &
                                          F.col("conflicting_passage_doc2").isNotNull()), docs)
    oc = materialize(oc.select("ord", "old_id", "new_id", T.normalize("p_old").alias("p_old"), T.normalize("p_new").alias("p_new"))
                     .withColumn("number", F.xxhash64("ord")))  # conflicts are told apart by a hash of their order
    passage = F.inline(F.array(F.struct(F.lit(True).alias("old"), F.col("p_old").alias("passage")),
                               F.struct(F.lit(False).alias("old"), F.col("p_new").alias("passage"))))
    sides = oc.select("number", F.col("p_old"), F.col("p_new"), F.explode(F.array_distinct(F.array("old_id", "new_id"))).alias("doc_id")) \
        .select("doc_id", "number", passage)
    # only chunks of documents that take part in a conflict are normalised (semi join first)
    involved = sides.select("doc_id").distinct()
    cn = chunks.join(involved, "doc_id", "left_semi").select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), T.normalize("text").alias("text"))
    met = passages_in_chunks(sides, cn).groupBy("number", "chunk_id").agg(F.max("old").alias("is_old"))
    per_conflict = met.groupBy("number").agg(
        F.collect_set(F.when(F.col("is_old"), F.col("chunk_id"))).alias("old_ids"),
        F.array_sort(F.collect_set(F.when(~F.col("is_old"), F.col("chunk_id")))).alias("new_ids"))  # the chunks of two documents at most
    a = per_conflict.join(oc.select("number", "ord"), "number").select("ord", "new_ids", F.explode("old_ids").alias("chunk_id"))
    if mode == "last":
        return a.groupBy("chunk_id").agg(F.max_by("new_ids", "ord").alias("outdated_by"))
    return a.groupBy("chunk_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("new_ids")))).alias("outdated_by"))


def apply_flags(chunks: DataFrame, flags: DataFrame) -> DataFrame:
    """All chunks with ``outdated_by`` ([] when never flagged)."""
    return chunks.join(flags, "chunk_id", "left").withColumn(
        "outdated_by", F.coalesce("outdated_by", F.array().cast("array<bigint>")))


def split_current_outdated(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(current, outdated) by whether ``outdated_by`` is empty (K2)."""
    return chunks.where(F.size("outdated_by") == 0), chunks.where(F.size("outdated_by") > 0)
