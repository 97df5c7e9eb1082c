"""Near-duplicate groups by MinHash bands and odd sketches, confirmed on full shingle sets (operator 2).

1. Every text becomes a set of word shingles, ``HASHES`` MinHash samples, band keys of ``ROWS`` samples each, and an odd
   sketch: a bitmap whose bits are the parities of the hashed samples that fall on them. The population count of two
   sketches' XOR estimates how many samples differ, most precisely for high similarities.
2. Documents with equal sets form a class; from here on its least id stands for it, so a huge group of copies is one row.
3. In every band bucket each member is paired with the least one; pairs whose sketches are near enough (6 standard
   deviations below the threshold still pass) are edges. Buckets that these edges leave in several components have the
   members outside the least one's component compared, by sketch, with all others, in blocks. The components of
   all these edges contain every link that shares a band.
4. Each such component gets its texts, in slices of bounded size that also hold its least member. In a slice all
   intersections are counted exactly; documents linked with the least member are settled, only the others are compared with
   the other slices, block against block. The confirmed links' components are the result.

With 32 bands of 5 a pair at similarity 0.8 (0.85) shares no band with probability 3e-6 (7e-9).
No pair of equal texts is ever formed, no list of pairs inside a group is emitted, and nothing is collected.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staleguard.llm.arrowtext import byte_pieces, mix, shingle_sets, texts_of
from staleguard.llm.shared import components, text_batches, written
from staleguard.session import clean_up

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
SKETCH_BITS = 512
SLACK = 0.2  # about six standard deviations of the sketch's estimate
SLICE, SLICE_SHINGLES = 256, 200_000
BLOCK = 1024

_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 64, HASHES, dtype=np.uint64)
_TIMES = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# --- signatures --------------------------------------------------------------------------------------------------

def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """One row of HASHES samples for each non-empty set."""
    flat = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), HASHES), np.uint64)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat((flat ^ _XOR[k]) * _TIMES[k], first)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(samples), BANDS))
    own = samples.reshape(len(samples), BANDS, ROWS)
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + own[:, :, i])
    return key.view(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Rows of SKETCH_BITS / 64 64-bit integers: the parity of the samples that fall on each bit."""
    bit = (mix(samples + mix(np.arange(1, HASHES + 1, dtype=np.uint64))[None, :]) >> np.uint64(55)).astype(np.int64)
    at = bit + SKETCH_BITS * np.arange(len(samples))[:, None]
    odd = (np.bincount(at.ravel(), minlength=SKETCH_BITS * len(samples)) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(samples), SKETCH_BITS), axis=1).view(np.int64)


def furthest(similarity: float) -> int:
    """The XOR population count up to which a pair may still reach the similarity."""
    differing = 2 * HASHES * (1 - max(similarity - SLACK, 0))
    return math.ceil(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** differing))


def signatures(df: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id, n (shingles), set_key, bands, odd for every row; the last three are null for empty sets."""
    def run(batches):
        for batch in batches:
            ids, col = batch.column(0), texts_of(batch, "text")
            n, keys, bands, odd = np.zeros(len(col), np.int64), [None] * len(col), [None] * len(col), [None] * len(col)
            for a, b, _, _ in byte_pieces(col):
                sets = [(a + r, s) for r, s in shingle_sets(col.slice(a, b - a), k) if len(s)]
                if not sets:
                    continue
                samples = minhashes([s for _, s in sets])
                for (r, s), x, y in zip(sets, band_keys(samples), odd_sketches(samples), strict=True):
                    n[r], keys[r], bands[r], odd[r] = len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), x, y
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(keys, pa.binary()), pa.array(bands, lists), pa.array(odd, lists)],
                                             names=["id", "n", "set_key", "bands", "odd"])

    rows = text_batches(df).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n long, set_key binary, bands array<long>, odd array<long>")


# --- candidate components ------------------------------------------------------------------------------------------

def _apart(x: str, y: str) -> F.Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)


def candidate_edges(reps: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) whose components hold every pair that shares a band and is near enough by its sketches."""
    near = furthest(similarity)
    member = reps.select("rep", F.explode("bands").alias("key"))
    shared = member.groupBy("key").agg(F.count("*").alias("m"), F.min("rep").alias("least")).filter("m > 1")
    inside = written(member.join(shared, "key"), "buckets")
    pairs = inside.filter("rep != least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    odd = reps.select("rep", "odd")
    star = pairs.join(odd.toDF("a", "x"), "a").join(odd.toDF("b", "y"), "b").filter(_apart("x", "y") <= near).select("a", "b")
    star = written(star, "star")
    label = components(star)
    labelled = inside.join(label, F.col("rep") == F.col("id"), "left").select("key", "m", "rep", F.coalesce("root", "rep").alias("label"))
    torn = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min_by("label", "rep").alias("main")) \
        .filter("low != high").select("key", "main")
    open_ = written(labelled.join(torn, "key").join(odd, "rep"), "open")

    def compare(block: pd.DataFrame) -> list[tuple[int, int]]:
        left, right = block[block.side == 0], block[block.side == 1]
        x, y = (np.stack(s.odd.to_list()).view(np.uint64) for s in (left, right))
        edges = []
        for i in range(len(y)):
            hit = (np.bitwise_count(x ^ y[i]).sum(axis=1) <= near) & (left.label.to_numpy() != right.label.iloc[i])
            edges += [(int(right.rep.iloc[i]), int(v)) for v in left.rep.to_numpy()[hit]]
        return _forest(edges)

    sides = _cross_blocks(open_.select("key", "rep", "label", "main", "odd"), "key", BLOCK)
    return star.unionAll(sides.groupBy("key", "i", "j").applyInPandas(
        lambda block: pd.DataFrame(compare(block), columns=["a", "b"], dtype="int64"), "a long, b long"))


def _cross_blocks(rows: DataFrame, group: str, size: int) -> DataFrame:
    """Blocks (group, i, j): side 0 has slice i of all members, side 1 slice j of the members outside the main label.

    Both sides have at most about ``size`` rows; groups without such members have no blocks.
    """
    outside = F.col("label") != F.col("main")
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / size).cast("int").alias("s"),
                                    F.ceil(F.sum(F.when(outside, 1).otherwise(0)) / size).cast("int").alias("r")).filter("r > 0")
    placed = rows.join(sizes, group)
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n).cast("long")).cast("int")
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.withColumns({"side": F.lit(0), "i": own("s")}).withColumn("j", to("r"))
    right = placed.filter(outside).withColumns({"side": F.lit(1), "j": own("r")}).withColumn("i", to("s"))
    return left.unionByName(right).drop("s", "r")


def _forest(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The edges that join components; at most one fewer than there are vertices."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (p := parent.setdefault(v, v)) != v:
            parent[v] = v = parent[p]
        return v

    out = []
    for a, b in edges:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


# --- confirmation on full sets ----------------------------------------------------------------------------------------

def linked(sets: list[np.ndarray], num: int, den: int, columns: int = 8192) -> np.ndarray:
    """Which pairs of sets have den * intersection >= num * union, from exact counts of shared shingles."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    common = times[at] > 1
    number = np.cumsum(times > 1) - 1
    col, owner = number[at[common]], owner[common]
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    both = np.zeros((len(sets), len(sets)), np.float64)
    for start in range(0, int(col[-1]) + 1 if len(col) else 0, columns):
        a, b = np.searchsorted(col, [start, start + columns])
        part = np.zeros((len(sets), min(columns, int(col[-1]) + 1 - start)), np.float32)
        part[owner[a:b], col[a:b] - start] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    return den * both >= num * (sizes[:, None] + sizes[None, :] - both)


def _labels(ids: np.ndarray, link: np.ndarray) -> np.ndarray:
    """The least id that each one is linked with, directly or not."""
    label = ids.copy()
    while True:
        lower = np.where(link, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        lower = np.minimum(lower, label)
        if (lower == label).all():
            return label
        label = lower


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """id, n_shingles, component_id, kept for every distinct id: groups of texts with similarity num / den or more.

    Words are runs without \\x20 \\x09-\\x0D, A-Z lower-cased; a set holds the distinct k-word shingles, or the whole
    sequence of fewer words. Null and empty texts have an empty set and are linked with nothing. Rows with a null id
    can't be named by a group: they are left out. Rows that repeat an id are one document; if their texts differ, it has the
    links of all of them and the largest set's size. Other columns of ``df`` are not read.
    """
    docs = df.filter(F.col(id_col).isNotNull())
    sig = written(signatures(docs, id_col, text_col, k), "signatures")
    classes = sig.filter("n > 0").groupBy("set_key").agg(F.min("id").alias("rep"), F.max("n").alias("n"),
                                                         F.first("bands").alias("bands"), F.first("odd").alias("odd"))
    classes = written(classes, "classes")
    group = components(candidate_edges(classes, num / den))

    # texts of candidate groups, in slices that also hold the group's least member
    sizes = group.join(classes.select(F.col("rep").alias("id"), "n"), "id").groupBy("root").agg(
        F.greatest(F.ceil(F.count("*") / SLICE), F.ceil(F.sum("n") / SLICE_SHINGLES)).cast("int").alias("s"))
    own = F.pmod(F.xxhash64("id"), F.col("s").cast("long")).cast("int")
    spread = F.when(F.col("id") == F.col("root"), F.sequence(F.lit(0), F.col("s") - 1)).otherwise(F.array(own))
    placed = group.join(sizes, "root").withColumn("slice", F.explode(spread))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def sets_of(block: pd.DataFrame) -> list[np.ndarray]:
        return [s for _, s in shingle_sets(pa.array(block.text.fillna(""), pa.large_string()), k)]

    def settle(block: pd.DataFrame) -> pd.DataFrame:
        block = block.drop_duplicates(["id", "text"]).sort_values("id", kind="stable")
        ids = block.id.to_numpy(np.int64)
        link = linked(sets_of(block), num, den) | (ids[:, None] == ids[None, :])
        out = pd.DataFrame({"id": ids, "root": block.root.to_numpy(), "s": block.s.to_numpy(), "label": _labels(ids, link)})
        return out[(block.id != block.root).to_numpy() | (block.slice == 0).to_numpy()].drop_duplicates("id")

    held = written(placed.join(texts, "id"), "held")  # the texts of group members only; all later reads take them from here
    settled = written(held.groupBy("root", "slice").applyInPandas(settle, "id long, root long, s int, label long"), "settled")
    clean_up(df.sparkSession)

    # members of several slices' groups that aren't linked with the least one: against all other slices
    split = settled.filter("s > 1").select(F.col("root").alias("key"), F.col("id").alias("rep"), "label", F.col("root").alias("main"))

    def confirm(block: pd.DataFrame) -> pd.DataFrame:
        block = block.drop_duplicates(["side", "rep", "text"])
        link = linked(sets_of(block), num, den)
        side, label = block.side.to_numpy(), block.label.to_numpy()
        i, j = np.nonzero(link & (side[:, None] == 1) & (side[None, :] == 0) & (label[:, None] != label[None, :]))
        return pd.DataFrame(_forest([(int(label[a]), int(label[b])) for a, b in zip(i, j)]), columns=["a", "b"], dtype="int64")

    members = held.filter("s > 1 and (id != root or slice = 0)").select(F.col("id").alias("rep"), "text")
    more = written(_cross_blocks(split, "key", SLICE).join(members, "rep").groupBy("key", "i", "j")
                   .applyInPandas(confirm, "a long, b long"), "confirmed")
    merged = settled.select("id", "label")
    if not more.isEmpty():
        top = components(more).select(F.col("id").alias("label"), F.col("root").alias("top"))
        merged = merged.join(top, "label", "left").select("id", F.coalesce("top", "label").alias("label"))

    found = classes.select("set_key", "rep").join(merged.withColumnRenamed("id", "rep"), "rep", "left") \
        .select("set_key", F.coalesce("label", "rep").alias("component_id"))
    out = sig.select("id", "n", "set_key").join(found, "set_key", "left") \
        .select("id", "n", F.coalesce("component_id", "id").alias("component_id"))
    return out.groupBy("id").agg(F.max("n").alias("n_shingles"), F.min("component_id").alias("component_id")) \
        .select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One document of each group, with all its columns: the one with the least id.

    Rows with a null id are kept as they are; of rows that repeat an id with the same text one is kept. Different texts
    under one id are documents of their own and are merged only if they are near copies.
    """
    named, nameless = df.filter(F.col(id_col).isNotNull()), df.filter(F.col(id_col).isNull())
    own, text = F.col(id_col).cast("long").alias("__id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("__text")
    torn = written(named.select(own, text).groupBy("__id").agg(F.min("__text").alias("__first"), F.max("__text").alias("__last"))
                   .filter("__first != __last").select("__id", "__first"), "torn")
    if torn.isEmpty():
        kept = near_duplicates(df, id_col, text_col, k, num, den).filter("kept").select(F.col(id_col).alias("__kept"))
        return named.dropDuplicates([id_col]).join(kept, F.col(id_col) == F.col("__kept"), "left_semi").select(*df.columns).unionAll(nameless)

    # all but one text of such an id get a number above all ids
    top = named.agg(F.max(own)).first()[0]
    others = written(named.select(own, text).join(torn, "__id").filter("__text != __first").select("__id", "__text").distinct()
                     .withColumn("__other", F.lit(top + 1) + F.monotonically_increasing_id()), "others")
    keyed = named.select("*", own, text).join(others, ["__id", "__text"], "left").withColumn("__key", F.coalesce("__other", "__id"))
    groups = near_duplicates(keyed.select("__key", text_col), "__key", text_col, k, num, den).select("__key", "component_id")
    kept = groups.join(others.select(F.col("__other").alias("__key"), "__id"), "__key", "left") \
        .groupBy("component_id").agg(F.min(F.struct(F.coalesce("__id", "__key"), F.col("__key").alias("__kept")))["__kept"].alias("__kept"))
    return keyed.dropDuplicates(["__key"]).join(kept, F.col("__key") == F.col("__kept"), "left_semi").select(*df.columns).unionAll(nameless)
