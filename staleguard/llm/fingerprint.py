"""Threshold-scaled document fingerprints, by DataFrame functions only (operator 1).

The shingles of a text are its runs of ``SHINGLE`` words (a shorter text is one shingle). Each is hashed with MD5, cut to
64 bits, and kept when its hash lies in the lowest eighth (first hexadecimal digit below ``KEEP_BELOW``), so the sketch of
a union is the union of the sketches and containment can be estimated between documents of very unequal length. The
least hash is kept in any case, so that no text with words has an empty sketch. Merging keeps that: of the united hashes
those below the limit stay, else the least one.

A null text counts as empty, an empty text or one of white space only has an empty sketch. Equal texts have equal sketches.
Word borders are \\x20 and \\x09-\\x0D.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from staleguard.session import materialize

SHINGLE = 5
KEEP_BELOW = "2"  # an eighth of the hexadecimal digits
LIMIT = int(KEEP_BELOW, 16) << 60
WORD_BORDER = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BORDER), lambda w: w != "")


def shingle_hashes(word_list: Column, k: int = SHINGLE) -> Column:
    """16 hexadecimal digits for every shingle."""
    at = F.when(F.size(word_list) > 0, F.sequence(F.lit(1), F.greatest(F.size(word_list) - (k - 1), F.lit(1)))) \
        .otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.substring(F.md5(F.array_join(F.slice(word_list, i, k), " ")), 1, 16))


def with_sketch(df: DataFrame, text: str, name: str, k: int = SHINGLE) -> DataFrame:
    """Adds the sketch: a sorted array of distinct 64-bit integers (an existing column of that name is replaced)."""
    number = lambda h: F.conv(h, 16, -10).cast("long")
    low = F.array_distinct(F.filter("__hashes", lambda h: h < KEEP_BELOW))
    return df.withColumn("__words", words(F.col(text))).withColumn("__hashes", shingle_hashes(F.col("__words"), k)) \
        .withColumn("__low", F.when(F.exists("__hashes", lambda h: h < KEEP_BELOW), low)
                    .otherwise(F.filter(F.array(F.array_min("__hashes")), lambda h: h.isNotNull()))) \
        .withColumn(name, F.array_sort(F.transform("__low", number))).drop("__words", "__hashes", "__low")


def fingerprint_text(sketch: Column) -> Column:
    """Comma-joined hexadecimal digits of a sketch."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), ",")


def merged(a: Column, b: Column) -> Column:
    """Sketch of the union of two documents."""
    both = F.array_sort(F.array_union(a, b))
    low = F.filter(both, lambda h: (h >= 0) & (h < LIMIT))
    return F.when(F.size(low) > 0, low).otherwise(F.slice(F.array_sort(both, _unsigned), 1, 1))


def _unsigned(x: Column, y: Column) -> Column:
    flip = lambda v: v.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    return F.when(flip(x) < flip(y), -1).when(flip(x) > flip(y), 1).otherwise(0)


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance, 0 to 1; two empty sketches are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; an empty sketch is contained in any."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def next_in_ring(ids: DataFrame, id_col: str) -> DataFrame:
    """id, next_id: the next lower id, and the highest after the lowest; for distinct, non-null ids.

    Ids are dealt out by range, so a window sees one range only; the borders between ranges are filled in from a
    table with one row per range. The ranges are written once, so both readings see the same ones.
    """
    ranged = materialize(ids.select(F.col(id_col).alias("id")).repartitionByRange(_partitions(ids), "id")
                         .withColumn("range", F.spark_partition_id()))
    inside = ranged.withColumn("next_id", F.lead("id").over(Window.partitionBy("range").orderBy(F.desc("id"))))
    tops = ranged.groupBy("range").agg(F.max("id").alias("top"))
    lower = tops.select("range", F.coalesce(F.lag("top").over(Window.orderBy("range")),
                                            F.max("top").over(Window.partitionBy(F.lit(0)))).alias("below"))
    return inside.join(lower, "range").select(F.col("id").alias(id_col), F.coalesce("next_id", "below").alias("next_id"))


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def edited_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, sketch, edited text, edited sketch, next sketch for every row with an id.

    The edited text has its last third of code points replaced by as many first ones (or all) of the next document in
    descending order of id, the first following the last. Ids are expected to be distinct. Rows without an id have no
    place in the order: their edited text is their own and so is their next sketch.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = with_sketch(rows.filter(F.col("id").isNotNull()), "text", "sketch")
    ring = next_in_ring(rows.filter(F.col("id").isNotNull()), "id")
    sizes = rows.filter(F.col("id").isNotNull()).select("id", F.floor(F.length("text") / 3).cast("int").alias("need"))
    wanted = ring.join(sizes, "id").select(F.col("next_id").alias("id"), F.col("id").alias("before"), "need")
    heads = own.join(wanted, "id").select(F.col("before").alias("id"), F.expr("substring(text, 1, need)").alias("head"),
                                          F.col("sketch").alias("next_sketch"))
    cut = F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))")
    ringed = own.join(heads, "id").withColumn("edited", F.concat(cut, "head")).drop("head")
    out = with_sketch(ringed, "edited", "edited_sketch")
    alone = with_sketch(rows.filter(F.col("id").isNull()), "text", "sketch") \
        .withColumns({"edited": F.col("text"), "edited_sketch": F.col("sketch"), "next_sketch": F.col("sketch")})
    columns = ["id", F.length("text").cast("long").alias("n_chars"), "sketch", "edited", "edited_sketch", "next_sketch"]
    return out.select(*columns).unionByName(alone.select(*columns)).withColumnRenamed("id", id_col)
