"""Intermediate tables and connected components that survive lost executors."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staleguard.session import checkpoint_dir, clean_up


BATCH_ROWS = 1000


def text_batches(df: DataFrame) -> DataFrame:
    """``df`` itself, with the session's Arrow batches held to ``BATCH_ROWS`` rows: whole texts are long, and a batch lies in
    memory several times, in the JVM and in its Python worker."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """The rows as a Parquet table in the shared checkpoint folder, read back (lineage starts there)."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, root) for every vertex of the edges (a, b): root is the least vertex that it is connected with.

    Alternating large-star and small-star steps: each lets all neighbours of a vertex point to the least of them, so
    the number of rounds grows with the logarithm of the longest path; every round is written. What a round leaves on the
    driver (plans, broadcast task code, collected hash tables) is let go before the next. The rounds end once every vertex
    has one edge at most to a root without edges of its own; a further round would change nothing.
    """
    spark = edges.sparkSession
    now = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a != b").distinct(), "edges")
    for _ in range(rounds):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .unionAll(least.select("a", F.col("m").alias("b")))
        now = written(small.distinct(), "edges")
        clean_up(spark)
        ends = now.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("root")) \
            .unionAll(now.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("root")))
        if ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("root").alias("root")).filter("up + root > 1").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")) \
        .unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
