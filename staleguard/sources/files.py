"""File sources and sinks.

All paths are expected on shared storage; scratch locations come from
:func:`staleguard.session.checkpoint_dir` (the cluster's checkpoint folder).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staleguard.functions import json as J
from staleguard.session import checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    return os.path.join(checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex}")


def read_jsonl(spark: SparkSession, path: str, language: str | None = "en") -> DataFrame:
    """A1: JSON-lines scan; the schema is the union of keys seen; optional language filter."""
    df = spark.read.json(path)
    return df.where(F.col("language") == language) if language else df


def read_csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A2: CSV with header, declared types, quoted multi-line fields and doubled quotes."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').option("quote", '"').csv(path))


def decode_lists(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A3: list-literal text columns -> arrays (``{column: element_type}``)."""
    for c, t in columns.items():
        df = df.withColumn(c, J.decode_list_literal(c, t))
    return df


def write_csv_table(df: DataFrame, path: str, list_columns: list[str] = ()) -> None:
    """Full rewrite as CSV; array columns become JSON list text."""
    out = df
    for c in list_columns:
        out = out.withColumn(c, F.to_json(c))
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_once(df: DataFrame, path: str, fail_if_exists: bool = True) -> None:
    """Create-only sink: fail, or do nothing, when the table exists."""
    df.write.mode("errorifexists" if fail_if_exists else "ignore").parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists in its own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_new(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """A7 + C6: append rows whose keys are not in the stored table; returns the appended rows.

    A stored table without one of the key columns is an error, not an empty table.
    """
    spark = df.sparkSession
    new = df.join(spark.read.parquet(path).select(*keys), keys, "left_anti") if path_exists(spark, path) else df
    new.write.mode("append").parquet(path)
    return new


def chunk_table_for_store(chunks: DataFrame) -> DataFrame:
    """Store form of chunks: no vector column, missing ``outdated_by`` -> []."""
    out = chunks.drop("embedding", "vector")
    if "outdated_by" in out.columns:
        out = out.withColumn("outdated_by", F.coalesce("outdated_by", F.array().cast("array<bigint>")))
    else:
        out = out.withColumn("outdated_by", F.array().cast("array<bigint>"))
    return out
