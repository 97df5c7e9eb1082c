"""Registry of named queries and their DuckDB oracle SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staleguard.session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` (with optional oracle SQL)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query key {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            checkpoint_dir(spark)  # checkpoints go to the session's shared folder (set only if unset)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return deco


def r6(c) -> Column:
    """Round a double for reporting (both engines round the same way)."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def load_all() -> None:
    """Import every plan module so all queries are registered."""
    from staleguard.plans import (  # noqa: F401
        p0_pairs, p1_scalars, p1_sets, p2_joins, p2_aggregates, p3_windows, p4_chunks,
        p5_retrieval, p6_jobs, p7_textml, p7_sinks, p8_rest,
    )
