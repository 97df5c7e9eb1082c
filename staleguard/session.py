"""Session construction and cluster-shared locations."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins from runtime sizes (so a
# data-dependent side is only broadcast once its real size is known) and
# splits skewed shuffle partitions; session time zone is pinned so DATE /
# TIMESTAMP values compare equal across engines.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "staleguard", extra: dict | None = None) -> SparkSession:
    """Get or create a session with the defaults above.

    On a cluster call it without ``master``; the launcher decides. Local runs
    (tests, bench) pass ``local[N]`` and a small shuffle partition count.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


MAX_SHUFFLE_PARTITIONS = 65536


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Uses ``spark.checkpoint.dir`` when the cluster names one. Only when it is
    unset and everything runs in one process (tests) a fresh scratch folder is created and registered.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="staleguard-ckpt-", dir=os.environ.get("STALEGUARD_SCRATCH", "/tmp"))
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def materialize(df):
    """Reliable checkpoint without computing the plan twice.

    ``checkpoint()`` writes the files in a second job that recomputes the plan
    unless the data is persisted, so the rows are persisted first (memory and
    disk), checkpointed into the shared folder, then released. The result's
    lineage starts at the checkpoint files and survives executor loss.
    """
    from pyspark import StorageLevel
    checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint()
    cached.unpersist()
    return out


BLOB_TABLE = {"parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.block.size": 1 << 24, "parquet.enable.dictionary": "false"}


SLIM_TABLE = {"compression": "zstd"}  # for many short rows


def stored(df, options=BLOB_TABLE):
    """(the rows as a table of its own in the shared folder, read back, its path), for tables that a loop replaces.

    A checkpoint's files stay until the application ends; these go by ``discard``. Rows may be megabytes long, so the writer looks
    at its size after every row and a row group holds 16 MiB, unless ``options`` say otherwise. Unlike a checkpoint, which
    is made from a persisted copy, the rows lie on disk once, and packed.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"stored-{uuid.uuid4().hex}")
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that ``stored`` wrote and nothing reads any more.

    The shuffle files of the jobs that wrote them go when the driver's JVM collects their plans, which is asked for here: with a
    large heap that may otherwise not happen while a loop runs.
    """
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if paths:
        clean_up(spark)


def clean_up(spark) -> None:
    """Asks the driver's JVM to collect plans that nothing reads any more: with them go their shuffle files and their broadcast task code."""
    spark._jvm.System.gc()
