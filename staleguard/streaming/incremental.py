"""Incremental processing with Structured Streaming (the streaming form of C6 + A7).

New request files landing in a folder are picked up by a file stream; every
micro-batch is anti-joined against the keys already stored in the sink table
and only unseen rows are appended. The checkpoint lives under the shared
checkpoint folder, so a restarted or failed job resumes where it stopped and
a replayed batch cannot append a key twice.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from staleguard.session import checkpoint_dir
from staleguard.sources.files import path_exists


def _append_unseen(sink: str, keys: list[str]):
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        if path_exists(spark, sink):
            new = new.join(spark.read.parquet(sink).select(*keys), keys, "left_anti")
        new.write.mode("append").parquet(sink)
    return run


def run_incremental(spark: SparkSession, source_dir: str, schema: str, sink: str, keys: list[str],
                    name: str = "incremental", once: bool = True):
    """Start (or resume) the stream; with ``once`` it processes what is available and stops."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    w = (stream.writeStream.foreachBatch(_append_unseen(sink, keys))
         .option("checkpointLocation", os.path.join(checkpoint_dir(spark), "streams", name)))
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")
    q = w.start()
    if once:
        q.awaitTermination()
    return q
