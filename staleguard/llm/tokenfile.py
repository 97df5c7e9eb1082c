"""Flat token-id files with 64-bit offsets, read back by memory map (operator 5).

A dataset is a folder of shards in ascending id order. ``shard-00000.bin`` holds the ids of its documents one after
another as flat little-endian unsigned integers of 16 or 32 bits, as the vocabulary asks; ``shard-00000.idx`` holds 64-bit
integers: the number n of documents and how many of the first have no id, then n document ids, then n + 1 offsets in ids from
the shard's start. The shards' bases, the ids of all documents before each shard, are prefix sums of their sizes and lie in ``bases.idx``.

Every range of document ids is written by the task that holds it, under a name of its own that is then renamed, so a
task that runs again, or twice, leaves the same whole shard. The folder must be a path that the driver and all executors
mount (memory maps need one); the default is a new folder in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staleguard.llm.arrowtext import texts_of
from staleguard.llm.shared import text_batches
from staleguard.llm.tokens import library_encoder
from staleguard.session import checkpoint_dir


def mounted(path: str) -> str:
    """The plain path of a ``file:`` URI or path; other file systems can't be memory-mapped."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"{path}: token files need a mounted folder, not {url.scheme}:")
    return unquote(url.path) if url.scheme else path


def new_folder(spark: SparkSession) -> str:
    """A fresh folder inside the shared checkpoint folder."""
    return os.path.join(mounted(checkpoint_dir(spark)), f"token-ids-{uuid.uuid4().hex}")


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _into_place(write, path: str) -> None:
    own = f"{path}.{uuid.uuid4().hex}.part"
    with open(own, "wb") as f:
        write(f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(own, path)


def write_token_files(df: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, folder: str | None = None,
                      shards: int | None = None) -> str:
    """Encodes whole texts, appends ``end_id`` to each, writes the shards; returns the folder.

    Texts are encoded where they are read; only their ids are kept and dealt out by ranges of document ids (approximate quantiles). Documents lie in
    ascending order of id (null ids first; equal ids in order of their token ids' bytes). A null text is empty: it has the end id alone. An empty table gives a folder with no shards.
    """
    spark = df.sparkSession
    folder = folder or new_folder(spark)
    os.makedirs(folder, exist_ok=True)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    rows = text_batches(df).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("__text"))
    cuts = rows.agg(F.percentile_approx("id", [k / shards for k in range(1, shards)], 10_000)).first()[0] if shards > 1 else []
    cuts = np.array(cuts or [], np.int64)  # one document id per shard

    def encode(batches):
        encoder = library_encoder(tokenizer)
        kind = id_type(max(encoder.vocabulary, end_id + 1))
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            raw = [np.frombuffer(ids + end, "<u4").astype(kind).tobytes() for ids in encoder.encode_column(texts_of(batch, "__text"))]
            ids = batch.column(0)
            shard = np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(cuts, ids.fill_null(0).to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), ids, pa.array(raw, pa.binary()), pa.array([kind] * len(raw), pa.string())],
                                             names=["shard", "id", "ids", "kind"])

    def run(batches):
        from pyspark import TaskContext
        name = os.path.join(folder, f"shard-{TaskContext.get().partitionId():05d}")
        ids, sizes, kinds = [], [], set()

        def write(f):
            for batch in batches:
                ids.extend(batch.column(1).to_pylist())
                kinds.update(batch.column(3).unique().to_pylist())
                for raw in batch.column(2):
                    f.write(raw.as_buffer())
                    sizes.append(raw.as_buffer().size)

        _into_place(write, f"{name}.bin")
        kind = kinds.pop() if kinds else "<u2"
        starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]) // int(kind[2])
        nulls = ids.count(None)  # they come first
        head = np.concatenate([[len(ids), nulls], np.array([i or 0 for i in ids], np.int64), starts]).astype("<i8")
        _into_place(lambda f: f.write(head.tobytes()), f"{name}.idx")
        yield pa.RecordBatch.from_arrays([pa.array([f"{os.path.basename(name)}"]), pa.array([int(starts[-1])], pa.int64()),
                                          pa.array([kind])], names=["shard", "n_ids", "kind"])

    done = rows.mapInArrow(encode, "shard int, id long, ids binary, kind string").repartitionById(shards, F.col("shard")) \
        .sortWithinPartitions("id", "ids").mapInArrow(run, "shard string, n_ids long, kind string").collect()  # one row per shard
    done = sorted(r for r in done if r["n_ids"])
    bases = np.concatenate([[0], np.cumsum([r["n_ids"] for r in done], dtype=np.int64)]).astype("<i8")
    _into_place(lambda f: f.write(bases.tobytes()), os.path.join(folder, "bases.idx"))
    _into_place(lambda f: f.write("".join(f"{r['shard']} {r['kind']}\n" for r in done).encode()), os.path.join(folder, "shards.txt"))
    return folder


def read_shard(folder: str, shard: str, kind: str):
    """(document ids, offsets, ids) of a shard: the document ids as an Arrow array, the ids as a memory map."""
    head = np.fromfile(os.path.join(folder, f"{shard}.idx"), "<i8")
    n, nulls = int(head[0]), int(head[1])
    return pa.array(head[2:n + 2], mask=np.arange(n) < nulls), head[n + 2:], np.memmap(os.path.join(folder, f"{shard}.bin"), kind, "r")


def shard_list(folder: str) -> list[tuple[str, str, int]]:
    """(shard, kind, base) in order."""
    with open(os.path.join(folder, "shards.txt"), encoding="utf-8") as f:
        names = [line.split() for line in f]
    bases = np.fromfile(os.path.join(folder, "bases.idx"), "<i8")
    return [(s, k, int(b)) for (s, k), b in zip(names, bases)]


def read_token_files(spark: SparkSession, folder: str, summarise, schema: str) -> DataFrame:
    """Rows of ``summarise(document ids (Arrow), starts in the whole set, sizes, iterator of id arrays)``, a RecordBatch per shard.

    One task per shard; each maps its shard's file and touches one document at a time.
    """
    listed = shard_list(folder)
    table = spark.createDataFrame(listed, "shard string, kind string, base long") if listed else \
        spark.createDataFrame([], "shard string, kind string, base long")

    def run(batches):
        for batch in batches:
            for shard, kind, base in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids, offsets, flat = read_shard(folder, shard, kind)
                yield summarise(ids, offsets[:-1] + base, np.diff(offsets), (flat[a:b] for a, b in zip(offsets, offsets[1:])))

    return table.repartition(max(1, len(listed)), "shard").mapInArrow(run, schema)
