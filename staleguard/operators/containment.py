"""Exact multi-pattern containment join: which passages occur inside which texts.

A ``contains`` theta join is a nested loop over texts x passages. Instead the
passages are compiled into one Aho-Corasick automaton per batch (the batch
size bounds what is shipped to executors), and every text partition is
scanned once in ``mapInPandas``: cost is linear in text length plus matches,
independent of the number of passages. Texts are never shuffled.
"""

from __future__ import annotations

import uuid

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PATTERNS_PER_BATCH = 50_000
MAX_PATTERN_BYTES_PER_BATCH = 64 << 20


def _batches(passages: DataFrame, pid_col: str, ptext_col: str):
    """Yield lists of (pid, text) with bounded count and bytes.

    The passage table is read in id order through ``toLocalIterator`` so only
    one batch is ever held on the driver.
    """
    batch, size = [], 0
    rows = passages.select(F.col(pid_col).alias("pid"), F.col(ptext_col).alias("p")) \
        .where(F.col("p").isNotNull()).orderBy("pid").toLocalIterator()
    for r in rows:
        b = len(r["p"].encode("utf-8"))
        if batch and (len(batch) >= MAX_PATTERNS_PER_BATCH or size + b > MAX_PATTERN_BYTES_PER_BATCH):
            yield batch
            batch, size = [], 0
        batch.append((r["pid"], r["p"]))
        size += b
    if batch:
        yield batch


_built: dict[str, tuple] = {}  # of this Python worker: the automaton of the batch it last worked on


def _automaton(key: str, patterns, lower: bool):
    """(ids of empty passages, automaton or None), built once per batch and worker."""
    if key not in _built:
        by_text: dict[str, list] = {}
        for pid, p in patterns:
            by_text.setdefault(p.lower() if lower else p, []).append(pid)
        empty, auto = by_text.pop("", []), None
        if by_text:
            auto = ahocorasick.Automaton()
            for text, ids in by_text.items():
                auto.add_word(text, ids)
            auto.make_automaton()
        _built.clear()
        _built[key] = (empty, auto)
    return _built[key]


def _scanner(patterns, id_col, text_col, lower):
    key = uuid.uuid4().hex

    def run(it):
        import pandas as pd
        empty, auto = _automaton(key, patterns, lower)
        for pdf in it:
            out_ids, out_pids = [], []
            for did, t in zip(pdf[id_col].tolist(), pdf[text_col].tolist()):
                if t is None:
                    continue
                found = set(empty)
                if auto is not None:
                    for _, ids in auto.iter(t.lower() if lower else t):
                        found.update(ids)
                out_ids += [did] * len(found)
                out_pids += found
            yield pd.DataFrame({"id": pd.Series(out_ids, dtype="int64"), "pid": pd.Series(out_pids, dtype="int64")})
    return run


def passage_hits(texts: DataFrame, id_col: str, text_col: str, passages: DataFrame, pid_col: str,
                 ptext_col: str, lower: bool = False) -> DataFrame:
    """(id, pid) for every text that contains a passage (case-folded when ``lower``)."""
    from staleguard.session import checkpoint_dir, materialize
    src = texts.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col))
    out = None
    for i, batch in enumerate(_batches(passages, pid_col, ptext_col)):
        part = src.mapInPandas(_scanner(batch, id_col, text_col, lower), "id bigint, pid bigint")
        if i > 0 or len(batch) >= MAX_PATTERNS_PER_BATCH:
            # several batches: materialise each before reading the next, so the driver holds one
            checkpoint_dir(texts.sparkSession)
            part = part.transform(materialize)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return texts.sparkSession.createDataFrame([], "id bigint, pid bigint")
    return out
