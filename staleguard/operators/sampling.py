"""Seeded, reproducible sampling.

Random choice is replaced by a seeded hash order, ``md5('<seed>-<id>')``, so
the same seed always gives the same sample on any cluster layout. Per-group
limits use ``row_number() <= n`` with a literal bound, which Spark turns into
a partial per-partition group limit before the shuffle: a hot group ships at
most ``n`` rows per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staleguard.config import SAMPLING_DOMAINS


def seeded_hash(id_col, seed: int):
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_col).cast("string")))


def round_robin_quota(n: int, domains: list[str] = SAMPLING_DOMAINS) -> dict[str, int]:
    """Picks per domain when the k-th remaining pick goes to domain ``k mod 3`` (k = n .. 1)."""
    q = {d: 0 for d in domains}
    for k in range(n, 0, -1):
        q[domains[k % len(domains)]] += 1
    return q


def stratified_sample(candidates: DataFrame, id_col: str, domain_col: str, n: int, seed: int,
                      domains: list[str] = SAMPLING_DOMAINS, exclude: DataFrame | None = None,
                      strict: bool = True) -> DataFrame:
    """Round-robin stratified sample of ``n`` ids over ``domains``.

    With ``strict`` it raises when a domain has fewer candidates than its quota (the sample is counted); without it
    such a domain gives what it has.
    """
    quota = round_robin_quota(n, domains)
    c = candidates.where(F.col(domain_col).isin(list(quota)))
    if exclude is not None:
        c = c.join(exclude.select(id_col), id_col, "left_anti")
    mx = max(quota.values()) if quota else 0
    w = Window.partitionBy(domain_col).orderBy(seeded_hash(id_col, seed), id_col)
    ranked = c.select(id_col, domain_col, F.row_number().over(w).alias("rank")).where(F.col("rank") <= mx)
    qcol = None
    for dmn, q in quota.items():
        qcol = F.when(F.col(domain_col) == dmn, F.lit(q)) if qcol is None else qcol.when(F.col(domain_col) == dmn, F.lit(q))
    sample = ranked.where(F.col("rank") <= qcol)
    if strict:
        check_quota(sample, domain_col, n, domains)
    return sample


def top_up(candidates: DataFrame, existing: DataFrame, id_col: str, domain_col: str, n: int, seed: int,
           domains: list[str] = SAMPLING_DOMAINS) -> DataFrame:
    """New ids that fill an existing selection up to its round-robin quota (K8): (id, domain, rank).

    ``existing`` (id, domain) counts towards the quota of its domain and is never picked again; a full domain gets
    nothing, a short one what it has.
    """
    quota = round_robin_quota(n, domains)
    have = existing.groupBy(domain_col).agg(F.count("*").alias("_have"))  # at most one row per domain
    rest = candidates.where(F.col(domain_col).isin(list(quota))).join(existing.select(id_col), id_col, "left_anti")
    w = Window.partitionBy(domain_col).orderBy(seeded_hash(id_col, seed), id_col)
    ranked = rest.select(id_col, domain_col, F.row_number().over(w).alias("rank")).where(F.col("rank") <= max(quota.values()))
    need = F.create_map(*(F.lit(x) for kv in quota.items() for x in kv))[F.col(domain_col)] - F.coalesce("_have", F.lit(0))
    return ranked.join(F.broadcast(have), domain_col, "left").where(F.col("rank") <= need).select(id_col, domain_col, "rank")


def check_quota(sample: DataFrame, domain_col: str, n: int, domains: list[str] = SAMPLING_DOMAINS) -> None:
    """raises when a domain has fewer rows than its quota."""
    quota = round_robin_quota(n, domains)
    got = {r[0]: r[1] for r in sample.groupBy(domain_col).count().collect()}  # at most len(domains) rows
    for dmn, q in quota.items():
        if got.get(dmn, 0) < q:
            raise RuntimeError(f"No candidate doc_ids left for domain {dmn}.")


def enough_selected(flags: DataFrame, targets: dict[str, int]) -> bool:
    """Quota check: every flag column already has its target count."""
    row = flags.agg(*[F.sum(F.col(c).cast("int")).alias(c) for c in targets]).collect()[0]
    return all((row[c] or 0) >= t for c, t in targets.items())


def k_per_group(rows: DataFrame, group_col: str, id_col: str, k: int, seed: int) -> DataFrame:
    """``k`` ids per group without replacement, by seeded hash order (F7); rank column 1..k."""
    w = Window.partitionBy(group_col).orderBy(seeded_hash(id_col, seed), id_col)
    return rows.select(group_col, id_col, F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def seeded_sample(rows: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """Simple seeded sample of ``n`` rows (F10); a top-n by hash, planned as a partial take-ordered."""
    return rows.orderBy(seeded_hash(id_col, seed), id_col).limit(n)
