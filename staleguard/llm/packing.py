"""Best-fit packing of token sequences by the linear grouping scheme (operator 3).

Only the histogram of piece lengths reaches the driver (at most ``capacity`` counts). There the large lengths are
split into groups of equal cardinality and rounded up to their group's longest, which leaves few sizes; a linear
programme over configurations of those sizes is solved by column generation; its whole multiples are filled with the
actual lengths; what is left over and all small lengths then go best-fit, longest first, into the sequence with the
least sufficient room. Equal sequences are kept as runs (pattern, number), so the plan's size depends on the capacity
alone. The pieces then find their places by (length, rank): ranks come from counts per (length, bucket) and a window
inside such a bucket, so a length that a third of all pieces share is spread over all buckets.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from staleguard.llm.arrowtext import texts_of
from staleguard.llm.shared import text_batches
from staleguard.llm.tokens import library_encoder
from staleguard.session import materialize

CAPACITY = 1024
SMALL_SHARES = (6, 2)  # lengths of at most capacity / share are small; the better plan of these is taken
GROUPS = 48
BUCKETS = 64


# --- the plan over the histogram ---------------------------------------------------------------------------

def grouped(counts: dict[int, int], n_groups: int) -> list[list[tuple[int, int]]]:
    """Lengths in falling order, cut into ``n_groups`` groups of equal cardinality; each a list of (length, number)."""
    total = sum(counts.values())
    per = max(1, -(-total // n_groups))
    out, room = [[]], per
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = per
            take = min(left, room)
            out[-1].append((length, take))
            left -= take
            room -= take
    return [g for g in out if g]


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits (unbounded knapsack over whole lengths)."""
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    small_first, gains = sizes[order], worth[order]
    for room in range(1, capacity + 1):
        fit = int(np.searchsorted(small_first, room, side="right"))
        value[room] = value[room - 1]
        if fit:
            got = value[room - small_first[:fit]] + gains[:fit]
            best = int(np.argmax(got))
            if got[best] > value[room] + 1e-12:
                value[room], choice[room] = got[best], order[best]
    used, room = np.zeros(len(sizes), int), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            used[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return float(value[capacity]), used


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, float]]:
    """Column generation for min sum(x) with sum(x * configuration) = demand: [(configuration, x)]."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        amount = np.maximum(inverse @ demand, 0)
        value, column = best_configuration(sizes, np.ones(k) @ inverse, capacity)
        if value <= 1 + 1e-9:
            break
        step = inverse @ column
        ratios = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(np.argmin(ratios))
        if not np.isfinite(ratios[leave]):
            break
        basis[:, leave] = column
    amount = np.maximum(np.linalg.inv(basis) @ demand, 0)
    return [(basis[:, i].astype(int), float(amount[i])) for i in range(k)]


class _Runs:
    """Runs of equal, partly filled sequences, found by their room."""

    def __init__(self, capacity: int):
        self.capacity, self.by_room, self.rooms = capacity, defaultdict(lambda: defaultdict(int)), []

    def add(self, pattern: tuple[int, ...], number: int) -> None:
        room = self.capacity - sum(pattern)
        if number:
            self.by_room[room][pattern] += number

    def least(self, length: int) -> int | None:
        return min((r for r, runs in self.by_room.items() if r >= length and runs), default=None)

    def take(self, room: int, most: int) -> tuple[tuple[int, ...], int]:
        runs = self.by_room[room]
        pattern = next(iter(runs))
        n = min(most, runs[pattern])
        runs[pattern] -= n
        if not runs[pattern]:
            del runs[pattern]
        return pattern, n


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS,
                   small_shares: tuple[int, ...] = SMALL_SHARES) -> list[tuple[tuple[int, ...], int]]:
    """The plan with the fewest sequences over the given borders between large and small lengths.

    Rounding wastes room where few small lengths follow, so it is tried with more and with fewer large lengths.
    """
    plans = [scheme(counts, capacity, groups, share) for share in small_shares]
    return min(plans, key=lambda plan: sum(n for _, n in plan))


def scheme(counts: dict[int, int], capacity: int, groups: int, small_share: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of one sequence, number of such sequences)]; every length is used exactly ``counts[length]`` times."""
    counts = {int(k): int(v) for k, v in counts.items() if v and k > 0}
    if any(k > capacity for k in counts):
        raise ValueError("a length exceeds the capacity")
    runs = _Runs(capacity)
    runs.add((capacity,), counts.pop(capacity, 0))
    left = {k: v for k, v in counts.items() if k * small_share <= capacity}
    if large := {k: v for k, v in counts.items() if k not in left}:
        stock = grouped(large, groups)
        sizes = np.array([g[0][0] for g in stock])
        demand = np.array([sum(n for _, n in g) for g in stock], float)
        for config, amount in sorted(configurations(sizes, demand, capacity), key=lambda x: -x[1]):
            slots, todo = [g for g in range(len(sizes)) for _ in range(config[g])], int(amount + 1e-6)
            have = np.array([sum(n for _, n in g) for g in stock])
            todo = min([todo, *(int(have[g] // config[g]) for g in set(slots))]) if slots else 0
            while todo:  # actual lengths take the places of the rounded ones, a run at a time
                need = {g: slots.count(g) for g in set(slots)}
                n = min(todo, *(max(1, stock[g][0][1] // c) for g, c in need.items()))
                pattern = []
                for g, c in need.items():
                    for _ in range(c):
                        length, number = stock[g][0]
                        use = n if number >= n else None
                        if use is None:  # only when n == 1 and the run ends inside this sequence
                            stock[g].pop(0)
                            length, number = stock[g][0]
                        pattern.append(length)
                        stock[g][0] = (length, number - n)
                        if stock[g][0][1] == 0:
                            stock[g].pop(0)
                runs.add(tuple(sorted(pattern, reverse=True)), n)
                todo -= n
        for g in stock:
            for length, n in g:
                left[length] = left.get(length, 0) + n
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            room = runs.least(length)
            if room is None:
                each = capacity // length
                runs.add((length,) * each, n // each)
                if n % each:
                    runs.add((length,) * (n % each), 1)
                break
            pattern, got = runs.take(room, n)
            fits = room // length
            if fits > 1 and n >= fits:  # a run of sequences may take several of this length each
                used = min(got, n // fits)
                runs.add(pattern + (length,) * fits, used)
                runs.add(pattern, got - used)
                n -= used * fits
            else:
                runs.add(pattern + (length,), got)
                n -= got
    return sorted((p, n) for r in runs.by_room.values() for p, n in r.items())


def places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first rank, first sequence, offset) of its segments, by rank."""
    taken, found, sequence = defaultdict(int), defaultdict(list), 0
    for pattern, number in plan:
        at = 0
        for length in pattern:
            found[length].append((taken[length], sequence, at))
            taken[length] += number
            at += length
        sequence += number
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in found.items()}


# --- the Spark job -------------------------------------------------------------------------------------------

PIECES = "__id long, __order int, piece int, start long, length long, ids_crc32 long"


def token_pieces(df: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: the ids of a whole text and the end id, cut only where they exceed ``capacity``.

    The first piece takes the remainder, all others are full. A null text is empty (its piece is the end id).
    ``__order`` numbers the rows of a batch, so that repeated rows stay apart.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        for batch in batches:
            encoder = library_encoder(tokenizer)
            ids, texts = batch.column(0).to_pylist(), texts_of(batch, "__text")
            rows = []
            for k, (doc, raw) in enumerate(zip(ids, encoder.encode_column(texts), strict=True)):
                raw += end
                n = len(raw) // 4
                first = n % capacity or min(n, capacity)
                a, piece = 0, 0
                while a < n:
                    b = a + (first if a == 0 else capacity)
                    rows.append((doc, k, piece, a, b - a, zlib.crc32(raw[4 * a:4 * b])))
                    a, piece = b, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows, strict=True) if rows else [[]] * 6,
                (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["__id", "__order", "piece", "start", "length", "ids_crc32"])

    return text_batches(df).select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).mapInArrow(run, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS, groups: int = GROUPS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    Every row gets a place; sequences are gapless from 0. Nulls in other columns, ties and repeated rows are only rows;
    an empty table gives an empty result. The rows are written to the checkpoint folder once, so that a task that
    runs again sees the same ranks.
    """
    keys = [c for c in pieces.columns if c != "length"]
    rows = materialize(pieces.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
    counted = rows.groupBy("length", "__bucket").count().collect()  # at most capacity * buckets rows
    counts = defaultdict(int)
    before = {}
    for length, bucket, n in sorted(counted):
        before[length, bucket] = counts[length]
        counts[length] += n
    spread = rows.sparkSession.sparkContext.broadcast((before, places(pack_histogram(counts, capacity, groups))))
    out = "sequence_id long, offset long"

    @F.pandas_udf(out)
    def place(length: pd.Series, bucket: pd.Series, rank: pd.Series) -> pd.DataFrame:
        before, where = spread.value
        seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        base = np.fromiter((before[k] for k in zip(length, bucket, strict=True)), np.int64, len(length))
        at = rank.to_numpy(np.int64) + base
        for value in np.unique(length.to_numpy()):
            own = np.flatnonzero(length.to_numpy() == value)
            first, sequence, offset = where[int(value)]
            k = np.searchsorted(first, at[own], side="right") - 1
            seq[own], off[own] = sequence[k] + at[own] - first[k], offset[k]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    order = Window.partitionBy("length", "__bucket").orderBy(*keys)
    ranked = rows.withColumn("__rank", F.row_number().over(order) - 1)
    return ranked.withColumn("__place", place("length", "__bucket", "__rank")) \
        .select("*", "__place.*").drop("__place", "__rank", "__bucket")


def pack_documents(df: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text: empty. Null id: kept as null. Repeated rows: each is packed. Other columns of ``df`` are not read.
    """
    placed = pack(token_pieces(df, id_col, text_col, tokenizer, end_id, capacity), capacity)
    return placed.select(F.col("__id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
