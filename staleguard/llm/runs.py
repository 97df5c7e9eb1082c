"""Periodic runs of words by descending-LCP Kruskal (operator 13).

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least
max(6, 4 q) that no neighbouring word extends. Per document:

1. The suffixes of its word sequence are sorted by prefix doubling, each round only those that are still tied; the ranks
   after each round give the longest common prefix (LCP) of neighbouring suffixes, longest steps first.
2. Neighbours are united in order of falling LCP. A class is an ordered list of positions; the smaller joins the larger.
   Positions p < p + d that become neighbours in the merged list have exactly the merge's LCP in common, so words p to
   p + d + LCP have period d and the next word breaks it. Where 3 d <= LCP and no word before p keeps the period, this
   is a run, and d is its smallest period: a smaller one would have put a position between the two earlier. Every run
   is found once, at its first word and the one a period later.

A run needs an LCP of 5 (six times one word) or more, so only documents in which five words repeat are sorted, and only
LCPs from 5 on are united. Words are told apart by 64-bit hashes; every run found is confirmed on the words themselves.
Many documents are worked on at once, a bounded piece of text at a time; a longer document is a piece of its own.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staleguard.llm.arrowtext import byte_pieces, range_hashes, row_of, texts_of, window_hashes, word_ranges
from staleguard.llm.shared import text_batches

SHORTEST = 6  # words
TIMES = 4  # periods
LEAST_LCP = 5  # what any run's first two positions have in common: max(SHORTEST - 1, (TIMES - 1) * period) at period 1

RUN = "struct<start: long, length: long, period: long>"


def _ranks(row: np.ndarray, stop: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, until none are tied.

    ``row`` is the document of each word and ``stop`` the end of that document; suffixes of different documents never
    tie, and neither do two of one document that both end early, since one is longer.
    """
    n = len(words)
    order = np.lexsort((words, row))
    fresh = np.ones(n, bool)
    fresh[1:] = (words[order[1:]] != words[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    levels, step = [rank.astype(np.int32 if n < 1 << 31 else np.int64)], 1
    tied = order[~(fresh & np.append(fresh[1:], True))]
    while len(tied):
        after = np.minimum(tied + step, n - 1)
        second = np.where(tied + step < stop[tied], rank[after] + 1, 0)
        first = rank[tied]
        by = np.argsort(first * (n + 1) + second, kind="stable")
        tied, first, second = tied[by], first[by], second[by]
        group = np.ones(len(tied), bool)
        group[1:] = first[1:] != first[:-1]
        fresh = group.copy()
        fresh[1:] |= second[1:] != second[:-1]
        at = np.arange(len(tied))
        rank[tied] = first + at[fresh][np.cumsum(fresh) - 1] - at[group][np.cumsum(group) - 1]
        levels.append(rank.astype(levels[0].dtype))
        tied = tied[~(fresh & np.append(fresh[1:], True))]
        step *= 2
    return levels


def neighbours(row: np.ndarray, stop: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, LCP) of suffixes next to each other in sorted order that have ``least`` words or more in common."""
    levels = _ranks(row, stop, words)
    place = np.empty(len(words), np.int64)
    place[levels[-1]] = np.arange(len(words))
    a, b = place[:-1], place[1:]
    coarse = levels[min(len(levels) - 1, least.bit_length() - 1)]  # ranks by the largest power of two up to ``least`` words
    alike = coarse[a] == coarse[b] if len(levels) >= least.bit_length() else np.zeros(len(a), bool)
    a, b = a[alike], b[alike]
    lcp = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        inside = np.flatnonzero((x < stop[a]) & (y < stop[b]))
        same = inside[levels[k][x[inside]] == levels[k][y[inside]]]
        lcp[same] += 1 << k
    enough = lcp >= least
    return a[enough], b[enough], lcp[enough]


def seeds(a: np.ndarray, b: np.ndarray, lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """(p, d, LCP) of positions p and p + d that become neighbours in a class when edges unite by falling LCP, 3 d <= LCP."""
    if len(a) == 0:
        return []
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    falling = np.argsort(-lcp, kind="stable")
    left, right, common = ends[:len(a)][falling].tolist(), ends[len(a):][falling].tolist(), lcp[falling].tolist()
    parent = list(range(len(names)))
    members = [[p] for p in names.tolist()]
    out = []
    for x, y, shared in zip(left, right, common):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if len(members[x]) < len(members[y]):
            x, y = y, x
        parent[y] = x
        large, small, members[y] = members[x], members[y], None
        reach = shared // (TIMES - 1)
        if len(small) == 1:
            p = small[0]
            i = bisect_left(large, p)
            if i and p - large[i - 1] <= reach:
                out.append((large[i - 1], p - large[i - 1], shared))
            if i < len(large) and large[i] - p <= reach:
                out.append((p, large[i] - p, shared))
            large.insert(i, p)
            continue
        large += small
        large.sort()  # two ordered runs: a merge
        own = set(small)
        for p in small:
            i = bisect_left(large, p)
            if i and (q := large[i - 1]) not in own and p - q <= reach:
                out.append((q, p - q, shared))
            if i + 1 < len(large) and (q := large[i + 1]) not in own and q - p <= reach:
                out.append((p, q - p, shared))
    return out


def word_runs(words: np.ndarray, first: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """{row: its runs (start, length, period) by start, then period} of rows of words, row r being words[first[r]:first[r + 1]].

    Rows without runs are left out.
    """
    windows, wfirst = window_hashes(words, first, LEAST_LCP)
    if len(windows) == 0:
        return {}
    wrow = row_of(wfirst)
    by = np.lexsort((windows, wrow))
    again = (windows[by[1:]] == windows[by[:-1]]) & (wrow[by[1:]] == wrow[by[:-1]])
    rows = np.unique(wrow[by[1:][again]])
    if len(rows) == 0:
        return {}
    sizes = first[rows + 1] - first[rows]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    own = row_of(begin)
    local = words[np.arange(begin[-1]) + (first[rows] - begin[:-1])[own]]
    local = np.unique(local, return_inverse=True)[1]
    out: dict[int, list[tuple[int, int, int]]] = {}
    spelled = local.tolist()
    for p, d, shared in seeds(*neighbours(own, begin[1:][own], local, LEAST_LCP)):
        r = int(own[p])
        if d + shared < SHORTEST or (p > begin[r] and spelled[p - 1] == spelled[p + d - 1]):
            continue
        out.setdefault(int(rows[r]), []).append((p - int(begin[r]), d + shared, d))
    return {r: sorted(v, key=lambda run: (run[0], run[2])) for r, v in out.items()}


def _holds(words: list[bytes], run: tuple[int, int, int]) -> bool:
    """The run on the words themselves (64-bit hashes of two words could fall together)."""
    start, length, period = run
    return words[start:start + length - period] == words[start + period:start + length]


def kept_words(words: list, runs) -> list:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def periodic_runs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, runs ARRAY<STRUCT<start, length, period>>, collapsed): one row per row of ``df``.

    ``runs`` are sorted by start, then period; ``collapsed`` are the words outside the repeats of all runs, joined by one
    space. A null text is empty, and so is one without words: 0, [], ''. Ids may be null or repeat; every row has
    its own result. Other columns of ``df`` don't come along.
    """
    def run(batches):
        for batch in batches:
            col = texts_of(batch, "__text")
            n, found, collapsed = [], [], []
            for a, b, data, offsets in byte_pieces(col):
                starts, ends, first = word_ranges(data, offsets)
                runs = word_runs(range_hashes(data, starts, ends), first)
                raw, at = data.tobytes(), offsets.tolist()
                for r in range(b - a):
                    words = raw[at[r]:at[r + 1]].split()  # bytes.split() parts at \x20 and \x09-\x0D
                    own = [x for x in runs.get(r, ()) if _holds(words, x)]
                    n.append(len(words))
                    found.append([{"start": s, "length": m, "period": d} for s, m, d in own])
                    collapsed.append(b" ".join(kept_words(words, own)))
            kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(found, kind),
                                              pa.array(collapsed, pa.binary()).cast(pa.string())], names=["id", "n_words", "runs", "collapsed"])

    rows = text_batches(df).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("__text"))
    return rows.mapInArrow(run, f"id long, n_words long, runs array<{RUN}>, collapsed string")


def strongest(runs) -> F.Column:
    """The run with the greatest length / period (ties: the smallest start, then period), or null.

    A quotient of two whole numbers below 2^26 has its exact order as a double.
    """
    one = F.transform(runs, lambda r: F.struct((r["length"] / r["period"]).alias("e"), (-r["start"]).alias("s"), (-r["period"]).alias("p"),
                                               r["length"].alias("length")))
    top = F.array_max(one)
    return F.when(F.size(runs) > 0, F.struct((-top["s"]).alias("start"), top["length"].alias("length"), (-top["p"]).alias("period")))
