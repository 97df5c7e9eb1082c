"""Token ids of whole batches of text: pre-tokens are cut and looked up a megabyte at a time with numpy.

``units`` cuts UTF-8 bytes into stretches that a byte-level or word-end pre-tokenizer never joins or splits otherwise: runs of
ASCII and Latin-1 letters, of ASCII digits, and of other ASCII characters, the first of a white-space-free chunk with the one space
before it where ``spaced``. Chunks that hold an apostrophe or any other character stay whole, and so do stretches of white space.
``WordTable`` maps stretches of up to ``LONGEST`` bytes to their ids: an open-addressing table of 64-bit hashes, checked by
length and first eight bytes, that forgets what it has not met for longest when it is full.
"""

from __future__ import annotations

import numpy as np

from staleguard.llm.arrowtext import mix, range_hashes

LONGEST = 64
WHITE, LETTER, DIGIT, OTHER, ODD = range(5)

_CLASS = np.full(256, ODD, np.uint8)
_CLASS[:128] = OTHER
_CLASS[[9, 10, 11, 12, 13, 32]] = WHITE
_CLASS[48:58] = DIGIT
_CLASS[65:91] = _CLASS[97:123] = LETTER


def classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """(class of every byte, the place where the character of each byte starts, or None if all are single bytes)."""
    kind = _CLASS[data]
    high = np.flatnonzero(data >= 128)
    if len(high) == 0:
        return kind, None
    lead = high[data[high] >= 0xC0]
    last = len(data) - 1
    b0, b1, b2 = data[lead], data[np.minimum(lead + 1, last)], data[np.minimum(lead + 2, last)]
    latin = lead[(b0 == 0xC3) & (b1 != 0x97) & (b1 != 0xB7)]  # all of U+00C0 to U+00FF but the signs for times and divided by
    kind[latin] = kind[latin + 1] = LETTER
    two = lead[(b0 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))]
    kind[two] = kind[two + 1] = WHITE
    three = lead[((b0 == 0xE1) & (b1 == 0x9A) & (b2 == 0x80))
                 | ((b0 == 0xE2) & (b1 == 0x80) & ((b2 <= 0x8A) | (b2 == 0xA8) | (b2 == 0xA9) | (b2 == 0xAF)))
                 | ((b0 == 0xE2) & (b1 == 0x81) & (b2 == 0x9F)) | ((b0 == 0xE3) & (b1 == 0x80) & (b2 == 0x80))]
    kind[three] = kind[three + 1] = kind[three + 2] = WHITE
    begin = np.arange(len(data))
    begin[high[data[high] < 0xC0]] = 0
    return kind, np.maximum.accumulate(begin)


def units(data: np.ndarray, offsets: np.ndarray, spaced: bool, digit_runs: bool) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of all stretches in order, white space only where ``spaced``. No stretch crosses a row."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind, begin = classes(data)
    solid = kind != WHITE
    first = np.zeros(n + 1, bool)  # the first byte of a row
    first[offsets[offsets < n]] = True
    first[n] = True
    chunk = solid.copy()
    chunk[1:] &= ~solid[:-1] | first[1:-1]
    start = solid.copy()
    start[1:] &= (kind[1:] != kind[:-1]) | first[1:-1]
    if not digit_runs:
        start |= kind == DIGIT
    whole = np.flatnonzero((kind == ODD) | (data == 39))
    if len(whole):
        chunks = np.flatnonzero(chunk)
        kept = np.zeros(len(chunks), bool)
        kept[np.searchsorted(chunks, whole, side="right") - 1] = True
        at = np.flatnonzero(start)
        start[at[kept[np.searchsorted(chunks, at, side="right") - 1]]] = False
        start |= chunk
    stop = np.ones(n, bool)
    stop[:-1] = ~solid[1:] | first[1:-1] | start[1:]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop & solid) + 1
    if not spaced:
        return starts, ends
    led = chunk[starts] & ~first[starts]
    led[led] = data[starts[led] - 1] == 32
    starts = starts - led
    rest = ~solid
    rest[starts[led]] = False
    if not rest.any():
        return starts, ends
    opens, closes = rest.copy(), rest.copy()
    opens[1:] &= ~rest[:-1] | first[1:-1]
    closes[:-1] &= ~rest[1:] | first[1:-1]
    a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    split = ~first[b] & solid[np.minimum(b, n - 1)]  # a word follows at once, so the last white character stands alone
    cut = begin[b - 1] if begin is not None else b - 1
    split &= cut > a
    starts = np.concatenate([starts, a, cut[split]])
    ends = np.concatenate([ends, np.where(split, cut, b), b[split]])
    by = np.argsort(starts, kind="stable")
    return starts[by], ends[by]


class WordTable:
    """At most ``limit`` stretches and their ids."""

    def __init__(self, limit: int):
        self.limit, self.turn = limit, 0
        self._fresh(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _fresh(self, keys, heads, sizes, counts, flat, used) -> None:
        room = max(1024, 2 * len(keys))
        self.size, self.flat_size = len(keys), len(flat)
        grown = lambda v, n: np.concatenate([v, np.zeros(n - len(v), v.dtype)])
        self.keys, self.heads, self.sizes, self.counts, self.used = (grown(v, room) for v in (keys, heads, sizes, counts, used))
        self.places = grown(np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(keys) else np.zeros(0, np.int64), room)
        self.flat = grown(flat, max(4096, 2 * len(flat)))
        self._slots(max(self.limit, len(keys)))

    def _slots(self, n: int) -> None:
        """Slots for n entries or more, at most half of them taken."""
        bits = max(10, (2 * n).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.slot_key, self.slot_entry = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        self._place(self.keys[:self.size], np.arange(self.size, dtype=np.int32))

    def _place(self, keys: np.ndarray, entries: np.ndarray) -> None:
        slot, todo = keys & self.mask, np.arange(len(keys))
        while len(todo):
            free = self.slot_entry[slot[todo]] < 0
            self.slot_entry[slot[todo[free]]] = entries[todo[free]]  # of several claims the last one holds
            done = self.slot_entry[slot[todo]] == entries[todo]
            self.slot_key[slot[todo[done]]] = keys[todo[done]]
            todo = todo[~done]
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask

    def find(self, keys: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Entry of each stretch, -1 where there is none (or one that only shares the hash)."""
        out, slot, todo = np.full(len(keys), -1, np.int64), keys & self.mask, np.arange(len(keys))
        while len(todo):
            entry = self.slot_entry[slot[todo]]
            hit = (entry >= 0) & (self.slot_key[slot[todo]] == keys[todo])
            out[todo[hit]] = entry[hit]
            todo = todo[(entry >= 0) & ~hit]
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask
        got = np.flatnonzero(out >= 0)
        other = got[(self.heads[out[got]] != heads[got]) | (self.sizes[out[got]] != sizes[got])]
        out[other] = -1
        self.turn += 1
        self.used[out[out >= 0]] = self.turn
        return out

    def add(self, keys: np.ndarray, heads: np.ndarray, sizes: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> None:
        """New stretches with distinct keys; ``flat`` holds the ids of all of them, ``counts`` how many each has."""
        n, m = self.size + len(keys), self.flat_size + len(flat)
        for name in ("keys", "heads", "sizes", "counts", "used", "places"):
            own = getattr(self, name)
            if n > len(own):
                own = np.concatenate([own, np.zeros(2 * n - len(own), own.dtype)])
                setattr(self, name, own)
        if m > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(2 * m - len(self.flat), np.uint32)])
        at = slice(self.size, n)
        self.keys[at], self.heads[at], self.sizes[at], self.counts[at], self.used[at] = keys, heads, sizes, counts, self.turn
        self.places[at] = self.flat_size + np.cumsum(counts) - counts
        self.flat[self.flat_size:m] = flat
        before, self.size, self.flat_size = self.size, n, m
        if 2 * n > len(self.slot_key):
            self._slots(n)
        else:
            self._place(keys, np.arange(before, n, dtype=np.int32))

    def trim(self) -> None:
        """Beyond the limit, the half that was met last stays."""
        if self.size <= self.limit:
            return
        kept = np.sort(np.argsort(self.used[:self.size], kind="stable")[self.size - self.limit // 2:])
        flat = self.gather(kept)[0]
        self._fresh(self.keys[kept], self.heads[kept], self.sizes[kept], self.counts[kept], flat, self.used[kept])

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all entries one after another, the end of each)."""
        counts = self.counts[entries]
        ends = np.cumsum(counts)
        return self.flat[np.repeat(self.places[entries] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)], ends


def keys_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first eight bytes, length) of every stretch."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    sizes = ends - starts
    heads = words[starts]
    short = sizes < 8
    heads[short] &= (np.uint64(1) << (sizes[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
    return mix(range_hashes(data, starts, ends)), heads, sizes
