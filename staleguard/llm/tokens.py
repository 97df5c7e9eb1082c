"""Token ids by the tokenizers library, a distinct word at a time.

The pre-tokenizers of the two supported kinds never look across the borders used here (``wordtable.units``), so the ids of a
text are those of its stretches, and every stretch that comes again is taken from a bounded table. Texts that hold
one of the tokenizer's special strings, and tokenizers of any other kind, are encoded whole.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

import numpy as np
import pyarrow as pa

from staleguard.llm.arrowtext import byte_pieces
from staleguard.llm.wordtable import LETTER, LONGEST, WordTable, classes, keys_of, units

#: Unicode white space, as the tokenizers' own patterns see it (fixed values).
WHITE = "\t-\r \x85\xa0  -     　"
CACHE_CHUNKS = 400_000
TABLE_WORDS = 700_000
TOGETHER = 200  # plain words that are encoded in one call

_odd = re.compile("[\x1c-\x1f]")
_solid = re.compile(f"[^{WHITE}]+")
_spaced = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


class ChunkCache(dict):
    """Two generations of at most ``limit`` entries each: what has been used since the last turn stays."""

    def __init__(self, limit: int = CACHE_CHUNKS):
        super().__init__()
        self.old, self.limit = {}, limit

    def unknown(self, chunks) -> list[str]:
        """Chunks without an entry; those of the older generation move up."""
        out = []
        for c in {c for c in chunks if c not in self}:
            got = self.old.get(c)
            if got is None:
                out.append(c)
            else:
                self[c] = got
        return out

    def trim(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


def white_chunks(text: str) -> list[str]:
    """Runs without white space."""
    return _solid.findall(text) if _odd.search(text) else text.split()


def spaced_chunks(text: str) -> list[str]:
    """Runs without white space, each with the one space before it, and the rest of the white space as it falls."""
    return _spaced.findall(text)


def chunker_for(spec: dict):
    """The chunk function that a tokenizer file allows, or None."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if any(any(c.isspace() for c in t["content"]) or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec.get("added_tokens", [])):
        return None
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return spaced_chunks
    kinds = [n.get("type") for n in (norm or {}).get("normalizers", [])]
    first = (pre.get("pretokenizers") or [{}])[0]
    if kinds == ["NFC", "Replace", "Lowercase"] and first.get("type") == "Split" and first.get("invert") \
            and first.get("behavior") == "Removed" and spec.get("post_processor") is None:
        return white_chunks
    return None


class LibraryEncoder:
    """ids of whole texts, as ``encode(text, add_special_tokens=False)`` gives them, as little-endian uint32 bytes."""

    def __init__(self, path: str, table_size: int = TABLE_WORDS):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        chunks = chunker_for(spec)
        self.known, self.spaced = chunks is not None, chunks is spaced_chunks
        self.table = WordTable(table_size)
        self.newline = self.tokenizer.token_to_id("\u010a")
        #: Tokens that end (white_chunks) or start (spaced_chunks) a plain word.
        self.border = np.zeros(self.vocabulary, bool)
        suffix = spec["model"].get("end_of_word_suffix") or "\0"
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.border[i] = token.startswith("\u0120") if self.spaced else token.endswith(suffix)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, led: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids of all, counts) of words of plain letters, each with the space before it where ``led``.

        Each is a pre-token of its own, so many go into one call; None where the vocabulary doesn't show their borders.
        """
        between = b"" if led else b"\n" if self.spaced else b" "
        sizes = ends - starts + len(between)
        stops = np.cumsum(sizes)
        raw = data[np.minimum(np.arange(stops[-1]) + np.repeat(starts - stops + sizes, sizes), len(data) - 1)]
        if between:
            raw[stops - 1] = between[0]
        cuts = [0, *stops[TOGETHER - 1:-1:TOGETHER].tolist(), int(stops[-1])]
        whole = raw.tobytes()
        found = self.tokenizer.encode_batch_fast([whole[a:b - len(between)].decode() for a, b in zip(cuts, cuts[1:])], add_special_tokens=False)
        flat, counts = [], []
        for k, e in enumerate(found):
            ids = np.array(e.ids, np.uint32)
            if between == b"\n":
                line = np.flatnonzero(ids == self.newline)
                flat.append(np.delete(ids, line))
                counts.append(np.diff(np.concatenate([[-1], line, [len(ids)]])) - 1)
            else:
                edge = np.flatnonzero(self.border[ids])
                flat.append(ids)
                counts.append(np.diff(np.append(edge, len(ids))) if led else np.diff(np.append(-1, edge)))
            if len(counts[-1]) != min(TOGETHER, len(starts) - k * TOGETHER) or counts[-1].sum() != len(flat[-1]):
                return None
        return np.concatenate(flat), np.concatenate(counts)

    def _learn(self, data: np.ndarray, starts, ends, keys, heads, sizes, missing: np.ndarray) -> None:
        """Adds the missing stretches to the table, each once."""
        at = missing[np.unique(keys[missing], return_index=True)[1]]
        letters = np.concatenate([[0], np.cumsum(classes(data)[0] == LETTER)])
        led = (data[starts[at]] == 32) & self.spaced
        plain = letters[ends[at]] - letters[starts[at]] == sizes[at] - led
        for own, space in ((at[plain & led], True), (at[plain & ~led], False)):
            got = self._plain_words(data, starts[own], ends[own], space) if len(own) else None
            if got:
                self.table.add(keys[own], heads[own], sizes[own], *got)
            else:
                plain[np.isin(at, own)] = False
        rest = at[~plain]
        if len(rest):
            raw = data.tobytes()
            ids = self._library([raw[a:b].decode() for a, b in zip(starts[rest].tolist(), ends[rest].tolist())])
            self.table.add(keys[rest], heads[rest], sizes[rest], np.frombuffer(b"".join(ids), "<u4"), np.array([len(b) >> 2 for b in ids]))

    def _piece(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        rows = len(offsets) - 1
        raw = data.tobytes()
        if not self.known:
            return self._library([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
        starts, ends = units(data, offsets, self.spaced, self.spaced)
        keys, heads, sizes = keys_of(data, starts, ends)
        self.table.trim()
        entry = self.table.find(keys, heads, sizes)
        fits = sizes <= LONGEST
        missing = np.flatnonzero((entry < 0) & fits)
        if len(missing):
            self._learn(data, starts, ends, keys, heads, sizes, missing)
            entry[missing] = self.table.find(keys[missing], heads[missing], sizes[missing])
        flat, stops = self.table.gather(np.where(entry < 0, 0, entry)) if self.table.size else (np.zeros(0, np.uint32), np.zeros(len(entry), np.int64))
        begins = np.concatenate([[0], stops])
        first = np.searchsorted(starts, offsets)
        cuts, ids = begins[first].tolist(), flat.astype("<u4").tobytes()
        out = [ids[4 * a:4 * b] for a, b in zip(cuts, cuts[1:])]
        lost = entry < 0  # long stretches, and one that shares its hash with another
        again = set((np.searchsorted(first, np.flatnonzero(lost), side="right") - 1).tolist())
        for r in again:
            out[r] = self._row_with_long_stretches(raw, starts, ends, entry, range(first[r], first[r + 1]))
        special = [s.encode() for s in self.specials]
        if any(s in raw for s in special):
            for r in range(rows):
                text = raw[offsets[r]:offsets[r + 1]]
                if any(s in text for s in special):
                    out[r] = self._library([text.decode()])[0]
        return out

    def _row_with_long_stretches(self, raw: bytes, starts, ends, entry, own: range) -> bytes:
        at = np.arange(own.start, own.stop)
        lost = at[entry[at] < 0]
        texts = [raw[starts[i]:ends[i]].decode() for i in lost]
        found = dict(zip(distinct := list(set(texts)), self._library(distinct), strict=True))
        parts, a = [], own.start
        for i, text in zip(lost.tolist(), texts):
            parts += [self.table.gather(entry[a:i])[0].astype("<u4").tobytes(), found[text]]
            a = i + 1
        return b"".join([*parts, self.table.gather(entry[a:own.stop])[0].astype("<u4").tobytes()])

    def encode_column(self, col: pa.Array):
        """Yields the id bytes of each text of a null-free large_string array, working on about a million bytes at a time."""
        for _, _, data, offsets in byte_pieces(col):
            yield from self._piece(data, offsets)

    def encode(self, texts: list[str]):
        """Yields the id bytes of each text in order."""
        return self.encode_column(pa.array(texts, pa.large_string()))


@functools.lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    """One encoder per file and Python worker; the library's own threads stay off, since Spark runs the tasks."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return LibraryEncoder(path)
