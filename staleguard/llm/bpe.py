"""BPE encoding and decoding with a contiguous rank array (operator 4).

A short word holds its part boundaries and, beside them, the rank of every adjacent pair. The least rank is sought by
scanning that array, one boundary is deleted, and the two neighbouring ranks are refreshed. Long words keep the same
order of merges (least rank, then leftmost) in a heap over linked parts, so that a very long run of letters doesn't
take quadratic time. Encoded chunks are kept in a bounded cache; texts are never cut.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from array import array

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from staleguard.llm.tokens import ChunkCache, chunker_for, white_chunks

SHORT = 64  # characters up to which a word is merged by scanning
NONE = 1 << 60


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte: itself where printable, else from 256 up."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(others)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a BPE file with word ends, white space dropped and lower case."""

    def __init__(self, path: str, cache_chunks: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if chunker_for(spec) is not white_chunks:
            raise ValueError(f"{path}: not a tokenizer of the supported kind")
        model = spec["model"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = byte_letters()
        self.cache = ChunkCache(cache_chunks)
        self.cut = regex.compile("|".join(f"({regex.escape(s)})" for s in self.special)) if self.special else None

    # -- one word

    def parts(self, word: str) -> list[str]:
        """The merged parts of one word in byte letters (the word end is already part of ``word``'s last letter)."""
        n = len(word) - len(self.end)
        if n <= 1:
            return [word] if word else []
        bounds = [*range(n), len(word)]
        return self._scan(word, bounds) if n <= SHORT else self._heap(word, bounds)

    def _scan(self, word: str, bounds: list[int]) -> list[str]:
        rank = self.rank.get

        def pair(i: int) -> int:
            if i + 2 >= len(bounds):
                return NONE
            return rank((word[bounds[i]:bounds[i + 1]], word[bounds[i + 1]:bounds[i + 2]]), NONE)

        ranks = [pair(i) for i in range(len(bounds) - 2)]
        while ranks and (least := min(ranks)) < NONE:
            i = ranks.index(least)
            del bounds[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = pair(i)
            if i:
                ranks[i - 1] = pair(i - 1)
        return [word[a:b] for a, b in zip(bounds, bounds[1:])]

    def _heap(self, word: str, bounds: list[int]) -> list[str]:
        n = len(bounds) - 1
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        stop = bounds[1:]
        part = lambda i: word[bounds[i]:stop[i]]
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (r := self.rank.get((part(i), part(after[i])))) is not None:
                heapq.heappush(heap, (r, i, stop[i], stop[after[i]]))

        for i in range(n):
            offer(i)
        alive = [True] * n
        while heap:
            _, i, mid, end = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or stop[i] != mid or stop[j] != end:
                continue  # one of the two parts has changed since
            stop[i], after[i], alive[j] = stop[j], after[j], False
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [part(i) for i in range(n) if alive[i]]

    # -- texts

    def _chunk(self, chunk: str) -> bytes:
        out = array("I")
        for word in self.words.findall(chunk):
            mapped = "".join(self.letters[b] for b in word.encode("utf-8")) + self.end
            out.extend(self.vocab[p] for p in self.parts(mapped) if p in self.vocab)
        return out.tobytes()

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case goes letter by letter
        chunks = white_chunks(text.lower())
        for c in self.cache.unknown(chunks):
            self.cache[c] = self._chunk(c)
        got = b"".join(map(self.cache.__getitem__, chunks))
        self.cache.trim()
        return got

    def encode(self, text: str) -> bytes:
        """ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else self._plain(p)
                        for p in self.cut.split(text) if p)

    def decode(self, ids: bytes) -> str:
        """The tokens' strings with a space between them, as a tokenizer file without a decoder gives them."""
        numbers = array("I")
        numbers.frombytes(ids)
        try:
            return " ".join(map(self.token.__getitem__, numbers))
        except KeyError:
            return " ".join(self.token[i] for i in numbers if i in self.token)


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One encoder per file and Python worker."""
    return WordBpe(path)


def bpe_encode(text: Column, tokenizer: str) -> Column:
    """ids (binary, little-endian unsigned 32-bit) of a string column; null and empty texts have no ids."""
    @F.pandas_udf("binary")
    def encode(texts):
        own = word_bpe(tokenizer)
        return texts.fillna("").map(own.encode)
    return encode(text)


def bpe_decode(ids: Column, tokenizer: str) -> Column:
    """The text of a binary id column; null counts as no ids."""
    @F.pandas_udf("string")
    def decode(raw):
        own = word_bpe(tokenizer)
        return raw.map(lambda b: own.decode(bytes(b)) if b is not None else "")
    return decode(ids)

