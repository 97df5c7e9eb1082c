"""BPE, library encoding by chunks, and token files, against the tokenizers library itself."""

import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from staleguard.llm import bpe, tokenfile, tokens

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LETTERS = "aB é'sΣİ1\x85\xa0\x1c\x0b\n\t\r  ́　日.,!ﬁÅß"


def odd_texts(n=1500):
    r = random.Random(0)
    out = ["".join(r.choice(LETTERS) for _ in range(r.randrange(0, 40))) for _ in range(n)]
    return out + ["", " ", "x <|endoftext|>  y", "a  <|startoftext|>b", "<|ENDOFTEXT|>", "aaaa" * 3000, "abcde" * 2000, "1" * 3000, "don't we'll"]


def library(path, texts):
    t = Tokenizer.from_file(path)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def numbers(raw):
    a = array("I")
    a.frombytes(raw)
    return list(a)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_chunked_encoding_is_the_librarys(path):
    texts = odd_texts()
    assert [numbers(b) for b in tokens.LibraryEncoder(path).encode(texts)] == library(path, texts)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_a_small_table_forgets_and_learns_again(path):
    r = random.Random(8)
    letters = LETTERS + "19<|×÷ÿ\u2009-_"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(0, 300))) for _ in range(2000)] + ["q" * 70 + " x", "x " + "é" * 40, "\xa0" * 80 + "a"]
    own = tokens.LibraryEncoder(path, table_size=300)
    for _ in range(2):
        assert [numbers(b) for b in own.encode(texts)] == library(path, texts)
        own.table.trim()
        assert own.table.size <= 300


def test_words_that_share_a_hash_keep_their_own_ids(monkeypatch):
    whole = tokens.keys_of
    monkeypatch.setattr(tokens, "keys_of", lambda *a: ((whole(*a)[0] % np.uint64(7)) + np.uint64(1), *whole(*a)[1:]))
    texts = ["one two three four five six seven eight nine ten", "ten nine eight", "one two"]
    assert [numbers(b) for b in tokens.LibraryEncoder(WORD).encode(texts)] == library(WORD, texts)


def test_cache_stays_bounded_and_keeps_what_is_used():
    cache = tokens.ChunkCache(limit=10)
    for k in range(100):
        for c in cache.unknown(["common", f"w{k}"]):
            cache[c] = c.encode()
        assert cache["common"] == b"common" and len(cache) <= 13 and len(cache.old) <= 13
        cache.trim()


def test_own_bpe_encodes_and_decodes_as_the_library():
    texts, own, t = odd_texts(), bpe.WordBpe(WORD, cache_chunks=50), Tokenizer.from_file(WORD)
    for text, ids in zip(texts, library(WORD, texts)):
        raw = own.encode(text)
        assert numbers(raw) == ids
        assert own.decode(raw) == t.decode(ids, skip_special_tokens=False)


def test_scanning_and_heap_merge_alike():
    own, r = bpe.WordBpe(WORD), random.Random(3)
    for _ in range(500):
        word = "".join(r.choice("thinger") for _ in range(r.randrange(2, 60))) + own.end
        n = len(word) - len(own.end)
        assert own._scan(word, [*range(n), len(word)]) == own._heap(word, [*range(n), len(word)])


def test_columns_of_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "the thing")], "id long, text string")
    got = {r["id"]: r for r in df.withColumn("ids", bpe.bpe_encode(df["text"], WORD)).withColumn("back", bpe.bpe_decode(bpe.bpe_encode(df["text"], WORD), WORD)).collect()}
    assert got[1]["ids"] == got[2]["ids"] == b"" and got[1]["back"] == ""
    assert numbers(bytes(got[3]["ids"])) == library(WORD, ["the thing"])[0] and got[3]["back"] == "the</w> thing</w>"
    assert df.limit(0).withColumn("ids", bpe.bpe_encode(df["text"], WORD)).count() == 0


def read_all(spark, folder):
    def rows(ids, starts, sizes, arrays):
        crc = [zlib.crc32(np.asarray(a).astype("<u4").tobytes()) for a in arrays]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(starts), pa.array(sizes), pa.array(crc, pa.int64())], names=["id", "start", "n", "crc"])
    return sorted((tuple(r) for r in tokenfile.read_token_files(spark, folder, rows, "id long, start long, n long, crc long").collect()), key=lambda r: r[1])


def test_token_files_round_trip(spark, tmp_path):
    texts = {i * 7 - 50: t for i, t in enumerate(odd_texts(60))} | {1000: None, 1001: "word " * 60000}
    df = spark.createDataFrame([(i, t, "x", 9) for i, t in texts.items()], "id long, text string, shard string, n_ids int").repartition(5)
    folder = tokenfile.write_token_files(df, "id", "text", WORD, 2, str(tmp_path / "out"), shards=4)
    want, at = [], 0
    for i, ids in zip(sorted(texts), library(WORD, [texts[i] or "" for i in sorted(texts)])):
        raw = np.array([*ids, 2], "<u4").tobytes()
        want.append((i, at, len(ids) + 1, zlib.crc32(raw)))
        at += len(ids) + 1
    assert read_all(spark, folder) == want
    assert all(kind == "<u2" for _, kind, _ in tokenfile.shard_list(folder))
    assert [b for _, _, b in tokenfile.shard_list(folder)] == sorted(b for _, _, b in tokenfile.shard_list(folder))


def test_token_files_of_ties_nulls_and_nothing(spark, tmp_path):
    df = spark.createDataFrame([(5, "b"), (5, "a"), (5, "a"), (None, "c")], "id long, text string")
    got = read_all(spark, tokenfile.write_token_files(df, "id", "text", WORD, 2, str(tmp_path / "ties"), shards=3))
    assert sorted((r[0] for r in got), key=str) == [5, 5, 5, None] and sorted(r[1] for r in got) == [0, 2, 4, 6]
    least = spark.createDataFrame([(-(1 << 63), "b"), (None, "c")], "id long, text string")
    assert [r[:2] for r in read_all(spark, tokenfile.write_token_files(least, "id", "text", WORD, 2, str(tmp_path / "least"), shards=1))] == [(None, 0), (-(1 << 63), 2)]
    assert read_all(spark, tokenfile.write_token_files(df.limit(0), "id", "text", WORD, 2, str(tmp_path / "none"))) == []


def test_other_file_systems_are_refused():
    assert tokenfile.mounted("file:///a%20b/c") == "/a b/c" and tokenfile.mounted("/x") == "/x"
    with pytest.raises(ValueError):
        tokenfile.mounted("hdfs://host/x")
