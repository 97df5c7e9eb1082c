"""WARC archives and their capture index: round trips, lookups, equal payloads, and damaged records."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from staleguard.llm import warc


def test_keys_sort_hosts_together_and_ids_in_order():
    assert warc.reversed_host_key("https://user@www.Example.org:443/a?b=c#d") == "org,example,www)/a?b=c"
    assert warc.reversed_host_key("http://example.org:443") == "org,example:443)/"
    assert [warc.reversed_host_key(u) for u in (None, "", "mailto:a b", "//h/x\ty é")] == ["-", "-", "mailto:a%20b", "h)/x%09y%20%C3%A9"]
    ids = [None, -(1 << 63), -5, 0, 7, (1 << 63) - 1]
    keys = [warc.capture_key("http://a.b/", i) for i in ids]
    assert keys == sorted(keys) and len(set(keys)) == len(ids)
    assert [warc.page_of(warc.record_id(i)) for i in ids] == ids


def test_records_round_trip_and_damage_shows():
    payload = "Zoë\r\n\r\nWARC/1.1\r\n".encode() * 3
    digest = hashlib.sha1(payload).hexdigest()
    got = warc.parse_record(warc.record(5, "http://x.y/ z", payload, digest, None, "2000-01-01T00:00:00Z"))
    assert got == {"page_id": 5, "url": "http://x.y/%20z", "kind": "response", "digest": digest, "payload_bytes": len(payload), "refers_to": None, "payload": payload}
    got = warc.parse_record(warc.record(None, None, payload, digest, (9,), "2000-01-01T00:00:00Z"))
    assert (got["page_id"], got["url"], got["kind"], got["refers_to"], got["payload_bytes"], got["payload"]) == (None, None, "revisit", 9, len(payload), None)
    raw = gzip.decompress(warc.record(5, None, payload, digest, None, "d"))
    with pytest.raises(ValueError):
        warc.parse_record(gzip.compress(raw.replace("Zoë".encode(), b"Zoee", 1)))


def pages(spark, rows, n=3):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, key string").repartition(n, "page_id")


def records(df, **kw):
    captures = warc.write_archives(df, "page_id", "url", "html")
    folder = warc.write_index(captures, **kw)
    found = warc.lookup(warc.keys_of(df, "page_id", "url"), folder)
    return captures, folder, warc.read_records(found, payloads=True).collect()


def some_rows():
    big, other = "é" * 500, "x" * 1000
    rows = [(i, f"http://h{i % 3}.example.org/p{i % 7}", f"page {i} " * (i % 400)) for i in range(300)]
    rows += [(1000 + i, "http://one.example.org/same", big) for i in range(40)] + [(-3, "http://a.b/", big)]
    rows += [(2000, None, None), (2001, "", ""), (None, "http://n/", other), (3000, "http://r/", other), (3000, "http://r/", other), (4000, "u", "x" * 999), (4001, "u", "x" * 999)]
    return [(i, u, h, "clash", "clash") for i, u, h in rows]


def expected(rows):
    held = {}
    for i, _, h, *_ in rows:
        if len((h or "").encode()) >= 1000:
            held.setdefault(h, []).append(i)
    out = []
    for i, _, h, *_ in rows:
        body = (h or "").encode()
        top = max((x for x in held.get(h, ()) if x is not None), default=None)
        again = len(body) >= 1000 and i != top
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", top if again else None, None if again else body))
    return sorted(out, key=repr)


def plain(got):
    return sorted(((r["page_id"], r["payload_bytes"], r["digest"], r["kind"], r["refers_to"], r["payload"] if r["payload"] is None else bytes(r["payload"])) for r in got), key=repr)


@pytest.mark.parametrize("few", [50_000, 0])
def test_every_page_is_found_and_read_back(spark, monkeypatch, few):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", few)
    monkeypatch.setattr(warc, "HOT_SHARE", 20)
    rows = some_rows()
    _, folder, got = records(pages(spark, rows), block_lines=4, shards=5)
    assert plain(got) == expected(rows)
    assert len(warc.index_files(folder)) > 2


def test_prefixes_find_all_captures_of_a_url_over_many_blocks_and_files(spark):
    df = pages(spark, some_rows())
    captures, folder, _ = records(df, block_lines=4, shards=6)
    ask = spark.createDataFrame([("org,example,one)/same ", 1), ("org,example,h1)/p2 ", 1), ("no,such)/ ", 1), (None, 1), ("org,example,one)/same ", 2)], "key string, file int")
    got = [r["key"] for r in warc.lookup(ask, folder).collect()]
    want = [r["key"] for r in captures.filter(F.col("key").startswith("org,example,one)/same ") | F.col("key").startswith("org,example,h1)/p2 ")).collect()]
    assert sorted(got) == sorted(want) and len(got) > 50


def test_search_visits_few_blocks(spark, monkeypatch):
    rows = [(i, f"http://h{i}.org/", "x", "", "") for i in range(2000)]
    _, folder, _ = records(pages(spark, rows), block_lines=16, shards=4)
    seen, files, whole = [], warc.index_files(folder), warc._block.__wrapped__
    monkeypatch.setattr(warc, "_block", lambda name, k: seen.append((name, k)) or whole(name, k))
    for i in random.Random(1).sample(range(2000), 50):
        seen.clear()
        assert len(list(warc.find(files, warc.capture_key(f"http://h{i}.org/", i).encode()))) == 1
        assert len(seen) <= 3


def test_nothing_gives_nothing(spark):
    captures, folder, got = records(pages(spark, some_rows()).limit(0))
    assert captures.count() == 0 and warc.index_files(folder) == [] and got == []
