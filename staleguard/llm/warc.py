"""WARC archives and a two-level capture index over them (operator 11).

Archives: one gzip member per record, WARC/1.1. A payload of ``SMALLEST`` bytes or more is stored once: the row with the
largest id is its ``response``, every other row with an equal payload a ``revisit`` that refers to it and holds the HTTP
head alone. Each task writes a file of its own, under a name no other attempt uses, and returns a capture row per record; the
capture table is committed before it is used, so it names the files of exactly one attempt per task.

Index: captures sorted by their key, which is the URL with its host's labels reversed (``org,example,www)/path?query``) and the
id, are written as compressed blocks of ``BLOCK_LINES`` lines, a file per key range. The directory of a file holds the first
key, offset and length of each of its blocks; a list of all files with their first and last keys heads the index. A lookup
binary-searches the list, the file's directory and the block that it fetches by a range read; a prefix (a key without
the id) finds all captures of a URL. Records are then range-read from the archives.

Files are reached through ``pyarrow.fs`` by the URI of the folder, so any shared file system that it knows will do. Only the
list of index files (one row each) passes through the driver.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
import json
import re
import uuid
import zlib
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staleguard.llm.shared import text_batches, written
from staleguard.session import checkpoint_dir

SMALLEST = 1000  # bytes from which equal payloads are stored once
BLOCK_LINES = 1024
FILE_LINES = 50_000  # captures in an index file, about
READ_BYTES = 16 << 20  # of archive that a task reads back, about
BROADCAST_GROUPS = 50_000  # groups of equal payloads (about 60 bytes each) that are broadcast at most
HOT_SHARE = 1000  # a group with a thousandth of all rows is hot; there are at most so many
CAPTURE = "key string, kind string, digest string, file string, offset long, length long"
_PRINTABLE = "".join(map(chr, range(33, 127)))
_URL = re.compile(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?//([^/?#]*)([^?#]*)(\?[^#]*)?")
_DEFAULT_PORTS = {"http": "80", "https": "443"}


# --- keys and records ----------------------------------------------------------------------------------------------

def escaped(url: str) -> str:
    """The URL in printable ASCII without spaces; what it has of these stays."""
    return url if url.isascii() and url.isprintable() and " " not in url else quote(url.encode("utf-8", "surrogatepass"), safe=_PRINTABLE)


def reversed_host_key(url: str | None) -> str:
    """``https://user@www.Example.org:443/a?b#c`` gives ``org,example,www)/a?b``; null or empty gives ``-``; what has no host stays."""
    if not url:
        return "-"
    m = _URL.match(url)
    if not m:
        return escaped(url)
    host, _, port = m[2].rpartition("@")[2].lower().partition(":")
    if port == _DEFAULT_PORTS.get((m[1] or "").lower()):
        port = ""
    return escaped(",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (m[3] or "/") + (m[4] or ""))


def capture_key(url: str | None, page_id: int | None) -> str:
    """Key, a space, and the id as 16 hex digits that sort as it does (nothing for a null id)."""
    return f"{reversed_host_key(url)} " + ("" if page_id is None else f"{page_id + (1 << 63):016x}")


def record_id(page_id: int | None) -> str:
    """The id as a UUID of version 8 (own layout): rows that repeat an id share it."""
    n = 0 if page_id is None else (1 << 64) | (page_id + (1 << 63))
    return f"<urn:uuid:{uuid.UUID(int=(n >> 62) << 64 | 0x8000 << 64 | 0b10 << 62 | n & (1 << 62) - 1)}>"


def page_of(record: str) -> int | None:
    n = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    n = (n >> 64 & 0xFFF) << 62 | n & (1 << 62) - 1
    return (n & (1 << 64) - 1) - (1 << 63) if n >> 64 else None


def _sha1_header(hexadecimal: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def _member(head: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", str(len(block)))])
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + press.flush()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: tuple[int | None] | None, date: str) -> bytes:
    """A response, or a revisit of the page in ``refers_to``, as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date)]
    if url:
        head.append(("WARC-Target-URI", escaped(url)))
    head += [("WARC-Payload-Digest", _sha1_header(digest)), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        return _member(head, http + payload)
    return _member([*head, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                    ("WARC-Refers-To", record_id(refers_to[0])), ("WARC-Refers-To-Date", date)], http)


def parse_record(member: bytes) -> dict:
    """page_id, url, kind, digest (hex), payload_bytes, refers_to, payload (None for a revisit); raises where the payload isn't what the head says."""
    raw = zlib.decompress(member, 31)
    top, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = top.decode().split("\r\n")
    head = dict(x.split(": ", 1) for x in lines)
    block = rest[:int(head["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("no whole WARC record at this place")
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    refers = head.get("WARC-Refers-To")
    if refers is None and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {head['WARC-Record-ID']} is damaged")
    return {"page_id": page_of(head["WARC-Record-ID"]), "url": head.get("WARC-Target-URI"), "kind": head["WARC-Type"], "digest": digest,
            "payload_bytes": n, "refers_to": refers and page_of(refers), "payload": payload if refers is None else None}


# --- files -----------------------------------------------------------------------------------------------------------

def store(uri: str):
    """(file system, path) of a URI; a bare path and ``file:`` are the mounted file system."""
    from pyarrow import fs
    url = urlparse(uri)
    if url.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(url.path) if url.scheme else uri
    return fs.FileSystem.from_uri(uri)


def new_folder(spark: SparkSession, name: str) -> str:
    """The URI of a fresh folder in the shared checkpoint folder."""
    uri = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    files, path = store(uri)
    files.create_dir(path, recursive=True)
    return uri


@functools.lru_cache(maxsize=8)
def _opened(uri: str):
    files, path = store(uri)
    return files.open_input_file(path)


def _range(uri: str, offset: int, length: int) -> bytes:
    return _opened(uri).read_at(length, offset)


# --- archives --------------------------------------------------------------------------------------------------------

def _with_response_id(pages: DataFrame) -> DataFrame:
    """``pages`` with ``m`` (rows with this payload, null if alone or small) and ``holder``, the largest id among them.

    Groups are counted by partial aggregation. A few groups are broadcast. Of many, the hot ones (at most ``HOT_SHARE``) are
    broadcast and their pages dealt out by id and URL; the others meet their pages by digest.
    """
    sized = pages.filter(F.octet_length("html") >= SMALLEST).select("digest", "page_id")
    groups = written(sized.groupBy("digest").agg(F.count("*").alias("m"), F.max("page_id").alias("holder")).filter("m > 1"), "equal-payloads")
    if groups.count() <= BROADCAST_GROUPS:
        return pages.join(F.broadcast(groups), "digest", "left")
    hot = groups.filter(F.col("m") * HOT_SHARE >= pages.count()).select("digest", F.col("m").alias("hm"), F.col("holder").alias("hh"))
    alone = F.col("hm").isNotNull() | (F.octet_length("html") < SMALLEST)
    own = F.when(alone, F.concat(F.lit("#"), F.xxhash64("page_id", "url"))).otherwise(F.col("digest"))
    return pages.join(F.broadcast(hot), "digest", "left").withColumn("by", own) \
        .join(groups.withColumnRenamed("digest", "by"), "by", "left") \
        .withColumn("m", F.coalesce("hm", "m")).withColumn("holder", F.coalesce("hh", "holder"))


def write_archives(df: DataFrame, id_col: str, url_col: str, html_col: str, folder: str | None = None, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row and returns the committed capture table (``CAPTURE``).

    A null html is an empty payload, a null URL leaves the target out. Of rows with equal payloads of ``SMALLEST`` bytes or
    more those with the largest id (null is the least; several, where rows repeat it) are responses. ``date`` stands in
    every record, as the table has none.
    """
    folder = folder or new_folder(df.sparkSession, "warc")
    html = F.coalesce(F.col(html_col), F.lit(""))
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    answer = F.col("m").isNull() | F.col("page_id").eqNullSafe(F.col("holder")) | (F.octet_length("html") < SMALLEST)
    rows = _with_response_id(pages).select("page_id", "url", F.col("html").cast("binary").alias("html"), "digest", answer.alias("answer"), "holder")

    def run(batches):
        uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        files, path = store(uri)
        out, at = [[] for _ in range(6)], 0
        with files.open_output_stream(path, compression=None, buffer_size=1 << 20) as f:
            info = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date),
                            ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            at += f.write(info)
            for batch in batches:
                for page, url, payload, digest, first, holder in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    member = record(page, url, payload, digest, None if first else (holder,), date)
                    f.write(member)
                    for col, v in zip(out, (capture_key(url, page), "response" if first else "revisit", digest, uri, at, len(member))):
                        col.append(v)
                    at += len(member)
        kinds = [pa.string()] * 4 + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["key", "kind", "digest", "file", "offset", "length"])

    return written(text_batches(rows).mapInArrow(run, CAPTURE), "captures")


# --- index -----------------------------------------------------------------------------------------------------------

def write_index(captures: DataFrame, folder: str | None = None, block_lines: int = BLOCK_LINES, shards: int | None = None) -> str:
    """Sorts the captures by key, writes blocks and directories, a file of each per key range, and the list of files; returns the folder.

    ``shards`` is the number of key ranges, by default one for ``FILE_LINES`` captures.
    A key that many captures share may fill many blocks and files. No captures give an empty list.
    """
    spark = captures.sparkSession
    folder = folder or new_folder(spark, "capture-index")
    shards = shards or 1 + captures.count() // FILE_LINES

    def run(batches):
        name = f"{folder}/{uuid.uuid4().hex}"
        files, path = store(name)
        lines, directory, at, first, last = [], [], 0, None, None

        def block(f):
            packed = zlib.compress(b"\n".join(lines), 6)
            f.write(packed)
            directory.append(b"%s\t%d\t%d" % (lines[0].partition(b"\t")[0], at, len(packed)))
            lines.clear()
            return len(packed)

        with files.open_output_stream(f"{path}.blocks", buffer_size=1 << 20) as f:
            for batch in batches:
                for key, kind, digest, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    first, last = key if first is None else first, key
                    lines.append(f"{key}\t{kind}\t{digest}\t{file}\t{offset}\t{length}".encode())
                    if len(lines) == block_lines:
                        at += block(f)
            if lines:
                at += block(f)
        with files.open_output_stream(f"{path}.directory") as f:
            f.write(b"\n".join(directory))
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([last]), pa.array([name])], names=["first", "last", "name"])

    ordered = captures.select("key", "kind", "digest", "file", "offset", "length").repartitionByRange(shards, "key", "file", "offset")
    listed = ordered.sortWithinPartitions("key", "file", "offset").mapInArrow(run, "first string, last string, name string").collect()  # one row per file
    listed = sorted((r["first"], r["last"], r["name"]) for r in listed)
    files, path = store(folder)
    with files.open_output_stream(f"{path}/files.json") as f:
        f.write(json.dumps(listed).encode())
    return folder


def index_files(folder: str) -> list[tuple[bytes, bytes, str]]:
    files, path = store(folder)
    with files.open_input_stream(f"{path}/files.json") as f:
        return [(a.encode(), b.encode(), name) for a, b, name in json.loads(f.read())]


@functools.lru_cache(maxsize=64)
def _directory(name: str) -> tuple[list[bytes], list[tuple[int, int]]]:
    files, path = store(name)
    with files.open_input_stream(f"{path}.directory") as f:
        entries = [x.split(b"\t") for x in f.read().split(b"\n")]
    return [e[0] for e in entries], [(int(e[1]), int(e[2])) for e in entries]


@functools.lru_cache(maxsize=16)
def _block(name: str, number: int) -> list[bytes]:
    return zlib.decompress(_range(f"{name}.blocks", *_directory(name)[1][number])).split(b"\n")


def find(files: list[tuple[bytes, bytes, str]], prefix: bytes):
    """Yields the index lines whose key starts with ``prefix``: binary searches in the list, a directory, and a block."""
    for k in range(bisect.bisect_left(files, prefix, key=lambda f: f[1]), len(files)):  # the first file whose last key isn't below
        if files[k][0] > prefix and not files[k][0].startswith(prefix):
            return
        firsts, _ = _directory(files[k][2])
        for number in range(max(bisect.bisect_left(firsts, prefix) - 1, 0), len(firsts)):
            if firsts[number] > prefix and not firsts[number].startswith(prefix):
                return
            lines = _block(files[k][2], number)
            for i in range(bisect.bisect_left(lines, prefix), len(lines)):
                if not lines[i].startswith(prefix):
                    return
                yield lines[i]


def lookup(keys: DataFrame, folder: str, key_col: str = "key") -> DataFrame:
    """The captures (``CAPTURE``) of every distinct key or prefix in ``keys``; null and unknown keys have none.

    Keys are sorted first, in as many ranges as there are files, so that a task's searches fall on the same few blocks.
    """
    files = index_files(folder)

    def run(batches):
        for batch in batches:
            got = [line.decode().split("\t") for key in batch.column(0).to_pylist() for line in find(files, key.encode())]
            cols = list(zip(*got)) if got else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols[:4]] + [pa.array(map(int, c), pa.int64()) for c in cols[4:]],
                                             names=["key", "kind", "digest", "file", "offset", "length"])

    wanted = keys.select(F.col(key_col).alias("key")).filter("key IS NOT NULL").distinct()
    return wanted.repartitionByRange(max(1, len(files)), "key").sortWithinPartitions("key").mapInArrow(run, CAPTURE)


def keys_of(df: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(key) of every row, as ``lookup`` takes them."""
    def run(batches):
        for batch in batches:
            keys = [capture_key(u, i) for i, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], names=["key"])

    return df.select(F.col(id_col).cast("long"), F.col(url_col)).mapInArrow(run, "key string")


def read_records(captures: DataFrame, payloads: bool = False) -> DataFrame:
    """The captures' records, range-read from the archives in order of file and place: page_id, url, kind, digest (hex SHA-1
    of the full payload), payload_bytes, refers_to and, if asked for, payload (null for a revisit)."""
    fields = [("page_id", "long"), ("url", "string"), ("kind", "string"), ("digest", "string"), ("payload_bytes", "long"), ("refers_to", "long")]
    fields += [("payload", "binary")] if payloads else []
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches):
        for batch in batches:
            got = [parse_record(_range(file, offset, length)) for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in got], kinds[t]) for n, t in fields], names=[n for n, _ in fields])

    found = written(captures.select("file", "offset", "length"), "places")
    tasks = 1 + (found.agg(F.sum("length")).first()[0] or 0) // READ_BYTES
    places = found.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return text_batches(places).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in fields))
