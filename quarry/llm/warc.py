"""WARC archives with a two-level capture index (operator 1).

Writing: records go to gzip members of WARC files in the shared folder; of records with equal payloads the
one with the largest page_id is a response, the others revisit it.  Each record leaves one capture row.

Index: captures are range-sorted by reversed-host URL key (``com,example)/path``); each range becomes a shard file of
compressed blocks and a directory file with one line per block (first key, place, rows).  The first keys of
the shards form the top level, one row per shard.  A lookup binary-searches shards and blocks, reads the blocks by
range, and then the records by range, neighbours together.

Every stage is a table of places in the shared folder: a file left by a lost task is never referred to.

Defined results: null html is the empty payload; null url has the key ``)/``; null page_ids are smaller than all
others and may be responses; rows that repeat both page_id and payload are all responses; captures that tie in key
are ordered by place; payloads of any length are one record; an empty table gives an empty archive and result;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import json
import uuid
import zlib
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import make_dir, new_path, staged, table

BLOCK_ROWS, FILE_BYTES, GAP, TASK_PLACES = 3000, 256 << 20, 64 << 10, 20_000
_DATE = "2024-01-01T00:00:00Z"
#: High halves of record ids; the low half is the page_id.
_ID, _NULL_ID = 0x71756172_72794D0D, 0x71756172_72794D0E


def url_key(url: str | None) -> str:
    """Reversed-host key: ``https://a.b.com:80/p?q`` -> ``com,b,a:80)/p?q``."""
    rest = (url or "").partition("://")[2] or (url or "")
    cut = min([i for i in map(rest.find, "/?#") if i >= 0] or [len(rest)])
    host, port = rest[:cut].lower().partition(":")[::2]
    tail = rest[cut:].partition("#")[0]
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (tail if tail.startswith("/") else "/" + tail)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=(_NULL_ID << 64) if page_id is None else (_ID << 64) | (page_id & (2**64 - 1)))}>"


def page_of(rid: str) -> int | None:
    n = uuid.UUID(rid[10:-1]).int
    if n >> 64 == _NULL_ID:
        return None
    low = n & (2**64 - 1)
    return low - 2**64 if low >= 2**63 else low


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id, url, payload: bytes, digest: str, date: str, refers_to=None) -> bytes:
    """One WARC/1.1 record; url characters that would break a header are percent-encoded."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if kind == "response" else b"")
    target = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to))]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one record; a truncated record is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(headers["Content-Length"])
    if len(rest) < n + 4 or rest[n : n + 4] != b"\r\n\r\n":
        raise ValueError("truncated WARC record")
    return headers, rest[:n].partition(b"\r\n\r\n")[2]


def _open(root: str):
    return fs.FileSystem.from_uri(root)


def _member(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_archives(pages: DataFrame, root: str, *, min_bytes: int = 0, level: int = 4, date: str = _DATE) -> DataFrame:
    """Write all pages; captures (key, page_id, file, offset, size), staged.  Payloads shorter than ``min_bytes`` never
    become revisits."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), payload.alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha2(F.col("html").cast("binary"), 256)))
    first = rows.filter(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("refers"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # Only repeated payloads are listed; Spark broadcasts the list where its file is small and merges, splitting skew, otherwise.
    marked = rows.join(staged(first, "warc-repeats"), "sha", "left").select("page_id", "url", "html", "refers", F.col("sha").isNotNull().alias("same"))

    def run(batches):
        store, top = _open(root)
        name, out, at = None, None, 0
        for b in batches:
            got = []
            for page, url, html, refers in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                data = html.encode("utf-8", "surrogatepass")
                revisit = refers is not None and page != refers
                member = _member(record("revisit" if revisit else "response", page, url, data, digest_of(data), date, refers), level)
                if out is None or at > FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"data-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                out.write(member)
                got.append((url_key(url), page, name, at, len(member)))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["key", "page_id", "file", "offset", "size"])
        if out is not None:
            out.close()

    make_dir(pages.sparkSession, root)
    return staged(marked.mapInArrow(run, "key string, page_id long, file string, offset long, size long"), "warc-captures")


def write_index(captures: DataFrame, root: str, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Shards, directories and the top level (first_key, shard), staged; ``captures`` as from write_archives."""

    def run(batches):
        store, top = _open(root)
        rows, blocks, out, at, name = [], [], None, 0, uuid.uuid4().hex

        def block():
            nonlocal out, at, rows
            if out is None:
                out = store.open_output_stream(f"{top}/cdx-{name}.gz", compression=None)
            data = _member("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows).encode(), 6)
            blocks.append((rows[0][0], at, len(data), len(rows)))
            out.write(data)
            at, rows = at + len(data), []

        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                rows.append(r)
                if len(rows) == block_rows:
                    block()
        if rows:
            block()
        if out is not None:
            out.close()
            with store.open_output_stream(f"{top}/dir-{name}.json.gz", compression=None) as f:
                f.write(_member("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in blocks).encode(), 6))
            yield pa.RecordBatch.from_arrays([pa.array([blocks[0][0]]), pa.array([name])], ["first_key", "shard"])

    ordered = captures.select("key", "page_id", "file", "offset", "size").repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return staged(ordered.mapInArrow(run, "first_key string, shard string"), "warc-index")


def _blocks_of(keys, top_keys, shards, directory):
    """(shard, offset, size, key) of every block that may hold a key: by binary search on both levels.

    A key's captures may begin in the block before the first that starts with it, and run on over several."""
    for key in keys:
        i = max(bisect.bisect_left(top_keys, key) - 1, 0)
        while i < len(top_keys) and top_keys[i] <= key:
            firsts, places = directory(shards[i])
            j = max(bisect.bisect_left(firsts, key) - 1, 0)
            while j < len(firsts) and firsts[j] <= key:
                yield (shards[i], places[j][0], places[j][1], key)
                j += 1
            i += 1


def lookup(keys: DataFrame, index: DataFrame, root: str) -> DataFrame:
    """Captures of the given keys (column key, distinct): sparse directory, then blocks by range, each read once.

    The top level, one short row per shard, comes to the driver: its length is the number of partitions the index was
    written in, never of captures.
    """
    # Code-point order, as Spark sorted them (UTF-8 bytes order alike).
    level = sorted(((r.first_key, r.shard) for r in index.collect()), key=lambda r: r[0].encode())
    top_keys, shards = [k for k, _ in level], [s for _, s in level]

    def search(batches):
        store, top = _open(root)
        kept: dict[str, tuple] = {}

        def directory(shard):
            if shard not in kept:
                if len(kept) >= 8:
                    kept.pop(next(iter(kept)))
                with store.open_input_file(f"{top}/dir-{shard}.json.gz") as f:
                    lines = [json.loads(x) for x in gzip.decompress(f.read()).decode().split("\n") if x]
                kept[shard] = ([x[0] for x in lines], [(x[1], x[2]) for x in lines])
            return kept[shard]

        for b in batches:
            got = list(_blocks_of(b.column(0).to_pylist(), top_keys, shards, directory))
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], ["shard", "at", "bytes", "key"])

    def read(batches):
        store, top = _open(root)
        place, rows = None, {}
        for b in batches:
            got = []
            for shard, at, n, key in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if place != (shard, at):
                    place, rows = (shard, at), {}
                    with store.open_input_file(f"{top}/cdx-{shard}.gz") as f:
                        for x in gzip.decompress(f.read_at(n, at)).decode().split("\n"):
                            if x:
                                x = json.loads(x)
                                rows.setdefault(x[0], []).append(x)
                got += rows.get(key, [])
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["key", "page_id", "file", "offset", "size"])

    found = keys.select("key").repartitionByRange("key").sortWithinPartitions("key").mapInArrow(search, "shard string, at long, bytes long, key string")
    found = staged(found, "warc-blocks")
    return found.repartition(_partitions(found), "shard", "at").sortWithinPartitions("shard", "at").mapInArrow(read, "key string, page_id long, file string, offset long, size long")


def _partitions(rows: DataFrame) -> int:
    """Places are small beside what they lead to, so Spark must not merge their partitions by size."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // TASK_PLACES)


def read_records(captures: DataFrame, root: str, *, payload: bool = True) -> DataFrame:
    """Records at the given places, by range reads that take neighbours together; payload digests are verified.
    ``payload=False`` leaves the payloads out of the result, not out of the check."""

    def run(batches):
        store, top = _open(root)
        for b in batches:
            rows = sorted(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
            got, i = [], 0
            while i < len(rows):
                file, lo, j = rows[i][0], rows[i][1], i
                hi = lo + rows[i][2]
                while j + 1 < len(rows) and rows[j + 1][0] == file and rows[j + 1][1] <= hi + GAP and rows[j + 1][1] + rows[j + 1][2] - lo < 16 << 20:
                    j += 1
                    hi = max(hi, rows[j][1] + rows[j][2])
                with store.open_input_file(f"{top}/{file}") as f:
                    data = f.read_at(hi - lo, lo)
                for _, at, n in rows[i : j + 1]:
                    h, data_of = parse_record(gzip.GzipFile(fileobj=io.BytesIO(data[at - lo : at - lo + n])).read())
                    kind, digest = h["WARC-Type"], h["WARC-Payload-Digest"].partition(":")[2]
                    if kind == "response" and digest_of(data_of) != digest:
                        raise ValueError(f"payload of {h['WARC-Record-ID']} does not match its digest")
                    refers = page_of(h["WARC-Refers-To"]) if kind == "revisit" else None
                    got.append((page_of(h["WARC-Record-ID"]), kind, digest, len(data_of) if kind == "response" else None, refers, h["WARC-Target-URI"], data_of if kind == "response" and payload else None))
                i = j + 1
            types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate(types)], ["page_id", "record_type", "payload_digest", "own_bytes", "refers_to", "url", "payload"])

    captures = staged(captures.select("file", "offset", "size"), "warc-places")
    by_file = captures.withColumn("part", F.floor(F.col("offset") / (4 << 20)))
    by_file = by_file.repartition(_partitions(captures), "file", "part").sortWithinPartitions("file", "offset").select("file", "offset", "size")
    return by_file.mapInArrow(run, "page_id long, record_type string, payload_digest string, own_bytes long, refers_to long, url string, payload binary")


def resolve(records: DataFrame) -> DataFrame:
    """``records`` with payload_bytes: of the response that a revisit refers to."""
    sizes = records.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("own_bytes").alias("there")).distinct()
    return records.join(sizes, ["refers_to", "payload_digest"], "left").withColumn("payload_bytes", F.coalesce("own_bytes", "there")).drop("there", "own_bytes")


def op1_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    root = new_path(spark, "warc")
    captures = write_archives(pages, root)
    index = write_index(captures, root)
    keys = captures.select("key").distinct()
    records = staged(read_records(lookup(keys, index, root), root, payload=False).drop("payload", "url"), "warc-records")
    return resolve(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
g as (select b, max(page_id) as top from p group by b),
d as (select page_id, octet_length(b) as payload_bytes, sha1(b) as hex, top from p join g using (b))
select page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + (((('0x' || substr(hex || '0000', 1 + (i * 5 // 4), 3))::int) >> (12 - 5 - (i * 5) % 4)) & 31)::int, 1)), '') as payload_digest,
       case when page_id = top then 'response' else 'revisit' end as record_type,
       case when page_id = top then null else top end as refers_to
from d
"""
