"""WARC archives: writing, and the normaliser for files that are one gzip stream.

A monolithic ``.warc.gz`` (one gzip member around all records) cannot be entered in the
middle. The normaliser inflates it once, as a stream, and rewrites every record as a gzip
member of its own beside a sidecar index (offset, length, record id), so that any record can
be read by one seek. Memory holds one record and a read buffer, whatever the file's size.

Files go to the shared folder through pyarrow's file systems, one archive per task and
attempt; manifests are checkpointed, and only files that a manifest lists are read, so lost or
repeated tasks leave at most unread files.

Defined results: a null html is an empty payload; a null url has no target line; rows with a
null page_id are responses and refer to nothing; of repeated rows with the same page_id and
payload every one is a response if that page_id is the largest; an empty table gives no file
and an empty result. Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import json
import zlib
from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import attempt_name, open_fs, ready, shared_folder

#: Payloads of fewer bytes are always written in full.
MIN_REVISIT = 0
GZIP, CHUNK = 31, 1 << 20
DATE = "1970-01-01T00:00:00Z"
_MANIFEST = "path string, sidecar string, records bigint"
_RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


# -- records -----------------------------------------------------------------------

def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(uri: str | None) -> int | None:
    tail = uri[len("<urn:page:"):-1] if uri else "none"
    return None if tail == "none" else int(tail)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record. Its block is an HTTP response; a revisit keeps the HTTP header (and so
    the payload's length) and leaves the payload out."""
    digest = "sha1:" + b32encode(sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join("%0D" if c == "\r" else "%0A" if c == "\n" else c for c in url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_uri(refers_to)}"]
    head += [f"WARC-Payload-Digest: {digest}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def parse(raw: bytes) -> dict:
    """The columns of a record; a response's payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    f = _fields(head)
    http, _, payload = rest[: int(f["content-length"])].partition(b"\r\n\r\n")
    size, digest = int(_fields(http)["content-length"]), f["warc-payload-digest"].removeprefix("sha1:")
    if f["warc-type"] == "response" and (len(payload) != size or b32encode(sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {f['warc-record-id']}")
    return {"page_id": _page(f["warc-record-id"]), "payload_bytes": size, "payload_digest": digest,
            "record_type": f["warc-type"], "refers_to": _page(f.get("warc-refers-to"))}


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Cut an inflated stream into whole records (with their closing blank lines)."""
    held, need, head_end = bytearray(), None, 0
    for chunk in chunks:
        held += chunk
        at = 0
        while True:
            if need is None:
                head_end = held.find(b"\r\n\r\n", at)
                if head_end < 0:
                    break
                need = head_end + 4 + int(_fields(bytes(held[at:head_end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[at:need])
            at, need = need, None
        del held[:at]
        if need is not None:
            need -= at
    if held:
        raise ValueError("the stream ends inside a record")


def inflate(stream) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, in pieces."""
    z, data = zlib.decompressobj(GZIP), stream.read(CHUNK)
    while data:
        out = z.decompress(data, CHUNK)
        if out:
            yield out
        data = z.unconsumed_tail
        if z.eof:
            data, z = z.unused_data, zlib.decompressobj(GZIP)
        data = data or stream.read(CHUNK)
    rest = z.flush()
    if rest:
        yield rest


# -- jobs --------------------------------------------------------------------------

def plan(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html and refers_to: of equal payloads the largest page_id is written in
    full and the others refer to it. The aggregate's map side keeps one row per payload and
    task, and the join is one that Spark splits, so a payload held by a third of the rows
    spreads over tasks."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")) \
        .withColumn("digest", F.sha1("html"))
    top = p.groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).filter("n > 1") \
        .select(F.col("digest").alias("_digest"), "top")
    old = (F.col("page_id") < F.col("top")) & (F.octet_length("html") >= min_revisit)
    return p.join(top, p["digest"] == top["_digest"], "left").select("page_id", "url", "html", F.when(old, F.col("top")).alias("refers_to"))


def write_monolithic(planned: DataFrame, folder: str) -> DataFrame:
    """One archive per task, each a single gzip stream; its manifest (path, sidecar = null,
    records), checkpointed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            if out is None:
                fsys, base = open_fs(folder)
                fsys.create_dir(base, recursive=True)
                name = attempt_name("whole") + ".warc.gz"
                out, z, n = fsys.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, GZIP), 0
            for pid, url, html, ref in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                out.write(z.compress(record(pid, url, html.encode(), ref)))
                n += 1
        if out is not None:
            out.write(z.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "sidecar": pa.array([None], pa.string()), "records": [n]})

    return planned.mapInArrow(run, _MANIFEST).checkpoint()


def _per_file(manifest: DataFrame, fn, schema: str) -> DataFrame:
    """Run fn(row) -> batches for every file, spread over the tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                yield from fn(row)

    return manifest.mapInArrow(run, schema)


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrite every monolithic archive record by record, with its sidecar index; the
    manifest of the new files, checkpointed."""
    def one(row: dict) -> Iterator[pa.RecordBatch]:
        src, path = open_fs(row["path"])
        dst, base = open_fs(folder)
        dst.create_dir(base, recursive=True)
        name = attempt_name("records")
        at = n = 0
        with src.open_input_stream(path, compression=None) as stream, \
                dst.open_output_stream(f"{base}/{name}.warc.gz", compression=None) as out, \
                dst.open_output_stream(f"{base}/{name}.idx", compression=None) as index:
            for raw in split_records(inflate(stream)):
                z = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                member = z.compress(raw) + z.flush()
                out.write(member)
                rid = _fields(raw[: raw.index(b"\r\n\r\n")])["warc-record-id"]
                index.write(json.dumps({"offset": at, "length": len(member), "id": rid}).encode() + b"\n")
                at, n = at + len(member), n + 1
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}.warc.gz"], "sidecar": [f"{folder}/{name}.idx"], "records": [n]})

    return _per_file(manifest, one, _MANIFEST).checkpoint()


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the normalised archives, each read through the sidecar index."""
    def one(row: dict) -> Iterator[pa.RecordBatch]:
        fsys, path = open_fs(row["path"])
        side, side_path = open_fs(row["sidecar"])
        rows = []
        with fsys.open_input_file(path) as archive, side.open_input_stream(side_path, compression=None) as index:
            rest = b""
            while True:
                data = index.read(CHUNK)
                *lines, rest = (rest + data).split(b"\n")
                for line in lines:
                    e = json.loads(line)
                    archive.seek(e["offset"])
                    rows.append(parse(zlib.decompress(archive.read(e["length"]), GZIP)))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ROWS)
                    rows = []
                if not data:
                    break

    return _per_file(manifest, one, _RECORD)


_ROWS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                   ("record_type", pa.string()), ("refers_to", pa.int64())])


def op3(pages: DataFrame) -> DataFrame:
    spark = ready(pages.sparkSession)
    whole = write_monolithic(plan(pages), shared_folder(spark, "warc-whole"))
    return read_archives(normalise(whole, shared_folder(spark, "warc-records")))


#: Base32 in SQL: the digest's 160 bits in groups of five.
SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS d FROM pages),
u AS (SELECT DISTINCT d FROM p),
b AS (SELECT d, list_aggregate(list_transform(range(1, 41), lambda i:
        right('000' || bin(strpos('0123456789abcdef', substr(d, i, 1)) - 1), 4)), 'string_agg', '') AS bits FROM u),
e AS (SELECT d, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        list_sum(list_transform(range(1, 6), lambda j: substr(bits, 5 * i + j, 1)::INT * (1 << (5 - j))))::INT + 1, 1)),
        'string_agg', '') AS payload_digest FROM b),
t AS (SELECT d, max(page_id) AS top FROM p GROUP BY d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM p JOIN e USING (d) JOIN t USING (d)
"""
