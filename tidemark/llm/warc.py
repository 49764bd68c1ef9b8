"""WARC archives: written with an index, read back by byte ranges.

Each record is a gzip member of its own.  While a task writes an archive it notes offset, length, url
and digest of each record; these notes are the index.  A reader sorts the selected index rows by place
and joins neighbours into one range read.  An archive's name is new in every attempt of a task, and the
index names only archives of tasks that ended well, so that lost or repeated tasks do no harm.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, shared_dir, small_batches, table, written

#: Payloads from so many bytes on are stored once; bytes of an archive, about; of a range read, of a gap in it, and that a task reads at most, about.
LEAST, ARCHIVE, RANGE, GAP, TASK = 1000, 1 << 28, 1 << 22, 1 << 16, 1 << 27
LEVEL = 4
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:tidemark:page:"


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One record, uncompressed: a response with its payload, or a revisit with the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID}{'none-' + uuid.uuid5(uuid.NAMESPACE_URL, (url or '') + digest.hex()).hex if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """What a record (uncompressed) says; raises ValueError if it isn't what it should be."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    size = int(fields["Content-Length"])
    block = rest[:size]
    if not version.startswith("WARC/") or len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    told = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    if fields["WARC-Type"] == "response" and (len(payload) != told or hashlib.sha1(payload).digest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not fit its digest")
    number = lambda x: None if x is None or "none-" in x else int(x.removeprefix(f"<{_ID}").removesuffix(">"))
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload": payload, "payload_bytes": told, "payload_digest": digest.hex(), "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To"))}


def planned(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, digest) with refers_to: the page that holds an equal payload, null if it is stored with the page.

    Of pages with an equal payload of LEAST bytes or more, that with the largest page_id holds it.
    """
    digest = F.sha1(F.coalesce("html", F.lit("")))
    pages = pages.select("page_id", "url", "html", digest.alias("digest"))
    large = F.octet_length("html") >= LEAST
    same = pages.where(large).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1").select("digest", "holder")
    out = pages.join(same, "digest", "left")
    return out.withColumn("refers_to", F.when(large & ~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder"))).drop("holder")


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of planned pages below folder; returns the index (archive, offset, length, page_id, url, digest, record_type), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, digest, refers_to in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                    if out is None or at > ARCHIVE:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = z.compress(record(page_id, url, (html or "").encode(), bytes.fromhex(digest), refers_to)) + z.flush()
                    out.write(member)
                    rows.append((name, at, len(member), page_id, url, digest, "response" if refers_to is None else "revisit"))
                    at += len(member)
                yield pa.RecordBatch.from_pylist([dict(zip(INDEX.names, r, strict=True)) for r in rows], schema=INDEX)
        finally:
            if out is not None:
                out.close()

    index = map_texts(pages, run, "archive string, offset long, length long, page_id long, url string, digest string, record_type string")
    return written(index, "warc-index")


INDEX = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string())])


def read(index: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records that index rows (archive, offset, length) select, checked against their digests.

    Ranges of RANGE bytes of an archive are dealt to tasks; in each, neighbours not over GAP bytes apart
    are one read.  Columns: page_id, url, payload (empty for a revisit; left out if not asked for),
    payload_bytes, payload_digest, record_type, refers_to.
    """
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    if not payload:
        del kinds["payload"]
    schema = pa.schema(list(kinds.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            names = batch.column("archive").to_pylist()
            starts, lens = batch.column("offset").to_numpy(), batch.column("length").to_numpy()
            first = 0
            while first < len(names):
                last = first + 1
                while last < len(names) and names[last] == names[first] and 0 <= starts[last] - starts[last - 1] - lens[last - 1] <= GAP and starts[last] + lens[last] - starts[first] <= RANGE:
                    last += 1
                if names[first] != name:
                    if source is not None:
                        source.close()
                    name = names[first]
                    source = system.open_input_file(f"{root}/{name}")
                base = int(starts[first])
                data = source.read_at(int(starts[last - 1] + lens[last - 1]) - base, base)
                found = [parsed(zlib.decompress(data[a : a + n], 31)) for a, n in zip((starts[first:last] - base).tolist(), lens[first:last].tolist(), strict=True)]
                yield pa.RecordBatch.from_pylist([{k: x[k] for k in schema.names} for x in found], schema=schema)
                first = last
        if source is not None:
            source.close()

    part = F.floor(F.col("offset") / RANGE).alias("part")
    total = index.agg(F.sum("length")).first()[0] or 0
    # the rows are few bytes, what they name is not: so many tasks as that asks for
    tasks = max(1, min(-(-2 * total // RANGE), int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-total // TASK))
    rows = index.select("archive", "offset", "length", part).repartition(tasks, "archive", "part").sortWithinPartitions("archive", "offset")
    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return map_texts(rows, run, ", ".join(f"{k} {names[v]}" for k, v in kinds.items()))


def round_trip(pages: DataFrame, payload: bool = False) -> DataFrame:
    """Write pages (page_id, url, html) to archives in the shared folder and read all of them back.

    A null html is an empty payload; equal payloads under LEAST bytes are stored each time; rows with one
    page_id are records of their own, and that of the holder is stored each time; a row without page_id
    can refer to another but holds nothing; an empty table gives an empty table.
    """
    folder = shared_dir(pages.sparkSession, "warc")
    return read(write(planned(pages), folder), folder, payload)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages say of each page."""
    small_batches(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p
), h AS (
  SELECT payload_digest, max(page_id) AS holder FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN holder <> page_id THEN holder END AS refers_to
FROM d LEFT JOIN h ON d.payload_digest = h.payload_digest
"""
