"""WARC archives with an index: write records and their places first, read selected byte ranges later.

Each task writes archives of its own, one gzip member per record, and returns the places of its
records. The index is a written table of what successful tasks returned, so files that a lost or
repeated task left behind are never read. Readers sort the index by place and join neighbouring
records into one read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_dir
from .staging import staged

ARCHIVE_BYTES, GAP_BYTES, READ_BYTES, LEVEL = 64 << 20, 64 << 10, 8 << 20, 4
TASK_BYTES = 8 << 20  # of archives that one task reads, about; an archive is read by one task
INDEX = ("path string, offset long, length long, url string, payload_digest string, page_id long, record_type string, refers_to long, payload_bytes long")
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _line(value) -> str:
    """A header value on one line; control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in str(value))


def record_bytes(kind: str, page, url, payload: bytes, digest: str, first, shared: bool, date: str) -> bytes:
    """One record; a revisit has the HTTP head only and names the record it repeats.

    The response of several equal payloads is named after its page and digest, so that revisits written
    by other tasks can refer to it; all other names are random.
    """
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    common = f"<urn:uuid:{uuid.uuid5(_SPACE, f'{first}/{digest}')}>"
    name = common if shared and kind == "response" else f"<urn:uuid:{uuid.uuid4()}>"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _line(url)))
    if page is not None:
        fields.append(("WARC-Page-ID", page))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", len(payload))]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", common)]
        if first is not None:
            fields.append(("WARC-Refers-To-Page-ID", first))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields and payload of one record; a response's payload must have the digest that the record names."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError("no record at this place")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} differs from its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("WARC-Page-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
            "refers_to": number("WARC-Refers-To-Page-ID"), "payload_digest": digest, "payload_bytes": number("WARC-Payload-Length"), "payload": payload}


def write_archives(pages: DataFrame, folder: str, id_col="page_id", url="url", payload="html", min_bytes=0, date="2026-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for every row below ``folder`` and returns the written index.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the smallest id is the
    response (of several rows with that id one; an id that is null counts last); the others are revisits.
    A null payload is an empty one, a null url or id leaves its field out. Repeated rows are
    records of their own, further columns are left out, an empty table gives an empty index.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload")).withColumn("digest", F.sha1("payload"))
    ids = rows.where(F.length("payload") >= min_bytes).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "n")
    first = ids.groupBy(F.col("digest").alias("_digest")).agg(F.min(order).alias("first"), F.sum("n").alias("all")).where(F.col("all") > 1)
    first = staged(first.select("_digest", F.col("first.page_id").alias("first"), F.col("first.n").alias("ties")), "first")
    same = F.col("digest") == F.col("_digest")
    is_first = F.col("page_id").eqNullSafe(F.col("first"))
    columns = ["page_id", "url", "payload", "first", F.col("_digest").isNotNull().alias("shared")]
    marked = rows.join(first, same, "left").where(F.col("_digest").isNull() | ~is_first | (F.col("ties") == 1)).select(
        *columns, (F.col("_digest").isNotNull() & ~is_first).alias("again"))
    repeated = first.where("ties > 1")
    if not repeated.isEmpty():  # rows that repeat the smallest id: the written table numbers them, one is the response
        ties = staged(rows.join(repeated, same).where(is_first).withColumn("row", F.monotonically_increasing_id()), "ties")
        chosen = staged(ties.groupBy(F.col("_digest").alias("_of")).agg(F.min("row").alias("chosen")), "chosen")
        marked = marked.unionByName(ties.join(chosen, F.col("_digest") == F.col("_of")).select(*columns, (F.col("row") != F.col("chosen")).alias("again")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(folder)
        system.create_dir(base, recursive=True)
        path = out = None
        at, index = 0, []

        def done():
            out.close()
            return pa.RecordBatch.from_pylist(index, schema=places)

        for batch in batches:
            for k in range(len(batch)):
                page, link, raw, first_, shared, again = (batch.column(c)[k].as_py() for c in range(6))
                digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
                kind = "revisit" if again else "response"
                record = record_bytes(kind, page, link, raw, digest, first_, shared, date)
                press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = press.compress(record) + press.flush()
                if out is None:
                    path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    out, at, index = system.open_output_stream(path, compression=None), 0, []
                out.write(member)
                index.append({"path": path, "offset": at, "length": len(member), "url": link, "payload_digest": digest, "page_id": page,
                              "record_type": kind, "refers_to": first_ if again else None, "payload_bytes": len(raw)})
                at += len(member)
                if at >= ARCHIVE_BYTES:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    places = pa.schema([(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f in T._parse_datatype_string(INDEX).fields])
    return staged(marked.mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str, with_payload=True) -> DataFrame:
    """The records that the rows of ``index`` name, from the archives below ``folder``.

    The rows of an archive meet in one task, sorted by place; records with at most GAP_BYTES between
    them are read together, up to READ_BYTES at a time. A record that is longer is read alone. Index rows
    without a path are left out; a row that is given twice is read twice.
    """
    kept = [f for f in T._parse_datatype_string(RECORD).fields if with_payload or f.name != "payload"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(folder)
        path = source = None
        try:
            for batch in batches:
                rows = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
                k = 0
                while k < len(rows):
                    name, start, length = rows[k]
                    end, stop = start + length, k + 1
                    while stop < len(rows) and rows[stop][0] == name and rows[stop][1] <= end + GAP_BYTES and rows[stop][1] + rows[stop][2] - start <= READ_BYTES:
                        end = max(end, rows[stop][1] + rows[stop][2])
                        stop += 1
                    if name != path:
                        if source is not None:
                            source.close()
                        path, source = name, system.open_input_file(name)
                    raw = source.read_at(end - start, start)
                    found = [parse_record(zlib.decompress(raw[a - start : a - start + n], 31)) for _, a, n in rows[k:stop]]
                    yield pa.RecordBatch.from_pylist([{c: r[c] for c in names} for r in found], schema=fields)
                    k = stop
        finally:
            if source is not None:
                source.close()

    names = [f.name for f in kept]
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in kept])
    picked = index.where("path IS NOT NULL").select("path", "offset", "length")
    # The tasks follow the bytes that are read, which the few bytes of index rows say nothing of.
    total = picked.agg(F.sum("length")).first()[0] or 0
    return picked.repartition(max(1, -(-total // TASK_BYTES)), "path").sortWithinPartitions("path", "offset").mapInArrow(read, T.StructType(kept))


def archive_folder(spark) -> str:
    """A fresh folder for archives that all executors share."""
    return scratch_dir(spark, "warc")
