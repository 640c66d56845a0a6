"""WARC archives as tables of record chunks.

An archive is a table of (archive, record, chunk, n_chunks, data, running): the
data of a record's chunks, one after the other, are the bytes of a WARC/1.1
record, and the records of an archive, one after the other, are a WARC file.
Payloads are cut into chunks before they reach Python; writer and reader see one
chunk at a time and carry the SHA-1 of the payload so far, so neither ever holds
a whole record, and a lost, doubled or swapped chunk is noticed where it occurs.

A payload that was written before becomes a revisit record without a body. Which
record is the first with a payload is decided on digests alone; digests with very
many records are joined apart from the rest.

Defined cases: a null payload is empty; a null URL is left out of the header; a
null id is never referred to and its record is a response unless an id has the
same payload; rows equal in id and payload are each a response if their id is the
smallest. Only the columns named in ``write`` and ``read_back`` come back.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import join_counted

CHUNK = 64 * 1024
ARCHIVE = "archive int, record long, chunk int, n_chunks int, data binary, running binary"
DATE = "2000-01-01T00:00:00Z"
_CRLF2 = b"\r\n\r\n"


def roles(rows: DataFrame, min_bytes: int) -> DataFrame:
    """Adds ``first``, the smallest id with the same payload, to rows of (id, n, sha, ...); null where it is the only one."""
    on = ["n", "sha"]
    same = rows.filter(F.col("n") >= min_bytes).groupBy(*on).agg(F.min("id").alias("first"), F.count("*").alias("_c"))
    same = cut_lineage(same.filter("_c > 1 AND first IS NOT NULL"))
    return join_counted(rows, same, on, "_c", "left").drop("_c")


def _chunks(payload: Column, n: Column, size: int) -> Column:
    count = F.greatest(F.lit(1), F.ceil(n / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(payload, i * size + 1, F.lit(size)))


def _head(row: dict, record: str) -> bytes:
    """Header of a record and the HTTP head of its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n']}\r\n\r\n".encode()
    revisit = row["first"] is not None and row["first"] != row["id"]
    digest = base64.b32encode(bytes.fromhex(row["sha"])).decode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{record}>",
             f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response",
             f"WARC-Payload-Digest: sha1:{digest}"]
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + quote(row["url"], safe=":/?#[]@!$&'()*+,;=%~"))
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{row['first']}>"]
    lines.append(f"Content-Length: {len(http) + (0 if revisit else row['n'])}")
    return "\r\n".join(lines).encode() + _CRLF2 + http


def _write_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows to archive rows. The chunks of a record come one after the other."""
    archive, record, sha = TaskContext.get().partitionId(), -1, None
    for batch in batches:
        out = {c: [] for c in ("record", "chunk", "n_chunks", "data", "running")}
        names = batch.schema.names
        for values in zip(*batch.columns):
            row = {c: v.as_py() for c, v in zip(names, values)}
            data = row["data"]
            if row["chunk"] == 0:
                record, sha = record + 1, hashlib.sha1(usedforsecurity=False)
            sha.update(data)
            if row["chunk"] == 0:
                name = f"none-{archive}-{record}" if row["id"] is None else str(row["id"])
                data = _head(row, name) + data
            if row["chunk"] == row["n_chunks"] - 1:
                data += _CRLF2
            for c, v in (("record", record), ("chunk", row["chunk"]), ("n_chunks", row["n_chunks"]), ("data", data),
                         ("running", sha.digest())):
                out[c].append(v)
        n = len(out["data"])
        yield pa.RecordBatch.from_arrays(
            [pa.array([archive] * n, pa.int32()), pa.array(out["record"], pa.int64()), pa.array(out["chunk"], pa.int32()),
             pa.array(out["n_chunks"], pa.int32()), pa.array(out["data"], pa.binary()),
             pa.array(out["running"], pa.binary())], ["archive", "record", "chunk", "n_chunks", "data", "running"])


def write(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          chunk: int = CHUNK, min_bytes: int = 0) -> DataFrame:
    """The archive table of a table of pages. Text payloads are written in UTF-8."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                     payload.alias("payload"))
    rows = roles(rows.select("*", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha")),
                 min_bytes)
    revisit = F.coalesce(F.col("first") != F.col("id"), F.col("first").isNotNull())
    body = F.when(revisit, F.array(F.lit(b""))).otherwise(_chunks(F.col("payload"), F.col("n"), chunk))
    rows = rows.select("id", "url", "n", "sha", F.when(revisit, F.col("first")).alias("first"), body.alias("_body"))
    rows = rows.select("id", "url", "n", "sha", "first", F.size("_body").alias("n_chunks"),
                       F.posexplode("_body").alias("chunk", "data"))
    return rows.mapInArrow(_write_chunks, ARCHIVE)


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def _page(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if name.startswith("none-") else int(name)


def _read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archive rows to one row per record. The chunks of a record come in order."""
    warc = http = sha = None
    block = expected = 0
    for batch in batches:
        out = {c: [] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")}
        for values in zip(*[batch.column(batch.schema.get_field_index(c))
                            for c in ("chunk", "n_chunks", "data", "running")]):
            chunk, n_chunks, data, running = (v.as_py() for v in values)
            if chunk != (0 if sha is None else expected):
                raise ValueError(f"chunk {expected} of a record is missing")
            if chunk == 0:
                head, _, rest = data.partition(_CRLF2)
                http_head, _, data = rest.partition(_CRLF2)
                warc, http, sha, block = _fields(head), _fields(http_head), hashlib.sha1(usedforsecurity=False), 0
                block = len(http_head) + len(_CRLF2)
            expected = chunk + 1
            last = expected == n_chunks
            if last:
                if not data.endswith(_CRLF2):
                    raise ValueError("a record does not end where its chunks end")
                data = data[:-len(_CRLF2)]
            sha.update(data)
            block += len(data)
            if sha.digest() != running:
                raise ValueError("the digest of a chunk does not match what was read")
            if last:
                digest = warc["WARC-Payload-Digest"].removeprefix("sha1:")
                kind = warc["WARC-Type"]
                if block != int(warc["Content-Length"]):
                    raise ValueError("the length of a record does not match its header")
                if kind == "response" and base64.b32encode(sha.digest()).decode() != digest:
                    raise ValueError("the digest of a payload does not match its header")
                refers = warc.get("WARC-Refers-To")
                for c, v in (("page_id", _page(warc["WARC-Record-ID"])), ("payload_bytes", int(http["Content-Length"])),
                             ("payload_digest", digest), ("record_type", kind),
                             ("refers_to", None if refers is None else _page(refers))):
                    out[c].append(v)
                sha = None
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["page_id"], pa.int64()), pa.array(out["payload_bytes"], pa.int64()),
             pa.array(out["payload_digest"], pa.string()), pa.array(out["record_type"], pa.string()),
             pa.array(out["refers_to"], pa.int64())], list(out))
    if sha is not None:
        raise ValueError("the last chunks of a record are missing")


def read_back(archive: DataFrame) -> DataFrame:
    """One row per record: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Records of one chunk are read where they lie. Chunks of larger ones meet in one
    task, in order, and stream through it.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    cols = ["chunk", "n_chunks", "data", "running"]
    single = archive.filter("n_chunks = 1").select(*cols)
    many = archive.filter("n_chunks > 1").repartition("archive", "record").sortWithinPartitions(
        "archive", "record", "chunk").select(*cols)
    return single.mapInArrow(_read_chunks, schema).unionByName(many.mapInArrow(_read_chunks, schema))
