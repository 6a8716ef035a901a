"""WARC archives: one gzip member per record, read back in sequence.

The writer puts each page into a record of its own gzip member. Of records
with equal payloads of at least ``min_revisit`` bytes that with the smallest
page_id is a response, the others are revisits that point to it. The reader
inflates member after member with an incremental decompressor, cuts records
by Content-Length and verifies every digest.

Null html is an empty payload, a null url is left out of the record. Rows
with a null page_id take no part. Equal page_ids give one record each, and
only those with an earlier page's payload are revisits. An empty table gives
an empty archive set.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_dir
from .shared_files import SharedFiles

#: An archive is closed when it holds so many compressed bytes; so a reader's task holds one such file.
ARCHIVE_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
_CRLF = b"\r\n"


def mark_revisits(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """page_id, url, payload (binary), digest (binary), refers_to (null: a response).

    Only digests are grouped: a hot payload shrinks to one row a task before
    the shuffle, and the join back is one that Spark may split by rows.
    """
    p = pages.filter("page_id IS NOT NULL").select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    big = F.octet_length("payload") >= min_revisit
    first = p.filter(big).groupBy("digest").agg(F.min("page_id").alias("first_id"))
    marks = p.filter(big).select("page_id", "digest").join(first.hint("merge"), "digest").filter("page_id <> first_id")
    # by payload too: rows of one page_id may hold different ones
    marks = marks.groupBy("page_id", "digest").agg(F.min("first_id").alias("refers_to"))
    return p.join(marks, ["page_id", "digest"], "left").select(*p.columns, "refers_to")


def _uri(page_id: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=(0x57415243 << 96) | (page_id & (1 << 64) - 1))}>"


def _page_id(uri: str) -> int:
    x = uuid.UUID(uri.strip()[len("<urn:uuid:") : -1]).int & (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _b32(digest: bytes) -> str:
    return "sha256:" + base64.b32encode(digest).decode()


def record(page_id: int, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head and drops the body."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    head += [f"WARC-Payload-Digest: {_b32(digest)}", f"WARC-Block-Digest: {_b32(hashlib.sha256(block).digest())}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_uri(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _CRLF * 2 + block + _CRLF * 2


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(marked: DataFrame, to: str, *, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of ``mark_revisits`` as archives below ``to``; a row a file: file, n_records, n_bytes.

    Every run of a task writes files of its own names, so the archives are
    those that the result lists: what a lost or repeated task has left beside
    them doesn't count.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        files, part, n = SharedFiles(to), f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}", 0
        held, count = io.BytesIO(), 0

        def close() -> pd.DataFrame:
            nonlocal held, count, n
            name = f"part-{part}-{n:05d}.warc.gz"
            files.put(name, held.getvalue())
            out = pd.DataFrame({"file": [name], "n_records": [count], "n_bytes": [held.tell()]})
            held, count, n = io.BytesIO(), 0, n + 1
            return out

        for b in batches:
            for page_id, url, payload, digest, ref in zip(b.page_id, b.url, b.payload, b.digest, b.refers_to, strict=True):
                held.write(member(record(int(page_id), url, bytes(payload), bytes(digest), None if pd.isna(ref) else int(ref))))
                count += 1
                if held.tell() >= archive_bytes:
                    yield close()
        if count:
            yield close()

    # most rows refer to none, and numbers beside nulls would come as doubles
    return marked.select("page_id", "url", "payload", "digest", F.col("refers_to").cast("string").alias("refers_to")).mapInPandas(run, "file string, n_records long, n_bytes long")


class WarcError(ValueError):
    """A record that breaks the framing or its digest."""


def inflate_members(raw: memoryview, step: int = 1 << 16) -> Iterator[bytes]:
    """Each gzip member's content, inflated piece by piece."""
    at = 0
    while at < len(raw):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            piece = raw[at : at + step]
            if not len(piece):
                raise WarcError("a gzip member is cut off")
            out.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        yield b"".join(out)


def parse_record(data: bytes) -> dict:
    """Frame one record by its Content-Length and verify its digests."""
    head, sep, rest = data.partition(_CRLF * 2)
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise WarcError("no WARC head")
    field = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(field["content-length"])
    block, tail = rest[:n], rest[n:]
    if len(block) != n or tail != _CRLF * 2:
        raise WarcError("the block doesn't have its stated length")
    if _b32(hashlib.sha256(block).digest()) != field["warc-block-digest"]:
        raise WarcError("block digest")
    http, _, payload = block.partition(_CRLF * 2)
    stated = next(int(x.partition(b":")[2]) for x in http.split(_CRLF) if x.lower().startswith(b"content-length:"))
    kind, said = field["warc-type"], field["warc-payload-digest"]
    if kind == "response" and (len(payload) != stated or _b32(hashlib.sha256(payload).digest()) != said):
        raise WarcError("payload digest")
    return {
        "page_id": _page_id(field["warc-record-id"]),
        "record_type": kind,
        "payload_bytes": stated,
        "payload_digest": base64.b32decode(said.partition(":")[2]).hex(),
        "refers_to": _page_id(field["warc-refers-to"]) if "warc-refers-to" in field else None,
        "url": field.get("warc-target-uri"),
        "payload": payload if kind == "response" else None,
    }


_FIELDS = {"page_id": "long", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long", "url": "string", "payload": "binary"}


def _names(with_payload: bool) -> list[str]:
    return [*_FIELDS] if with_payload else [*_FIELDS][:5]


def _schema(names: list[str]) -> str:
    return ", ".join(f"{n} {_FIELDS[n]}" for n in names)


def _records(contents: Iterator[memoryview], names: list[str]) -> Iterator:
    """Arrow batches of the records of whole archives."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    of = pa.schema([(n, kinds[_FIELDS[n]]) for n in names])
    for content in contents:
        rows = []
        for data in inflate_members(content):
            r = parse_record(data)
            rows.append({k: r[k] for k in names})
            if len(rows) == 256:
                yield pa.RecordBatch.from_pylist(rows, schema=of)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=of)


def read_archives(spark: SparkSession, path: str, *, with_payload: bool = False) -> DataFrame:
    """A row per record of the ``*.warc.gz`` files below ``path``, each digest verified.

    With ``with_payload`` also url and payload (null for revisits).
    """
    names = _names(with_payload)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    return found.select("content").mapInArrow(lambda batches: _records((memoryview(c.as_buffer()) for b in batches for c in b.column("content")), names), _schema(names))


def read_written(written: DataFrame, path: str, *, with_payload: bool = False) -> DataFrame:
    """As ``read_archives``, of the files that ``written`` (a stored result of ``write_archives``) lists."""
    names = _names(with_payload)

    def run(batches: Iterator) -> Iterator:
        files = SharedFiles(path)
        return _records((memoryview(files.read(f.as_py())) for b in batches for f in b.column("file")), names)

    return written.select("file").mapInArrow(run, _schema(names))


def archive_roundtrip(pages: DataFrame, *, min_revisit: int = 100, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` to new archives in the shared folder and read them back."""
    to = fresh_dir(pages.sparkSession, "warc")
    return read_written(cut(write_archives(mark_revisits(pages, min_revisit), to, archive_bytes=archive_bytes)), to)
