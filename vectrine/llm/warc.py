"""WARC archives: a record a page written, and a sequential reader.

Every record is a gzip member of its own. The reader takes an archive as a stream of small chunks,
inflates them with one incremental zlib object a member, frames each record by its content length, and
checks block and payload digests while the bytes pass; only one record is in memory, and its payload only
if it is asked for. Of pages with equal payloads of at least MIN_REVISIT bytes the smallest page_id gives
the response record; the others refer to it.

Archives lie in the folder that all executors share, one a partition. Their names carry the task attempt
and the reader takes only those that a finished task has reported, so what a lost executor left behind
is not read.

Which payloads came more than once is found from digests. Pages that came once are not shuffled, nor are those of the
fewer than HEAVY digests that came most often; the other repeated pages meet their digest in a shuffle.

Nulls: a null html is an empty payload. A null page_id or url has no header field and reads back as null;
among equal payloads a null page_id comes last. Rows that repeat the smallest page_id are all responses. A very long
payload is in memory once where it is written; the reader passes it in chunks. No rows in, no archives and no rows out.
Columns beside page_id, url and html don't matter.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrine.llm.common import HEAVY, cut, remove, shared_path, sieved

MIN_REVISIT = 100
CHUNK = 1 << 16
RECORD = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def decisions(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, record_type, refers_to of each page."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"), F.sha2(payload, 256).alias("payload_digest"))
    again = cut(
        rows.where(F.octet_length("payload") >= MIN_REVISIT)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first_id is not null")
    )
    size = again.agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows")).first()
    marked = sieved(rows, again, size["keys"], "payload_digest")
    once, maybe = marked.where("not __maybe").drop("__maybe"), marked.where("__maybe").drop("__maybe")
    # pages that came once stay where they are; so do those of the few digests that came most often
    limit = max(64, (size["rows"] or 0) // HEAVY)
    heavy, light = again.where(F.col("n") > limit).drop("n"), again.where(F.col("n") <= limit).drop("n")
    here = maybe.join(F.broadcast(heavy), "payload_digest")
    there = maybe.join(F.broadcast(heavy.select("payload_digest")), "payload_digest", "left_anti").join(light, "payload_digest", "left")
    known = once.withColumn("first_id", F.lit(None).cast("long")).unionByName(here).unionByName(there)
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return known.select(
        "page_id", "url", "payload", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to")
    )


def _clean(value: str) -> str:
    """A header value without control characters, which are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One gzip member that holds one record."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <{RECORD}{page_id}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{RECORD}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    member = zlib.compressobj(1, zlib.DEFLATED, 31)
    return member.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + member.flush()


class Framer:
    """Takes one record's bytes as they come; ``done`` gives its fields once the member has ended."""

    def __init__(self, keep: bool):
        self.keep, self.head, self.http = keep, None, None
        self.buffer, self.left = b"", 0
        self.block, self.payload, self.kept = hashlib.sha256(), hashlib.sha256(), []
        self.length = 0

    def feed(self, data: bytes) -> None:
        if self.head is None:
            self.buffer += data
            head, end, data = self.buffer.partition(b"\r\n\r\n")
            if not end:
                return
            lines = head.decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no record starts with {lines[0][:40]!r}")
            self.head = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
            self.left, self.buffer = int(self.head["content-length"]), b""
        block, tail = data[: self.left], data[self.left :]
        self.left -= len(block)
        self.buffer += tail  # what follows the block must be two line ends
        self.block.update(block)
        if self.http is None:
            self.kept.append(block)
            http, end, block = b"".join(self.kept).partition(b"\r\n\r\n")
            if not end:
                return
            self.http, self.kept = {k.lower(): v for k, _, v in (line.partition(": ") for line in http.decode().split("\r\n"))}, []
        self.payload.update(block)
        self.length += len(block)
        if self.keep:
            self.kept.append(block)

    def done(self) -> dict:
        h = self.head or {}
        if self.http is None or self.left or self.buffer != b"\r\n\r\n":
            raise ValueError(f"record {h.get('warc-record-id')} is not framed by its content length")
        if f"sha256:{self.block.hexdigest()}" != h["warc-block-digest"]:
            raise ValueError(f"record {h.get('warc-record-id')}: block digest differs")
        length, kind = int(self.http["content-length"]), h["warc-type"]
        if kind == "response" and (length != self.length or f"sha256:{self.payload.hexdigest()}" != h["warc-payload-digest"]):
            raise ValueError(f"record {h.get('warc-record-id')}: payload digest differs")
        number = lambda field: int(h[field][len(RECORD) + 1 : -1]) if field in h else None
        return {
            "page_id": number("warc-record-id"),
            "url": h.get("warc-target-uri"),
            "payload_bytes": length,
            "payload_digest": h["warc-payload-digest"].removeprefix("sha256:"),
            "record_type": kind,
            "refers_to": number("warc-refers-to"),
        } | ({"payload": b"".join(self.kept) if kind == "response" else None} if self.keep else {})


def read_archive(chunks: Iterable[bytes], keep: bool = False) -> Iterator[dict]:
    """The records of one archive, which comes as chunks of any size. keep: with payloads."""
    inflate = frame = None
    for data in chunks:
        while data:
            if inflate is None:
                inflate, frame = zlib.decompressobj(31), Framer(keep)
            frame.feed(inflate.decompress(data, CHUNK))
            data = inflate.unconsumed_tail
            if inflate.eof:
                data = inflate.unused_data
                yield frame.done()
                inflate = None
    if inflate is not None:
        raise ValueError("the archive ends within a record")


def _chunks(path: str) -> Iterator[bytes]:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_stream(at) as stream:
        while data := stream.read(CHUNK):
            yield data


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write what decisions() gives, an archive a partition; archive and n_records of each, computed once."""

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        path = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out, n = None, 0
        for batch in batches:
            if out is None and batch.num_rows:
                store, at = fs.FileSystem.from_uri(path)
                store.create_dir(at.rpartition("/")[0])
                out = store.open_output_stream(at)
            for row in zip(*(batch.column(i) for i in range(batch.num_columns)), strict=True):
                out.write(record(*(x.as_py() for x in row)))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [path], "n_records": [n]})

    columns = ["page_id", "url", "payload", "payload_digest", "record_type", "refers_to"]
    return cut(records.select(*columns).mapInArrow(write, "archive string, n_records long"))


FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(archives: DataFrame, payload: bool = False) -> DataFrame:
    """The records of the archives that a frame names in column archive."""
    schema = FIELDS + (", payload binary" if payload else "")

    def read(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in schema.split(", ")]
        kinds = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]]) for n, x in zip(names, schema.split(", "), strict=True)])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for r in read_archive(_chunks(path), payload):
                    rows.append(r)
                    held += 500 + len(r.get("payload") or b"")
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    # the archives were named by a job of as many tasks, so their rows lie in as many partitions
    return archives.select("archive").mapInArrow(read, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives and read them back."""
    folder = shared_path(pages.sparkSession, "warc")
    archives = write_archives(decisions(pages), folder)
    back = cut(read_archives(archives))
    remove(pages.sparkSession, folder)
    return back
