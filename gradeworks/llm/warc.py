"""WARC archives as a chunked record table (operator 3).

Pages are written as WARC 1.1 records, one gzip member each, to the shared
folder. Of records with equal payloads that with the least page id is a
response and the others revisit it. Reading streams an archive: a payload comes
as rows of record and chunk number with the digest and length so far, so a
record of any size needs only one chunk of memory.

A task writes under its own attempt's name and only archives of tasks that
succeeded are listed, so a lost or repeated task leaves no double records.

Defined results: a null page is an empty payload; a very long one is written and
read in chunks; page ids may be of any type that strings convert to; null page ids
come last and refer to the least id that is not null; rows that repeat the least
page id are all responses; rows that repeat id and payload have record ids of
their own, and what revisits them names the page but no record; an empty table
gives no archives and no rows; further columns are left alone.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeworks.llm.common import written
from gradeworks.sources.scratch import new_path

CHUNK = 1 << 20
#: Bytes and rows after which a batch of chunk rows is handed over.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 4096
CHUNKS = (
    "record_id string, page_id string, record_type string, refers_to string, target_uri string, chunk_no long, data binary, "
    "payload_bytes long, payload_digest string, is_last boolean, declared_digest string"
)
ARROW_CHUNKS = pa.schema(
    [
        ("record_id", pa.string()), ("page_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("chunk_no", pa.int64()),
        ("data", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("is_last", pa.bool_()), ("declared_digest", pa.string()),
    ]
)


def opened(path: str):
    """A file system that both driver and executors reach, and the path on it."""
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def planned(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages with payload, digest, and the page they revisit (null for responses).

    Digests that occur once need no partner, so only repeated ones are joined
    back; a payload that very many pages share is one row there.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    digest = F.sha1(html.cast("binary"))
    rows = pages.select("page_id", F.col("url").alias("url"), html.alias("html"), digest.alias("digest"))
    by_page = rows.where(F.octet_length("html") >= least_bytes).groupBy("digest", "page_id").agg(F.count("*").alias("c"))
    many = by_page.groupBy("digest").agg(F.sum("c").alias("n"), F.min("page_id").alias("first"), (F.max("c") > 1).alias("twin")).where("n > 1")
    many = written(many.select("digest", "first", "twin"), "repeated-payloads")
    out = rows.join(many, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    small = (F.octet_length("html") < least_bytes) | F.col("page_id").isNull()  # these are not known to be the only ones
    return out.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest", F.when(again, F.col("first")).cast("string").alias("refers_to"), (small | F.coalesce("twin", F.lit(False))).alias("twin"))


def encoded(text: str) -> str:
    """Percent-encoded but for printable ASCII, so that it fits a header line."""
    return "".join(c if 33 <= ord(c) < 127 and c != "%" else "".join(f"%{x:02X}" for x in c.encode("utf-8", "surrogatepass")) for c in text)


def record(page_id: str | None, url: str | None, payload: bytes, digest: bytes, refers_to: str | None, own: str = ""):
    """Yield one record's bytes, its payload in pieces. ``own`` makes the record's id its own where page and payload do not."""
    named = lambda p, own="": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{p}:{digest.hex()}:{own}')}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = b"" if refers_to is not None else payload
    uri = "".join(c if 33 <= ord(c) < 127 else "".join(f"%{x:02X}" for x in c.encode("utf-8", "surrogatepass")) for c in url or "urn:none")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {named(page_id, own)}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {uri}",
        *([] if page_id is None else [f"X-Page-Id: {encoded(str(page_id))}"]), f"WARC-Payload-Digest: sha1:{base32(digest)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", *([] if own else [f"WARC-Refers-To: {named(refers_to)}"]), f"X-Refers-To-Page: {encoded(str(refers_to))}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(body)}", "", ""]
    yield "\r\n".join(head).encode() + http
    view = memoryview(body)
    for at in range(0, len(body), CHUNK):
        yield view[at : at + CHUNK]
    yield b"\r\n\r\n"


def archived(plan: DataFrame, root: str | None = None) -> DataFrame:
    """Write archives of planned pages; returns the table ``path, records, bytes`` of those that hold."""
    root = root or new_path(plan.sparkSession, "warc")

    def work(batches):
        fs, base = opened(root)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        n = size = 0
        sink = None
        for b in batches:
            for page_id, url, html, digest, refers_to, twin in zip(*b.columns, strict=True):
                sink = sink or fs.open_output_stream(f"{base}/{name}", compression=None)
                member = zlib.compressobj(1, zlib.DEFLATED, 31)
                for piece in record(page_id.as_py(), url.as_py(), html.as_buffer().to_pybytes(), bytes.fromhex(digest.as_py()), refers_to.as_py(), f"{name}:{n}" if twin.as_py() else ""):
                    out = member.compress(piece)
                    size += len(out)
                    sink.write(out)
                out = member.flush()
                size += len(out)
                sink.write(out)
                n += 1
        if sink:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{root}/{name}"]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

    return written(plan.select("page_id", "url", "html", "digest", "refers_to", "twin").mapInArrow(work, "path string, records long, bytes long"), "archives")


def lines_until_blank(stream) -> list[str]:
    out = []
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        out.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
    return out


def fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines if ":" in x)}


def chunks(stream, size: int = CHUNK, with_data: bool = True):
    """Yield the chunk rows of an archive's stream; holds one chunk at a time."""
    while version := stream.readline():
        if not version.strip():
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        head = fields(lines_until_blank(stream))
        left = int(head["content-length"])
        taken = io.BytesIO()
        while left > 0 and (line := stream.readline()):  # the HTTP head
            left -= len(line)
            taken.write(line)
            if line == b"\r\n":
                break
        http = fields(taken.getvalue().decode("utf-8", "replace").split("\r\n"))
        page, refers = (None if head.get(c) is None else unquote(head[c]) for c in ("x-page-id", "x-refers-to-page"))
        declared = head.get("warc-payload-digest", "").removeprefix("sha1:")
        same = (head["warc-record-id"].strip("<>"), page, head["warc-type"], refers, head.get("warc-target-uri"))
        if head["warc-type"] == "revisit":
            yield *same, 0, b"", int(http["content-length"]), declared, True, declared
        else:
            sha, n, k = hashlib.sha1(), 0, 0
            while True:
                data = stream.read(min(size, left))
                if not data and left:
                    raise ValueError("an archive ends within a record")
                left -= len(data)
                n += len(data)
                sha.update(data)
                yield *same, k, data if with_data else None, n, base32(sha.digest()), not left, declared
                k += 1
                if not left:
                    break
            if base32(sha.digest()) != declared:
                raise ValueError(f"the payload of {same[0]} does not match its digest")
        while left > 0:
            left -= len(stream.read(min(size, left)))


def read_chunks(archives: DataFrame, size: int = CHUNK, with_data: bool = True, id_type: str = "long") -> DataFrame:
    """The chunk rows of all listed archives, one archive a task, with page ids of ``id_type``."""

    def work(batches):
        rows, held = [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = opened(path)
                with fs.open_input_stream(at, compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(raw, 1 << 16) if isinstance(raw, io.RawIOBase) else raw) as stream:
                    for row in chunks(io.BufferedReader(stream, 1 << 16), size, with_data):
                        rows.append(row)
                        held += len(row[6] or b"")
                        if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), ARROW_CHUNKS, strict=True)], schema=ARROW_CHUNKS)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), ARROW_CHUNKS, strict=True)], schema=ARROW_CHUNKS)

    n = max(1, archives.count())
    out = archives.select("path").repartition(n, F.xxhash64("path")).mapInArrow(work, CHUNKS)
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, least_bytes: int = 0, with_data: bool = True) -> DataFrame:
    """Archive the pages and read the archives back as chunk rows, with page ids of the pages' type."""
    return read_chunks(archived(planned(pages, least_bytes)), with_data=with_data, id_type=dict(pages.dtypes)["page_id"])
