"""WARC archives: written with de-duplicated payloads, read back record by record."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvespace.llm.common import keep, ready, shared_dir

CHUNK = 1 << 16
#: An archive is closed and another begun once it holds this many bytes.
ARCHIVE_BYTES = 32 << 20
#: Archives that one task reads.
TASK_BYTES = 256 << 20
#: A payload of more pages may have its response sent to all tasks, if the response's URL has at most so many characters.
HOT, HOT_URL = 1000, 4096
#: A record's header block may not be longer.
HEADER_BYTES = 1 << 20

# Fixed values of the WARC 1.1 standard.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _plain(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, lead: dict | None, date: str) -> bytes:
    """One uncompressed record: a response, or a revisit of the record of page ``lead``."""
    digest = base32_sha1(hashlib.sha1(payload).digest())
    name = lambda page, d: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{d}')}>"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [VERSION, f"WARC-Type: {'response' if lead is None else 'revisit'}", f"WARC-Record-ID: {name(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_plain(url or '')}", f"WARC-Payload-Digest: sha1:{digest}"]
    if lead is None:
        block += payload
    else:
        head += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: {name(lead['page_id'], digest)}", f"WARC-Refers-To-Target-URI: {_plain(lead['url'] or '')}", f"Refers-To-Page: {lead['page_id']}"]
    head += [f"Page: {'' if page_id is None else page_id}", f"WARC-Block-Digest: sha1:{base32_sha1(hashlib.sha1(block).digest())}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def file_system(uri: str):
    """``(file system, path)`` for a folder URI, the same on the driver and on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record for every row of ``pages``, each a gzip member of its own; ``path, records, bytes`` of the
    archives. Of rows with equal payloads of at least ``min_bytes`` bytes, those of the largest ``page_id`` are
    responses and the others revisit it (repeated rows of that id are all responses); smaller payloads are all
    responses. Null html: an empty payload; null url: an empty one; a null id is less than any other. Every task
    names its archives anew: what a lost task left behind is listed nowhere and read by no one.
    """
    spark = ready(pages.sparkSession)
    folder = folder or f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}"
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    sha = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    lead = keep(sha.filter(F.length("payload") >= min_bytes).groupBy(F.col("sha").alias("same")).agg(F.max(F.struct("page_id", "url")).alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    # payloads of more rows than one in 10,000 of all number 10,000 at most: their pages meet the broadcast response where they are, and no other key
    total = lead.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    many = (F.col("n") > F.greatest(F.lit(HOT), F.lit(total // 10_000))) & (F.length(F.coalesce("lead.url", F.lit(""))) <= HOT_URL)
    hot = lead.filter(many).select(F.col("same").alias("hot"), F.col("lead").alias("hot_lead"))
    own = F.encode(F.monotonically_increasing_id().cast("string"), "utf-8")  # shorter than a digest
    dealt = sha.join(F.broadcast(hot), F.col("sha") == F.col("hot"), "left").withColumn("key", F.when(F.col("hot").isNull(), F.col("sha")).otherwise(own))
    met = dealt.join(lead.filter(~many).select("same", "lead").hint("merge"), F.col("key") == F.col("same"), "left").withColumn("lead", F.coalesce("hot_lead", "lead"))
    again = F.when(~F.col("lead.page_id").eqNullSafe(F.col("page_id")) & (F.length("payload") >= min_bytes), F.col("lead")).alias("lead")
    todo = met.select("page_id", "url", "payload", again)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root)
        out, path, done = None, "", [0, 0]

        def listed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path.rpartition("/")[2]]), pa.array([done[0]], pa.int64()), pa.array([done[1]], pa.int64())], names=["name", "records", "bytes"])

        for b in batches:
            for page, link, payload, ref in zip(*b.columns, strict=True):
                if out is None:
                    path, done = f"{root}/{uuid.uuid4().hex}.warc.gz", [0, 0]
                    out = fs.open_output_stream(path, compression=None)
                member = _gzip(record(page.as_py(), link.as_py(), payload.as_py(), ref.as_py(), date))
                out.write(member)
                done[0] += 1
                done[1] += len(member)
                if done[1] >= ARCHIVE_BYTES:
                    yield listed()
                    out = None
        if out is not None:
            yield listed()

    made = keep(todo.mapInArrow(write, "name string, records long, bytes long"))
    return made.select(F.concat(F.lit(folder + "/"), "name").alias("path"), "records", "bytes")


class RecordReader:
    """Records of one archive in order: gzip members are inflated piece by piece, the block is framed by its
    Content-Length and hashed as it passes, so memory does not grow with a record. A payload is kept on request."""

    def __init__(self, stream: BinaryIO, keep_payload: bool = False):
        self.stream, self.keep_payload, self.rest = stream, keep_payload, b""

    def __iter__(self) -> Iterator[dict]:
        while self.rest or (chunk := self.stream.read(CHUNK)):
            if not self.rest:
                self.rest = bytes(chunk)
            yield self.member()

    def inflated(self) -> Iterator[bytes]:
        z = zlib.decompressobj(31)
        data, self.rest = self.rest, b""
        while True:
            got = z.decompress(data, CHUNK)
            data = z.unconsumed_tail
            if got:
                yield got
            if z.eof:
                self.rest = z.unused_data
                return
            if not data and len(got) < CHUNK:
                data = bytes(self.stream.read(CHUNK))
                if not data:
                    raise ValueError("archive ends within a record")

    def member(self) -> dict:
        pieces = self.inflated()
        head, rest = self.until(pieces, b"", "record header")
        version, *lines = head.decode().split("\r\n")
        if version not in ("WARC/1.0", "WARC/1.1"):
            raise ValueError(f"not a WARC record: {version[:20]!r}")
        field = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        left = int(field["content-length"])
        block, payload, http, kept, size = hashlib.sha1(), hashlib.sha1(), b"", [], 0
        open_head = field.get("content-type", "").startswith("application/http")
        tail = b""
        while left or rest:
            piece, rest = rest[:left], rest[left:]
            left -= len(piece)
            block.update(piece)
            if open_head:
                http += piece
                if (end := http.find(b"\r\n\r\n")) >= 0:
                    http, piece, open_head = http[:end], http[end + 4 :], False
                elif len(http) > HEADER_BYTES:
                    raise ValueError("HTTP header too long")
                else:
                    piece = b""
            payload.update(piece)
            size += len(piece)
            if self.keep_payload:
                kept.append(piece)
            if not left:
                tail = rest
                break
            rest = next(pieces, b"")
            if not rest:
                raise ValueError("record shorter than its Content-Length")
        for piece in pieces:
            tail += piece
            if len(tail) > 4:
                break
        if tail != b"\r\n\r\n":
            raise ValueError("record not followed by two line ends")
        own = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
        return {"fields": field, "http": own, "payload_bytes": size, "payload": b"".join(kept), "block_digest": base32_sha1(block.digest()), "payload_digest": base32_sha1(payload.digest())}

    @staticmethod
    def until(pieces: Iterator[bytes], have: bytes, what: str) -> tuple[bytes, bytes]:
        while (end := have.find(b"\r\n\r\n")) < 0:
            if len(have) > HEADER_BYTES:
                raise ValueError(f"{what} too long")
            more = next(pieces, b"")
            if not more:
                raise ValueError(f"{what} cut short")
            have += more
        return have[:end], have[end + 4 :]


def page_row(r: dict) -> tuple:
    """A record as ``page_id, url, payload_bytes, payload_digest, record_type, refers_to``; both digests are checked."""
    f = r["fields"]
    kind, told = f["warc-type"], f["warc-payload-digest"].removeprefix("sha1:")
    if f["warc-block-digest"].removeprefix("sha1:") != r["block_digest"]:
        raise ValueError(f"block digest differs: {f['warc-record-id']}")
    if kind == "response" and told != r["payload_digest"]:
        raise ValueError(f"payload digest differs: {f['warc-record-id']}")
    number = lambda k: int(f[k]) if f.get(k) else None
    size = r["payload_bytes"] if kind == "response" else int(r["http"]["content-length"])
    return number("page"), f["warc-target-uri"], size, told, kind, number("refers-to-page")


def read_archives(archives: DataFrame, opener: Callable[[str], BinaryIO] | None = None) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` of every record of ``archives(path)``,
    dealt to tasks of about ``TASK_BYTES``. Broken framing or a digest that differs raises; no archives: no rows."""
    spark = ready(archives.sparkSession)
    size = archives.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0] if "bytes" in archives.columns else 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    todo = archives.select("path").repartition(tasks)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                folder, _, name = path.rpartition("/")
                fs, root = file_system(folder)
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    rows = []
                    for r in RecordReader(stream):
                        rows.append(page_row(r))
                        if len(rows) == 2000:
                            yield batch(rows)
                            rows = []
                    if rows:
                        yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return todo.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def broken_revisits(records: DataFrame) -> DataFrame:
    """Of ``records`` (see :func:`read_archives`) the revisits whose response is missing or has another digest or length."""
    own = records.filter("record_type = 'revisit'")
    lead = records.filter("record_type = 'response'").select(F.col("page_id").alias("at"), F.col("payload_digest").alias("told"), F.col("payload_bytes").alias("long"))
    return own.join(lead, (F.col("refers_to") == F.col("at")) & (F.col("payload_digest") == F.col("told")) & (F.col("payload_bytes") == F.col("long")), "left_anti")


def archive_pages(pages: DataFrame, **how) -> DataFrame:
    """Write archives of ``pages`` and read them back: see :func:`write_archives` and :func:`read_archives`."""
    return read_archives(write_archives(pages, **how))
