"""WARC archives on shared files: writer, and a sequential reader.

Every record is a gzip member of its own.  The reader inflates incrementally, frames records by
Content-Length and verifies block and payload digests.  Equal payloads are stored once: the record
with the smallest page_id is the response, the others are revisits that refer to it.
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

from .shared import cut, drop, new_path, positional, place, sized, small_batches

#: A fixed instant: archives of equal tables are equal.
DATE = "2000-01-01T00:00:00Z"
#: At most this many digests of repeated payloads are broadcast (some 40 MB).
SENT = 1 << 19
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: Headers without which a record can't be read.
REQUIRED = ["warc-type", "content-length", "warc-block-digest", "warc-payload-digest"]


class WarcError(ValueError):
    pass


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, salt: str = "") -> str:
    """The id of a page's record with a payload of that digest."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'page {page_id} {digest} {salt}'.encode()).digest())}>"


def _header(value: str) -> str:
    """A header's value stays on its line: each byte of a character that can't be printed is escaped."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in value)


def write_record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, level: int = 6, salt: str = "") -> bytes:
    """One gzip member.  refers_to: the response's page_id if this is a revisit.  salt: tells rows
    with one page_id and payload apart, '' for the one that revisits refer to."""
    digest = sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest, salt)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_header(url)}", f"X-Page-ID: {'' if page_id is None else page_id}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {PROFILE}"]
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def read_members(file, step: int = 1 << 18) -> Iterator[bytes]:
    """Contents of the gzip members of a file, one after another, read ``step`` bytes at a time."""
    inflate, parts, fresh = zlib.decompressobj(31), [], True
    data = file.read(step)
    while data:
        try:
            parts.append(inflate.decompress(data))
        except zlib.error as e:
            raise WarcError(f"gzip member: {e}") from None
        fresh = False
        data = inflate.unused_data
        if inflate.eof:
            yield b"".join(parts)
            inflate, parts, fresh = zlib.decompressobj(31), [], True
        if not data:
            data = file.read(step)
    if not fresh:
        raise WarcError("truncated gzip member")


def _number(text: str | bytes) -> int:
    try:
        return int(text)
    except ValueError:
        raise WarcError(f"not a number: {text!r}") from None


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with lower-case names, block); raises WarcError where framing or digests are wrong."""
    head, found, rest = member.partition(b"\r\n\r\n")
    try:
        lines = head.decode().split("\r\n")
    except UnicodeDecodeError:
        raise WarcError("headers aren't UTF-8") from None
    if not found or not lines[0].startswith("WARC/1."):
        raise WarcError("no record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if missing := [k for k in REQUIRED if k not in fields]:
        raise WarcError(f"no header {missing[0]}")
    n = _number(fields["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise WarcError("content length")
    if fields["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
        raise WarcError("block digest")
    return fields, block


def read_record(member: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload or None)."""
    fields, block = parse_record(member)
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [_number(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if len(sizes) != 1:
        raise WarcError("no length of the payload")
    size = sizes[0]
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
        raise WarcError("payload digest")
    number = lambda k: _number(fields[k]) if fields.get(k) else None
    return number("x-page-id"), size, digest, kind, number("x-refers-to-page-id"), payload if kind == "response" else None


def write_archives(pages: DataFrame, least: int = 0, sent: int = SENT) -> DataFrame:
    """Writes a record for each row of pages(page_id, url, html); returns the table of (path, records).

    Payloads of at least ``least`` bytes are compared by SHA-256.  Only (digest, page_id) is shuffled
    to learn which payloads repeat; the digests of those come back to the pages, which stay where
    they are while there are at most ``sent`` such digests.  Each task writes one archive under
    a name of its own, and only names of tasks that ended are in the table, so tasks may run again.

    A record's id is made of its page_id and digest.  Of rows that have both in common the first one of the first
    partition that has any keeps that id, and others, and rows without page_id, get one of their own, so that no
    two records share an id in all archives.  Pages must have the same partitions whenever they are
    read, as files have; an error says so if they haven't.
    """
    spark = pages.sparkSession
    small_batches(spark)
    col = {c: F.col(place(pages, c)) for c in ("page_id", "url", "html")}
    rows = positional(pages).select(*[(x.cast("long") if c == "page_id" else F.coalesce(x.cast("string"), F.lit(""))).alias(c) for c, x in col.items()], F.spark_partition_id().alias("part"))
    sha, n = F.unhex(F.sha2("html", 256)), F.octet_length("html")
    keys = cut(rows.select(sha.alias("sha"), "page_id", "part", (n >= least).alias("long")).groupBy("sha", "page_id", "long").agg(F.count("*").alias("k"), F.min("part").alias("first_part")), "keys")
    total, known = keys.agg(F.coalesce(F.sum("k"), F.lit(0)), F.count("page_id")).first()
    same = keys.where("long").groupBy("sha").agg(F.min("page_id").alias("first"), F.sum("k").alias("k"))
    same = cut(same.where("k > 1").select("sha", "first"), "same", total // 2)
    again = cut(keys.where("k > 1 AND page_id IS NOT NULL").select("sha", "page_id", "first_part"), "again", total // 2)
    drop(keys)
    joined = rows.withColumn("n", n).withColumn("sha", sha).join(sized(same, sent), "sha", "left").join(sized(again, sent), ["sha", "page_id"], "left")
    refers = F.when((F.col("n") >= least) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    # 0: the id is free, 1: the first such row of the task has it, 2: it's another task's.
    taken = F.when(F.col("page_id").isNull(), 2).when(F.col("first_part").isNull(), 0).when(F.col("first_part") == F.col("part"), 1).otherwise(2)
    joined = joined.select("page_id", "url", "html", refers.alias("refers_to"), taken.alias("taken"), "part", "sha")
    folder = new_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top)
        name, n, own, out, seen = f"{uuid.uuid4().hex}.warc.gz", 0, 0, None, set()
        for b in batches:
            for page_id, url, html, to, taken, part, sha in zip(*(b.column(i).cast(pa.binary()).to_pylist() if i == 2 else b.column(i).to_pylist() for i in range(7)), strict=True):
                out = out or store.open_output_stream(f"{top}/{name}", compression=None)
                salted = taken == 2 or taken == 1 and (page_id, sha, part) in seen
                if taken == 1:
                    seen.add((page_id, sha, part))
                out.write(write_record(page_id, url, html, to, salt=f"{name} {n}" if salted else ""))
                n, own = n + 1, own + (not salted)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64()), pa.array([own], pa.int64())], ["path", "records", "own"])

    made = cut(joined.mapInArrow(run, "path string, records long, own long"), "archives")
    if made.agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0] != known:
        raise WarcError("pages changed their partitions while they were read: write them to a table first")
    return made.select("path", "records")


def read_archives(files: DataFrame) -> DataFrame:
    """files(path) -> (page_id, payload_bytes, payload_digest, record_type, refers_to, payload), a
    row for each record; payload is null for revisits.  Raises WarcError on damage."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for path in b.column(0).to_pylist():
                store, top = fs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                with store.open_input_stream(top, compression=None) as file:
                    for member in read_members(file):
                        rows.append(read_record(member))
                        if len(rows) == 200:
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
                            rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return files.select("path").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_and_read(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes pages to archives and reads them back, a row for each row of pages.

    A null html is an empty payload and a null url an empty one.  Rows that repeat the smallest
    page_id of a group are all responses; a row without page_id revisits the group's smallest if
    it has one and is a response if not.  An empty table gives an empty result; other columns are
    ignored.
    """
    files = write_archives(pages, least)
    n = max(1, files.count())
    return read_archives(files.repartition(n))
