"""WARC archives: a writer, and a reader that splits compressed files.

Every record is a gzip member of its own. The writer is Spark's text sink, whose commit protocol
survives lost executors: a member ends in a zero byte (the high byte of its length; a member of
16 MiB or more is followed by an empty one), and that byte is the sink's line separator, so that a
file is nothing but members. The reader deals files out in byte ranges. A task looks for the gzip
magic in its range, takes a candidate for a record if it inflates to a WARC header, and reads on
past the range's end for the last record that starts inside.

Defined cases: page_id is an integer (another type fails the job). A null html is an empty payload; a null url is empty; pages with a null id are
written and read back with a null id (they are referred to only if no page with an id has the
same payload); repeated rows are records of their own, and those with the smallest id are all
responses; an empty table gives an archive without records; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bytes_of, chunks, cut, fresh_folder, partitions, table

MAGIC = b"\x1f\x8b\x08"
EMPTY = gzip.compress(b"", mtime=0)
#: Payloads below this size are never revisits.
LEAST = 100
#: Repeated digests that are broadcast at most.
MOST_BROADCAST = 500_000


def _member(data: bytes) -> bytes:
    z = gzip.compress(data, compresslevel=4, mtime=0)
    return z if z[-1:] == b"\0" else z + EMPTY


def _record(kind: str, page: str, url: str, digest: str, refers: str | None, body: bytes, size: int) -> bytes:
    """One record: header lines, blank line, HTTP header with the full payload's length, payload (none for a revisit)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + body
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Target-URI: {url}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _kinds(pages: DataFrame) -> DataFrame:
    """pages with digest, the record kind and what it refers to."""
    html = F.coalesce("html", F.lit(""))
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("size"))
    # The first of equal payloads, aggregated before it is dealt out; a hot payload's rows are joined with one row.
    same = cut(p.where(F.col("size") >= LEAST).groupBy("digest").agg(F.min(F.col("page_id")).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("key"), "first"))
    # Payloads travel only if more digests repeat than can be broadcast (some 100 bytes each); then each small payload has a key of its own.
    key = F.when(F.col("size") >= LEAST, F.col("digest")).otherwise(F.concat_ws(" ", F.lit("small"), "page_id"))
    j = p.withColumn("key", key).join(F.broadcast(same) if same.count() <= MOST_BROADCAST else same.hint("merge"), "key", "left").drop("key")
    return j.withColumn("again", F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))))


def write(pages: DataFrame, path: str) -> None:
    """Archives pages (page_id, url, html) under path."""

    def run(batches):
        for b in chunks(batches, "html", 4 << 20):
            ids, urls, digests = (b.column(c).to_pylist() for c in ("page_id", "url", "digest"))
            again, first, size = (b.column(c).to_pylist() for c in ("again", "first", "size"))
            out = []
            for i, body in enumerate(bytes_of(b.column("html"))):
                url = "".join(urls[i].split("\r")).replace("\n", "")
                page = "" if ids[i] is None else str(ids[i])
                rec = _record("revisit", page, url, digests[i], str(first[i]), b"", size[i]) if again[i] else _record("response", page, url, digests[i], None, body, size[i])
                out.append(_member(rec)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    rows = _kinds(pages).select("page_id", "url", "html", "digest", "again", "first", "size").mapInArrow(run, "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").mode("overwrite").text(path)


def _header(data: bytes) -> dict[str, str] | None:
    """Header fields of a record that starts with WARC/; None for anything else."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/") or end < 0:
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)} | {"": str(end + 4)}


def _inflated(stream, data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """The record whose member starts at data[at:], reading on from stream as far as needed, and where the member ends in data or beyond; None where none starts."""
    z, out, piece, fields = zlib.decompressobj(31), [], data[at : at + 4096], None
    fed = at + len(piece)
    try:
        while not z.eof:
            if not piece:
                return None
            out.append(z.decompress(piece))
            if fields is None:
                head = b"".join(out)
                if head and not head[:5] == b"WARC/"[: len(head[:5])]:
                    return None
                fields = _header(head)
            piece = data[fed : fed + 65536] if fed < len(data) else stream.read(65536)
            fed += len(piece)
    except zlib.error:
        return None
    return (fields, b"".join(out), fed - len(piece) - len(z.unused_data)) if fields else None


def records(stream, start: int, end: int):
    """(offset, header, block) of each record that starts in [start, end) of a seekable stream."""
    stream.seek(start)
    # A magic that crosses the end starts inside.
    data, at = stream.read(end - start), start
    at = 0
    tail = stream.read(len(MAGIC) - 1)
    data += tail
    while (at := data.find(MAGIC, at)) >= 0 and at < end - start:
        stream.seek(start + len(data))
        if got := _inflated(stream, data, at):
            fields, raw, end_of_member = got
            body = int(fields[""])
            yield start + at, fields, raw[body : body + int(fields.get("content-length", len(raw) - body))]
            at = end_of_member
        else:
            at += 1


def _opened(path: str):
    """A seekable stream of a file in a store that Arrow knows by its scheme: file, hdfs, s3, gs and others; viewfs, s3a or abfss it does not know."""
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path)
    return where.open_input_file(name)


def read(spark: SparkSession, path: str, split_bytes: int = 4 << 20, opener=_opened) -> DataFrame:
    """A row a record: page_id, url, record_type, refers_to, digest, payload (null for a revisit), payload_bytes.

    Spark lists the files; tasks read their ranges by themselves, with `opener`: from a path to a seekable binary stream.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "length")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.repartition(partitions(spark), "path", "start")

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                with opener(row["path"]) as f:
                    rows = []
                    for _, h, block in records(f, row["start"], min(row["start"] + split_bytes, row["length"])):
                        head, _, body = block.partition(b"\r\n\r\n")
                        size = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(body))
                        page, ref = (h.get(k, "").removeprefix("<urn:page:").removesuffix(">") for k in ("warc-record-id", "warc-refers-to"))
                        kind = h.get("warc-type", "")
                        full = kind == "response"
                        rows.append((int(page) if page else None, h.get("warc-target-uri", ""), kind, int(ref) if ref else None, hashlib.sha256(body).hexdigest() if full else h.get("warc-payload-digest", "").removeprefix("sha256:"), body if full else None, len(body) if full else size))
                        if len(rows) >= 200:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    def _batch(rows):
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64()]
    names = ["page_id", "url", "record_type", "refers_to", "digest", "payload", "payload_bytes"]
    return ranges.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, digest string, payload binary, payload_bytes long")


def op8_warc(spark, sf_dir):
    path = fresh_folder(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
