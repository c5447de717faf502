"""WARC archives: written as one gzip stream per file, normalised to a member per record, read by index.

- ``write`` puts pages into archives, each compressed as a whole: cheap, but nothing can be read apart.
- ``normalise`` inflates such a file once, as a stream, writes every record as a gzip member of its own,
  and gives an index of (path, offset, length) with the records' headers.
- ``read`` opens single members at their offsets.

Of records with equal payloads of at least MIN_REVISIT bytes, that with the smallest page id is a
response and the others are revisits, which name it and hold no payload.

Files go to the folder that all executors share, by pyarrow's file systems (local paths, hdfs, s3, gs).
A task writes under a name of its own attempt, and only names in the written index tables count, so a
task that is lost or runs twice leaves nothing that is read.

NULL pages are empty; a NULL url has no target header, and a NULL page_id comes after all others. Pages
equal in id and payload are both responses or both revisits. Line breaks in urls are percent-encoded.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.text import kept
from assayer.session import run_dir

MIN_REVISIT = 100
#: Pages of one archive at most.
PAGES_PER_FILE = 2000
READ_BYTES = 1 << 20
VERSION = "WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = "path string, offset bigint, length bigint, page_id bigint, record_type string, refers_to bigint"
_INDEX = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64())])
READ = "page_id bigint, record_type string, refers_to bigint, url string, digest string, payload binary"
_READ = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("payload", pa.binary())])


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _uri(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if c in "\r\n%" else c for c in url)


def _plain(uri: str) -> str:
    return uri.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record."""
    block = b"" if revisit else HTTP + payload
    head = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:] if ": " in line)}


def _page(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def inflated(stream) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, in pieces; no piece is larger than READ_BYTES."""
    inflate, data, begun = zlib.decompressobj(31), b"", False
    while True:
        data = data or stream.read(READ_BYTES)
        if not data:
            break
        begun = True
        if inflate.eof:
            inflate = zlib.decompressobj(31)
        yield inflate.decompress(data, READ_BYTES)
        data = inflate.unconsumed_tail or inflate.unused_data
    if begun and not inflate.eof:
        tail = inflate.flush()
        if not inflate.eof:
            raise EOFError("the gzip stream ends early")
        yield tail


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records out of a stream; one record is held at a time."""
    held = bytearray()
    need = None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(headers_of(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise EOFError("the archive ends inside a record")


def _written(batches: Iterator[pa.RecordBatch], folder: str, per_file: int) -> Iterator[pa.RecordBatch]:
    out = files = None
    paths, count = [], 0

    def close():
        files.close()
        out.close()

    for batch in batches:
        ids, urls, pages, refers, revisits = (batch.column(i).to_pylist() for i in range(5))
        for page_id, url, html, to, revisit in zip(ids, urls, pages, refers, revisits, strict=True):
            if count % per_file == 0:
                if files:
                    close()
                path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                system, local = opened(path)
                out = system.open_output_stream(local, compression=None)
                files = gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0)
                paths.append(path)
            files.write(record(page_id, url, (html or "").encode("utf-8"), to, revisit))
            count += 1
    if files:
        close()
    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])


def marked(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """Pages (page_id, url, html) with refers_to and revisit."""
    plain = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes"))
    order = F.coalesce(F.col("page_id"), F.lit((1 << 63) - 1))
    first = kept(plain.where(F.col("bytes") >= least).groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "payloads")
    joined = plain.join(first.withColumnRenamed("digest", "_digest"), (F.col("digest") == F.col("_digest")) & (F.col("bytes") >= least), "left")
    revisit = F.coalesce(order > F.col("first"), F.lit(False))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write(pages: DataFrame, folder: str | None = None, per_file: int = PAGES_PER_FILE) -> DataFrame:
    """Archives of the pages, each one gzip stream; a written table of their paths."""
    folder = folder or run_dir(pages.sparkSession, "warc")
    _made(pages, folder)
    return kept(marked(pages).mapInArrow(lambda batches: _written(batches, folder, per_file), "path string"), "warc-files")


def _made(df: DataFrame, folder: str) -> None:
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def _normalised(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for source in batch.column(0).to_pylist():
            target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
            (system, local), (to_system, to_local) = opened(source), opened(target)
            offset, rows = 0, []
            with system.open_input_stream(local, compression=None) as stream, to_system.open_output_stream(to_local, compression=None) as out:
                for whole in records(inflated(stream)):
                    headers = headers_of(whole[: whole.index(b"\r\n\r\n")])
                    member = gzip.compress(whole, 6, mtime=0)
                    out.write(member)
                    rows.append((target, offset, len(member), _page(headers["warc-record-id"]), headers["warc-type"], _page(headers.get("warc-refers-to"))))
                    offset += len(member)
            columns = zip(*rows, strict=True) if rows else [[] for _ in _INDEX]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _INDEX, strict=True)], schema=_INDEX)


def normalise(files: DataFrame, folder: str | None = None) -> DataFrame:
    """Archives (path) rewritten with a member per record; the written index of all records.

    A file is one stream and so one task's work; files are dealt over the tasks one by one.
    """
    folder = folder or run_dir(files.sparkSession, "warc-members")
    _made(files, folder)
    dealt = files.repartition(max(1, files.count()), "path")
    return kept(dealt.mapInArrow(lambda batches: _normalised(batches, folder), INDEX), "warc-index")


def _opened_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, last, stream = [], None, None
        held = 0
        for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
            if path != last:
                if stream:
                    stream.close()
                system, local = opened(path)
                stream, last = system.open_input_file(local), path
            whole = gzip.decompress(stream.read_at(length, offset))
            end = whole.index(b"\r\n\r\n")
            headers = headers_of(whole[:end])
            block = whole[end + 4 : end + 4 + int(headers["content-length"])]
            payload = block[block.index(b"\r\n\r\n") + 4 :] if block else None
            url = headers.get("warc-target-uri")
            rows.append((_page(headers["warc-record-id"]), headers["warc-type"], _page(headers.get("warc-refers-to")), None if url is None else _plain(url), headers["warc-payload-digest"].removeprefix("sha256:"), payload))
            held += len(payload or b"")
            if held > READ_BYTES * 8:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)
                rows, held = [], 0
        if stream:
            stream.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)


def read(index: DataFrame) -> DataFrame:
    """The records of an index, read at their offsets: page_id, record_type, refers_to, url, the digest they state, payload (NULL for revisits)."""
    return index.mapInArrow(_opened_records, READ)


def resolved(index: DataFrame) -> DataFrame:
    """Per record its payload's size and SHA-256; revisits get those of the response they name."""
    payload = F.col("payload")
    own = kept(read(index).select("page_id", "record_type", "refers_to", "digest", F.octet_length(payload).cast("bigint").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest")), "warc-records")
    wanted = own.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "digest").distinct()
    named = own.where("record_type = 'response'").join(wanted, ["page_id", "digest"], "left_semi")
    named = named.groupBy(F.col("page_id").alias("_page"), F.col("digest").alias("_stated")).agg(F.max("payload_bytes").alias("_bytes"), F.max("payload_digest").alias("_digest"))
    joined = own.join(named, (F.col("refers_to") == F.col("_page")) & (F.col("digest") == F.col("_stated")), "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "_digest").alias("payload_digest"), "record_type", "refers_to")
