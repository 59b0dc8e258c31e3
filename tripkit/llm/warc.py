"""WARC archives: written with one gzip member per record, read back sequentially.

The reader inflates one member at a time as bytes arrive, frames the record by its content
length and verifies its digests. Archives are files in a shared folder; tasks stream them
through the file system that the folder's scheme names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripkit.llm.common import free_name, numbered
from tripkit.operators.layout import checkpointed, ensure_checkpoint_dir

ARCHIVE_BYTES = 1 << 28
READ_BYTES = 1 << 18
DATE = "2024-01-01T00:00:00Z"
# The record format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = [VERSION, *(f"{k}: {v}".encode("utf-8") for k, v in headers.items())]
    lines.append(b"Content-Length: %d" % len(block))
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def http_block(payload: bytes | None, length: int) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n"
    return head.encode("ascii") + (payload or b"")


def target_uri(url: str | None) -> str:
    return " ".join((url or "").split())


def record_id(page_id, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{url}')}>"


def page_record(page_id, url: str | None, payload: bytes, refers_to, has_reference: bool, refers_to_url: str | None = None) -> bytes:
    """A response record, or a revisit record that names the response with the same payload."""
    block = http_block(None if has_reference else payload, len(payload))
    headers = {
        "WARC-Type": "revisit" if has_reference else "response",
        "WARC-Record-ID": record_id(page_id, url),
        "WARC-Date": DATE,
        "WARC-Target-URI": target_uri(url),
        "WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}",
        "WARC-Block-Digest": f"sha1:{sha1_base32(block)}",
        "Content-Type": "application/http; msgtype=response",
        "X-Page-Id": "" if page_id is None else str(page_id),
        "X-Payload-Length": str(len(payload)),
    }
    if has_reference:
        headers["WARC-Profile"] = REVISIT_PROFILE
        headers["WARC-Refers-To"] = record_id(refers_to, refers_to_url)
        headers["WARC-Refers-To-Target-URI"] = target_uri(refers_to_url)
        headers["WARC-Refers-To-Date"] = DATE
        headers["X-Refers-To-Page-Id"] = "" if refers_to is None else str(refers_to)
    return record_bytes(headers, block)


def members(stream: BinaryIO) -> Iterator[bytes]:
    """The inflated content of one gzip member after the other, reading ahead at most ``READ_BYTES``."""
    rest = b""
    while True:
        rest = rest or stream.read(READ_BYTES)
        if not rest:
            return
        inflater, parts = zlib.decompressobj(31), []
        while not inflater.eof:
            if not rest:
                rest = stream.read(READ_BYTES)
                if not rest:
                    raise ValueError("the archive ends inside a record")
            parts.append(inflater.decompress(rest))
            rest = inflater.unused_data
        yield b"".join(parts)


def parse_record(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record; its length must frame the member exactly.

    A header line that isn't UTF-8 is read byte for byte, as old archives have them.
    """
    head, mark, rest = content.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not mark or not version.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines:
        try:
            name, _, value = line.decode("utf-8").partition(":")
        except UnicodeDecodeError:
            name, _, value = line.decode("latin-1").partition(":")
        headers[name.strip().lower()] = value.strip()
    if not headers.get("content-length", "").isdecimal():
        raise ValueError("the record has no content length")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("the content length does not frame the record")
    return headers, rest[:length]


def full_length(headers: dict[str, str], block: bytes, payload: bytes) -> int | None:
    """Bytes of the full payload, which a revisit doesn't repeat: by its own header, or by the one of its HTTP block."""
    own = headers.get("x-payload-length", "")
    if own.isdecimal():
        return int(own)
    if headers.get("warc-type") != "revisit":
        return len(payload)
    for line in block.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value)
    return None


def read_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes, int | None]]:
    """``(headers, payload, full_length)`` of every record of an archive; a digest that does not fit is an error."""
    for content in members(stream):
        headers, block = parse_record(content)
        if f"sha1:{sha1_base32(block)}" != headers.get("warc-block-digest", f"sha1:{sha1_base32(block)}"):
            raise ValueError("block digest differs")
        payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
        if headers.get("warc-type") == "response":
            digest = f"sha1:{sha1_base32(payload)}"
            if digest != headers.get("warc-payload-digest", digest):
                raise ValueError("payload digest differs")
        yield headers, payload, full_length(headers, block, payload)


def with_revisits(pages: DataFrame, page_id: Column, payload: Column, url: Column, least_bytes: int = 0) -> DataFrame:
    """Add ``response_id``, its url and ``revisits``: of equal payloads the largest id is the response.

    Payloads below ``least_bytes`` are all responses. NULL ids count as the smallest; rows that
    repeat the largest id are all responses.
    """
    keyed = pages.withColumn("digest", F.sha1(payload)).withColumn("size", F.length(payload))
    wide = keyed.where(F.col("size") >= least_bytes)
    groups = wide.groupBy(F.col("digest").alias("of"), F.col("size").alias("of_size")).agg(
        F.max(F.struct(page_id.alias("id"), url.alias("url"))).alias("response"), F.count(F.lit(1)).alias("n")
    )
    shared = checkpointed(
        groups.where("n > 1").select(
            "of", "of_size", F.col("response.id").alias("response_id"), F.col("response.url").alias("response_url")
        )
    )
    joined = keyed.join(shared, (F.col("digest") == F.col("of")) & (F.col("size") == F.col("of_size")), "left")
    revisits = F.col("of").isNotNull() & F.col("response_id").isNotNull() & ~page_id.eqNullSafe(F.col("response_id"))
    return joined.withColumn("revisits", revisits).drop("of", "of_size", "digest", "size")


def write_archives(
    pages: DataFrame,
    folder: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record per row of ``pages`` to ``folder``: the manifest ``(path, records, bytes)``.

    The payload is the html in UTF-8, empty for NULL. Each task writes its own archives and
    starts a new one at about ``archive_bytes``. A file gets its name, that of the task and its
    attempt, once it is whole; the manifest, written by the same job, lists the files that
    count, so what failed or repeated tasks leave behind is never read. Ids are kept as text.
    Extra columns are ignored; no rows give no archives.
    """
    chosen = pages.select(
        F.col(page_id).alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    marked = with_revisits(chosen, F.col("page_id"), F.col("payload"), F.col("url"), least_bytes)
    rows = marked.select(
        F.col("page_id").cast("string"), "url", "payload", F.col("response_id").cast("string"), "revisits", "response_url"
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, base = fs.FileSystem.from_uri(folder)
        made: list[tuple[str, int, int]] = []
        out, path, count, size = None, "", 0, 0

        def close() -> None:
            nonlocal out, count, size
            if out is not None:
                out.close()
                system.move(f"{path}.part", path)
                made.append((f"{folder}/{path.rsplit('/', 1)[1]}", count, size))
            out, count, size = None, 0, 0

        for batch in batches:
            columns = [batch[name].to_pylist() for name in ("page_id", "url", "payload", "response_id", "revisits", "response_url")]
            for record in zip(*columns, strict=True):
                if out is None:
                    path = f"{base}/{task.partitionId():06d}-{task.taskAttemptId()}-{len(made):04d}.warc.gz"
                    out = system.open_output_stream(f"{path}.part")
                data = page_record(*record)
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())],
            names=["path", "records", "bytes"],
        )

    # The folder exists before any task opens a file in it.
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    return checkpointed(rows.mapInArrow(write, "path string, records long, bytes long"))


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of the archives that ``manifest`` lists, each archive read by one task.

    ``(record_type, page_id, uri, payload_digest, payload_bytes, refers_to, payload, record_id,
    refers_to_record)``: ids as text, NULL where there were none; the last two are those of the
    record format, which archives of other writers have as well. ``payload_bytes`` is that of the
    full payload, whose bytes a revisit record does not repeat (NULL if nothing tells it). A broken
    record, a wrong length or digest, or a missing record fails the job, by the archive's name.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_type", "page_id", "uri", "payload_digest", "payload_bytes", "refers_to", "payload", "record_id", "refers_to_record"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names
            )

        for batch in batches:
            for path, records in zip(batch["path"].to_pylist(), batch["records"].to_pylist(), strict=True):
                system, inner = fs.FileSystem.from_uri(path)
                rows, size, seen = [], 0, 0
                with system.open_input_stream(inner, compression=None) as stream:
                    found = read_records(stream)
                    while True:
                        try:
                            headers, payload, length = next(found)
                        except StopIteration:
                            break
                        except (ValueError, zlib.error) as error:
                            raise ValueError(f"{path}, record {seen}: {error}") from error
                        seen += 1
                        kind = headers.get("warc-type")
                        revisit = kind == "revisit"
                        rows.append(
                            (
                                kind,
                                headers.get("x-page-id") or None,
                                headers.get("warc-target-uri"),
                                headers.get("warc-payload-digest", "").removeprefix("sha1:"),
                                length,
                                (headers.get("x-refers-to-page-id") or None) if revisit else None,
                                None if revisit else payload,
                                headers.get("warc-record-id"),
                                headers.get("warc-refers-to"),
                            )
                        )
                        size += len(payload)
                        if size >= 1 << 22 or len(rows) >= 4096:
                            yield batch_of(rows)
                            rows, size = [], 0
                if seen != records:
                    raise ValueError(f"{path} has {seen} records of {records}")
                if rows:
                    yield batch_of(rows)

    # A task per archive: ranges of one number each, which Spark does not merge again.
    number = free_name(manifest, "number")
    paths = numbered(manifest, number).repartitionByRange(max(1, manifest.count()), number).select("path", "records")
    return paths.mapInArrow(
        read,
        "record_type string, page_id string, uri string, payload_digest string, payload_bytes long, refers_to string, "
        "payload binary, record_id string, refers_to_record string",
    )


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives beside the checkpoints, as a URI."""
    folder = ensure_checkpoint_dir(spark)
    return f"{folder if ':/' in folder else f'file://{folder}'}/warc-{uuid.uuid4()}"
