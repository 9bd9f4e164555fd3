"""WARC archives of Zstandard frames: written and read in tasks, with a dictionary in a leading skippable frame.

An archive starts with a skippable frame that holds the dictionary; after it, each record is one frame of its
own. Readers load the dictionary, decode frame by frame, and validate the headers, the lengths and the digest of
each record. A revisit names the length of the payload that it stands for, so that no record has to be looked up to
read another. Archives roll over at a bounded size and lie in the shared folder. A task writes under a name of its
own attempt and hands on only the names of finished archives, so that lost tasks leave nothing that is read.

Payloads are UTF-8; null is empty. Among equal payloads of at least ``least`` bytes the largest page id is the
response and the others revisit it; rows that repeat that id are responses too, and if all ids are null all are
responses. A null id among others revisits. Pages may be empty: then there are no archives. Surplus columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, fresh_path

#: Magic number of the skippable frame that holds a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
FRAME = 0xFD2FB528
#: The dictionary is trained on so many pages, the first by a hash of their payload digests, each up to a length.
FIT_PAGES, FIT_LENGTH, DICTIONARY_BYTES = 512, 16_384, 32_768
ARCHIVE_BYTES = 16 << 20
LEVEL = 3
READ_BYTES = 1 << 20
VERSION = b"WARC/1.1"
#: An extension field of revisits: bytes of the payload that they stand for.
LENGTH = b"WARC-Payload-Length"
NEEDED = (b"warc-type", b"warc-record-id", b"warc-date", b"content-length", b"warc-payload-digest")
DATE = b"2024-01-01T00:00:00Z"  # records of a rewrite carry a fixed date, so that reruns agree


class InvalidArchive(ValueError):
    """An archive breaks the format: the message says where."""


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


@lru_cache(maxsize=8)
def opened(base: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if not urlsplit(base).scheme:
        return pyarrow.fs.LocalFileSystem(), base
    return pyarrow.fs.FileSystem.from_uri(base)


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A record with its block. A revisit's block is empty: it names the record that holds the payload."""
    line = lambda name, value: name + b": " + value + b"\r\n"
    known = lambda i: b"<urn:page:" + (b"none" if i is None else str(i).encode()) + b":" + digest.encode() + b">"
    block = payload if kind == "response" else b""
    head = VERSION + b"\r\n" + line(b"WARC-Type", kind.encode()) + line(b"WARC-Record-ID", known(page_id)) + line(b"WARC-Date", DATE)
    if url is not None:
        head += line(b"WARC-Target-URI", re.sub(r"[\s\x00-\x1f]+", "%20", url).encode("utf-8", "surrogatepass"))
    head += line(b"WARC-Payload-Digest", b"sha1:" + digest.encode())
    if kind == "revisit":
        head += line(b"WARC-Profile", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest") + line(b"WARC-Refers-To", known(refers_to)) + line(LENGTH, str(len(payload)).encode())
    return head + line(b"Content-Length", str(len(block)).encode()) + b"\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[bytes, bytes], bytes]:
    """Headers and block of a record; everything that the format fixes is validated."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] != VERSION:
        raise InvalidArchive(f"no record header: {raw[:40]!r}")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip() or name.lower() in headers:
            raise InvalidArchive(f"bad header line: {line[:80]!r}")
        headers[name.lower()] = value.strip()
    if missing := [n for n in NEEDED if n not in headers]:
        raise InvalidArchive(f"headers missing: {missing}")
    length = headers[b"content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise InvalidArchive(f"content length {length!r} against {len(rest) - 4} bytes")
    block = rest[:-4]
    if headers[b"warc-type"] == b"response" and headers[b"warc-payload-digest"] != b"sha1:" + digest_of(block).encode():
        raise InvalidArchive("payload digest differs")
    if headers[b"warc-type"] not in (b"response", b"revisit") or (headers[b"warc-type"] == b"revisit") != (b"warc-refers-to" in headers):
        raise InvalidArchive(f"record type {headers[b'warc-type']!r}")
    if headers[b"warc-type"] == b"revisit" and (block or not headers.get(LENGTH.lower(), b"").isdigit()):
        raise InvalidArchive("a revisit without the length of its payload, or with a block of its own")
    return headers, block


def trained(samples: list[bytes]) -> bytes:
    """A dictionary, or none where there is too little to learn from."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


class Archive:
    """Writes records to one file: first the dictionary's frame, then a frame for each record."""

    def __init__(self, base: str, name: str, dictionary: bytes):
        self.files, root = opened(base)
        self.files.create_dir(root, recursive=True)
        self.path, self.size, self.records = posixpath.join(root, name), 0, 0
        self.out = self.files.open_output_stream(self.path)
        own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.frames = zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=True, write_checksum=True)
        self.put(DICTIONARY_FRAME.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary)

    def put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.size += len(raw)

    def add(self, raw: bytes) -> None:
        self.put(self.frames.compress(raw))
        self.records += 1


def records_in(stream: pa.NativeFile, most_record: int = 1 << 31) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Reads an archive in pieces: memory holds one piece, one frame and one record."""
    lead = stream.read(8)
    if len(lead) < 8 or int.from_bytes(lead[:4], "little") != DICTIONARY_FRAME:
        raise InvalidArchive("no leading dictionary frame")
    length = int.from_bytes(lead[4:], "little")
    dictionary = stream.read(length)
    if len(dictionary) != length:
        raise InvalidArchive("the dictionary frame is cut off")
    if dictionary[:4] == FRAME.to_bytes(4, "little"):  # the format lets the dictionary itself be compressed
        dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
    own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    context = zstandard.ZstdDecompressor(dict_data=own)
    rest = b""
    while True:
        if not rest and not (rest := stream.read(READ_BYTES)):
            return
        frame, parts, size = context.decompressobj(), [], 0
        while True:
            try:
                parts.append(frame.decompress(rest))
            except zstandard.ZstdError as e:
                raise InvalidArchive(f"bad frame: {e}") from e
            if (size := size + len(parts[-1])) > most_record:
                raise InvalidArchive("the record is too long")
            if frame.eof:
                rest = frame.unused_data
                break
            if not (rest := stream.read(READ_BYTES)):
                raise InvalidArchive("the last frame is cut off")
        yield parsed(b"".join(parts))


def decided(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, kind, refers_to) of each row."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    sha = F.sha1("payload")
    rows = rows.withColumn("sha", sha)
    # Sums and maxima are taken before the shuffle; a hot payload has one row here, and Spark splits its side of the join.
    last = rows.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 and last is not null").select("sha", "last")
    found = rows.join(last, "sha", "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("last")) & F.col("last").isNotNull(), F.lit(False))
    return found.select("page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("last")).alias("refers_to"))


def written(rows: DataFrame, base: str, dictionary: bytes, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives; returns (path, records) of each. Evaluate it once: each evaluation writes anew."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stem, at, own = f"{task.partitionId()}-{task.attemptNumber()}-{uuid.uuid4().hex}", 0, None

        def done(archive: Archive) -> pa.RecordBatch:
            archive.out.close()
            return pa.RecordBatch.from_arrays([pa.array([posixpath.basename(archive.path)]), pa.array([archive.records], pa.int64())], names=["path", "records"])

        for batch in batches:
            for page_id, url, payload, kind, refers_to in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "kind", "refers_to")], strict=True):
                own = own or Archive(base, f"{stem}-{(at := at + 1)}.warc.zst", dictionary)
                own.add(record(kind, page_id, url, payload, digest_of(payload), refers_to))
                if own.size >= archive_bytes:
                    yield done(own)
                    own = None
        if own:
            yield done(own)

    return rows.select("page_id", "url", "payload", "kind", "refers_to").mapInArrow(work, "path string, records long")


def read(archives: DataFrame, base: str) -> DataFrame:
    """(page_id, record_type, payload_digest, refers_to, payload_bytes) of each record."""
    names = ["page_id", "record_type", "payload_digest", "refers_to", "payload_bytes"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(base)
        number = lambda name: None if (x := name.split(b":")[2]) == b"none" else int(x)
        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                found = []
                with files.open_input_stream(posixpath.join(root, path)) as stream:
                    for headers, block in records_in(stream):
                        kind = headers[b"warc-type"].decode()
                        refers = number(headers[b"warc-refers-to"]) if kind == "revisit" else None
                        found.append((number(headers[b"warc-record-id"]), kind, headers[b"warc-payload-digest"].removeprefix(b"sha1:").decode(), refers, len(block) if kind == "response" else int(headers[LENGTH.lower()])))
                if len(found) != records:
                    raise InvalidArchive(f"{path}: {len(found)} of {records} records")
                columns = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=names)

    return archives.mapInArrow(work, "page_id long, record_type string, payload_digest string, refers_to long, payload_bytes long")


def archived(pages: DataFrame, *, least: int = 0, html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> tuple[DataFrame, str]:
    """Writes all pages; returns the list of archives (path, records) and the folder they lie in."""
    spark = pages.sparkSession
    bounded_batches(spark)
    text = F.substring(F.coalesce(F.col(html_col), F.lit("")), 1, FIT_LENGTH)
    sample = pages.select(text.alias("t")).where("t != ''").orderBy(F.xxhash64("t"), "t").limit(FIT_PAGES)
    dictionary = trained([r["t"].encode("utf-8", "surrogatepass") for r in sample.toLocalIterator()])
    base = fresh_path(spark, "warc")
    # The list is written once, and so are the archives that it names: a few rows for each archive.
    listed = f"{base}-list"
    written(decided(pages, least, html_col=html_col), base, dictionary, archive_bytes).write.parquet(listed)
    return spark.read.schema("path string, records long").parquet(listed), base


def round_trip(pages: DataFrame, *, least: int = 0, html_col: str = "html") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each page, from the archives read back."""
    archives, base = archived(pages, least=least, html_col=html_col)
    return read(archives.repartition(max(1, archives.count())), base).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
