"""WARC records in seekable Zstandard bundles.

Each task writes its records to bundles in the shared folder.  Records gather in independent Zstandard frames; a
skippable frame at the end of a bundle holds the seek table in the published seekable format (compressed and plain
size of each frame), so any frame can be read alone.  The index maps a record's id to bundle, frame, and the offset
and length within the plain frame.

Of records with equal payloads the one with the largest id is the response, and the others are revisit records with
its id and without payload.  The largest id of each digest is found by an aggregate that combines before the shuffle;
ids and digests alone are joined with it, and pages get it back by their own id and digest.  So html is dealt by page
and never by digest, and a payload that a third of all pages share spreads over all tasks like any other.  Frames are
dealt to the tasks that read them back by a hash of the frame, as many tasks as the bytes of the archives ask for.

Results for odd input.  A null html is an empty payload.  Rows with an equal payload and the same largest id are all
responses.  A null id counts as the smallest; its record id ends in "null", and refers_to is null where the response
has a null id.  A null url gives an empty target URI; line ends in a url become spaces.  Other columns are ignored.
An empty table writes no bundle and gives an empty result.

A bundle is written under a name of the attempt's own and then renamed to its final name, which holds a random part;
rows of the index name only finished bundles, so a task that runs again leaves at most an unused file.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.llm.base import NULL_ID, folder as folder_of, known_id, new_path, partitions, real_id, saved, small_batches

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 18, 1 << 26, 3
#: Plain bytes that a task reads back.
READ_BYTES = 1 << 28
#: Magic numbers of the seekable format (fixed values): of the skippable frame, and of the seek table's footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _urn(page: int) -> str:
    return "urn:page:" + ("null" if page == NULL_ID else str(page))


def _id(urn: str) -> int:
    tail = urn.rpartition(":")[2].rstrip(">")
    return NULL_ID if tail == "null" else int(tail)


def record(page: int, url: str | None, payload: bytes, digest: str, of: int | None) -> bytes:
    """One WARC/1.1 record; a revisit of the record of page ``of`` if that isn't None."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if of is None else 'revisit'}",
        f"WARC-Record-ID: <{_urn(page)}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if of is None else b"")
    if of is not None:
        head += [f"WARC-Refers-To: <{_urn(of)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The headers and block of the record at an offset, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    stop = end + 4 + int(head["Content-Length"])
    return head, data[end + 4 : stop], stop + 4


class BundleWriter:
    """Frames of records, then the seek table."""

    def __init__(self, out: io.RawIOBase):
        self.out, self.zip, self.frames = out, zstandard.ZstdCompressor(level=LEVEL), []
        self.plain, self.size = bytearray(), 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame number and offset in it."""
        if self.plain and len(self.plain) + len(data) > FRAME_BYTES:
            self.flush()
        at = len(self.frames), len(self.plain)
        self.plain += data
        return at

    def flush(self) -> None:
        if self.plain:
            packed = self.zip.compress(bytes(self.plain))
            self.out.write(packed)
            self.frames.append((len(packed), len(self.plain)))
            self.size += len(packed)
            self.plain = bytearray()

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Reads the seek table from the end of a bundle and then single frames."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        size = file.tell()
        file.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        file.seek(size - 9 - 8 * n)
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", file.read(8 * n)):
            self.frames.append((at, packed, plain))
            at += packed
        self.unzip = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        self.file.seek(at)
        return self.unzip.decompress(self.file.read(packed), max_output_size=plain)


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes the bundles and returns their index: (page, bundle, frame, at, size)."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    small_batches(spark)
    rows = pages.select(known_id("page_id").alias("page"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    # Only payloads that occur more than once get a last page; the rest need no more than their own row.
    long = rows.filter(F.octet_length("html") >= min_bytes).select("page", "digest")
    last = long.groupBy("digest").agg(F.max("page").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "last")
    of = long.distinct().join(saved(last, "last"), "digest").filter("page < last")
    rows = rows.join(saved(of, "revisits"), ["page", "digest"], "left")

    def write(batches):
        files, base = folder_of(folder)
        files.create_dir(base, recursive=True)
        writer = name = None
        index: list = []

        def done():
            writer.close()
            files.move(f"{base}/{name}.part", f"{base}/{name}")
            return pd.DataFrame(index, columns=["page", "bundle", "frame", "at", "size"])

        for pdf in batches:
            for page, url, html, last in zip(pdf["page"], pdf["url"], pdf["html"], pdf["last"].astype("Int64"), strict=True):
                if writer is None:
                    name, index = f"{uuid.uuid4().hex}.warc.zst", []
                    writer = BundleWriter(files.open_output_stream(f"{base}/{name}.part"))
                payload = html.encode("utf-8", "replace")
                of = None if last is pd.NA or last == page else int(last)
                data = record(page, url, payload, payload_digest(payload), of)
                index.append((page, f"{folder}/{name}", *writer.add(data), len(data)))
                if writer.size >= BUNDLE_BYTES:
                    yield done()
                    writer = None
        if writer is not None:
            yield done()

    return saved(rows.select("page", "url", "html", "last").mapInPandas(write, "page long, bundle string, frame int, at long, size long"), "warc-index")


def read_archives(spark, index: DataFrame) -> DataFrame:
    """The records of all bundles in an index, each frame read alone and checked against the index and its digest."""
    small_batches(spark, 64)
    size = index.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    frames = index.groupBy("bundle", "frame").agg(F.collect_list(F.struct("at", "size", "page")).alias("records"))
    # The index is small and the archives behind it are not: the number of tasks follows the archives.
    tasks = max(partitions(spark), size // READ_BYTES)
    frames = frames.repartition(tasks, F.xxhash64("bundle", "frame")).sortWithinPartitions("bundle", "frame")

    def read(batches):
        reader = at = None
        for pdf in batches:
            out = []
            for bundle, frame, records in zip(pdf["bundle"], pdf["frame"], pdf["records"], strict=True):
                if bundle != at:
                    files, path = folder_of(bundle)
                    reader, at = BundleReader(files.open_input_file(path)), bundle
                data = reader.frame(int(frame))
                for x in records:
                    head, block, end = parsed(data, int(x["at"]))
                    page, digest = _id(head["WARC-Record-ID"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if page != x["page"] or end - x["at"] != x["size"]:
                        raise ValueError(f"{bundle}: the index and frame {frame} differ")
                    size, of = int(head["X-Payload-Length"]), None
                    if head["WARC-Type"] == "revisit":
                        of = _id(head["WARC-Refers-To"])
                    else:
                        payload = block.partition(b"\r\n\r\n")[2]
                        size, digest = len(payload), payload_digest(payload)
                        if head["WARC-Payload-Digest"] != f"sha1:{digest}":
                            raise ValueError(f"{bundle}: a payload has not its digest")
                    out.append((page, size, digest, head["WARC-Type"], of))
            yield pd.DataFrame(out, columns=["page", "payload_bytes", "payload_digest", "record_type", "of"]).astype({"of": "Int64"})

    got = frames.mapInPandas(read, "page long, payload_bytes long, payload_digest string, record_type string, of long")
    return got.select(real_id("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", real_id("of").alias("refers_to"))


def fetch(index: DataFrame, page_id: int) -> bytes:
    """The payload of one page, by its frame; a revisit is followed to its response."""
    row = index.filter(F.col("page") == page_id).first()
    files, path = folder_of(row["bundle"])
    head, block, _ = parsed(BundleReader(files.open_input_file(path)).frame(row["frame"]), row["at"])
    if head["WARC-Type"] == "revisit":
        return fetch(index, _id(head["WARC-Refers-To"]))
    return block.partition(b"\r\n\r\n")[2]


def archived(pages: DataFrame) -> DataFrame:
    """Writes all pages to archives, reads them back, and returns one row per record."""
    return read_archives(pages.sparkSession, write_archives(pages))
