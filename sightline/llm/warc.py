"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle ends with a seek table in a skippable
frame, so any frame can be read alone.  The index maps a record's id to its bundle, its frame and
its place in the frame's content.  Tasks write under names of their own and rename when complete; the
index names only bundles of tasks that succeeded, so a lost or repeated task leaves nothing wrong.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import settle

REVISIT_FROM = 1000  # bytes; shorter payloads are always stored
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 512 << 20
DATE = "2000-01-01T00:00:00Z"  # the pages carry no date

# Fixed values of the seekable format and of WARC.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "record_id string, bundle string, frame int, frame_at bigint, frame_bytes int, start int, bytes int"
READ = (
    "record_id string, page_id string, url string, record_type string, refers_to string, "
    "payload_bytes bigint, payload_digest string, payload binary"
)


def _store(uri: str):
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def _record(page: str, url: str | None, payload: bytes, size: int, sha1: str, refers: str | None) -> bytes:
    """One record; a revisit has the payload's length and digest, not the payload."""
    revisit = refers is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page}>",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


class _Bundle:
    """A bundle being written."""

    def __init__(self, folder: str):
        self.store, root = _store(folder)
        self.name = f"part-{uuid.uuid4().hex}.warc.zst"
        self.path, self.final = f"{root}/.{self.name}", f"{root}/{self.name}"
        self.uri = f"{folder}/{self.name}"
        self.store.create_dir(root, recursive=True)
        self.out = self.store.open_output_stream(self.path, compression=None)
        self.at, self.table, self.frame, self.rows, self.done = 0, [], [], [], []
        self.raw = 0

    def add(self, record_id: str, record: bytes) -> None:
        self.rows.append((record_id, self.raw, len(record)))
        self.frame.append(record)
        self.raw += len(record)

    def end_frame(self) -> None:
        if not self.frame:
            return
        data = zstandard.ZstdCompressor(level=3, write_content_size=True).compress(b"".join(self.frame))
        self.out.write(data)
        self.done += [(i, self.uri, len(self.table), self.at, len(data), s, n) for i, s, n in self.rows]
        self.table.append((len(data), self.raw))
        self.at += len(data)
        self.frame, self.rows, self.raw = [], [], 0

    def close(self) -> list[tuple]:
        self.end_frame()
        entries = b"".join(struct.pack("<II", *x) for x in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()
        self.store.move(self.path, self.final)
        return self.done


def seek_table(file) -> list[tuple[int, int, int]]:
    """(start, compressed bytes, content bytes) of each frame, read from the end of the bundle."""
    size = file.size()
    file.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * count)
    at, found = 0, []
    for packed, content in struct.iter_unpack("<II", file.read(8 * count)):
        found.append((at, packed, content))
        at += packed
    return found


def described(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, size, sha1, refers): each page with the record that holds its payload.

    Payloads are compared by SHA-256 and length.  Of equal payloads of ``REVISIT_FROM`` bytes or
    more the rows with the largest page_id are stored (repeated rows of that id each); a null id is
    below all others.
    """
    told = pages.select(
        F.col("page_id"), F.col("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    ).select("*", F.octet_length("payload").cast("bigint").alias("size"), F.sha2("payload", 256).alias("same"))
    first = (
        told.where(F.col("size") >= REVISIT_FROM).groupBy("same")
        .agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    )
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return told.join(first, "same", "left").select(
        "page_id", "url", "payload", "size", F.sha1("payload").alias("sha1"), refers.alias("refers")
    )


def write(pages: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) into bundles; returns the settled index."""

    def work(batches):
        bundle = None

        def rows(found):
            columns = list(zip(*found, strict=True)) or [[]] * 7
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            names = [x.split()[0] for x in INDEX.split(", ")]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
            )

        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                for page, url, payload, size, sha1, refers in zip(
                    *[c.to_pylist() for c in batch.slice(start, 64).columns], strict=True
                ):
                    bundle = bundle or _Bundle(folder)
                    bundle.add(f"urn:page:{page}", _record(page, url, payload, size, sha1, refers))
                    if bundle.raw >= frame_bytes:
                        bundle.end_frame()
                    if bundle.at >= bundle_bytes:
                        yield rows(bundle.close())
                        bundle = None
        if bundle:
            yield rows(bundle.close())

    told = described(pages).select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "url", "payload", "size", "sha1",
        F.col("refers").cast("string"),
    )
    return settle(told.mapInArrow(work, INDEX), "warc-index")


def _parsed(record: bytes) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")

    def page(name: str) -> str | None:
        found = fields.get(name, "<urn:page:null>")[10:-1]
        return None if found == "null" else found

    return (
        fields["WARC-Record-ID"][1:-1], page("WARC-Record-ID"), fields.get("WARC-Target-URI"), kind,
        page("WARC-Refers-To"), size, digest, payload if kind == "response" else None,
    )


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that ``index`` names, read frame by frame; a part of an index reads only its frames.

    Each payload is checked against its digest.  The payload of a revisit is null: it is that of the
    record it refers to.
    """

    def work(batches):
        file, opened, frame, content = None, None, None, b""
        table: list = []
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                out = []
                part = batch.slice(start, 256).to_pylist()
                for x in part:
                    if x["bundle"] != opened:
                        if file:
                            file.close()
                        store, path = _store(x["bundle"])
                        file, opened, frame = store.open_input_file(path), x["bundle"], None
                        table = seek_table(file)
                    if x["frame"] != frame:
                        at, packed, size = table[x["frame"]]
                        file.seek(at)
                        content = zstandard.ZstdDecompressor().decompressobj().decompress(file.read(packed))
                        if len(content) != size:
                            raise ValueError(f"damaged frame {x['frame']} of {opened}")
                        frame = x["frame"]
                    found = _parsed(content[x["start"] : x["start"] + x["bytes"]])
                    out.append(found if payloads else (*found[:-1], None))
                columns = list(zip(*out, strict=True)) or [[]] * 8
                kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.binary()]
                names = [c.split()[0] for c in READ.split(", ")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
                )
        if file:
            file.close()

    rows = index.repartition("bundle").sortWithinPartitions("bundle", "frame", "start")
    return rows.mapInArrow(work, READ)
