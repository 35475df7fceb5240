"""WARC archives: written a gzip member per record, read by byte ranges.

Writing: tasks write archive files of their own on the shared folder and return a
row per finished file; only files of that manifest are read, so what a lost task left
behind is never seen. Of records with equal payloads the one with the smallest id is
a response, the others are revisits that refer to it.

Reading: a task scans its byte ranges for the first bytes of gzip members, decodes each
candidate's first bytes, and takes those that begin like a WARC record and decode to
their end, with the checksum of the member. A record belongs to the range in which it
starts, however far it reaches. Files are opened through Arrow, so any store it knows
will do.

Defined results: a NULL payload is empty; a NULL url is left out; of equal payloads,
rows that share the smallest id are all responses, and rows without id refer to the
smallest id unless no row has one; equal rows give equal records; empty tables
give no files and no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepframe.session import write_table

MAGIC = b"\x1f\x8b\x08"
BEGIN = b"WARC/1."
#: Bytes of an archive scanned as one range, and of a file until the next is begun.
RANGE_BYTES = 8 << 20
FILE_BYTES = 256 << 20
#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


def open_store(uri: str):
    """File system and path of a uri or absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One gzip member with a response, or with a revisit if ``refers_to`` is given."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{page}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%:/?#[]@!$&'()*+,;=~")))
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head = "".join([VERSION, "\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode()
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    return member.compress(head + block + b"\r\n\r\n") + member.flush()


def fields_of(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in lines.split(b"\r\n")[1:] if line)
    return {k.decode().strip().lower(): v.decode("utf-8", "replace").strip() for k, _, v in pairs}


def parse(raw: bytes) -> dict:
    """A record's fields and payload. A revisit's payload is not stored: its length and
    digest come from its headers."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = fields_of(head)
    block = rest[: int(fields.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields.get("warc-type") == "revisit"
    urn = re.compile(r"<urn:page:(.*)>")
    named = {k: urn.fullmatch(fields[k]) for k in ("warc-record-id", "warc-refers-to") if k in fields}
    return {
        "page": (m := named.get("warc-record-id")) and (m[1] or None),
        "url": fields.get("warc-target-uri"),
        "record_type": fields.get("warc-type"),
        "refers_to": (m := named.get("warc-refers-to")) and m[1],
        "payload_bytes": int(fields_of(http).get("content-length", 0)) if revisit else len(payload),
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else digest(payload),
        "payload": None if revisit else payload,
    }


class Source:
    """Bytes of a file, read ahead a piece at a time."""

    def __init__(self, file, size: int, piece: int = 1 << 20) -> None:
        self.file, self.size, self.piece = file, size, piece
        self.start, self.held = 0, b""

    def _hold(self, start: int, length: int) -> int:
        """Have ``length`` bytes from ``start`` at hand, as far as the file goes; where
        they are in what is held."""
        length = min(length, self.size - start)
        if not self.start <= start <= start + length <= self.start + len(self.held):
            self.start = start
            self.held = self.file.read_at(min(max(length, self.piece), self.size - start), start)
        return start - self.start

    def read(self, start: int, length: int) -> memoryview:
        if start >= self.size:
            return memoryview(b"")
        at = self._hold(start, length)
        return memoryview(self.held)[at : at + length]

    def find(self, what: bytes, start: int, end: int) -> int | None:
        """The first place of ``what`` that begins in ``start <= place < end``."""
        while start < end:
            at = self._hold(start, len(what))
            found = self.held.find(what, at, end - self.start + len(what) - 1)
            if found >= 0:
                return self.start + found
            start = max(start + 1, self.start + len(self.held) - len(what) + 1)
        return None


def member(source: Source, start: int) -> tuple[bytes, int] | None:
    """The WARC record that starts at a place, and where its gzip member ends."""
    decoder, place, out, piece = zlib.decompressobj(31), start, [], 4096
    checked = False
    try:
        while not decoder.eof:
            data = source.read(place, piece)
            if not data:
                return None
            place += len(data)
            out.append(decoder.decompress(data))
            if not checked:
                begun = b"".join(out)[: len(BEGIN)]
                if not BEGIN.startswith(begun):
                    return None
                checked = len(begun) == len(BEGIN)
            piece = min(2 * piece, source.piece)
    except zlib.error:
        return None
    return (b"".join(out), place - len(decoder.unused_data)) if checked else None


def records(source: Source, start: int, end: int) -> Iterator[bytes]:
    """Records that start in ``start <= place < end``."""
    while (at := source.find(MAGIC, start, end)) is not None:
        found = member(source, at)
        if found is None:
            start = at + 1
        else:
            yield found[0]
            start = found[1]


def marked(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """``page``, ``url``, ``payload`` and, for revisits, ``refers_to``. Runs a job."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")
    )
    rows = rows.withColumn("same", F.concat_ws(":", F.octet_length("payload"), F.sha2("payload", 256)))
    large = F.octet_length("payload") >= least
    first = (
        rows.where(large).groupBy("same").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("rows"))
    )
    # written, so that both sides are shuffled as they are and a hot payload can be split
    first = write_table(first.where("rows > 1").drop("rows"), "first").df.hint("merge")
    other = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    return rows.join(first, "same", "left").select(
        "page", "url", "payload", F.when(other, F.col("first")).alias("refers_to")
    )


def write(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least: int = 0,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Archives in ``folder``, which all executors must reach; the manifest (``file``,
    ``bytes``, ``records``). Runs a job.

    Payloads of fewer than ``least`` bytes are always responses.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        out, name, size, count = None, None, 0, 0

        def manifest() -> pa.RecordBatch:
            out.close()
            row = [[f"{folder.rstrip('/')}/{name}"], [size], [count]]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["file", "bytes", "records"])

        for batch in parts:
            for page, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, size, count = store.open_output_stream(f"{path}/{name}", compression=None), 0, 0
                data = record(page or "", url, payload.encode(), refers_to)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= file_bytes:
                    yield manifest()
                    out = None
        if out is not None:
            yield manifest()

    rows = marked(pages, id_col, url_col, html_col, least)
    rows = rows.select(F.col("page").cast("string"), "url", "payload", F.col("refers_to").cast("string"))
    return write_table(rows.mapInArrow(run, "file string, bytes long, records long"), "manifest").df


FIELDS = "page string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string"


def read(
    manifest: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True, tasks: int | None = None
) -> DataFrame:
    """Records of the files of a manifest (``file``, ``bytes``), with their payloads, read
    by so many tasks (as many as a shuffle has, if not given)."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))
    ranges = manifest.where("bytes > 0").select("file", "bytes", F.explode(starts).alias("start"))
    schema = pa.schema([(n, pa.string()) for n in ("page", "url", "record_type", "refers_to")])
    schema = schema.append(pa.field("payload_bytes", pa.int64())).append(pa.field("payload_digest", pa.string()))
    schema = schema.append(pa.field("payload", pa.binary())) if payloads else schema

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for uri, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                store, path = open_store(uri)
                with store.open_input_file(path) as file:
                    held, rows = 0, []
                    for raw in records(Source(file, size), start, min(start + range_bytes, size)):
                        rows.append(parse(raw))
                        held += len(raw) if payloads else 256
                        if held > RANGE_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            held, rows = 0, []
                    yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = FIELDS + ", payload binary" if payloads else FIELDS
    # a number, because adaptive execution would join the ranges, which are small rows, in few tasks
    n = tasks or int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(n, "file", "start").mapInArrow(run, kinds)
