"""WARC archives: writing page records, and a splittable reader.

Writing: every page becomes one gzip member with one record. Of pages with equal
payloads of ``LEAST_BYTES`` bytes or more, that with the smallest page_id is a
response, the others are revisits that name it and its digest and carry no
payload. Records are cut over files of near ``FILE_BYTES`` bytes. A file's name is new for each attempt
and files are listed by the rows that the writing job returns, so what a lost or
repeated task leaves behind is not read.

Reading: tasks take byte ranges of files. A task looks for gzip magic in its
range, and takes a place for a member only if it inflates to a WARC header with
a version line, a type and a Content-Length that the member then fulfils. It owns records that start
in its range, and reads on past the end for the last one; so every record is read
once, whatever the ranges are.

Null page_id and null or empty html are written (empty payload). Repeated rows are
records each; rows that share page_id and payload with a response are responses too. An empty
table gives no file. Other columns are not written.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm.common import durable, open_store, shared_folder

LEAST_BYTES, FILE_BYTES, SPLIT_BYTES, READ_BYTES = 100, 128 << 20, 16 << 20, 1 << 20
MAGIC = b"\x1f\x8b\x08"
LEVEL = 4
FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


# Records

def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit has an empty block and says what its payload was."""
    block = b"" if revisit else payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {json.dumps(url)}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-Id: {json.dumps(page_id)}", f"X-Payload-Bytes: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To: {json.dumps(refers_to)}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields and block of a whole record, or None if it is none."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not lines[0].startswith(b"WARC/1."):
        return None
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("ascii", "replace").lower()] = value.strip().decode("utf-8", "surrogatepass")
    length = fields.get("content-length", "")
    if "warc-type" not in fields or not length.isdigit() or len(rest) != int(length) + 4 or rest[int(length):] != b"\r\n\r\n":
        return None
    return fields, rest[:int(length)]


# Writing

def record_types(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """``_id, _url, _html, _digest, _first``: the page each row would revisit, null where its payload stands alone."""
    body = F.coalesce(F.col(html), F.lit(""))
    return pages.select(F.col(page_id).cast("long").alias("_id"), F.col("url").alias("_url"), body.alias("_html"), F.sha2(body.cast("binary"), 256).alias("_digest"))


def write_warc(pages: DataFrame, page_id: str = "page_id", html: str = "html", folder: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives; returns (file, n_bytes, n_records)."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    rows = record_types(pages, page_id, html)
    # Digests met twice or more, counted before they meet; the join's large side can be split where one digest is very common.
    several = rows.where(F.octet_length("_html") >= LEAST_BYTES).groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("_digest", "_first")
    typed = rows.join(several, "_digest", "left").select("_id", "_url", "_html", "_digest", "_first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        out, file, name, size, count = [], None, "", 0, 0
        for batch in batches:
            for page, url, text, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                if file is None:
                    name, size, count = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    file = store.open_output_stream(open_store(name)[1], compression=None)
                raw = member(record(page, url, text.encode("utf-8", "surrogatepass"), digest, first, first is not None and page != first))
                file.write(raw)
                size, count = size + len(raw), count + 1
                if size >= file_bytes:
                    file.close()
                    out.append((name, size, count))
                    file = None
        if file is not None:
            file.close()
            out.append((name, size, count))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out)], names=["file", "n_bytes", "n_records"])

    return durable(typed.mapInArrow(write, "file string, n_bytes long, n_records long"))


# Reading

class _Window:
    """Bytes of a file from ``start`` on, read in pieces as they are asked for."""

    def __init__(self, file, start: int, size: int):
        self.file, self.base, self.size = file, start, size
        self.data = bytearray()
        file.seek(start)

    def more(self) -> bool:
        got = self.file.read(READ_BYTES)
        self.data += got
        return bool(got)

    def drop(self, to: int) -> None:
        """Forget what lies before ``to``."""
        del self.data[:to - self.base]
        self.base = to


def _inflate(window: _Window, at: int) -> tuple[bytes, int] | None:
    """Content and end of the gzip member at ``at``, or None. The header is checked as soon as it is there."""
    z = zlib.decompressobj(31)
    out, pos, checked = bytearray(), at, False
    while True:
        piece = bytes(window.data[pos - window.base:pos - window.base + READ_BYTES])
        if not piece:
            if not window.more():
                return None
            continue
        try:
            out += z.decompress(piece)
        except zlib.error:
            return None
        pos += len(piece)
        if not checked and len(out) >= 7:
            if not out.startswith(b"WARC/1."):
                return None
            checked = True
        if z.eof:
            return bytes(out), pos - len(z.unused_data)


def records_in(file, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, block) of the records that start in [start, end)."""
    window, at = _Window(file, start, size), start
    while at < end:
        k = window.data.find(MAGIC, at - window.base)
        if k < 0 or window.base + k + len(MAGIC) > window.base + len(window.data):
            keep = max(at, window.base + len(window.data) - len(MAGIC) + 1)
            window.drop(keep)
            at = keep
            if at >= end or not window.more():
                return
            continue
        at = window.base + k
        if at >= end:
            return
        window.drop(at)
        found = _inflate(window, at)
        whole = parse(found[0]) if found else None
        if whole is None:
            at += 1
            continue
        yield at, *whole
        at = found[1]
        window.drop(at)


def read_warc(spark: SparkSession, files: DataFrame, split_bytes: int = SPLIT_BYTES, payload: bool = False) -> DataFrame:
    """Records of archives (file, n_bytes) with the fields of ``FIELDS``, and the payload if asked for.

    Byte counts and digests of responses are computed from the payload that was read;
    a payload that differs from the digest in its header raises. Those of revisits come from the header.
    """
    ranges = files.select("file", "n_bytes", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(split_bytes))).alias("start"))
    ranges = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "start")
    names = [f.split()[0] for f in FIELDS.split(", ")] + ["payload"] * payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, path = open_store(r["file"])
                rows, held = [], 0
                with store.open_input_file(path) as f:
                    for _, fields, block in records_in(f, r["n_bytes"], r["start"], r["start"] + split_bytes):
                        kind, said = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
                        count, digest, refers = len(block), said, None
                        if kind == "revisit":
                            count, refers = int(fields["x-payload-bytes"]), json.loads(fields["x-refers-to"])
                        elif (digest := hashlib.sha256(block).hexdigest()) != said:
                            raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
                        rows.append((json.loads(fields["x-page-id"]), json.loads(fields["warc-target-uri"]), count, digest, kind, refers, *[block] * payload))
                        held += len(block) if payload else 200
                        if held > 8 << 20:
                            yield _batch(rows, names)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, names)

    return ranges.mapInArrow(read, FIELDS + ", payload binary" * payload)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"url": pa.string(), "payload_digest": pa.string(), "record_type": pa.string(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds.get(n, pa.int64())) for n, c in zip(names, zip(*rows))], names=names)
