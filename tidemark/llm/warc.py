"""WARC archives: writing, and reading with segment reassembly.

``write`` makes one record per page. The HTTP response is framed in chunks; a record whose block exceeds ``SEGMENT``
bytes is cut into a first record and continuation records, which name the first by WARC-Segment-Origin-ID and state
their number; the last states the total length. Of pages with equal payloads (of at least ``least`` bytes) that with the
smallest page_id is a response, the others are revisits that refer to it. Files are written by Spark's text writer, whose
line separator is the end of a WARC record, gzipped, so any Hadoop file system will do.

``read`` parses the files, groups the segments of split records by origin (whole records need no shuffle), orders them
by number, verifies count, order and total length, decodes the chunked framing and checks the block's digest.

Defined results: a null payload counts as empty; records that lack a segment, state another length or digest, or are
framed wrongly, and bytes that hold no record, get status ``damaged`` and no payload, and reading goes on at the next
record; rows that repeat a page are written once each, and all are
responses if the page is the smallest of its payload; an empty table gives none. Cuts fall between characters, so
records stay UTF-8. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import new_folder

SEGMENT, CHUNK = 48 << 10, 4096
#: Records of a file, so that a file is at most about RECORDS x SEGMENT bytes before compression.
RECORDS = 400
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
#: How a gzip member begins.
GZIP = b"\x1f\x8b\x08"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def cuts(data: bytes, size: int) -> list[bytes]:
    """Parts of at most ``size`` bytes that end between characters."""
    out, at = [], 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80 and end > at + 1:
            end -= 1
        out.append(data[at:end])
        at = end
    return out or [b""]


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in cuts(payload, size) if c) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if it is framed wrongly or goes on after its end."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk")
        if not size:
            if at + 2 != len(body):
                raise ValueError("trailer")
            return b"".join(out)
        out.append(body[at : at + size])
        at += size + 2


def _headers(pairs: list[tuple[str, object]]) -> str:
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in pairs) + "\r\n"


def records(page: int, row: int, url: str | None, payload: bytes, refers: int | None, segment: int = SEGMENT) -> list[str]:
    """The records of a page, without their end: a revisit, or a response in as many segments as it takes."""
    uri = "".join(c if c > " " else "%20" for c in url or "about:blank")
    own = f"<urn:page:{page}:{row}>"
    common = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", "sha1:" + digest(payload))]
    if refers is not None:
        head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        more = [("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers}>")]
        return [_headers([*more, *common, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(head))]) + head]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = cuts(block, segment)
    out = []
    for i, part in enumerate(parts, 1):
        if i == 1:
            head = [("WARC-Type", "response"), *common, ("WARC-Block-Digest", "sha1:" + digest(block)), ("Content-Type", "application/http; msgtype=response")]
        else:
            head = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{i}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", own)]
        if len(parts) > 1:
            head.append(("WARC-Segment-Number", i))
        if len(parts) > 1 and i == len(parts):
            head.append(("WARC-Segment-Total-Length", len(block)))
        out.append(_headers([*head, ("Content-Length", len(part))]) + part.decode("utf-8"))
    return out


def write(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, segment: int = SEGMENT) -> None:
    """Archives of ``df`` in the folder ``path``."""
    own = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    key = F.unhex(F.sha2("html", 256))
    first = own.select(key.alias("k"), "page_id").groupBy("k").agg(F.min("page_id").alias("first"))
    known = own.withColumn("k", key).join(first, "k").select("page_id", F.monotonically_increasing_id().alias("row"), "url", "html", F.when((F.col("first") < F.col("page_id")) & (F.octet_length("html") >= least), F.col("first")).alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, row, url, html, refers in zip(*[c.to_pylist() for c in batch.columns]):
                out += records(page, row, url, html.encode(), refers, segment)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    known.mapInArrow(run, "value string").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


def inflated(data: bytes) -> tuple[bytes, bool]:
    """The content of a file, gzipped (in any number of members) or not, and whether all of it could be read. After a
    damaged member it goes on at the next."""
    if data[:2] != GZIP[:2]:
        return data, True
    out, at, sound = [], 0, True
    while 0 <= at < len(data):
        one = zlib.decompressobj(31)
        try:
            out.append(one.decompress(data[at:]))
            if not one.eof:
                return b"".join(out), False
            rest = one.unused_data.lstrip(b"\0")
            if rest and not rest.startswith(GZIP):
                sound, rest = False, rest[rest.find(GZIP) :] if GZIP in rest else b""
            at = len(data) - len(rest)
        except zlib.error:
            sound, at = False, data.find(GZIP, at + 1)
    return b"".join(out), sound


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers in lower case, block) of each record of a file; the block is None where the record is damaged: without a
    sound length, cut short, or not followed by a record's end. Reading then goes on at the next ``WARC/``; bytes in which
    there is no record at all are one damaged record without headers."""
    whole, sound = inflated(data)
    at, end = 0, END.encode()
    while at < len(whole):
        stop = whole.find(end, at)
        if not whole.startswith(b"WARC/", at) or stop < 0:
            yield {}, None
            at = _next(whole, at + 1)
            continue
        lines = whole[at:stop].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        stated, first = head.get("content-length", ""), stop + 4
        last = first + int(stated) if stated.isascii() and stated.isdigit() else -1
        if last < 0 or last > len(whole) or whole[last : last + 4] not in (end, b""):
            yield head, None
            at = _next(whole, first)
            continue
        yield head, whole[first:last]
        at = last + 4
    if not sound:
        yield {}, None


def _next(whole: bytes, at: int) -> int:
    """Where the next record may begin: at the file's end if nowhere."""
    found = whole.find(b"WARC/", at)
    while found > 0 and whole[found - 1 : found] != b"\n":
        found = whole.find(b"WARC/", found + 1)
    return len(whole) if found < 0 else found


def payload_of(block: bytes) -> bytes:
    head, mark, body = block.partition(END.encode())
    if not mark:
        raise ValueError("no HTTP header")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def assemble(parts: list[tuple[int, int | None, bytes]], block_digest: str | None) -> bytes:
    """The payload of a record in segments (number, total length, block); ValueError if anything is amiss."""
    parts = sorted(parts, key=lambda p: p[0])
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)):
        raise ValueError("segments")
    block = b"".join(p[2] for p in parts)
    if len(parts) > 1 and parts[-1][1] != len(block):
        raise ValueError("total length")
    if block_digest and block_digest != "sha1:" + digest(block):
        raise ValueError("digest")
    return payload_of(block)


_READ = "record_id string, page_id long, record_type string, refers_to long, stated string, segment int, total long, block_digest string, block binary, payload binary, status string"
_ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for c in _READ.split(", ")])


def _page(uri: str) -> int | None:
    parts = uri.strip("<>").split(":")
    return int(parts[2]) if len(parts) > 2 and parts[2].lstrip("-").isdigit() else None


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: record_id, page_id, record_type, refers_to, stated (payload digest), payload, status."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = []
                for head, block in parse(data):
                    kind, own = head.get("warc-type"), head.get("warc-record-id", "")
                    row = {"record_id": head.get("warc-segment-origin-id", own), "page_id": _page(own), "record_type": kind, "stated": head.get("warc-payload-digest", "").removeprefix("sha1:") or None, "block_digest": head.get("warc-block-digest")}
                    number, total = head.get("warc-segment-number"), head.get("warc-segment-total-length")
                    if block is None or not all(x is None or x.isascii() and x.isdigit() and len(x) < 10 for x in (number, total)):
                        row["status"] = "damaged"
                    elif kind == "revisit":
                        row |= {"refers_to": _page(head.get("warc-refers-to", "")), "status": "ok"}
                    elif number is not None:
                        row |= {"segment": int(number), "total": int(total) if total else None, "block": block}
                    else:
                        try:
                            row |= {"payload": assemble([(1, None, block)], row["block_digest"]), "status": "ok"}
                        except ValueError:
                            row["status"] = "damaged"
                    rows.append(row)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    def join(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        first = next((r for r in rows if r["segment"] == 1), rows[0])
        out = {k: first[k] for k in ("record_id", "page_id", "stated")} | {"record_type": "response", "refers_to": None, "payload": None, "status": "damaged"}
        try:
            out |= {"payload": assemble([(r["segment"], r["total"], r["block"]) for r in rows], first["block_digest"]), "status": "ok"}
        except ValueError:
            pass
        return pa.Table.from_pylist([out], pa.schema([_ARROW.field(c) for c in names]))

    names = ["record_id", "page_id", "record_type", "refers_to", "stated", "payload", "status"]
    schema = "record_id string, page_id long, record_type string, refers_to long, stated string, payload binary, status string"
    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = files.mapInArrow(run, _READ)
    whole = parsed.where("segment IS NULL").select(*names)
    split = parsed.where("segment IS NOT NULL").groupBy("record_id").applyInArrow(join, schema)
    return whole.union(split)


def digests(found: DataFrame) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit's payload is its target's."""
    from tidemark.llm.warc import digest as make

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = batch.column("payload").to_pylist()
            sums = [make(p) if p is not None else s for p, s in zip(payloads, batch.column("stated").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("record_type"), batch.column("refers_to"), pa.array([None if p is None else len(p) for p in payloads], pa.int64()), pa.array(sums, pa.string()), batch.column("status")], ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "status"])

    rows = found.mapInArrow(run, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, status string")
    rows = rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "status")
    return rows


def archive(df: DataFrame, **options) -> DataFrame:
    """Write the pages into a new folder of the shared one, and read the archives back."""
    spark = df.sparkSession
    path = new_folder(spark, "warc")
    write(df, path, **options)
    return read(spark, path)


def resolved(rows: DataFrame) -> DataFrame:
    """``digests`` with each revisit's payload_bytes taken from the response it refers to, if their digests agree."""
    full = rows.where("record_type = 'response'")
    target = full.groupBy(F.col("page_id").alias("refers_to")).agg(F.max("payload_bytes").alias("b"), F.max("payload_digest").alias("d"))
    again = rows.where("record_type = 'revisit'").join(target, "refers_to", "left")
    again = again.select("page_id", F.when(F.col("d") == F.col("payload_digest"), F.col("b")).alias("payload_bytes"), "payload_digest", "record_type", "refers_to", F.when(F.col("d") == F.col("payload_digest"), "ok").otherwise("damaged").alias("status"))
    return full.union(again)
