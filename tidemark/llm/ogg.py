"""Media columns: lossless 8-bit samples in Ogg containers.

``encode`` stores the samples as two logical streams (even and odd samples), cuts each into packets, writes packets as
lacing values into checksummed pages and interleaves the pages by time. ``decode`` verifies the page checksums,
demultiplexes the streams by serial number, reassembles packets from lacing values, including packets that continue on
later pages, and derives timestamps from granule positions (here: samples per stream since the start).

Defined results: a null sample column counts as empty; ``encode`` pads samples to a positive multiple of 64 bytes; a
null or empty media value decodes to no pages and an empty payload with status ``empty``; pages whose checksum or
structure is wrong are skipped up to the next capture pattern and counted in ``bad_pages``, packets that miss a part are
dropped, and the status is ``damaged``. Equal samples give equal media bytes. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE = 8000
PACKET = 4000
_HEAD = struct.Struct("<4sBBqIIIB")
_IDENT = struct.Struct("<8sBBI")
_MAGIC = b"PCM8mono"
_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_FLIP16 = np.array([int(f"{i:016b}"[::-1], 2) for i in range(1 << 16)], dtype=np.uint32)


def page_crc(page: bytes) -> int:
    """The Ogg checksum: CRC-32 with polynomial 0x04c11db7, most significant bit first, start 0, no final xor.

    zlib's CRC reads the least significant bit first, so it runs over bit-reversed bytes and its result is reversed."""
    r = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(_FLIP16[r & 0xFFFF]) << 16 | int(_FLIP16[r >> 16])


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    raw = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return raw[:22] + struct.pack("<I", page_crc(raw)) + raw[26:]


def _stream(samples: bytes, serial: int, channel: int, rate: int, packet: int) -> list[tuple[int, bytes]]:
    """(sort time, page) of one logical stream: its identification page, then its data pages."""
    pages = [(-1, _page(2, 0, serial, 0, bytes([_IDENT.size]), _IDENT.pack(_MAGIC, channel, 2, rate)))]
    lacing, ends = bytearray(), []
    for at in range(0, len(samples), packet):
        size = min(packet, len(samples) - at)
        lacing += b"\xff" * (size // 255) + bytes([size % 255])
        ends.append((len(lacing), at + size))
    offset, k, last = 0, 0, 0
    for number, first in enumerate(range(0, len(lacing), 255), 1):
        part = bytes(lacing[first : first + 255])
        granule = -1
        while k < len(ends) and ends[k][0] <= first + len(part):
            granule = last = ends[k][1]
            k += 1
        size = sum(part)
        continued = first > 0 and lacing[first - 1] == 255
        final = first + 255 >= len(lacing)
        pages.append((last, _page(continued * 1 | final * 4, granule, serial, number, part, samples[offset : offset + size])))
        offset += size
    return pages


def pad(samples: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return samples + bytes(-len(samples) % 64 if samples else 64)


def mux(samples: bytes, rate: int = RATE, packet: int = PACKET) -> bytes:
    """Samples (an even number) as an Ogg file of two interleaved logical streams."""
    serial = zlib.crc32(samples) & 0x7FFFFFFE
    pages = _stream(samples[0::2], serial, 0, rate, packet) + _stream(samples[1::2], serial + 1, 1, rate, packet)
    return b"".join(p for _, p in sorted(pages, key=lambda x: x[0]))


def read_pages(data: bytes) -> tuple[list[tuple], int]:
    """(flags, granule, serial, number, lacing, body) of each sound page, and the number of damaged stretches."""
    pages, bad, at = [], 0, 0
    while at < len(data):
        head = data[at : at + 27]
        if len(head) == 27 and head[:5] == b"OggS\0":
            _, _, flags, granule, serial, number, crc, n = _HEAD.unpack(head)
            lacing = data[at + 27 : at + 27 + n]
            end = at + 27 + n + sum(lacing)
            if len(lacing) == n and end <= len(data) and page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) == crc:
                pages.append((flags, granule, serial, number, lacing, data[at + 27 + n : end]))
                at = end
                continue
        bad += 1
        at = data.find(b"OggS", at + 1)
        if at < 0:
            break
    return pages, bad


def demux(pages: list[tuple]) -> dict[int, list[tuple[bytes, int]]]:
    """Per serial number its packets as (bytes, granule at the packet's end; -1 where its page states none).

    A page states the granule of the last packet that ends on it. A packet that lacks a part is dropped."""
    streams: dict[int, list] = {}
    open_: dict[int, tuple[int, list]] = {}  # serial: next page number, parts of an unfinished packet or None if lost
    for flags, granule, serial, number, lacing, body in pages:
        out = streams.setdefault(serial, [])
        due, parts = open_.get(serial, (0, []))
        if number != due or bool(flags & 1) != bool(parts):
            parts = None if flags & 1 else []
        at, done = 0, 0
        start = 0
        for value in lacing:
            at += value
            if value < 255:
                if parts is not None:
                    parts.append(body[start:at])
                    out.append((b"".join(parts) if len(parts) > 1 else parts[0], -1))
                    done += 1
                start, parts = at, []
        if lacing and lacing[-1] == 255:
            if parts is not None:
                parts.append(body[start:at])
        if done:
            out[-1] = (out[-1][0], granule)
        open_[serial] = (number + 1, parts)
    return streams


def timed(packets: list[tuple[bytes, int]], rate: int) -> list[tuple[int, int]]:
    """(start, end) in microseconds of a stream's data packets, one sample a byte: a packet whose page states its granule
    position ends there; the others' ends follow from the next known one, less the samples between, or from the one before."""
    ends = [g for _, g in packets]
    for i in range(len(ends) - 2, -1, -1):
        if ends[i] < 0 <= ends[i + 1]:
            ends[i] = max(ends[i + 1] - len(packets[i + 1][0]), 0)
    for i in range(len(ends)):
        if ends[i] < 0:
            ends[i] = (ends[i - 1] if i else 0) + len(packets[i][0])
    us = lambda n: n * 1_000_000 // rate if rate else 0
    return [(us(max(e - len(p), 0)), us(e)) for e, (p, _) in zip(ends, packets)]


def packet_rows(data: bytes | None) -> list[dict]:
    """The data packets of a file made by ``mux``, in order of stream and time."""
    out = []
    for serial, got in sorted(demux(read_pages(data)[0]).items()) if data else []:
        if not got or len(got[0][0]) != _IDENT.size or not got[0][0].startswith(_MAGIC):
            continue
        _, channel, _, rate = _IDENT.unpack(got[0][0])
        for k, ((start, end), (body, _)) in enumerate(zip(timed(got[1:], rate), got[1:])):
            out.append({"serial": serial, "channel": channel, "packet": k, "bytes": len(body), "start_us": start, "end_us": end})
    return out


def packet_times(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per data packet of the media column: doc_id, serial, channel, packet (from 0), bytes, start_us, end_us."""
    fields = ["serial", "channel", "packet", "bytes", "start_us", "end_us"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, media in zip(*(c.to_pylist() for c in batch.columns)):
                if rows := [{"doc_id": doc, **r} for r in packet_rows(media)]:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([(c, pa.int64()) for c in ("doc_id", *fields)]))

    own = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media"))
    return own.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", *fields)))


def unmux(data: bytes | None) -> dict:
    """Payload and description of a file made by ``mux``, from its bytes alone."""
    if not data:
        return {"payload": b"", "status": "empty", "pages": 0, "bad_pages": 0, "packets": 0, "streams": 0, "rate": 0, "duration_us": 0}
    pages, bad = read_pages(data)
    channels, packets, rate, end, whole = {}, 0, 0, 0, not bad
    for serial, got in demux(pages).items():
        packets += len(got)
        if not got or len(got[0][0]) != _IDENT.size or not got[0][0].startswith(_MAGIC):
            whole = False
            continue
        _, channel, _, rate = _IDENT.unpack(got[0][0])
        channels[channel] = b"".join(p for p, _ in got[1:])
        end = max([end, *(g for _, g in got)])
        whole &= got[-1][1] in (len(channels[channel]), 0)
    left, right = channels.get(0, b""), channels.get(1, b"")
    whole &= len(left) == len(right) and len(channels) == 2
    n = min(len(left), len(right))
    payload = bytearray(2 * n)
    payload[0::2], payload[1::2] = left[:n], right[:n]
    return {"payload": bytes(payload), "status": "ok" if whole else "damaged", "pages": len(pages), "bad_pages": bad, "packets": packets, "streams": len(channels), "rate": rate, "duration_us": end * 1_000_000 // rate if rate else 0}


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.columns
        raw = [(x or "").encode() for x in texts.to_pylist()]
        yield pa.RecordBatch.from_arrays([ids, pa.array([len(x) for x in raw], pa.int64()), pa.array([mux(pad(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the UTF-8 text) and media: the padded text bytes as an Ogg file of 8-bit samples."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


_DECODED = "payload binary, status string, pages long, bad_pages long, packets long, streams long, rate long, duration_us long, level_mean double, level_rms double, crossings long"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for media in batch.column("media").to_pylist():
            row = unmux(media)
            x = np.frombuffer(row["payload"], np.uint8).astype(np.int64) - 128
            n = max(len(x), 1)
            row |= {"level_mean": round(int(x.sum()) / n, 6), "level_rms": round(float(np.sqrt(int((x * x).sum()) / n)), 6), "crossings": int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))}
            rows.append(row)
        extra = pa.RecordBatch.from_pylist(rows, pa.schema([(c.split()[0], {"binary": pa.binary(), "string": pa.string(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]]) for c in _DECODED.split(", ")]))
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra.columns], [*batch.schema.names, *extra.schema.names])


def decode(df: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """The columns of ``keep`` and ``media`` with the payload read back, its structure and sample features."""
    types = dict(df.dtypes)
    kept = [c for c in keep if c in types]
    return df.select(*kept, "media").mapInArrow(_decode, ", ".join([f"{c} {types[c]}" for c in kept] + ["media binary", _DECODED]))


def feature(prefix: str = "") -> Column:
    """One line of text that describes a decoded row."""
    parts = [("status", "%s"), ("streams", "%d"), ("pages", "%d"), ("packets", "%d"), ("rate", "%d"), ("duration_us", "%d"), ("crossings", "%d"), ("level_mean", "%s"), ("level_rms", "%s")]
    return F.format_string(";".join(f"{n}={f}" for n, f in parts), *[F.col(prefix + n) for n, _ in parts])


def digests(df: DataFrame) -> DataFrame:
    """The digest columns of encoded and decoded documents."""
    return df.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature().alias("feature"),
    )


def brute(text: str | None) -> tuple:
    """What ``digests`` states for one text, without the container (for tests)."""
    payload = pad((text or "").encode())
    return len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])
