"""Media columns as MPEG transport streams (ISO/IEC 13818-1).

A payload is cut into access units; each becomes one elementary packet (private stream 1) with a presentation
time stamp, dealt over 188-byte transport packets. Every RAP_EVERY units a random-access point starts: program
association and program map tables, then a packet with the random-access flag and a clock reference. The media
table keeps the stream with its time stamps and packet numbers of random-access points, so that a reader can seek.
Reading parses the program tables to find the elementary stream, checks continuity counters and table checksums,
reassembles the elementary packets and their time stamps, and fails loudly on a damaged stream.

Defined cases: null text is empty; every payload has at least one block of BLOCK bytes; equal texts give equal streams;
repeated rows are kept; a null doc_id is kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, read, tidy

BLOCK = 192
UNIT_BYTES = 4096
RAP_EVERY = 8
TICKS = 3600
PMT_PID, MEDIA_PID, PROGRAM, STREAM_TYPE = 0x1000, 0x0100, 1, 0x06
_SYNC, _PACKET = 0x47, 188
_SCHEMA = "doc_id long, n_bytes long, media binary, points array<struct<pts:long,packet:long>>"


def _crc(data: bytes) -> int:
    value = 0xFFFFFFFF
    for byte in data:
        value ^= byte << 24
        for _ in range(8):
            value = (value << 1 ^ 0x04C11DB7 if value & 0x80000000 else value << 1) & 0xFFFFFFFF
    return value


def _section(table: int, key: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | len(body) + 9, key, 0xC1, 0, 0) + body
    return b"\0" + head + struct.pack(">I", _crc(head))


_TABLES = [
    (0, _section(0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID)).ljust(184, b"\xff")),
    (PMT_PID, _section(0x02, PROGRAM, struct.pack(">HHBHH", 0xE000 | MEDIA_PID, 0xF000, STREAM_TYPE, 0xE000 | MEDIA_PID, 0xF000)).ljust(184, b"\xff")),
]


def _stamp(pts: int) -> bytes:
    return bytes((0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE))


def mux(payload: bytes) -> tuple[bytes, list[tuple[int, int]]]:
    """The transport stream of a payload, and (pts, packet number) of its random-access points."""
    out, points, counters = [], [], {0: 0, PMT_PID: 0, MEDIA_PID: 0}

    def send(pid: int, start: bool, adaptation: bytes | None, data: bytes) -> None:
        cc = counters[pid]
        counters[pid] = cc + 1 & 15
        out.append(struct.pack(">BHB", _SYNC, (0x4000 if start else 0) | pid, (0x30 if adaptation is not None else 0x10) | cc) + (adaptation or b"") + data)

    for number, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        unit, pts = payload[at : at + UNIT_BYTES], number * TICKS
        rap = number % RAP_EVERY == 0
        field = b""
        if rap:
            for pid, table in _TABLES:
                send(pid, True, None, table)
            points.append((pts, len(out)))
            field = b"\x50" + struct.pack(">IH", pts >> 1, (pts & 1) << 15 | 0x7E00)
        data = b"\0\0\1\xbd" + struct.pack(">H", len(unit) + 8) + b"\x80\x80\x05" + _stamp(pts) + unit
        taken, start = 0, True
        while start or taken < len(data):
            room = 184 - (1 + len(field) if field else 0)
            part = data[taken : taken + room]
            adaptation = bytes((len(field),)) + field if field else None
            if len(part) < room:
                spare = room - len(part)
                if field:
                    adaptation = bytes((len(field) + spare,)) + field + b"\xff" * spare
                else:
                    adaptation = b"\0" if spare == 1 else bytes((spare - 1, 0)) + b"\xff" * (spare - 2)
            send(MEDIA_PID, start, adaptation, part)
            taken += len(part)
            start, field = False, b""
    return b"".join(out), points


def _table(data: bytes) -> bytes:
    """The body of the section that starts in a packet's data."""
    at = 1 + data[0]
    size = (data[at + 1] & 0x0F) << 8 | data[at + 2]
    whole = data[at : at + 3 + size]
    if len(whole) != 3 + size or _crc_cached(whole[:-4]) != int.from_bytes(whole[-4:], "big"):
        raise ValueError("a program table is damaged")
    return whole[8:-4]


_CRCS: dict[bytes, int] = {}


def _crc_cached(data: bytes) -> int:
    if data not in _CRCS:
        if len(_CRCS) > 1000:
            _CRCS.clear()
        _CRCS[data] = _crc(data)
    return _CRCS[data]


def demux(stream: bytes) -> tuple[bytes, dict]:
    """The payload of a stream and what its parsing found: packets, elementary packets, time stamps, random-access points."""
    if len(stream) % _PACKET:
        raise ValueError("not a whole number of packets")
    maps, media = set(), set()
    counters: dict[int, int] = {}
    units, stamps, points, parts = [], [], [], []

    def close() -> None:
        if not parts:
            return
        packet = b"".join(parts)
        parts.clear()
        if packet[:3] != b"\0\0\1" or not packet[7] & 0x80:
            raise ValueError("an elementary packet has no start or no time stamp")
        size = int.from_bytes(packet[4:6], "big")
        if size and len(packet) != size + 6:
            raise ValueError("an elementary packet is incomplete")
        p = packet[9:14]
        stamps.append((p[0] & 0x0E) << 29 | p[1] << 22 | (p[2] & 0xFE) << 14 | p[3] << 7 | p[4] >> 1)
        units.append(packet[9 + packet[8] :])

    for number in range(len(stream) // _PACKET):
        packet = stream[number * _PACKET : (number + 1) * _PACKET]
        if packet[0] != _SYNC:
            raise ValueError("lost synchronisation")
        pid, start, control = (packet[1] & 0x1F) << 8 | packet[2], packet[1] & 0x40, packet[3] >> 4 & 3
        at, flagged = 4, False
        if control & 2:
            flagged = packet[4] > 0 and bool(packet[5] & 0x40)
            at += 1 + packet[4]
        if control & 1:
            if pid in counters and packet[3] & 15 != counters[pid] + 1 & 15:
                raise ValueError(f"continuity broken at packet {number}")
            counters[pid] = packet[3] & 15
        data = packet[at:]
        if pid == 0:
            body = _table(data)
            maps |= {int.from_bytes(body[k + 2 : k + 4], "big") & 0x1FFF for k in range(0, len(body), 4) if int.from_bytes(body[k : k + 2], "big")}
        elif pid in maps:
            body = _table(data)
            k = 4 + (int.from_bytes(body[2:4], "big") & 0x0FFF)
            while k < len(body):
                if body[k] == STREAM_TYPE:
                    media.add(int.from_bytes(body[k + 1 : k + 3], "big") & 0x1FFF)
                k += 5 + (int.from_bytes(body[k + 3 : k + 5], "big") & 0x0FFF)
        elif pid in media:
            if start:
                close()
                if flagged:
                    points.append(number)
            parts.append(data)
    close()
    return b"".join(units), {"packets": len(stream) // _PACKET, "stamps": stamps, "points": points}


def payload_of(text: bytes) -> bytes:
    """The text with spaces up to a positive multiple of BLOCK bytes."""
    return text.ljust(max(1, -(-len(text) // BLOCK)) * BLOCK, b" ")


def _muxer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("pts", pa.int64()), ("packet", pa.int64())]))
    for batch in batches:
        sizes, streams, points, size, start = [], [], [], 0, 0
        texts = batch.column(1).cast(pa.binary())
        for i in range(len(batch)):
            text = texts[i].as_py() or b""
            stream, found = mux(payload_of(text))
            sizes.append(len(text))
            streams.append(stream)
            points.append([{"pts": p, "packet": k} for p, k in found])
            size += len(stream)
            if size > 8_000_000 or i == len(batch) - 1:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, i + 1 - start), pa.array(sizes, pa.int64()), pa.array(streams, pa.binary()), pa.array(points, kind)], names=["doc_id", "n_bytes", "media", "points"])
                sizes, streams, points, size, start = [], [], [], 0, i + 1


def media_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, points): the stream of every row with the time stamps and packets of its random-access points."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(_muxer), _SCHEMA)


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for n, media, points in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
            stream = media.as_py()
            try:
                payload, found = demux(stream)
                if [p["packet"] for p in points] != found["points"]:
                    raise ValueError("the random-access points differ from the stream")
            except (ValueError, IndexError) as error:
                rows.append((None, None, None, len(stream), hashlib.sha256(stream).hexdigest(), f"damaged: {error}"))
                continue
            stamps = found["stamps"]
            feature = f"packets={found['packets']};units={len(stamps)};points={len(points)};pts={stamps[0]}-{stamps[-1]};distinct_bytes={len(set(payload))};spaces={payload.count(32)}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stream), hashlib.sha256(stream).hexdigest(), feature))
        cols = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())))], names=[c.split()[0] for c in _FEATURES.split(", ")])


def features(media: DataFrame) -> DataFrame:
    """What reading every stream back gives: sizes, digests and a feature string; a damaged stream has null payload values and says so in its feature."""
    return media.select("doc_id", "n_bytes", "media", "points").mapInArrow(tidy(_reader), _FEATURES)


def op7_transport_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(durable(media_table(read(spark, sf_dir, "documents"))))
