"""MPEG transport streams as a media column."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the format (ISO/IEC 13818-1): packet size, sync byte, PID of the program association table,
# stream type and stream id of private data, clock of timestamps.
PACKET, SYNC, PAT_PID, NULL_PID, PRIVATE_TYPE, PRIVATE_ID, CLOCK = 188, 0x47, 0, 0x1FFF, 0x06, 0xBD, 90_000
ROOM = PACKET - 4
#: The user-private descriptor in which our program maps name the number of bytes that the stream carries.
LENGTH_TAG = 0xF0
#: Where our streams put the program map and the data; samples a second; samples of an access unit; units between random-access points.
PMT_PID, DATA_PID, RATE, UNIT, RANDOM_ACCESS = 0x1000, 0x100, 8000, 2048, 16
#: Rows of an output batch.
BATCH = 200


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)
        table.append(crc & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """The checksum of table sections: polynomial 04C11DB7, not reflected."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ _CRC[(crc >> 24) ^ byte]
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    data = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0]) + body
    return data + section_crc(data).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section).ljust(PACKET, b"\xff")


_PAT = _table_packet(PAT_PID, _section(0, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF])))


def tables(n_bytes: int) -> bytes:
    """The program tables of a stream that carries ``n_bytes``, which a private descriptor of the program map names."""
    named = bytes([LENGTH_TAG, 8]) + n_bytes.to_bytes(8, "big")
    body = bytes([0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, len(named)]) + named + bytes([PRIVATE_TYPE, 0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0])
    return _PAT + _table_packet(PMT_PID, _section(2, 1, body))


#: Packet headers by (unit starts, has an adaptation field, counter).
_HEADERS = [[[bytes([SYNC, start << 6 | DATA_PID >> 8, DATA_PID & 0xFF, (0x30 if field else 0x10) | c]) for c in range(16)] for field in (0, 1)] for start in (0, 1)]


def mux(payload: bytes) -> bytes:
    """A transport stream of one program that carries ``payload`` as 8-bit samples in access units with timestamps."""
    out, counter = [tables(len(payload))], 0
    for unit, at in enumerate(range(0, len(payload), UNIT)):
        data = payload[at : at + UNIT]
        pts = (at * CLOCK // RATE) & 0x1FFFFFFFF
        stamp = bytes([0x21 | (pts >> 30) << 1, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])
        pes = b"\0\0\1" + bytes([PRIVATE_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp + data
        field = b""
        if unit % RANDOM_ACCESS == 0:
            field = b"\x50" + bytes([pts >> 25 & 0xFF, pts >> 17 & 0xFF, pts >> 9 & 0xFF, pts >> 1 & 0xFF, pts << 7 & 0x80 | 0x7E, 0])
        pos, start = 0, 1
        while pos < len(pes):
            room = ROOM - (len(field) + 1 if field else 0)
            part = pes[pos : pos + room]
            if len(part) < room or field:
                length = ROOM - 1 - len(part)
                stuffed = (field or b"\0"[:length]).ljust(length, b"\xff")
                out.append(_HEADERS[start][1][counter] + bytes([length]) + stuffed + part)
            else:
                out.append(_HEADERS[start][0][counter] + part)
            pos, start, field, counter = pos + len(part), 0, b"", counter + 1 & 15
    return b"".join(out)


class StreamError(ValueError):
    """A transport stream that breaks the format."""


def _sections(packets: np.ndarray, begin: np.ndarray) -> Iterator[bytes]:
    """The sound sections in packets of one PID, which may lie across packets."""
    held, counter = b"", None
    for packet, at in zip(packets, begin, strict=True):
        data, now = packet[at:].tobytes(), int(packet[3]) & 15
        if counter is not None and now == counter:
            continue  # sent twice
        if counter is not None and now != (counter + 1 & 15):
            held = b""  # what was lost ends the section
        counter = now
        if packet[1] & 0x40:
            pointer = data[0]
            ready, held = [held + data[1 : 1 + pointer]] * bool(held), data[1 + pointer :]
        else:
            ready, held = [], held + data if held else b""
        while len(held) >= 3 and held[0] != 0xFF and len(held) >= 3 + ((held[1] & 0x0F) << 8 | held[2]):
            end = 3 + ((held[1] & 0x0F) << 8 | held[2])
            ready, held = [*ready, held[:end]], held[end:]
        if held[:1] == b"\xff":
            held = b""
        yield from (x for x in ready if len(x) >= 12 and section_crc(x[: 3 + ((x[1] & 0x0F) << 8 | x[2])]) == 0)


def _read_section(packets: np.ndarray, begin: np.ndarray, table: int) -> bytes:
    """The body of the first section of ``table``."""
    for data in _sections(packets, begin):
        if data[0] == table:
            return data[8 : 3 + ((data[1] & 0x0F) << 8 | data[2]) - 4]
    raise StreamError(f"no sound section of table {table}")


def _without_pcr(packet: np.ndarray) -> np.ndarray:
    """A packet's bytes without its clock reference, which may differ where a packet is sent twice."""
    packet = packet.copy()
    if packet[3] & 0x20 and packet[4] >= 7 and packet[5] & 0x10:
        packet[6:12] = 0
    return packet


def _continuity(p: np.ndarray) -> tuple[np.ndarray, int]:
    """Which packets of a PID are sent for the second time, and the number of places at which packets are missing.

    A packet counts as sent again if its counter stands still and it agrees
    with the one before in every byte but the clock reference, once. A counter
    may jump where the discontinuity indicator says so.
    """
    jumps = (p[1:, 3].astype(np.int16) - p[:-1, 3]) & 15
    told = (p[:, 3] & 0x20 > 0) & (p[:, 4] > 0) & (p[:, 5] & 0x80 > 0)
    again = np.zeros(len(p), dtype=bool)
    breaks = 0
    for i in (jumps != 1).nonzero()[0].tolist():
        if jumps[i] == 0 and not again[i] and (_without_pcr(p[i]) == _without_pcr(p[i + 1])).all():
            again[i + 1] = True
        elif not told[i + 1]:
            breaks += 1
    return again, breaks


def demux(stream: bytes, *, rate: int | None = RATE) -> dict:
    """Read a transport stream: its first program's first elementary stream.

    Returns payload, pts (of each unit), random_access (numbers of the packets
    at which decoding can start, with their pts), packets, units and breaks: the
    places where the continuity counter jumps; without any, units that are
    shorter than they say, packets before the first unit, and steps of the
    timestamps that a unit's samples at ``rate`` don't account for (None: any
    step will do); without any, a payload that isn't as long as the program
    map says. So a stream from which packets were lost, however many, has
    breaks; it is still read, as far as its units go.
    """
    if len(stream) % PACKET:
        raise StreamError("not whole packets")
    a = np.frombuffer(stream, dtype=np.uint8).reshape(-1, PACKET)
    if not len(a) or (a[:, 0] != SYNC).any():
        raise StreamError("sync byte missing")
    pid = (a[:, 1].astype(np.int32) & 0x1F) << 8 | a[:, 2]
    control = a[:, 3] >> 4 & 3
    begin = np.where(control & 2, 5 + a[:, 4].astype(np.int32), 4)
    if (begin > PACKET).any():
        raise StreamError("adaptation field longer than its packet")
    carried = lambda p: ((pid == p) & (control & 1 == 1)).nonzero()[0]

    at = carried(PAT_PID)
    body = _read_section(a[at], begin[at], 0)
    programs = [((body[i + 2] & 0x1F) << 8 | body[i + 3]) for i in range(0, len(body) - 3, 4) if body[i] << 8 | body[i + 1]]
    if not programs:
        raise StreamError("no program")
    at = carried(programs[0])
    body = _read_section(a[at], begin[at], 2)
    at = 4 + ((body[2] & 0x0F) << 8 | body[3])
    named, described = body[4:at], None
    while len(named) >= 2:
        if named[0] == LENGTH_TAG and named[1] == 8:
            described = int.from_bytes(named[2:10], "big")
        named = named[2 + named[1] :]
    if len(body) < at + 5:
        raise StreamError("no elementary stream")
    data_pid = (body[at + 1] & 0x1F) << 8 | body[at + 2]

    mine = carried(data_pid)
    again, jumps = _continuity(a[mine])
    breaks = 0
    mine = mine[~again]
    p, starts = a[mine], begin[mine]
    data = p[np.arange(PACKET)[None, :] >= starts[:, None]].tobytes()
    ends = np.cumsum(PACKET - starts)
    first = (p[:, 1] & 0x40 > 0).nonzero()[0]
    breaks += int(len(p) > 0 and (not len(first) or first[0] > 0))
    has_flags = (p[:, 3] & 0x20 > 0) & (p[:, 4] > 0)
    random_access = has_flags & (p[:, 5] & 0x40 > 0)
    units, stamps, points = [], [], []
    edges = [*(ends[first] - (PACKET - starts[first])).tolist(), len(data)]
    for k, at in enumerate(edges[:-1]):
        if data[at : at + 3] != b"\0\0\1":
            raise StreamError("unit without start code")
        if edges[k + 1] - at < 9 or data[at + 7] & 0x80 and edges[k + 1] - at < 14:
            breaks += 1
            continue
        length, header = int.from_bytes(data[at + 4 : at + 6], "big"), data[at + 8]
        t = data[at + 9 : at + 14]
        pts = (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1 if data[at + 7] & 0x80 else None
        breaks += at + 6 + length > edges[k + 1]
        if rate and units and pts is not None and stamps[-1] is not None:
            # stamps are cut to whole ticks, so a step may be one off
            breaks += (pts - stamps[-1] - len(units[-1]) * CLOCK // rate) & 0x1FFFFFFFF not in (0, 1, 0x1FFFFFFFF)
        units.append(data[at + 9 + header : min(at + 6 + length, edges[k + 1]) if length else edges[k + 1]])
        stamps.append(pts)
        if random_access[first[k]]:
            points.append((int(mine[first[k]]), pts))
    payload = b"".join(units)
    breaks = jumps or breaks or int(described is not None and described != len(payload))
    return {"payload": payload, "pts": stamps, "random_access": points, "packets": len(a), "units": len(units), "breaks": breaks}


def padded(data: bytes, block: int = 64) -> bytes:
    """``data`` and zero bytes up to a positive multiple of ``block``."""
    return data + bytes(-len(data) % block or (0 if data else block))


def _muxed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(at, BATCH) for b in batches for at in range(0, b.num_rows, BATCH)):
        texts = [(text or "").encode() for text in batch.column("text").to_pylist()]
        media = pa.array([mux(padded(text)) for text in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), media], ["doc_id", "n_bytes", "media"])


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 bytes, padded to 64, as a transport stream. Null texts are empty."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_muxed, f"doc_id {id_type}, n_bytes long, media binary")


def _feature(found: dict) -> str:
    counts, n = np.bincount(np.frombuffer(found["payload"], dtype=np.uint8), minlength=256), max(1, len(found["payload"]))
    p = counts[counts > 0] / n
    entropy = float(-(p * np.log2(p)).sum())
    mean = float(counts @ np.arange(256)) / n
    stamps = [t for t in found["pts"] if t is not None] or [0]
    seconds = ((stamps[-1] - stamps[0]) & 0x1FFFFFFFF) / CLOCK
    parts = {"packets": found["packets"], "units": found["units"], "breaks": found["breaks"], "random_access": len(found["random_access"]), "seconds": f"{seconds:.3f}", "mean": f"{mean:.3f}", "entropy": f"{entropy:.4f}"}
    return ";".join(f"{k}={v}" for k, v in parts.items())


def _demuxed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    point = pa.struct([("packet", pa.int32()), ("pts", pa.int64())])
    for batch in (b.slice(at, BATCH) for b in batches for at in range(0, b.num_rows, BATCH)):
        out: list[list] = [[] for _ in range(8)]
        for media in batch.column("media").to_pylist():
            found = demux(media)
            payload = found["payload"]
            row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), _feature(found), found["pts"], [{"packet": n, "pts": t} for n, t in found["random_access"]])
            for c, value in zip(out, row, strict=True):
                c.append(value)
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(point)]
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pts", "random_access"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *map(pa.array, out, types)], ["doc_id", "n_bytes", *names])


def from_media(media: DataFrame) -> DataFrame:
    """What the streams of a media column hold, read from their bytes alone.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, pts and random_access (packet and pts
    of the points at which decoding can start). feature counts breaks, so a
    stream that lost packets tells of it. A null or broken media cell fails.
    """
    id_type = media.schema["doc_id"].dataType.simpleString()
    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<struct<packet:int,pts:long>>"
    return media.mapInArrow(_demuxed, f"doc_id {id_type}, {schema}")


assert math.gcd(UNIT, 64) == 64
