"""MPEG transport streams: pack bytes into 188-byte packets, and read program tables, continuity and access units back.

Per-text helpers are vectorised over the packets of one stream; Spark deals the texts out and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of ISO/IEC 13818-1: packet length, sync byte, table ids, CRC polynomial.
PACKET, SYNC, PAT_TABLE, PMT_TABLE, CRC_POLY = 188, 0x47, 0x00, 0x02, 0x04C11DB7
#: Private data in PES packets (stream type 0x06, stream id 0xBD).
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
PMT_PID, ES_PID, PROGRAM = 0x100, 0x101, 1
#: Payload is padded to a multiple of UNIT; an access unit takes up to UNITS of them.
UNIT, UNITS = 192, 16
#: Ticks of the 90 kHz clock between access units; every RAP_EVERY-th unit is a random-access point.
TICKS, RAP_EVERY = 3600, 8


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint64) << 24
    for _ in range(8):
        table = np.where(table & 0x80000000, (table << 1) ^ CRC_POLY, table << 1) & 0xFFFFFFFF
    return table


_TABLE = [int(x) for x in _crc_table()]


def section_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ _TABLE[(crc >> 24) ^ byte]
    return crc


def _section(pid: int, body: bytes) -> np.ndarray:
    """A packet that holds one whole table section."""
    whole = body + section_crc(body).to_bytes(4, "big")
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return np.frombuffer((head + whole).ljust(PACKET, b"\xff"), dtype=np.uint8)


def _tables() -> np.ndarray:
    pat = bytes([PAT_TABLE, 0xB0, 13, 0, 1, 0xC1, 0, 0, PROGRAM >> 8, PROGRAM & 0xFF, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF])
    pmt = bytes([PMT_TABLE, 0xB0, 18, PROGRAM >> 8, PROGRAM & 0xFF, 0xC1, 0, 0, 0xE0 | ES_PID >> 8, ES_PID & 0xFF, 0xF0, 0, STREAM_TYPE, 0xE0 | ES_PID >> 8, ES_PID & 0xFF, 0xF0, 0])
    return np.concatenate([_section(0, pat), _section(PMT_PID, pmt)])


_HEAD = _tables()


def _units(data: np.ndarray, first: int) -> np.ndarray:
    """Packets (units, packets a unit, 188) of access units of one size; first: the number of the first unit."""
    n, size = data.shape
    index = np.arange(first, first + n, dtype=np.int64)
    pts = index * TICKS
    pes = np.empty((n, 14 + size), dtype=np.uint8)
    length = size + 8
    pes[:, :9] = [0, 0, 1, STREAM_ID, length >> 8, length & 0xFF, 0x84, 0x80, 5]
    pes[:, 9] = 0x21 | (pts >> 30 & 7) << 1
    pes[:, 10] = pts >> 22 & 0xFF
    pes[:, 11] = 1 | (pts >> 15 & 0x7F) << 1
    pes[:, 12] = pts >> 7 & 0xFF
    pes[:, 13] = 1 | (pts & 0x7F) << 1
    pes[:, 14:] = data
    # the first packet has an adaptation field of 8 bytes: flags and clock reference; the last is stuffed
    room0, room = PACKET - 4 - 8, PACKET - 4
    rest = pes.shape[1] - room0
    count = 1 + max(0, -(-rest // room))
    out = np.full((n, count, PACKET), 0xFF, dtype=np.uint8)
    out[:, :, 0] = SYNC
    out[:, :, 1] = ES_PID >> 8
    out[:, :, 2] = ES_PID & 0xFF
    counter = (index[:, None] * 0).astype(np.uint8) + np.arange(count, dtype=np.uint8)
    out[:, :, 3] = 0x10 | counter & 15  # continuity is set by mux() for the whole stream
    out[:, 0, 1] |= 0x40
    out[:, 0, 3] |= 0x20
    out[:, 0, 4] = 7
    out[:, 0, 5] = np.where(index % RAP_EVERY == 0, 0x50, 0x10)
    base = pts
    out[:, 0, 6] = base >> 25 & 0xFF
    out[:, 0, 7] = base >> 17 & 0xFF
    out[:, 0, 8] = base >> 9 & 0xFF
    out[:, 0, 9] = base >> 1 & 0xFF
    out[:, 0, 10] = 0x7E | (base & 1) << 7
    out[:, 0, 11] = 0
    if rest <= 0:  # all in the first packet: lengthen its adaptation field
        out[:, 0, 4] = 7 - rest
        out[:, 0, PACKET - pes.shape[1] :] = pes
        return out
    out[:, 0, 12:] = pes[:, :room0]
    full, last = divmod(rest, room)
    if full:
        out[:, 1 : 1 + full, 4:] = pes[:, room0 : room0 + full * room].reshape(n, full, room)
    if last:
        out[:, -1, 3] |= 0x20
        out[:, -1, 4] = room - last - 1
        if room - last > 1:
            out[:, -1, 5] = 0
        out[:, -1, PACKET - last :] = pes[:, room0 + full * room :]
    return out


def mux(payload: bytes) -> bytes:
    """A transport stream with a PAT, a PMT and one elementary stream that holds payload (a multiple of UNIT bytes)."""
    data = np.frombuffer(payload, dtype=np.uint8)
    size = UNIT * UNITS
    whole = len(data) // size
    parts = []
    if whole:
        parts.append(_units(data[: whole * size].reshape(whole, size), 0).reshape(-1, PACKET))
    if len(data) > whole * size:
        parts.append(_units(data[whole * size :].reshape(1, -1), whole).reshape(-1, PACKET))
    packets = np.concatenate(parts)
    packets[:, 3] = packets[:, 3] & 0xF0 | (np.arange(len(packets)) & 15).astype(np.uint8)
    return _HEAD.tobytes() + packets.tobytes()


@dataclass
class Stream:
    """What demux() reads: the elementary stream's bytes, its access units, and what was wrong on the way."""

    payload: bytes
    pts: np.ndarray
    unit_bytes: np.ndarray
    random_access: np.ndarray
    packets: int
    programs: int
    pid: int
    stream_type: int
    discontinuities: int


def _sections(packets: np.ndarray) -> Iterator[bytes]:
    """Table sections of one PID's packets: one may begin anywhere in a packet, go on over several, or follow another."""
    held, begun = b"", False
    for packet in packets:
        if not packet[3] & 0x10:
            continue
        body = packet[4 + (1 + int(packet[4]) if packet[3] & 0x20 else 0) :].tobytes()
        if packet[1] & 0x40:
            pointer = body[0]
            pieces = [(body[1 : 1 + pointer], False), (body[1 + pointer :], True)]  # what ends here, what begins here
        else:
            pieces = [(body, False)]
        for piece, fresh in pieces:
            if fresh:
                held, begun = piece, True
            elif begun:
                held += piece
            while begun and len(held) >= 3 and held[0] != 0xFF:
                length = 3 + ((held[1] & 0x0F) << 8 | held[2])
                if len(held) < length:
                    break
                yield held[:length]
                held = held[length:]


def _read_table(packets: np.ndarray, pids: np.ndarray, pid: int, table: int) -> bytes:
    """The first section of a table that is in force."""
    for section in _sections(packets[pids == pid]):
        if section_crc(section):
            raise ValueError("a program table is broken")
        if section[0] == table and section[5] & 1:
            return section
    raise ValueError("a program table is missing")


def _streams(pmt: bytes) -> Iterator[tuple[int, int]]:
    """(type, PID) of a program's elementary streams."""
    at = 12 + ((pmt[10] & 0x0F) << 8 | pmt[11])
    while at < len(pmt) - 4:
        yield pmt[at], int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF
        at += 5 + ((pmt[at + 3] & 0x0F) << 8 | pmt[at + 4])


def _once(own: np.ndarray) -> np.ndarray:
    """Which packets of a PID aren't repeats: one that has its predecessor's counter and bytes, but for a clock reference."""
    keep = np.ones(len(own), dtype=bool)
    same = np.flatnonzero((own[1:, 3] == own[:-1, 3]) & (own[1:, 3] & 0x10 != 0)) + 1
    alike = own[same] == own[same - 1]
    clock = (own[same, 3] & 0x20 != 0) & (own[same, 4] > 6) & (own[same, 5] & 0x10 != 0)
    alike[:, 6:12] |= clock[:, None]
    keep[same] = ~alike.all(1)
    return keep


def demux(media: bytes, stream_type: int = STREAM_TYPE) -> Stream:
    """Read the first elementary stream of a type in the first program; raises ValueError where there is none.

    A repeated packet counts once, and a counter may jump where a packet announces it. Other programs, streams and PIDs
    are passed over.
    """
    if len(media) % PACKET:
        raise ValueError("not a whole number of packets")
    packets = np.frombuffer(media, dtype=np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("a sync byte is missing")
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    pat = _read_table(packets, pids, 0, PAT_TABLE)
    programs = [(n, pid & 0x1FFF) for k in range(8, len(pat) - 4, 4) if (n := int.from_bytes(pat[k : k + 2], "big")) and (pid := int.from_bytes(pat[k + 2 : k + 4], "big"))]
    if not programs:
        raise ValueError("a program table is empty")
    pid = next((pid for kind, pid in _streams(_read_table(packets, pids, programs[0][1], PMT_TABLE)) if kind == stream_type), None)
    if pid is None:
        raise ValueError("the program has no stream of this type")
    own = packets[pids == pid]
    own = own[_once(own)]
    first = (own[:, 1] & 0x40) != 0
    has_payload = (own[:, 3] & 0x10) != 0
    counters = own[has_payload, 3] & 15
    adaptation = (own[:, 3] & 0x20) != 0
    told = np.cumsum(adaptation & (own[:, 4] > 0) & (own[:, 5] & 0x80 != 0))[has_payload]
    broken = int((((counters[1:] - counters[:-1] - 1) & 15 != 0) & (told[1:] == told[:-1])).sum())
    begin = np.where(adaptation, 5 + own[:, 4].astype(np.int32), 4)
    begin = np.where(has_payload, np.minimum(begin, PACKET), PACKET)
    flags = np.where(adaptation & (own[:, 4] > 0), own[:, 5], 0)
    stream = own[np.arange(PACKET) >= begin[:, None]]
    ends = np.cumsum(PACKET - begin)
    heads = (ends - (PACKET - begin))[first]
    head = stream[heads[:, None] + np.arange(14)].astype(np.int64)
    if (head[:, :3] != [0, 0, 1]).any():
        raise ValueError("a PES start code is missing")
    pts = (head[:, 9] >> 1 & 7) << 30 | head[:, 10] << 22 | (head[:, 11] >> 1) << 15 | head[:, 12] << 7 | head[:, 13] >> 1
    skip = 9 + head[:, 8]
    keep = np.ones(len(stream) + 1, dtype=np.int8)
    step = np.zeros(len(stream) + 1, dtype=np.int8)
    step[heads] -= 1
    step[heads + skip] += 1
    keep = np.cumsum(step)[:-1] == 0
    unit_bytes = np.diff(np.append(heads, len(stream))) - skip
    return Stream(stream[keep].tobytes(), pts, unit_bytes, (flags[first] & 0x40) != 0, len(packets), len(programs), pid, stream_type, broken)


def padded(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes of a text, padded with spaces to a positive multiple of UNIT, after their number."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b" ")


FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _feature(s: Stream) -> str:
    spaced = int((np.diff(s.pts) != TICKS).sum())
    return (
        f"programs={s.programs};pid={s.pid};type={s.stream_type};packets={s.packets};units={len(s.pts)};random_access={int(s.random_access.sum())};"
        f"first_pts={int(s.pts[0])};last_pts={int(s.pts[-1])};uneven={spaced};discontinuities={s.discontinuities};largest_unit={int(s.unit_bytes.max())}"
    )


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            rows = []
            for text in part.column(1):
                n, payload = padded(text.as_py())
                media = mux(payload)
                s = demux(media)
                if s.payload != payload:
                    raise ValueError("the stored stream doesn't give its payload back")
                rows.append((n, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), _feature(s)))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )


def describe_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text as a transport stream, read it back and return what was read: one row per row of df.

    A null text is stored as an empty one (one unit of spaces); equal texts give equal values; repeated rows are
    kept; other columns of df are ignored; a null key stays null. Nothing is shuffled: a stream is made and read
    within one row.
    """
    slim = df.select(df[key].alias("_id"), df[text].cast("string").alias("_text"))
    return slim.mapInArrow(_describe, f"_id {dict(slim.dtypes)['_id']}, {FEATURES}").withColumnRenamed("_id", key)


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.slice(at, 64)
            media = [mux(padded(t.as_py())[1]) for t in part.column(1)]
            streams = [demux(m) for m in media]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(media, pa.binary()), pa.array([s.pts.tolist() for s in streams], pa.list_(pa.int64())), pa.array([s.random_access.tolist() for s in streams], pa.list_(pa.bool_()))],
                names=["_id", "media", "pts", "random_access"],
            )


def media_column(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, media (the transport stream), pts and random_access (one entry per access unit) of each row."""
    slim = df.select(df[key].alias("_id"), df[text].cast("string").alias("_text"))
    return slim.mapInArrow(_media, f"_id {dict(slim.dtypes)['_id']}, media binary, pts array<long>, random_access array<boolean>").withColumnRenamed("_id", key)
