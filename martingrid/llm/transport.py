"""MPEG transport streams as media columns: written from payloads, parsed back in bulk.

A stream has a program association table, a program map table and one elementary
stream of private data.  Its elementary packets carry time stamps; every
``RANDOM_ACCESS``-th one is a random-access point with a clock reference.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fixed values of the format.
PACKET, SYNC, NULL_PID, PRIVATE_STREAM, STREAM_TYPE = 188, 0x47, 0x1FFF, 0xBD, 0x06
PMT_PID, DATA_PID, PROGRAM, CLOCK = 0x1000, 0x0100, 1, 90_000
#: Payloads are padded to a multiple of a unit; an elementary packet holds UNITS of them.
UNIT, FILL, UNITS, RANDOM_ACCESS = 576, 255, 16, 8
#: Time stamps advance by so much per unit: 576 samples at 48 kHz.
TICKS = CLOCK * UNIT // 48_000


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + extension.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


def _tables() -> bytes:
    pat = PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")
    pmt = (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0"
    return _table_packet(0, _section(0, 1, pat)) + _table_packet(PMT_PID, _section(2, PROGRAM, pmt))


_TABLES = _tables()


def _stamp(kind: int, t: int) -> bytes:
    return bytes([kind << 4 | t >> 29 & 0xE | 1, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


def _clock(t: int) -> bytes:
    return (t << 15 | 0x7E00).to_bytes(6, "big")


def pad(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of the unit."""
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, bytes([FILL]))


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream."""
    out, counter, step = [_TABLES], 0, UNIT * UNITS
    for k, at in enumerate(range(0, len(payload), step)):
        unit = payload[at : at + step]
        time = (at // UNIT * TICKS) & (1 << 33) - 1
        random_access = k % RANDOM_ACCESS == 0
        pes = b"\0\0\1" + bytes([PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, time) + unit
        field_ = b"\x07\x50" + _clock(time) if random_access else b""
        room = 184 - len(field_)
        body = np.frombuffer(pes, np.uint8)
        first, rest = body[:room], body[room:]
        full = len(rest) // 184
        n = 1 + full + (len(rest) % 184 > 0)
        packets = np.empty((n, PACKET), np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
        packets[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        packets[0, 1] |= 0x40
        if field_:
            packets[0, 3] |= 0x20
            packets[0, 4 : 4 + len(field_)] = np.frombuffer(field_, np.uint8)
        _stuff(packets[0], 4 + len(field_), first, bool(field_))
        packets[1 : 1 + full, 4:] = rest[: full * 184].reshape(full, 184)
        if n > 1 + full:
            _stuff(packets[-1], 4, rest[full * 184 :], False)
        counter += n
        out.append(packets.tobytes())
    return b"".join(out)


def _stuff(packet: np.ndarray, at: int, data: np.ndarray, has_field: bool) -> None:
    """Put data at the end of a packet; what is left over becomes adaptation-field stuffing."""
    spare = PACKET - at - len(data)
    if spare:
        if has_field:
            packet[4] += spare
            packet[at : at + spare] = 255
        else:
            packet[3] |= 0x20
            packet[4] = spare - 1
            if spare > 1:
                packet[5] = 0
                packet[6 : 4 + spare] = 255
    packet[PACKET - len(data) :] = data


@dataclass
class Stream:
    """What a parse finds."""

    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    table_errors: int = 0
    continuity_errors: int = 0
    #: Bytes that are not of a packet with a sync byte, packets before the first start of a unit, and damaged units.
    lost_bytes: int = 0
    headless: int = 0
    damaged: int = 0
    #: (pid, pts or None, random access, byte offset in its stream's payload, payload)
    units: list[tuple[int, int | None, bool, int, bytes]] = field(default_factory=list)

    def payload(self, pid: int | None = None) -> bytes:
        return b"".join(u[4] for u in self.units if pid is None or u[0] == pid)

    def error(self) -> str | None:
        """What is wrong with the stream, or none."""
        found = {k: getattr(self, k) for k in ("lost_bytes", "table_errors", "continuity_errors", "headless", "damaged")}
        return ";".join(f"{k}={n}" for k, n in found.items() if n) or None

    def feature(self) -> str:
        stamps = [u[1] for u in self.units if u[1] is not None]
        return (
            f"packets={self.packets};programs={len(self.programs)};streams={len(self.streams)};units={len(self.units)};random_access={sum(u[2] for u in self.units)};"
            f"first_pts={min(stamps, default=-1)};last_pts={max(stamps, default=-1)};continuity_errors={self.continuity_errors};table_errors={self.table_errors}"
        )


def _sections(payload: bytes) -> tuple[int, bytes] | None:
    """(table id, body) of the section that a table packet starts; None if its checksum is wrong."""
    start = 1 + payload[0] if payload else 0
    length = int.from_bytes(payload[start + 1 : start + 3], "big") & 0xFFF
    section = payload[start : start + 3 + length]
    if len(section) < 12 or len(section) < 3 + length or crc32_mpeg(section):
        return None
    return section[0], section[8:-4]


def demux(media: bytes) -> Stream:
    """Parse tables, check continuity counters and put elementary packets together again.

    Packets that repeat a counter are dropped as duplicates; a gap counts as an error
    unless the packet signals a discontinuity.  Packets without a sync byte, a tail
    shorter than a packet and units without a readable head are counted and left out;
    sections longer than one packet count as table errors.
    """
    n = len(media) // PACKET
    a = np.frombuffer(media, np.uint8, n * PACKET).reshape(-1, PACKET)
    good = a[:, 0] == SYNC
    s = Stream(packets=int(good.sum()), lost_bytes=len(media) - int(good.sum()) * PACKET)
    a = a[good]
    pid = (a[:, 1].astype(np.int32) & 0x1F) << 8 | a[:, 2]
    has_field, has_payload = (a[:, 3] & 0x20) > 0, (a[:, 3] & 0x10) > 0
    offset = np.minimum(np.where(has_field, 5 + a[:, 4].astype(np.int32), 4), PACKET)
    flags = np.where(has_field & (a[:, 4] > 0), a[:, 5], 0)

    def table(i: int) -> tuple[int, bytes] | None:
        found = _sections(a[i, offset[i] :].tobytes())
        s.table_errors += found is None
        return found

    start = (a[:, 1] & 0x40) > 0
    for i in np.flatnonzero((pid == 0) & start & has_payload):
        if (found := table(i)) and found[0] == 0:
            b = found[1]
            s.programs |= {int.from_bytes(b[k : k + 2], "big"): int.from_bytes(b[k + 2 : k + 4], "big") & 0x1FFF for k in range(0, len(b), 4) if b[k : k + 2] != b"\0\0"}
    for i in np.flatnonzero(np.isin(pid, list(s.programs.values())) & start & has_payload):
        if (found := table(i)) and found[0] == 2:
            b = found[1]
            k = 4 + (int.from_bytes(b[2:4], "big") & 0xFFF)
            while k + 5 <= len(b):
                s.streams[int.from_bytes(b[k + 1 : k + 3], "big") & 0x1FFF] = b[k]
                k += 5 + (int.from_bytes(b[k + 3 : k + 5], "big") & 0xFFF)
    columns = np.arange(PACKET)[None, :]
    for p in s.streams:
        own = np.flatnonzero((pid == p) & has_payload)
        if not len(own):
            continue
        step = np.diff(a[own, 3].astype(np.int16) & 15) % 16
        same = np.concatenate([[False], (step == 0) & ((flags[own[1:]] & 0x80) == 0)])
        s.continuity_errors += int(((step > 1) & ((flags[own[1:]] & 0x80) == 0)).sum())
        own = own[~same]
        heads = np.flatnonzero(start[own])
        s.headless += int(heads[0] if len(heads) else len(own))
        at = 0
        for x, y in zip(heads, [*heads[1:], len(own)], strict=True):
            rows = own[x:y]
            pes = a[rows][columns >= offset[rows][:, None]].tobytes()
            if len(pes) < 9 or pes[:3] != b"\0\0\1" or len(pes) < 9 + pes[8] or pes[7] & 0x80 and pes[8] < 5:
                s.damaged += 1
                continue
            length = int.from_bytes(pes[4:6], "big")
            body = 9 + pes[8]
            t = pes[9:14]
            pts = (t[0] & 0xE) << 29 | t[1] << 22 | (t[2] & 0xFE) << 14 | t[3] << 7 | t[4] >> 1 if pes[7] & 0x80 else None
            data = pes[body : 6 + length if length else None]
            s.damaged += length > 0 and len(pes) < 6 + length
            s.units.append((p, pts, bool(flags[rows[0]] & 0x40), at, data))
            at += len(data)
    return s


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in map(pa.StringScalar.as_py, b.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([mux(pad(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"]
        )


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded, as a transport stream; null texts are empty.

    One row per row; other columns are ignored; an empty table gives an empty result.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


_PARSED = "payload binary, feature string, error string, continuity_errors long, table_errors long, access_points array<struct<pid:int,pts:long,offset:long>>"


def parse(stored: DataFrame) -> DataFrame:
    """``stored`` with what its column media holds.

    payload: the elementary streams' bytes, feature: a summary, access_points: time
    stamp and byte offset of each random-access point.  Columns of these names are
    replaced.  Null media give nulls; of damaged media what can be read, and error says what is wrong.
    """
    new = ["payload", "feature", "error", "continuity_errors", "table_errors", "access_points"]
    rest = [c for c in stored.columns if c not in new]
    points = pa.list_(pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("offset", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [None if m is None else demux(m) for m in map(pa.BinaryScalar.as_py, b.column("media"))]
            get = lambda f: [None if s is None else f(s) for s in found]
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(c) for c in rest),
                    pa.array(get(Stream.payload), pa.binary()),
                    pa.array(get(Stream.feature), pa.string()),
                    pa.array(get(Stream.error), pa.string()),
                    pa.array(get(lambda s: s.continuity_errors), pa.int64()),
                    pa.array(get(lambda s: s.table_errors), pa.int64()),
                    pa.array(get(lambda s: [{"pid": p, "pts": t, "offset": o} for p, t, r, o, _ in s.units if r]), points),
                ],
                [*rest, *new],
            )

    extra = StructType.fromDDL(_PARSED)
    schema = StructType([*stored.select(rest).schema.fields, *extra.fields])
    return stored.select(rest).mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """Texts stored as transport streams and read back, with digests of both forms."""
    read = parse(store(docs))
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, length(payload) - 31, 32)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "error",
        F.size("access_points").cast("long").alias("n_access_points"),
        F.element_at("access_points", -1)["pts"].alias("last_access_pts"),
        F.element_at("access_points", -1)["offset"].alias("last_access_offset"),
    )
