"""MPEG transport streams as a media column: write one per document, parse one back.

Writing cuts a payload into access units, wraps each in a PES packet of private stream 1 with a presentation time stamp,
and deals these out to 188-byte packets under a program association table and a program map table, which are repeated
before each random-access point. Parsing works on any stream: it follows the tables (checking their CRC-32/MPEG-2),
checks continuity counters, drops duplicate packets, reassembles the PES packets of each elementary stream and keeps time
stamps, clock references and random-access points.

Both are vectorised over the packets of a stream; a document is one row, so nothing is shuffled and a task holds one
Arrow batch. Null text is a document without bytes; an empty payload still has one unit of padding.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fathomline.llm.common import arrow_struct, blocks, text_block

PACKET = 188
#: Payloads are padded with 0xFF to a positive multiple of this.
GRANULE = 576
UNIT_BYTES = 8 * GRANULE
#: 90 kHz ticks from one access unit to the next (25 a second).
TICKS = 3600
RANDOM_ACCESS_EVERY = 4
PMT_PID, STREAM_PID, PRIVATE_DATA, PRIVATE_STREAM_1 = 0x1000, 0x0100, 0x06, 0xBD


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def pad(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % GRANULE if text else GRANULE)


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + extension.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


_PAT = _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = _section(2, 1, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_DATA]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\0")


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    return (b"\x47" + (0x4000 | pid).to_bytes(2, "big") + bytes([0x10 | counter & 15, 0]) + section).ljust(PACKET, b"\xff")


def _stamp(kind: int, t: int) -> bytes:
    return bytes([kind << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1])


def mux(payload: bytes, unit_bytes: int = UNIT_BYTES, every: int = RANDOM_ACCESS_EVERY) -> bytes:
    """The transport stream of `payload`."""
    out, counter = [], 0
    for i, at in enumerate(range(0, max(1, len(payload)), unit_bytes)):
        unit, pts, access = payload[at : at + unit_bytes], i * TICKS % (1 << 33), i % every == 0
        if access:
            out += [_table_packet(0, _PAT, i // every), _table_packet(PMT_PID, _PMT, i // every)]
        pes = b"\0\0\1" + bytes([PRIVATE_STREAM_1]) + (8 + len(unit)).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, pts) + unit
        n = 1 + max(0, -(-(len(pes) - 176) // 184))
        rows = np.full((n, PACKET), 0xFF, np.uint8)
        rows[:, 0], rows[:, 1], rows[:, 2] = 0x47, STREAM_PID >> 8, STREAM_PID & 255
        rows[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        rows[0, 1] |= 0x40
        rows[0, 3] |= 0x20
        spare = 176 + 184 * (n - 1) - len(pes)
        rows[0, 4:12] = [7 + (spare if n == 1 else 0), 0x10 | 0x40 * access, pts >> 25, pts >> 17 & 255, pts >> 9 & 255, pts >> 1 & 255, (pts & 1) << 7 | 0x7E, 0]
        skip = np.full(n, 4)
        skip[0] = 12
        if n == 1:
            skip[0] += spare
        elif spare:
            rows[-1, 3] |= 0x20
            rows[-1, 4] = spare - 1
            if spare > 1:
                rows[-1, 5] = 0
            skip[-1] += spare
        rows[np.arange(PACKET) >= skip[:, None]] = np.frombuffer(pes, np.uint8)
        out.append(rows.tobytes())
        counter += n
    return b"".join(out)


@dataclass
class Stream:
    """An elementary stream: its reassembled bytes and one entry per access unit."""

    program: int
    pid: int
    kind: int
    packets: int = 0
    data: bytes = b""
    pts: list[int] = field(default_factory=list)
    dts: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)
    pcr: list[int] = field(default_factory=list)


@dataclass
class Parsed:
    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: list[Stream] = field(default_factory=list)
    sync_errors: int = 0
    continuity_errors: int = 0
    section_errors: int = 0
    duplicates: int = 0


def _sections(rows: np.ndarray, start: np.ndarray, first: np.ndarray) -> Iterator[bytes]:
    have = b""
    for row, s, at in zip(rows, start, first, strict=True):
        body = row[at:].tobytes()
        if s:
            if not body:
                continue
            have, body = b"", body[1 + body[0] :]
        elif not have:
            continue
        have += body
        while len(have) >= 3 and have[0] != 0xFF:
            n = 3 + ((have[1] & 15) << 8 | have[2])
            if len(have) < n:
                break
            yield have[:n]
            have = have[n:]
        else:
            have = b""


def _time(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def demux(media: bytes) -> Parsed:
    """Parse a transport stream. Bytes before the first packet boundary and packets out of sync are counted and skipped."""
    a = np.frombuffer(media, np.uint8)
    lead = next((i for i in range(min(PACKET, len(a))) if (a[i::PACKET][: 5 if len(a) - i >= PACKET else 0] == 0x47).all()), 0)
    a = a[lead : lead + (len(a) - lead) // PACKET * PACKET].reshape(-1, PACKET)
    good = (a[:, 0] == 0x47) & (a[:, 1] < 0x80)
    out = Parsed(packets=len(a), sync_errors=int((~good).sum()) + bool(lead))
    if not good.all():
        a = a[good]
    head = a[:, :6].astype(np.int32)
    pid, start = (head[:, 1] & 31) << 8 | head[:, 2], head[:, 1] >> 6 & 1 == 1
    control, counter = head[:, 3] >> 4 & 3, head[:, 3] & 15
    adapted = control >= 2
    first = np.where(adapted, 5 + head[:, 4], 4)
    flags = np.where(adapted & (head[:, 4] > 0), head[:, 5], 0)
    filled = (control & 1 == 1) & (first <= PACKET)
    keep = filled.copy()
    for p in np.unique(pid[pid != 0x1FFF]):
        at = np.flatnonzero((pid == p) & filled)
        step = np.diff(counter[at]) & 15
        for j in np.flatnonzero(step != 1):
            x, y = at[j], at[j + 1]
            if step[j] == 0 and (a[x, first[x] :].tobytes() == a[y, first[y] :].tobytes()):
                keep[y] = False
                out.duplicates += 1
            elif not flags[y] & 0x80:
                out.continuity_errors += 1

    def tables(p: int, table_id: int) -> Iterator[bytes]:
        at = np.flatnonzero((pid == p) & keep)
        for s in dict.fromkeys(_sections(a[at], start[at], first[at])):
            if crc32_mpeg(s):
                out.section_errors += 1
            elif s[0] == table_id and s[5] & 1:
                yield s

    for s in tables(0, 0):
        for j in range(8, len(s) - 4, 4):
            if number := s[j] << 8 | s[j + 1]:
                out.programs[number] = (s[j + 2] & 31) << 8 | s[j + 3]
    found: dict[int, Stream] = {}
    for number, p in sorted(out.programs.items()):
        for s in tables(p, 2):
            j = 12 + ((s[10] & 15) << 8 | s[11])
            while j + 5 <= len(s) - 4:
                es = (s[j + 1] & 31) << 8 | s[j + 2]
                found.setdefault(es, Stream(number, es, s[j]))
                j += 5 + ((s[j + 3] & 15) << 8 | s[j + 4])
    for es, stream in sorted(found.items()):
        at = np.flatnonzero((pid == es) & keep)
        stream.packets = len(at)
        rows, skip = a[at], first[at]
        body = rows[np.arange(PACKET) >= skip[:, None]].tobytes()
        begins = np.concatenate([[0], np.cumsum(PACKET - skip)])
        marks = np.flatnonzero(start[at])
        clocks = np.flatnonzero((flags[at] & 0x10 > 0) & (a[at, 4] >= 7))
        stream.pcr = [(int(r[6]) << 25 | int(r[7]) << 17 | int(r[8]) << 9 | int(r[9]) << 1 | int(r[10]) >> 7) * 300 + ((int(r[10]) & 1) << 8 | int(r[11])) for r in rows[clocks]]
        data = []
        for k, m in enumerate(marks):
            pes = body[begins[m] : begins[marks[k + 1]] if k + 1 < len(marks) else None]
            if pes[:3] != b"\0\0\1" or len(pes) < 9:
                out.section_errors += 1
                continue
            n = pes[4] << 8 | pes[5]
            pes = pes[: 6 + n] if n else pes
            times = pes[7] >> 6
            stream.pts.append(_time(pes[9:14]) if times & 2 else -1)
            stream.dts.append(_time(pes[14:19]) if times == 3 else stream.pts[-1])
            if flags[at[m]] & 0x40:
                stream.random_access.append(len(stream.sizes))
            data.append(pes[9 + pes[8] :])
            stream.sizes.append(len(data[-1]))
        stream.data = b"".join(data)
        out.streams.append(stream)
    return out


def feature(p: Parsed) -> str:
    """A line on the stream's structure: tables, packets, units, random-access points, time span, faults."""
    es = p.streams[0] if p.streams else Stream(0, 0, 0)
    return f"programs={len(p.programs)};pid={es.pid};type={es.kind};packets={p.packets};units={len(es.sizes)};random_access={len(es.random_access)};pts={es.pts[0] if es.pts else -1}..{es.pts[-1] if es.pts else -1};pcr={len(es.pcr)};continuity={p.continuity_errors};faults={p.sync_errors + p.section_errors}"


COLUMNS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
INDEX = "stream_pid int, stream_type int, pts array<long>, unit_bytes array<long>, random_access array<long>, continuity_errors int"


def transport_streams(df: DataFrame, key: str, text: str, media: bool = True) -> DataFrame:
    """One row per row of `df`: the key, digests of the payload as read back from its stream, the stream's index (time
    stamp and size of each access unit, which of them are random-access points) and, if `media`, the stream itself.

    A null or empty text is one unit of padding; repeated rows come out alike; the stream of a text of any length is held by
    one task. Other columns are left out."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, " + ", ".join(f"{f}" for f in (COLUMNS + ", " + INDEX).replace(" long", " bigint").replace("<long>", "<bigint>").split(", ")) + (", media binary" if media else "")
    fields = list(arrow_struct(COLUMNS + ", " + INDEX + (", media binary" if media else "")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text):
                raw, at = text_block(part.column(text))
                rows: list[tuple] = []
                for i in range(part.num_rows):
                    own = raw[at[i] : at[i + 1]].tobytes()
                    stored = mux(pad(own))
                    p = demux(stored)
                    es = p.streams[0]
                    rows.append((len(own), len(es.data), hashlib.sha256(es.data).hexdigest(), zlib.crc32(es.data[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(p), es.pid, es.kind, es.pts, es.sizes, es.random_access, p.continuity_errors, stored)[: len(fields)])
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(key), *columns], names=[key, *(f.name for f in fields)])

    return df.select(key, text).mapInArrow(each, schema)
