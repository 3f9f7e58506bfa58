import hashlib
import zlib

import numpy as np
import pytest

from fathomline.llm import mpeg_ts as m
from tests.llm.helpers import documents


@pytest.mark.parametrize("n", [0, 1, 150, 161, 162, 163, 345, 346, 347, 576, 4608, 4609, 30000])
def test_round_trip(n):
    data = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
    stored = m.mux(data)
    p = m.demux(stored)
    assert len(stored) % 188 == 0 and stored[::188] == b"\x47" * (len(stored) // 188)
    assert p.streams[0].data == data and p.streams[0].kind == m.PRIVATE_DATA
    assert (p.sync_errors, p.continuity_errors, p.section_errors, p.duplicates) == (0, 0, 0, 0)
    assert p.streams[0].pts == [i * m.TICKS for i in range(max(1, -(-n // m.UNIT_BYTES)))]
    assert p.streams[0].random_access == list(range(0, len(p.streams[0].pts), m.RANDOM_ACCESS_EVERY))
    assert [c // 300 for c in p.streams[0].pcr] == p.streams[0].pts


def test_faults_are_counted():
    data = bytes(range(256)) * 40
    rows = [m.mux(data)[i : i + 188] for i in range(0, len(m.mux(data)), 188)]
    assert m.demux(b"".join(rows[:10] + rows[11:])).continuity_errors == 1
    twice = m.demux(b"".join(rows[:10] + rows[9:]))
    assert twice.duplicates == 1 and twice.streams[0].data == data
    assert m.demux(b"xyz" + b"".join(rows)).streams[0].data == data
    broken = bytearray(b"".join(rows))
    broken[10] ^= 1
    assert m.demux(bytes(broken)).section_errors >= 1
    assert m.demux(b"").streams == []


def test_crc():
    assert m.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_column(spark):
    texts = ["", None, "é" * 400, "a" * 576, "b" * 50001, "same", "same"]
    rows = {(r.doc_id): r for r in m.transport_streams(documents(spark, texts), "doc_id", "text").collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = m.pad(raw)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(want)) and len(want) % 576 == 0 and want
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-32:])
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and m.demux(bytes(r.media)).streams[0].data == want
    assert rows[5].feature == rows[6].feature
    assert m.transport_streams(documents(spark, ["x"]).limit(0), "doc_id", "text").count() == 0
