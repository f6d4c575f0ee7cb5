import hashlib
import zlib

import pytest

from leadloom.llm import media as m


def payload(text):
    raw = (text or "").encode()
    return raw.ljust(max(192, -(-len(raw) // 192) * 192)), len(raw)


@pytest.mark.parametrize("name", ["docs", "edge"])
def test_round_trip(request, scratch, name):
    df = request.getfixturevalue(name)
    rows = m.read_media(scratch.save(m.store_texts(df), "media", "zstd")).collect()
    want = sorted(((r.doc_id, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])) for r in df.collect() for p, n in [payload(r.text)]), key=str)
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows), key=str) == want
    assert all(r.duration_us == r.n_frames * 24_000 for r in rows)


def frame(kbps_index=9, pad=0, crc=False, fill=b"\0"):
    head = bytes([0xFF, 0xFA if crc else 0xFB, kbps_index << 4 | pad << 1, 0x00])
    h = m.header(head + bytes(4), 0)
    body = b"" if not crc else m.crc16(head[2:] + bytes(32)).to_bytes(2, "big")
    return (head + body).ljust(h.size, fill[:1] if not crc else b"\0")


def test_headers_of_all_layers():
    assert m.header(bytes([0xFF, 0xFB, 0x90, 0x00]), 0).size == 417
    assert m.header(bytes([0xFF, 0xFD, 0x84, 0xC0]), 0).size == 384  # layer II, 128 kbit/s, 48 kHz
    assert m.header(bytes([0xFF, 0xFF, 0x14, 0xC0]), 0).size == 32  # layer I, 32 kbit/s, 48 kHz
    assert m.header(bytes([0xFF, 0xF3, 0x40, 0x00]), 0).samples == 576
    assert all(m.header(bytes(b), 0) is None for b in ([0xFF, 0xEB, 0x90, 0], [0xFF, 0xF9, 0x90, 0], [0xFF, 0xFB, 0xF0, 0], [0xFF, 0xFB, 0x9C, 0], [0, 0, 0, 0]))


def test_resynchronises_and_counts():
    frames = [frame(9), frame(9, 1), frame(5), frame(9)] * 5
    junk = b"\xff\xfb\x90" + b"noise\xff\xe0" * 9
    data = b"ID3\x03\0\0\0\0\0\x0aXXXXXXXXXX" + junk + b"".join(frames[:10]) + junk + b"".join(frames[10:]) + b"TAG" + b"A song".ljust(125, b"\0")
    s = m.parse(data)
    assert len(s.offsets) == 20 and s.samples == 20 * 1152 and s.micros == 20 * 1152 * 1_000_000 // 44100
    assert s.skipped == 2 * len(junk) and s.tags["TIT2"] == "A song"
    assert all(data[o] == 0xFF for o in s.offsets) and s.sizes.sum() == sum(map(len, frames))


def test_checksums_and_tables():
    good, bad = frame(9, crc=True), bytearray(frame(9, crc=True))
    bad[10] ^= 1
    s = m.parse(good * 3 + bytes(bad) + good)
    assert (s.crc_good, s.crc_bad) == (4, 1)
    vbri = bytearray(frame(9))
    vbri[36:62] = b"VBRI" + bytes(6) + (999).to_bytes(4, "big") + (2).to_bytes(4, "big") + (1).to_bytes(2, "big") + (1).to_bytes(2, "big") + (2).to_bytes(2, "big") + bytes(2)
    s = m.parse(bytes(vbri) + frame(9) * 2)
    assert s.table["kind"] == "VBRI" and s.table["frames"] == 2 and len(s.offsets) == 2
    stored = m.parse(m.store_payload(b"x" * 384, {"k": "v"}))
    assert stored.table["frames"] == 2 and len(stored.table["toc"]) == 100 and stored.tags["k"] == "v"


def test_no_audio():
    for data in (b"", b"\xff", b"plain text", b"\xff\xfb\x90\x00", b"ID3"):
        assert len(m.parse(data).offsets) == 0
    with pytest.raises(ValueError):
        m.store_payload(b"x")
