"""MPEG audio columns: writing payloads into frames and reading any stream of frames back.

``parse`` resynchronises on frame headers, reads ID3v1 and ID3v2 tags and Xing, Info and VBRI tables, verifies
the CRC-16 of Layer III frames, and returns exact durations (samples over rate) and a seek offset per frame.
``store_payload`` keeps bytes losslessly: every Layer III frame decodes to silence (no main data) and carries
192 payload bytes as ancillary data, which decoders skip.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from leadloom.llm.common import table
from leadloom.scratch import Scratch

# Fixed values of the format: kbit/s by (version 1 or 2, layer) and index, and Hz by version bits.
BITRATES = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}

#: Payload bytes a frame carries, and the frame's size: MPEG-1 Layer III, mono, 48 kHz, 80 kbit/s, with checksum.
UNIT, FRAME = 192, 240
_HEADER = bytes([0xFF, 0xFA, 0x64, 0xC0])
_SIDE = 17


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1) ^ (0x8005 if crc & 0x8000 else 0)
        out.append(crc & 0xFFFF)
    return out


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    crc = 0xFFFF
    for byte in data:
        crc = ((crc << 8) & 0xFFFF) ^ _CRC[(crc >> 8) ^ byte]
    return crc


@dataclass
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    size: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


def header(data: bytes, at: int) -> Header | None:
    """The frame header at a position, or None where there is none."""
    if at < 0 or at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b1, b2, b3 = data[at + 1], data[at + 2], data[at + 3]
    version, layer, index, rate = b1 >> 3 & 3, 4 - (b1 >> 1 & 3), b2 >> 4, b2 >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return None
    kbps, hz, pad = BITRATES[1 if version == 3 else 2, layer][index], RATES[version][rate], b2 >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    size = (12 * kbps * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + pad
    return Header(version, layer, not b1 & 1, kbps, hz, b3 >> 6 == 3, size, samples)


@dataclass
class Stream:
    """What ``parse`` has found; offsets are of audio frames, without the table's own frame."""

    tags: dict[str, str] = field(default_factory=dict)
    table: dict = field(default_factory=dict)
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    rate: int = 0
    samples: int = 0
    crc_good: int = 0
    crc_bad: int = 0
    skipped: int = 0  # bytes passed over to find frames again

    @property
    def micros(self) -> int:
        return self.samples * 1_000_000 // self.rate if self.rate else 0


def _safe_int(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _text(raw: bytes) -> str:
    code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0] if raw else 0, "latin-1")
    return raw[1:].decode(code, "replace").strip("\0")


def _tags(data: bytes) -> tuple[dict[str, str], int]:
    """The tags in front, and where audio begins."""
    tags, first = {}, 0
    while data[first : first + 3] == b"ID3" and len(data) >= first + 10:
        version, end = data[first + 3], first + 10 + _safe_int(data[first + 6 : first + 10])
        at = first + 10
        while version >= 3 and at + 10 <= min(end, len(data)) and data[at : at + 4].isalnum():
            name, raw = data[at : at + 4].decode("latin-1"), data[at + 4 : at + 8]
            size = _safe_int(raw) if version == 4 else int.from_bytes(raw, "big")
            value = _text(data[at + 10 : at + 10 + size]) if name[0] == "T" else ""
            key, _, rest = value.partition("\0") if name == "TXXX" else (name, "", value)
            tags.setdefault(key if name == "TXXX" else name, rest)
            at += 10 + size
        first = end
    return tags, first


def _rate_table(data: bytes, at: int, head: Header) -> dict | None:
    """A Xing, Info or VBRI table in the frame at a position; what lies beyond the frame is not read."""
    data = data[: at + head.size]
    place = at + 4 + 2 * head.protected + head.side
    for base in (place, at + 4 + head.side):
        name = data[base : base + 4]
        if name in (b"Xing", b"Info"):
            flags, pos, out = int.from_bytes(data[base + 4 : base + 8], "big"), base + 8, {"kind": name.decode()}
            for bit, key, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
                if flags & bit and pos + size <= len(data):
                    out[key] = list(data[pos : pos + size]) if key == "toc" else int.from_bytes(data[pos : pos + size], "big")
                    pos += size
            return out
    if data[at + 36 : at + 40] == b"VBRI" and at + 62 <= len(data):
        size, frames, entries, scale, width = struct.unpack(">IIHHH", data[at + 46 : at + 60])
        raw = data[at + 62 : at + 62 + entries * width]
        return {"kind": "VBRI", "bytes": size, "frames": frames, "toc": [int.from_bytes(raw[k : k + width], "big") * scale for k in range(0, len(raw), max(1, width))]}
    return None


def _agree(a: Header, b: Header) -> bool:
    return (a.version, a.layer, a.rate) == (b.version, b.layer, b.rate)


def _pair(body: bytes, at: int, like: Header | None) -> bool:
    """Whether a frame begins here that another one, or the end, follows."""
    head = header(body, at)
    if head is None or at + head.size > len(body) or (like and not _agree(head, like)):
        return False
    after = header(body, at + head.size)
    return at + head.size == len(body) or after is not None and _agree(head, after)


def _doubtful(body: bytes, at: int, head: Header) -> bool:
    """A frame that none follows, and inside which a followed one begins, is noise that looks like a header."""
    if _pair(body, at, head):
        return False
    inside = at
    while 0 <= (inside := body.find(b"\xff", inside + 1)) < at + head.size:
        if _pair(body, inside, head):
            return True
    return False


def parse(data: bytes) -> Stream:
    """Read a stream; what isn't a frame is skipped, so bytes without any give an empty stream.

    The first frame after a gap counts where another one, or the end, follows it; later ones count unless a
    followed frame begins inside them.  The last 128 bytes are a tag if they begin with its mark and no frame that
    ends with the data covers the mark.
    """
    tags, first = _tags(data)
    last = len(data)
    mark = last - 128
    marked = mark >= first and data[mark : mark + 3] == b"TAG"
    out = _frames(data, first, last)
    if marked and not (len(out.offsets) and int(out.offsets[-1] + out.sizes[-1]) == last and ((out.offsets < mark) & (out.offsets + out.sizes > mark)).any()):
        out = _frames(data, first, mark)
        tags.setdefault("TIT2", data[mark + 3 : mark + 33].decode("latin-1").strip("\0 "))
        tags.setdefault("TPE1", data[mark + 33 : mark + 63].decode("latin-1").strip("\0 "))
    out.tags = tags
    return out


def _frames(data: bytes, at: int, last: int) -> Stream:
    """The frames and the table between two places."""
    out = Stream()
    if at >= last:
        return out
    body, view = data[:last], np.frombuffer(data, np.uint8, last)
    runs: list[tuple[int, int, int]] = []  # first offset, size, count
    locked: Header | None = None
    tabled = False
    while at < last:
        head = header(body, at)
        if locked is None:
            sound = _pair(body, at, None)
        else:
            sound = head is not None and at + head.size <= last and _agree(head, locked) and not _doubtful(body, at, head)
        if not sound:
            again = body.find(b"\xff", at + 1)
            again = last if again < 0 else again
            out.skipped += again - at
            at, locked = again, None
            continue
        locked = head
        if not tabled:
            tabled = True
            if found := _rate_table(body, at, head):
                out.table = found
                out.rate = head.rate
                at += head.size
                continue
        # frames that share this header byte for byte are taken in one step
        rows = view[at : at + (last - at) // head.size * head.size].reshape(-1, head.size)
        same = (rows[:, :4] == rows[0, :4]).all(1)
        n = len(same) if same.all() else int(np.argmin(same))
        if n > 1 and _doubtful(body, at + head.size * (n - 1), head):
            n -= 1
        rows = rows[:n]
        runs.append((at, head.size, n))
        out.rate = head.rate
        out.samples += head.samples * n
        if head.protected and head.layer == 3:
            covered = rows[:, 6 : 6 + head.side]
            alike = (covered == covered[0]).all(1)
            first = crc16(bytes(rows[0, 2:4]) + covered[0].tobytes())
            want = np.full(n, first, np.int64)
            for i in np.flatnonzero(~alike):
                want[i] = crc16(bytes(rows[i, 2:4]) + covered[i].tobytes())
            good = int((want == rows[:, 4].astype(np.int64) * 256 + rows[:, 5]).sum())
            out.crc_good += good
            out.crc_bad += n - good
        at += head.size * n
    if runs:
        out.offsets = np.concatenate([a + s * np.arange(n, dtype=np.int64) for a, s, n in runs])
        out.sizes = np.concatenate([np.full(n, s, np.int64) for _, s, n in runs])
    return out


def store_payload(payload: bytes, tags: dict[str, str] | None = None) -> bytes:
    """A stream whose frames carry payload, a multiple of UNIT bytes, behind an ID3v2 tag and an Info table."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"a payload holds a positive multiple of {UNIT} bytes")
    n, body = len(payload) // UNIT, b""
    for key, value in (tags or {}).items():
        raw = b"\x03" + key.encode() + b"\0" + value.encode()
        body += b"TXXX" + len(raw).to_bytes(4, "big") + b"\0\0" + raw
    size = len(body)
    tag = b"ID3\x03\0\0" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + body
    side = bytes(_SIDE)
    front = _HEADER + crc16(_HEADER[2:] + side).to_bytes(2, "big") + side
    info = front + b"Info" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + ((n + 1) * FRAME).to_bytes(4, "big") + bytes(k * 256 // 100 for k in range(100))
    frames = np.zeros((n, FRAME), np.uint8)
    frames[:, : len(front)] = np.frombuffer(front, np.uint8)
    frames[:, len(front) : len(front) + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    return tag + info.ljust(FRAME, b"\0") + frames.tobytes()


def read_payload(data: bytes, stream: Stream) -> bytes:
    """The ancillary bytes of every frame that store_payload has written; of other frames what stands there."""
    front = 4 + 2 + _SIDE
    view = np.frombuffer(data, np.uint8)
    steps = np.diff(stream.offsets)
    if len(stream.offsets) and (steps == FRAME).all() and (stream.sizes == FRAME).all():
        a = int(stream.offsets[0])
        return view[a : a + FRAME * len(stream.offsets)].reshape(-1, FRAME)[:, front : front + UNIT].tobytes()
    return b"".join(data[o + front : o + min(size, front + UNIT)] for o, size in zip(stream.offsets.tolist(), stream.sizes.tolist(), strict=True))


def feature(stream: Stream) -> str:
    """Duration, frames, checks and a digest of the seek offsets."""
    seek = zlib.crc32(stream.offsets.astype("<i8").tobytes())
    return f"frames={len(stream.offsets)};hz={stream.rate};us={stream.micros};crc={stream.crc_good}/{stream.crc_good + stream.crc_bad};table={stream.table.get('kind', '')}:{stream.table.get('frames', 0)};skipped={stream.skipped};seek={seek:08x}"


def _store_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media = []
        for text in batch.column(1):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            media.append(store_payload(raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT), {"bytes": str(len(raw))}))
        yield pa.record_batch({"doc_id": batch.column(0), "media": pa.array(media, pa.binary())})


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each text, null ones as empty, as UTF-8 padded with blanks, in MPEG frames.

    Null and repeated doc ids are rows like any other; no rows give none; other columns are not read.
    """
    return docs.select("doc_id", "text").mapInArrow(_store_batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, media binary")


def _digests(data: bytes | None) -> tuple:
    """What read_media returns of a value."""
    if data is None:
        return (None,) * 9
    stream = parse(data)
    payload, size = read_payload(data, stream), stream.tags.get("bytes", "")
    n_bytes = int(size) if size.isascii() and size.isdigit() and len(size) < 19 else None
    return n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(stream), stream.micros, len(stream.offsets)


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_us", "n_frames")}
        for value in batch.column(1):
            for k, v in zip(rows, _digests(value.as_py()), strict=True):
                rows[k].append(v)
        yield pa.record_batch({"doc_id": batch.column(0)} | {k: pa.array(v, pa.string() if k in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for k, v in rows.items()})


def read_media(media: DataFrame) -> DataFrame:
    """Digests and features of ``media(doc_id, media)``, one row a row, repeated rows included.

    Streams of other writers have a null n_bytes, and their payload is what stands where ours has it; bytes without a
    frame have no payload, duration or frame; a null value has nulls.
    """
    schema = f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_us long, n_frames long"
    return media.select("doc_id", "media").mapInArrow(_read_batches, schema)


def op6_mpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as ``store_texts`` does and read back as ``read_media`` does."""
    stored = Scratch(spark, "op6").save(store_texts(table(spark, sf_dir, "documents")), "media", "zstd")
    return read_media(stored)
