"""Media columns of MPEG audio.

parse() reads a stream of MPEG-1, 2 or 2.5 audio, layers I to III: it skips and
reads ID3v2, ID3v1 and APEv2 tags, finds frame headers and finds them again
after damage, reads Xing/Info and VBRI tables with the encoder's delay, checks
frame checksums, and gives exact durations (samples over rate) and the byte
offsets of frames for seeking.

carry() stores bytes without loss in a valid silent layer III stream: a frame's
side information says that it holds no coded audio, so that the rest of the
frame is ancillary data, which decoders skip. Each frame carries a unit of 576
bytes, the length of a granule.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table, written

UNIT = 576
#: Every so many frames an offset is kept by default: all of them.
SEEK_STRIDE = 1

# Fixed values of the MPEG audio header: kbit/s by index for (MPEG-1?, layer), and Hz for MPEG-1.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)


class Header(NamedTuple):
    version: int  # 1, 2, or 3 for 2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    size: int
    samples: int
    mono: bool

    @property
    def side(self) -> int:
        """Bytes of a layer III frame's side information."""
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


_headers: dict[int, Header | None] = {}


def _decode_header(word: int) -> Header | None:
    if word >> 21 != 0x7FF:
        return None
    version = {0: 3, 2: 2, 3: 1}.get(word >> 19 & 3)
    layer = 4 - (word >> 17 & 3)
    index, hz = word >> 12 & 15, word >> 10 & 3
    if version is None or layer == 4 or index in (0, 15) or hz == 3 or word & 3 == 2:
        return None
    kbps, rate = BITRATES[version == 1, layer][index], RATES[hz] >> (version - 1)
    padding = word >> 9 & 1
    if layer == 1:
        size, samples = (12_000 * kbps // rate + padding) * 4, 384
    else:
        samples = 576 if layer == 3 and version != 1 else 1152
        size = samples * 125 * kbps // rate + padding
    return Header(version, layer, not word >> 16 & 1, kbps, rate, size, samples, word >> 6 & 3 == 3)


def header_at(data: bytes, at: int) -> Header | None:
    """The frame header at a byte offset; free-format streams have none."""
    if at < 0 or at + 4 > len(data) or data[at] != 0xFF:
        return None
    word = int.from_bytes(data[at : at + 4], "big")
    if word not in _headers:
        if len(_headers) > 50_000:
            _headers.clear()
        _headers[word] = _decode_header(word)
    return _headers[word]


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ (0x8005 if crc & 0x8000 else 0)) & 0xFFFF
        out.append(crc)
    return out


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    """CRC-16 of polynomial 8005 hex from all ones, as frames use it."""
    crc = 0xFFFF
    for byte in data:
        crc = (crc << 8 & 0xFFFF) ^ _CRC[crc >> 8 ^ byte]
    return crc


def _checksum_ok(data: bytes, at: int, h: Header) -> bool | None:
    """Whether a protected frame's checksum holds; None where it isn't checked.

    Layer III covers the header's last two bytes and the side information,
    layer I the bit allocation: four bits a channel and subband, but from the
    bound of joint stereo on both channels share them. Layer II needs allocation
    tables and is left unchecked.
    """
    if not h.protected or h.layer == 2:
        return None
    mode, extension = data[at + 3] >> 6, data[at + 3] >> 4 & 3
    bound = 4 * (extension + 1) if mode == 1 else 32
    covered = h.side if h.layer == 3 else 16 if h.mono else 16 + bound // 2
    return crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + covered]) == int.from_bytes(data[at + 4 : at + 6], "big")


@dataclass
class Track:
    """What parse() finds. frames excludes a table frame; samples excludes delay and padding."""

    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    vbr: str = ""
    vbr_frames: int | None = None
    vbr_bytes: int | None = None
    toc: bytes = b""
    checked: int = 0
    bad: int = 0
    skipped: int = 0
    kbps: float = 0.0


def _syncsafe(data: bytes) -> int:
    return (data[0] & 127) << 21 | (data[1] & 127) << 14 | (data[2] & 127) << 7 | data[3] & 127


def _text(raw: bytes) -> str:
    code, body = raw[:1], raw[1:]
    return body.decode({b"\1": "utf-16", b"\2": "utf-16-be", b"\3": "utf-8"}.get(code, "latin-1"), "replace").rstrip("\0")


def _id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """The offset behind the ID3v2 tag at `at`, or `at` itself."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10:
        return at
    major, flags, size = data[at + 3], data[at + 5], _syncsafe(data[at + 6 : at + 10])
    pos, end = at + 10, min(len(data), at + 10 + size)
    if flags & 0x40 and major >= 3:  # extended header
        pos += _syncsafe(data[pos : pos + 4]) if major == 4 else int.from_bytes(data[pos : pos + 4], "big") + 4
    while pos + 10 <= end and data[pos] and major >= 3:
        name = data[pos : pos + 4].decode("latin-1")
        length = _syncsafe(data[pos + 4 : pos + 8]) if major == 4 else int.from_bytes(data[pos + 4 : pos + 8], "big")
        value = data[pos + 10 : pos + 10 + length]
        if name.startswith("T") and value:
            key, _, rest = _text(value).partition("\0") if name == "TXXX" else (name, "", _text(value))
            tags.setdefault(key, rest)
        pos += 10 + length
    return end + (10 if flags & 0x10 else 0)


def _tail_tags(data: bytes) -> list[tuple[int, dict[str, str]]]:
    """Where audio may end, and the tags behind: the end of the data, before an ID3v1 tag, before an APEv2 tag."""
    end, tags = len(data), {}
    found = [(end, dict(tags))]
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
            if value := data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                tags.setdefault(name, value)
        found.append((end, dict(tags)))
    if end >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, count, flags = struct.unpack("<III", data[end - 20 : end - 8])
        pos = max(0, end - size)
        end = max(0, pos - (32 if flags >> 31 else 0))
        for _ in range(count):
            if pos + 8 > len(data):
                break
            length, stop = struct.unpack("<I", data[pos : pos + 4])[0], data.find(b"\0", pos + 8)
            if stop < 0:
                break
            tags.setdefault(data[pos + 8 : stop].decode("latin-1"), data[stop + 1 : stop + 1 + length].decode("utf-8", "replace"))
            pos = stop + 1 + length
        found.append((end, dict(tags)))
    return found


def _vbr_table(data: bytes, at: int, h: Header, track: Track) -> tuple[bool, int]:
    """Whether the frame is a table frame, and the encoder's delay and padding in samples."""
    frame = data[at : at + h.size]
    if h.layer != 3:
        return False, 0
    for shift in (4, 6):
        pos = shift + h.side
        if frame[pos : pos + 4] in (b"Xing", b"Info"):
            track.vbr, flags, pos = frame[pos : pos + 4].decode(), int.from_bytes(frame[pos + 4 : pos + 8], "big"), pos + 8
            if flags & 1:
                track.vbr_frames, pos = int.from_bytes(frame[pos : pos + 4], "big"), pos + 4
            if flags & 2:
                track.vbr_bytes, pos = int.from_bytes(frame[pos : pos + 4], "big"), pos + 4
            if flags & 4:
                track.toc, pos = frame[pos : pos + 100], pos + 100
            pos += 4 * (flags >> 3 & 1)
            if frame[pos : pos + 1].isalpha() and len(frame) >= pos + 24:
                gap = int.from_bytes(frame[pos + 21 : pos + 24], "big")
                return True, (gap >> 12) + (gap & 0xFFF)
            return True, 0
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        track.vbr, track.vbr_bytes, track.vbr_frames = "VBRI", *struct.unpack(">II", frame[46:54])
        return True, 0
    return False, 0


def parse(data: bytes) -> Track:
    """Tags, frames and durations of a stream; no bytes give a track without frames.

    A header counts if the next one agrees in version, layer and rate, if the
    audio ends there, or if it follows a frame without a gap and agrees with
    that (the last frame before damage). Anything else is skipped until two
    headers agree.
    A tag at the end counts only where no frame of the walk reaches into it.
    """
    ends = _tail_tags(data)
    while (track := _walk(data, ends)) is None:
        ends.pop()
    return track


def _walk(data: bytes, ends: list[tuple[int, dict[str, str]]]) -> Track | None:
    """The track up to the last of ends; None if a frame that is whole crosses it."""
    track = Track(tags=dict(ends[-1][1]))
    end, at = ends[-1][0], 0
    outer = [x for x, _ in ends[:-1]]
    while (behind := _id3v2(data, at, track.tags)) > at:
        at = behind
    first, gap, weighed, behind = None, 0, 0, -1
    while at + 4 <= end:
        h = header_at(data, at)
        if h and at + h.size <= end:
            after = header_at(data, at + h.size) if at + h.size + 4 <= end else None
            fits = at + h.size == end or after is not None and (after.version, after.layer, after.rate) == (h.version, h.layer, h.rate)
        else:
            fits = False
            if h and outer and (not first or (h.version, h.layer, h.rate) == first):
                after = header_at(data, at + h.size)
                if at + h.size in outer or after is not None and (after.version, after.layer, after.rate) == (h.version, h.layer, h.rate):
                    return None
        if h and not fits and first and at == behind and at + h.size <= end:
            fits = (h.version, h.layer, h.rate) == first
        if not h or not fits:
            nxt = data.find(b"\xff", at + 1, end)
            track.skipped += (nxt if nxt >= 0 else end) - at
            at = nxt if nxt >= 0 else end
            continue
        if first is None:
            first, track.rate = (h.version, h.layer, h.rate), h.rate
            is_table, gap = _vbr_table(data, at, h, track)
            if is_table:
                at = behind = at + h.size
                continue
        ok = _checksum_ok(data, at, h)
        track.checked += ok is not None
        track.bad += ok is False
        track.offsets.append(at)
        track.sizes.append(h.size)
        track.samples += h.samples
        weighed += h.kbps
        at = behind = at + h.size
    track.samples = max(0, track.samples - gap)
    track.kbps = weighed / len(track.offsets) if track.offsets else 0.0
    return track


def _frame_head(kbps_index: int) -> bytes:
    """MPEG-1 layer III, 48 kHz, mono, with checksum and empty side information."""
    head = bytes([0xFF, 0xFA, kbps_index << 4 | 1 << 2, 0xC0])
    side = bytes(17)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side


_DATA_HEAD = _frame_head(12)  # 224 kbit/s: 672 bytes
_DATA_SIZE = 672
_TABLE_HEAD = _frame_head(5)  # 64 kbit/s: 192 bytes


def carry(payload: bytes, tags: dict[str, str]) -> bytes:
    """A stream whose frames carry payload, a positive multiple of 576 bytes."""
    if not payload or len(payload) % UNIT:
        raise ValueError("payload must be a positive multiple of 576 bytes")
    filler = bytes(_DATA_SIZE - len(_DATA_HEAD) - UNIT)
    frames = b"".join(_DATA_HEAD + payload[i : i + UNIT] + filler for i in range(0, len(payload), UNIT))
    count, size = len(payload) // UNIT, len(frames) + 192
    toc = bytes(min(255, (192 + p * count // 100 * _DATA_SIZE) * 256 // size) for p in range(100))
    table_frame = (_TABLE_HEAD + b"Xing" + struct.pack(">III", 7, count, size) + toc).ljust(192, b"\0")
    body = b""
    for key, value in tags.items():
        raw = b"\3" + key.encode() + b"\0" + value.encode()
        n = len(raw)
        body += b"TXXX" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127, 0, 0]) + raw
    n = len(body)
    return b"ID3\4\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + body + table_frame + frames


def carried(data: bytes, track: Track) -> bytes:
    """The payload of a stream made by carry(), from its frames' ancillary data; frames that are missing raise."""
    if track.vbr_frames is not None and len(track.offsets) != track.vbr_frames:
        raise ValueError(f"{len(track.offsets)} frames found of {track.vbr_frames} declared")
    skip = len(_DATA_HEAD)
    return b"".join(data[a + skip : a + skip + UNIT] for a in track.offsets)


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the text filled up with bytes 255 to a positive multiple of 576."""
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def store_texts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, media binary): every row's text, null as empty, as an audio stream; a written table.

    Texts of any length are stored whole; repeated rows and null ids stay;
    other columns are not looked at; an empty table gives no rows.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, len(batch), 500)):
                media = []
                for value in part.column(1).to_pylist():
                    n, payload = padded(value)
                    media.append(carry(payload, {"bytes": str(n)}))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], names=["doc", "media"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return written(docs.select(F.col(doc_id).alias("doc"), F.col(text)).mapInArrow(store, f"doc {kind}, media binary"))


FIELDS = {
    "n_bytes": pa.int64(),
    "payload_bytes": pa.int64(),
    "payload_sha256": pa.string(),
    "tail_crc32": pa.int64(),
    "media_bytes": pa.int64(),
    "media_sha256": pa.string(),
    "feature": pa.string(),
    "n_frames": pa.int64(),
    "duration_samples": pa.int64(),
    "sample_rate": pa.int64(),
    "bad_checksums": pa.int64(),
    "skipped_bytes": pa.int64(),
    "seek_offsets": pa.list_(pa.int64()),
}


def describe(data: bytes, seek_stride: int = SEEK_STRIDE) -> dict:
    """The media columns of one stored stream, all from its bytes."""
    track = parse(data)
    payload = carried(data, track)
    sizes = sorted(set(track.sizes))
    feature = f"{track.vbr or 'CBR'};frames={len(track.offsets)};declared={track.vbr_frames};seconds={track.samples}/{track.rate};kbps={track.kbps:.3f};sizes={sizes};checked={track.checked};bad={track.bad}"
    return {
        "n_bytes": int(track.tags.get("bytes", len(payload))),
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-32:]),
        "media_bytes": len(data),
        "media_sha256": hashlib.sha256(data).hexdigest(),
        "feature": feature,
        "n_frames": len(track.offsets),
        "duration_samples": track.samples,
        "sample_rate": track.rate,
        "bad_checksums": track.bad,
        "skipped_bytes": track.skipped,
        "seek_offsets": track.offsets[::seek_stride],
    }


def media_columns(stored: DataFrame, *, seek_stride: int = SEEK_STRIDE) -> DataFrame:
    """(doc, FIELDS) of every row of (doc, media), with the offset of every seek_stride-th frame.

    Repeated rows and null ids stay, an empty table gives no rows. A stream is
    read whole; one that lacks declared frames raises.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, len(batch), 500)):
                rows = [describe(x.as_py(), seek_stride) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[k] for r in rows], t) for k, t in FIELDS.items()]], names=["doc", *FIELDS])

    spark_type = {pa.int64(): "long", pa.string(): "string"}
    kind = stored.schema["doc"].dataType.simpleString()
    return stored.mapInArrow(read, f"doc {kind}, " + ", ".join(f"{k} {spark_type.get(t, 'array<long>')}" for k, t in FIELDS.items()))


def op1_mpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media columns of every document's stored text; null texts count as empty, repeated rows stay."""
    return media_columns(store_texts(table(spark, sf_dir, "documents"))).withColumnRenamed("doc", "doc_id")
