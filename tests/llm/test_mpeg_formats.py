"""Streams of all versions and layers, with the tables and tags that carry() doesn't write."""

import struct

import pytest

from millrace.llm import mpeg


def frame(version, layer, kbps_index, hz, *, protect=False, mono=False, body=b""):
    """One frame: version 1, 2 or 3 (2.5), its data zero but for body."""
    code = {1: 3, 2: 2, 3: 0}[version]
    word = 0x7FF << 21 | code << 19 | (4 - layer) << 17 | (0 if protect else 1) << 16 | kbps_index << 12 | hz << 10 | (3 if mono else 0) << 6
    head = word.to_bytes(4, "big")
    h = mpeg.header_at(head + bytes(4), 0)
    return (head + body).ljust(h.size, b"\0"), h


@pytest.mark.parametrize("version,layer,index,hz,size,samples,rate", [(1, 1, 3, 1, 96, 384, 48000), (1, 2, 5, 1, 240, 1152, 48000), (1, 3, 9, 1, 384, 1152, 48000), (2, 3, 8, 1, 192, 576, 24000), (2, 2, 8, 1, 384, 1152, 24000), (3, 3, 8, 1, 384, 576, 12000), (3, 1, 8, 1, 512, 384, 12000)])
def test_sizes_and_durations(version, layer, index, hz, size, samples, rate):
    one, h = frame(version, layer, index, hz)
    assert (h.size, h.samples, h.rate) == (size, samples, rate)
    track = mpeg.parse(one * 5)
    assert len(track.offsets) == 5 and track.samples == 5 * samples and track.rate == rate and track.skipped == 0
    assert track.offsets == [k * size for k in range(5)] and track.checked == 0


@pytest.mark.parametrize("layer,mono", [(1, False), (1, True), (3, False), (3, True)])
def test_checksums(layer, mono):
    plain, h = frame(1, layer, 9, 1, protect=True, mono=mono)
    covered = h.side if layer == 3 else (16 if mono else 32)
    good = plain[:4] + mpeg.crc16(plain[2:4] + plain[6 : 6 + covered]).to_bytes(2, "big") + plain[6:]
    hurt = bytearray(good)
    hurt[10] ^= 4
    track = mpeg.parse(good * 3 + bytes(hurt) + good)
    assert (len(track.offsets), track.checked, track.bad) == (5, 5, 1)


@pytest.mark.parametrize("extension,covered", [(0, 18), (1, 20), (2, 22), (3, 24)])
def test_checksums_of_joint_stereo(extension, covered):
    """Layer I: 2 * bound + (32 - bound) fields of four bits."""
    word = int.from_bytes(frame(1, 1, 9, 1, protect=True)[0][:4], "big") | 1 << 6 | extension << 4
    head = word.to_bytes(4, "big")
    size = mpeg.header_at(head + bytes(4), 0).size
    body = bytes(range(1, 41))
    check = mpeg.crc16(head[2:4] + body[:covered]).to_bytes(2, "big")
    good = (head + check + body).ljust(size, b"\0")
    beyond, within = bytearray(good), bytearray(good)
    beyond[6 + covered] ^= 1
    within[5 + covered] ^= 1
    track = mpeg.parse(good * 2 + bytes(beyond) + bytes(within) + good)
    assert (len(track.offsets), track.checked, track.bad) == (5, 5, 1)


def test_xing_table_with_delay():
    plain, h = frame(1, 3, 9, 1)
    gap = (576 << 12 | 1000).to_bytes(3, "big")
    info = b"Xing" + struct.pack(">III", 7, 10, 10 * h.size) + bytes(range(100)) + b"LAME3.100" + bytes(12) + gap
    table = plain[:4] + bytes(h.side) + info
    track = mpeg.parse(table.ljust(h.size, b"\0") + plain * 10)
    assert (track.vbr, track.vbr_frames, track.vbr_bytes, track.toc) == ("Xing", 10, 10 * h.size, bytes(range(100)))
    assert len(track.offsets) == 10 and track.samples == 10 * 1152 - 1576


def test_vbri_table():
    plain, h = frame(1, 3, 9, 1)
    table = plain[:36] + b"VBRI" + bytes(6) + struct.pack(">II", 4000, 7)
    track = mpeg.parse(table.ljust(h.size, b"\0") + plain * 7)
    assert (track.vbr, track.vbr_bytes, track.vbr_frames, len(track.offsets)) == ("VBRI", 4000, 7, 7)


def test_ape_tag_at_the_end():
    plain, _ = frame(1, 3, 9, 1)
    item = struct.pack("<II", 5, 0) + b"Artist\0" + b"Alice"
    foot = b"APETAGEX" + struct.pack("<IIII", 2000, len(item) + 32, 1, 0) + bytes(8)
    track = mpeg.parse(plain * 4 + item + foot)
    assert track.tags == {"Artist": "Alice"} and len(track.offsets) == 4 and track.skipped == 0


def test_a_single_header_after_damage_is_not_believed():
    plain, h = frame(1, 3, 9, 1)
    lone = plain[:4] + b"\x55" * 200
    track = mpeg.parse(plain * 3 + b"\x01\x02\x03" + lone + plain * 2)
    assert track.offsets == [0, h.size, 2 * h.size, 3 * h.size + 207, 4 * h.size + 207]


def test_the_last_frame_before_damage_counts():
    plain, h = frame(1, 3, 9, 1)
    track = mpeg.parse(plain * 3 + b"junk" * 30)
    assert len(track.offsets) == 3 and track.skipped == 120
