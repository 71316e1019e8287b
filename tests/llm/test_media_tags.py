"""Tags at the end of MPEG streams against payloads that look like them."""

import pytest

from millrace.llm import mpeg


@pytest.mark.parametrize("frames", [1, 3])
@pytest.mark.parametrize("tail", [b"", b"TAG" + b"title".ljust(125, b"\0")])
def test_tag_inside_the_payload_is_no_tag(frames, tail):
    n, payload = mpeg.padded("x" * (frames * 576 - 55) + "TAG" + "y" * 52)
    data = mpeg.carry(payload, {"bytes": str(n)})
    assert data[-128:-125] == b"TAG"
    track = mpeg.parse(data + tail)
    assert len(track.offsets) == frames and track.skipped == 0 and mpeg.carried(data, track) == payload
    assert track.tags == {"bytes": str(n)} | ({"TIT2": "title"} if tail else {})


def test_missing_frames_raise():
    data = mpeg.carry(mpeg.padded("x" * 2000)[1], {})
    cut = data[: -mpeg._DATA_SIZE]
    with pytest.raises(ValueError):
        mpeg.carried(cut, mpeg.parse(cut))
