"""Pages of an image file from its headers: sizes and orientation of PNG, JPEG and TIFF, without decoding a pixel."""

from __future__ import annotations

import struct
from collections.abc import Iterator

#: Tags of width, height and orientation; orientations that lie on their side; JPEG markers of a frame.
WIDTH, HEIGHT, ORIENTATION = 256, 257, 274
SIDEWAYS = range(5, 9)
FRAME_MARKERS = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
PNG, JPEG, EXIF = b"\x89PNG\r\n\x1a\n", b"\xff\xd8", b"Exif\0\0"
Frame = tuple[int, int, int, int]


def directories(data: bytes) -> Iterator[dict[int, int]]:
    """The first values of whole-number tags in each directory of TIFF data, along the chain; a loop or a cut ends it."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        return
    at, seen = struct.unpack_from(f"{order}I", data, 4)[0], set()
    while at and at not in seen and at + 2 <= len(data):
        seen.add(at)
        entries = struct.unpack_from(f"{order}H", data, at)[0]
        end = at + 2 + 12 * entries
        if end > len(data):
            return
        tags = {}
        for place in range(at + 2, end, 12):
            tag, kind = struct.unpack_from(f"{order}HH", data, place)
            if kind in (3, 4):
                tags[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), data, place + 8)[0]
        yield tags
        at = struct.unpack_from(f"{order}I", data, end)[0] if end + 4 <= len(data) else 0


def jpeg_segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, body) of the segments before the picture's data."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if marker == 0xFF:  # fill
            at += 1
            continue
        if marker == 0xDA:
            return
        yield marker, data[at + 4 : at + 2 + size]
        at += 2 + size


def seen(n: int, width: int, height: int, turn: int) -> Frame:
    turn = turn if turn in range(1, 9) else 1
    return (n, height, width, turn) if turn in SIDEWAYS else (n, width, height, turn)


def image_frames(data: bytes) -> list[Frame]:
    """(number, width, height, orientation) of each page, sizes as seen."""
    if data.startswith(PNG) and len(data) >= 24:
        return [seen(1, *struct.unpack_from(">II", data, 16), 1)]
    if data.startswith(JPEG):
        turn, size = 1, None
        for marker, body in jpeg_segments(data):
            if marker == 0xE1 and body.startswith(EXIF):
                turn = next(directories(body[len(EXIF) :]), {}).get(ORIENTATION, 1)
            elif marker in FRAME_MARKERS and len(body) >= 5:
                size = struct.unpack_from(">HH", body, 1)[::-1]
        return [seen(1, *size, turn)] if size else []
    return [seen(n, d.get(WIDTH, 0), d.get(HEIGHT, 0), d.get(ORIENTATION, 1)) for n, d in enumerate(directories(data), 1)]
