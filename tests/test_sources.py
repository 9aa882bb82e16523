"""Files in: kinds, pages of images, storage by hash."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from dateloom.sources import ingest
from dateloom.sources.frames import image_frames


def tiff(order, *pages):
    """Directories of (width, height, orientation or None), chained."""
    out = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 8)
    for i, (width, height, turn) in enumerate(pages):
        tags = [(256, 4, width), (257, 3, height), *([(274, 3, turn)] if turn else [])]
        body = struct.pack(f"{order}H", len(tags))
        for tag, kind, value in tags:
            body += struct.pack(f"{order}HHI", tag, kind, 1) + (struct.pack(f"{order}HH", value, 0) if kind == 3 else struct.pack(f"{order}I", value))
        following = len(out) + len(body) + 4 if i + 1 < len(pages) else 0
        out += body + struct.pack(f"{order}I", following)
    return out


def jpeg(width, height, turn=None):
    segment = lambda marker, body: bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body
    exif = segment(0xE1, b"Exif\0\0" + tiff(">", (1, 1, turn))) if turn else b""
    return b"\xff\xd8" + exif + segment(0xC4, b"x") + segment(0xC0, struct.pack(">BHHB", 8, height, width, 3)) + b"\xff\xda\0\0"


PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 30, 20)


def test_pages_of_images():
    assert image_frames(PNG) == [(1, 30, 20, 1)]
    assert image_frames(jpeg(40, 10)) == [(1, 40, 10, 1)] and image_frames(jpeg(40, 10, 6)) == [(1, 10, 40, 6)]
    for order in "<>":
        assert image_frames(tiff(order, (70_000, 20, None), (30, 40, 8), (5, 6, 3))) == [(1, 70_000, 20, 1), (2, 40, 30, 8), (3, 5, 6, 3)]


def test_broken_images_end_early():
    whole = tiff("<", (3, 4, None), (5, 6, None))
    assert image_frames(whole[:40]) == [(1, 3, 4, 1)] and image_frames(b"") == [] and image_frames(b"\xff\xd8\xff") == []
    looped = whole[:-4] + struct.pack("<I", 8)
    assert len(image_frames(looped)) == 2 and all(image_frames(whole[:n]) is not None for n in range(len(whole)))


def test_files_are_stored_once_by_hash(spark, tmp_path):
    rows = [("a/x.png", PNG), ("b/y.png", PNG), ("z.tif", tiff("<", (3, 4, 6))), ("no.txt", b"text")]
    files = ingest.with_identity(spark.createDataFrame(rows, "path string, content binary"))
    for _ in range(2):
        stored = ingest.store_files(files, str(tmp_path)).collect()
        assert sorted(p.name for p in tmp_path.iterdir()) == sorted(f"{r.sha256}.{r.kind}" for r in stored) and len(stored) == 2
    assert {p.read_bytes() for p in tmp_path.iterdir()} == {PNG, rows[2][1]}
    pages = files.select("path", F.explode(ingest.frames(F.col("content"))).alias("f")).select("path", "f.*").collect()
    assert sorted(map(tuple, pages)) == [("a/x.png", 1, 30, 20, 1), ("b/y.png", 1, 30, 20, 1), ("z.tif", 1, 4, 3, 6)]
