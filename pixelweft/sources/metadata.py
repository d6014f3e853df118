"""Metadata of image files: EXIF tags, IPTC records and XMP packets, as maps of text."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of common tags of the main and the EXIF directory, and of records of the IPTC application.
EXIF = {0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x011A: "XResolution", 0x011B: "YResolution", 0x0128: "ResolutionUnit",
        0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "ISOSpeedRatings",
        0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x920A: "FocalLength", 0xA002: "PixelXDimension", 0xA003: "PixelYDimension"}
IPTC = {5: "ObjectName", 15: "Category", 25: "Keywords", 40: "SpecialInstructions", 55: "DateCreated", 80: "Byline", 90: "City", 101: "Country", 105: "Headline", 110: "Credit",
        116: "CopyrightNotice", 120: "Caption"}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}


def parse_exif(data: bytes) -> dict[str, str]:
    """Tags of a TIFF structure's first directory and of its EXIF directory; damaged ones end where the damage is."""
    out: dict[str, str] = {}
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        return out
    todo = [struct.unpack_from(order + "I", data, 4)[0]]
    while todo:
        at = todo.pop()
        if at + 2 > len(data):
            continue
        for k in range(struct.unpack_from(order + "H", data, at)[0]):
            place = at + 2 + 12 * k
            if place + 12 > len(data):
                break
            tag, kind, n = struct.unpack_from(order + "HHI", data, place)
            size = _SIZES.get(kind, 1) * n
            start = place + 8 if size <= 4 else struct.unpack_from(order + "I", data, place + 8)[0]
            if kind not in _SIZES or start + size > len(data):
                continue
            if tag == 0x8769:
                todo.append(struct.unpack_from(order + "I", data, place + 8)[0])
                continue
            name = EXIF.get(tag, f"0x{tag:04X}")
            if kind == 2:
                out[name] = data[start: start + size].split(b"\0")[0].decode("utf-8", "replace")
            elif kind in (5, 10):
                pairs = struct.unpack_from(order + ("II" if kind == 5 else "ii") * n, data, start)
                out[name] = " ".join(f"{a}/{b}" for a, b in zip(pairs[::2], pairs[1::2]))
            elif kind == 7:
                out[name] = data[start: start + size].hex()
            else:
                out[name] = " ".join(map(str, struct.unpack_from(order + _CODES[kind] * n, data, start)))
    return out


def parse_iptc(data: bytes) -> dict[str, str]:
    """Records of the second envelope; repeated ones are parted by ;"""
    out: dict[str, str] = {}
    at = 0
    while at + 5 <= len(data) and data[at] == 0x1C:
        record, number, size = data[at + 1], data[at + 2], struct.unpack_from(">H", data, at + 3)[0]
        if record == 2:
            name, text = IPTC.get(number, f"2:{number}"), data[at + 5: at + 5 + size].decode("utf-8", "replace")
            out[name] = f"{out[name]};{text}" if name in out else text
        at += 5 + size
    return out


def _segments(data: bytes):
    """(kind, content) of what a file holds beside its pixels: exif, iptc or xmp."""
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4: at + 2 + size]
            if data[at + 1] == 0xE1 and body.startswith(b"Exif\0\0"):
                yield "exif", body[6:]
            elif data[at + 1] == 0xE1 and body.startswith(b"http://ns.adobe.com/xap/1.0/\0"):
                yield "xmp", body.split(b"\0", 1)[1]
            elif data[at + 1] == 0xED and body.startswith(b"Photoshop 3.0\0"):
                yield from (("iptc", x) for x in _resources(body[14:]))
            at += 2 + size
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size, kind = struct.unpack_from(">I4s", data, at)
            body = data[at + 8: at + 8 + size]
            if kind == b"eXIf":
                yield "exif", body
            elif kind == b"iTXt" and body.startswith(b"XML:com.adobe.xmp\0"):
                yield "xmp", body[18 + 2:].split(b"\0", 2)[-1]
            at += 12 + size
    elif data[:4] in (b"II*\0", b"MM\0*"):
        yield "exif", data


def _resources(data: bytes):
    """IPTC blocks among the image resources."""
    at = 0
    while data[at: at + 4] == b"8BIM" and at + 12 <= len(data):
        kind = struct.unpack_from(">H", data, at + 4)[0]
        at += 6 + (data[at + 6] + 2) // 2 * 2
        size = struct.unpack_from(">I", data, at)[0]
        if kind == 0x0404:
            yield data[at + 4: at + 4 + size]
        at += 4 + size + size % 2


def read(data: bytes) -> tuple[dict[str, str], dict[str, str], str | None]:
    """EXIF, IPTC and the XMP packet of a file."""
    exif, iptc, xmp = {}, {}, None
    for kind, body in _segments(data):
        if kind == "exif":
            exif |= parse_exif(body)
        elif kind == "iptc":
            iptc |= parse_iptc(body)
        else:
            xmp = body.decode("utf-8", "replace")
    return exif, iptc, xmp


def metadata(files: DataFrame) -> DataFrame:
    """files(image_id, content) -> image_id, exif and iptc (maps of text), xmp (null where there is none). Null content has none."""
    def run(batches):
        import pyarrow as pa

        texts = pa.map_(pa.string(), pa.string())
        for batch in batches:
            found = [read(x) if x is not None else ({}, {}, None) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([list(f[k].items()) for f in found], texts) for k in (0, 1)], pa.array([f[2] for f in found], pa.string())],
                                             ["image_id", "exif", "iptc", "xmp"])

    return files.select(F.col("image_id").cast("long").alias("image_id"), "content").mapInArrow(run, "image_id long, exif map<string,string>, iptc map<string,string>, xmp string")
