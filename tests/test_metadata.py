import struct

import numpy as np

from pixelweft.sources import codecs, metadata


def exif(order):
    """Orientation 6, a make of more than four bytes, and an exposure in the second directory."""
    o = {"<": b"II*\0", ">": b"MM\0*"}[order]
    make, second, ratio = 8 + 2 + 36 + 4, 8 + 2 + 36 + 4 + 8, 8 + 2 + 36 + 4 + 8 + 2 + 12 + 4
    body = o + struct.pack(order + "IH", 8, 3)
    body += struct.pack(order + "HHII", 0x010F, 2, 7, make) + struct.pack(order + "HHIHH", 0x0112, 3, 1, 6, 0) + struct.pack(order + "HHII", 0x8769, 4, 1, second) + struct.pack(order + "I", 0)
    body += b"Camera\0\0" + struct.pack(order + "HHHIII", 1, 0x829A, 5, 1, ratio, 0) + struct.pack(order + "II", 1, 250)
    return body


def test_exif_of_either_order():
    for order in "<>":
        assert metadata.parse_exif(exif(order)) == {"Make": "Camera", "Orientation": "6", "ExposureTime": "1/250"}
    assert metadata.parse_exif(b"II*\0\xff\xff\xff\xff") == {} and metadata.parse_exif(b"") == {}


def test_files_of_a_table(spark):
    part = lambda kind, body: bytes((0xFF, kind)) + struct.pack(">H", len(body) + 2) + body
    record = lambda n, text: struct.pack(">BBBH", 0x1C, 2, n, len(text)) + text
    iptc = record(25, b"sea") + record(25, b"sky") + record(120, b"A view")
    blocks = b"Photoshop 3.0\0" + b"8BIM" + struct.pack(">HH", 0x0404, 0) + struct.pack(">I", len(iptc)) + iptc
    plain = codecs.encode_jpeg(np.zeros((8, 8, 1)))
    full = plain[:2] + part(0xE1, b"Exif\0\0" + exif(">")) + part(0xE1, b"http://ns.adobe.com/xap/1.0/\0<x/>") + part(0xED, blocks) + plain[2:]
    files = spark.createDataFrame([(1, bytearray(full)), (2, bytearray(plain)), (3, None)], "image_id int, content binary")
    got = {r.image_id: (r.exif, r.iptc, r.xmp) for r in metadata.metadata(files).collect()}
    assert got[1] == ({"Make": "Camera", "Orientation": "6", "ExposureTime": "1/250"}, {"Keywords": "sea;sky", "Caption": "A view"}, "<x/>")
    assert got[2] == ({}, {}, None) and got[3] == ({}, {}, None)
    assert codecs.decode_jpeg(full).shape == (8, 8, 1)
