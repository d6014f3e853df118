import numpy as np
import pytest

from pixelweft.sources import codecs as C


def picture(bands, top=255, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, top + 1, (7, 13, bands))
    a[2:5, 3:9] = a[2, 3]
    return a


@pytest.mark.parametrize("name,bands", [("pnm", 1), ("pnm", 2), ("pnm", 3), ("pnm", 4), ("bmp", 3), ("bmp", 4), ("tga", 1), ("tga", 3), ("tga", 4), ("qoi", 3), ("qoi", 4),
                                        ("png", 1), ("png", 2), ("png", 3), ("png", 4), ("fits", 1), ("fits", 3), ("nifti", 1), ("nifti", 3)])
def test_round_trip(name, bands):
    a = picture(bands)
    data = C.ENCODERS[name](a)
    assert C.sniff(data) == name
    assert (C.DECODERS[name](data) == a).all()


@pytest.mark.parametrize("name", ["pnm", "png"])
def test_sixteen_bits(name):
    a = picture(3, 65535)
    assert (C.DECODERS[name](C.ENCODERS[name](a)) == a).all()


def test_hdr_is_close():
    a = np.random.default_rng(1).random((5, 9, 3)) * 7
    b = C.decode_hdr(C.encode_hdr(a))
    assert np.abs(a - b).max() <= 7 / 128


def test_plain_and_packed_bits():
    assert C.decode_pnm(b"P1\n# note\n3 2\n1 0 1\n0 1 0\n")[:, :, 0].tolist() == [[0, 255, 0], [255, 0, 255]]
    assert C.decode_pnm(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000]))[:, :, 0].tolist() == [[0, 255, 0], [255, 0, 255]]
    assert C.decode_pnm(b"P2 2 1 15 15 7")[:, :, 0].tolist() == [[255, 7 * 255 // 15]]


def test_tables(spark, tmp_path):
    a, b = picture(3), picture(3, seed=1)
    rows = [(k, x, y, c, float(p[y, x, c])) for k, p in enumerate((a, b)) for y in range(7) for x in range(13) for c in range(3)]
    pixels = spark.createDataFrame(rows, "image_id int, x int, y int, band int, v double")
    for name in ("png", "qoi", "bmp"):
        files = C.encode(pixels, name)
        assert {r.format for r in C.identify(files).collect()} == {name}
        assert sorted(map(tuple, C.decode(files).collect())) == sorted(rows)
    for r in C.encode(pixels, "pnm").collect():
        (tmp_path / f"{r.image_id}.ppm").write_bytes(r.content)
    assert C.load(spark, str(tmp_path)).count() == len(rows)
    (tmp_path / "m.csv").write_text("# note\n1, 2;300\n-4 5.9\t6\n")
    got = sorted((r.y, r.x, r.v) for r in C.read_csv_matrix(spark, str(tmp_path / "m.csv")).collect())
    assert got == [(0, 0, 1.0), (0, 1, 2.0), (0, 2, 255.0), (1, 0, 0.0), (1, 1, 5.0), (1, 2, 6.0)]


@pytest.mark.parametrize("bands", [1, 2, 3, 4])
def test_tiff_round_trip(bands):
    for a in (picture(bands), picture(bands, 60000), picture(bands) / 8.0):
        assert C.sniff(C.encode_tiff(a)) == "tiff" and (C.decode_tiff(C.encode_tiff(a)) == a).all()


def test_tiff_of_other_kinds():
    """Big-endian, PackBits, two strips, white is 0."""
    import struct
    rows = [bytes((1, 2, 3, 3, 3, 3)), bytes((9, 9, 9, 9, 9, 9))]
    strips = [bytes((2, 1, 2, 3, 254, 3)), bytes((251, 9))]
    fields = [(256, 6), (257, 2), (258, 8), (259, 32773), (262, 0), (273, None), (277, 1), (278, 1), (279, None)]
    at = 8 + 2 + 12 * len(fields) + 4
    where = {273: at, 279: at + 8}
    body = b"MM\0*" + struct.pack(">IH", 8, len(fields))
    for tag, v in fields:
        body += struct.pack(">HHII", tag, 4, 2, where[tag]) if v is None else struct.pack(">HHIHH", tag, 3, 1, v, 0)
    body += struct.pack(">I", 0) + struct.pack(">II", at + 16, at + 22) + struct.pack(">II", 6, 2) + strips[0] + strips[1]
    assert C.decode_tiff(body)[:, :, 0].tolist() == [[255 - v for v in r] for r in rows]


def test_gif():
    a = picture(3) // 64 * 64
    assert C.sniff(C.encode_gif(a)) == "gif" and (C.decode_gif(C.encode_gif(a))[:, :, :3] == a).all()
    many = np.random.default_rng(2).integers(0, 256, (90, 80, 3))
    assert np.abs(C.decode_gif(C.encode_gif(many))[:, :, :3] - many).max() <= 26
    clear = np.concatenate((a, np.where(a[:, :, :1] > 100, 255, 0)), 2)
    got = C.decode_gif(C.encode_gif(clear))
    assert (got[:, :, 3] == clear[:, :, 3]).all() and (got[got[:, :, 3] > 0] == clear[clear[:, :, 3] > 0]).all()
    # A picture of 10 x 10 in white, red and blue that is often given as an example of the format.
    sample = bytes.fromhex("47494638396 10a000a009100 00ffffffff00000000ff000000 21f9040000000000 2c000000000a000a0000 02168c2d99872a1cdc33a00275ec95faa8de608c0491 4c01 003b".replace(" ", ""))
    got = C.decode_gif(sample)
    assert got.shape == (10, 10, 4) and got[0, 0, :3].tolist() == [255, 0, 0] and got[0, 9, :3].tolist() == [0, 0, 255] and got[4, 4, :3].tolist() == [255, 255, 255]


def test_jpeg_is_close():
    y, x = np.mgrid[:45, :61]
    a = np.stack((x * 4, y * 5, x + y), 2).astype(float)
    for b in (a, a[:, :, :1]):
        got = C.decode_jpeg(C.encode_jpeg(b, 95))
        assert C.sniff(C.encode_jpeg(b)) == "jpeg" and got.shape == b.shape and np.abs(got - b).max() <= 4
    noise = np.random.default_rng(3).integers(0, 256, (24, 40, 1))
    assert np.abs(C.decode_jpeg(C.encode_jpeg(noise, 100)) - noise).max() <= 3


def test_bmp_of_few_colours():
    import struct
    palette = bytes((0, 0, 255, 0, 0, 255, 0, 0, 255, 0, 0, 0, 9, 9, 9, 0))
    head = lambda depth, packed, body, w=5, h=2: b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + 16) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, depth, packed, len(body), 0, 0, 4, 0) + palette + body
    red, green, blue, grey = [255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9]
    want = [[grey, grey, red, red, red], [red, green, blue, blue, blue]]
    assert C.decode_bmp(head(8, 0, bytes((0, 1, 2, 2, 2, 0, 0, 0, 3, 3, 0, 0, 0, 0, 0, 0)))).tolist() == want
    assert C.decode_bmp(head(4, 0, bytes((0x01, 0x22, 0x20, 0, 0x33, 0, 0, 0)))).tolist() == want
    assert C.decode_bmp(head(8, 1, bytes((0, 3, 0, 1, 2, 0, 2, 2, 0, 0, 2, 3, 3, 0, 0, 1)))).tolist() == want
    assert C.decode_bmp(head(4, 2, bytes((2, 0x01, 3, 0x22, 0, 0, 2, 0x33, 3, 0, 0, 1)))).tolist() == want
    assert C.decode_bmp(head(1, 0, bytes((0b01111000, 0, 0, 0, 0b11000000, 0, 0, 0)))).tolist() == [[green, green, red, red, red], [red, green, green, green, green]]


def test_tga_with_a_palette():
    import struct
    head = struct.pack("<BBBHHBHHHHBB", 0, 1, 9, 0, 3, 24, 0, 0, 4, 2, 8, 0x20)
    data = head + bytes((0, 0, 255, 0, 255, 0, 255, 0, 0)) + bytes((0x83, 2, 0x01, 0, 1, 0x81, 1))
    assert C.sniff(data) == "tga"
    assert C.decode_tga(data).tolist() == [[[0, 0, 255]] * 4, [[255, 0, 0], [0, 255, 0], [0, 255, 0], [0, 255, 0]]]


@pytest.mark.parametrize("depth", [1, 2, 4, 8, 16])
def test_interlaced_png(depth):
    import struct
    import zlib
    a = np.random.default_rng(depth).integers(0, 1 << depth, (11, 13))
    raw = b""
    for x, dx, y, dy in C._PASSES:
        for row in a[y::dy, x::dx]:
            if len(row):
                bits = (row[:, None] >> np.arange(depth)[::-1] & 1).astype(np.uint8).reshape(-1)
                raw += b"\0" + np.packbits(bits).tobytes()
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    data = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 13, 11, depth, 0, 0, 0, 1)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")
    assert (C.decode_png(data)[:, :, 0] == a * (255 // ((1 << depth) - 1) if depth < 8 else 1)).all()
