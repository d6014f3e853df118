"""Image files as pixel tables and back.

Files are scanned with Spark's binaryFile source (or come as a column of bytes), recognised by their first bytes, and
decoded by NumPy a file at a time in Arrow batches. Encoders give a table (image_id, content) to write with any sink.
Formats: PNM (P1 to P7), BMP, QOI, TGA, PNG (interlaced too), GIF, TIFF, JPEG (baseline), HDR, FITS, NIfTI-1.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.arrays import PIXELS, to_array, to_rows
from .formats import decode_gif, decode_jpeg, decode_tiff, encode_gif, encode_jpeg, encode_tiff


def sniff(data: bytes) -> str | None:
    """Format of a file by its first bytes; None if it isn't known."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "png"
    if data[:1] == b"P" and data[1:2] in b"1234567" and len(data) > 2:
        return "pnm"
    for magic, name in ((b"BM", "bmp"), (b"qoif", "qoi"), (b"#?RADIANCE", "hdr"), (b"#?RGBE", "hdr"), (b"SIMPLE  =", "fits"), (b"\xff\xd8\xff", "jpeg"),
                        (b"GIF8", "gif"), (b"II*\0", "tiff"), (b"MM\0*", "tiff"), (b"II+\0", "tiff"), (b"%PDF", "pdf")):
        if data.startswith(magic):
            return name
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    if len(data) >= 352 and data[344:348] in (b"n+1\0", b"ni1\0"):
        return "nifti"
    if len(data) > 18 and data[1] in (0, 1) and data[2] in (1, 2, 3, 9, 10, 11) and data[16] in (8, 24, 32):
        return "tga"
    return None


# ---------------------------------------------------------------- PNM

def _tokens(data: bytes, at: int, n: int) -> tuple[list[int], int]:
    """n whole numbers of a PNM header, comments skipped, and the place after the blank that ends them."""
    out = []
    while len(out) < n:
        while data[at: at + 1].isspace() or data[at: at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at: at + 1] == b"#" else at + 1
        end = at
        while end < len(data) and not data[end: end + 1].isspace():
            end += 1
        out.append(int(data[at:end]))
        at = end
    return out, at + 1


def decode_pnm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    if kind == 7:
        header, _, body = data.partition(b"ENDHDR\n")
        fields = dict(line.split(None, 1) for line in header.decode().splitlines()[1:] if line and not line.startswith("#") and " " in line)
        w, h, bands, top = (int(fields[k]) for k in ("WIDTH", "HEIGHT", "DEPTH", "MAXVAL"))
        at, data = 0, body
    else:
        bands = 3 if kind in (3, 6) else 1
        (w, h, *rest), at = _tokens(data, 2, 2 if kind in (1, 4) else 3)
        top = rest[0] if rest else 1
    n = w * h * bands
    if kind == 1:
        bits = [c - 48 for c in data[at - 1:] if c in b"01"][:n]
        return np.where(np.array(bits).reshape(h, w, 1) == 1, 0, 255)
    if kind == 4:
        rows = np.frombuffer(data, np.uint8, h * -(-w // 8), at).reshape(h, -1)
        return np.where(np.unpackbits(rows, axis=1)[:, :w, None] == 1, 0, 255)
    if kind in (2, 3):
        values = np.array(data[at - 1:].split()[:n], int)
    else:
        values = np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at).astype(int)
    return (values * (65535 if top > 255 else 255) // top).reshape(h, w, bands)


def encode_pnm(a: np.ndarray) -> bytes:
    """PGM for one band, PPM for three, PAM for two or four; 16 bits where a value is above 255."""
    h, w, bands = a.shape
    a = np.rint(a)
    deep = bool(a.max(initial=0) > 255)
    top = 65535 if deep else 255
    body = np.clip(a, 0, top).astype(">u2" if deep else np.uint8).tobytes()
    if bands in (1, 3):
        return f"P{5 if bands == 1 else 6}\n{w} {h}\n{top}\n".encode() + body
    kind = {2: "GRAYSCALE_ALPHA", 4: "RGB_ALPHA"}.get(bands, "UNKNOWN")
    return f"P7\nWIDTH {w}\nHEIGHT {h}\nDEPTH {bands}\nMAXVAL {top}\nTUPLTYPE {kind}\nENDHDR\n".encode() + body


# ---------------------------------------------------------------- BMP, TGA

def decode_bmp(data: bytes) -> np.ndarray:
    """1, 4, 8, 16 (5 bits a band), 24 and 32 bits; run lengths of 4 and 8 bits."""
    start, size, w, h, _, depth, packed = (*struct.unpack_from("<I", data, 10), *struct.unpack_from("<IiiHHI", data, 14))
    if packed not in (0, 1, 2, 3):
        raise ValueError(f"BMP of compression {packed}")
    top, h = h < 0, abs(h)
    if depth <= 8:
        used = struct.unpack_from("<I", data, 46)[0] or 1 << depth
        palette = np.zeros((256, 3), int)
        palette[:used] = np.frombuffer(data, np.uint8, 4 * used, 14 + size).reshape(-1, 4)[:, 2::-1]
        if packed:
            index = _bmp_runs(data[start:], w, h, depth)
        else:
            stride = (w * depth + 31) // 32 * 4
            rows = np.frombuffer(data, np.uint8, stride * h, start).reshape(h, stride)
            bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)[:, :w]
            index = (bits * (1 << np.arange(depth)[::-1])).sum(2)
        out = palette[index]
    elif depth == 16:
        stride = (2 * w + 3) // 4 * 4
        rows = np.frombuffer(data, np.uint8, stride * h, start).reshape(h, stride)[:, : 2 * w].copy().view("<u2").astype(int)
        masks = struct.unpack_from("<III", data, 54) if packed == 3 else (0x7C00, 0x3E0, 0x1F)
        out = np.stack([(rows & m) // (m & -m) * 255 // (m // (m & -m)) for m in masks], 2)
    else:
        n = depth // 8
        stride = (w * n + 3) // 4 * 4
        rows = np.frombuffer(data, np.uint8, stride * h, start).reshape(h, stride)[:, : w * n].reshape(h, w, n)
        out = rows[:, :, [2, 1, 0, 3][:n]].astype(int)
    return out if top else out[::-1]


def _bmp_runs(data: bytes, w: int, h: int, depth: int) -> np.ndarray:
    """Palette indices, lowest row first: runs, literal stretches, ends of lines and jumps."""
    out, x, y, at = np.zeros((h, w), int), 0, 0, 0

    def nibbles(part: bytes) -> list[int]:
        return list(part) if depth == 8 else [n for c in part for n in (c >> 4, c & 15)]

    def put(values: list[int]) -> None:
        nonlocal x
        values = values[: max(0, w - x)]
        if y < h:
            out[y, x: x + len(values)] = values
        x += len(values)

    while at + 1 < len(data):
        n, what = data[at], data[at + 1]
        at += 2
        if n:
            put((nibbles(bytes((what,))) * n)[:n])
        elif what == 0:
            x, y = 0, y + 1
        elif what == 1:
            break
        elif what == 2:
            x, y, at = x + data[at], y + data[at + 1], at + 2
        else:
            size = what if depth == 8 else (what + 1) // 2
            put(nibbles(data[at: at + size])[:what])
            at += size + size % 2
    return out


def encode_bmp(a: np.ndarray) -> bytes:
    h, w, bands = a.shape
    a = np.clip(np.rint(a), 0, 255).astype(np.uint8)
    a = np.repeat(a, 3, 2) if bands == 1 else a
    n = 4 if a.shape[2] == 4 else 3
    rows = a[::-1, :, [2, 1, 0, 3][:n]].reshape(h, w * n)
    body = np.pad(rows, ((0, 0), (0, -w * n % 4))).tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 * n, 0, len(body), 2835, 2835, 0, 0) + body


def decode_tga(data: bytes) -> np.ndarray:
    """Palette, colour and grey, plain or in runs."""
    skip, mapped, kind, w, h, depth, flags = data[0], data[1], data[2], *struct.unpack_from("<HH", data, 12), data[16], data[17]
    first, entries, entry = struct.unpack_from("<HHB", data, 3)
    n, at, want = depth // 8, 18 + skip, w * h * (depth // 8)
    palette = None
    if mapped:
        wide = entry // 8
        palette = np.zeros((first + entries, wide), int)
        palette[first:] = np.frombuffer(data, np.uint8, entries * wide, at).reshape(entries, wide)
        at += entries * wide
    if kind < 8:
        flat = np.frombuffer(data, np.uint8, want, at)
    else:
        out = bytearray()
        while len(out) < want:
            k = (data[at] & 127) + 1
            if data[at] & 128:
                out += data[at + 1: at + 1 + n] * k
                at += 1 + n
            else:
                out += data[at + 1: at + 1 + n * k]
                at += 1 + n * k
        flat = np.frombuffer(bytes(out[:want]), np.uint8)
    a = flat.reshape(h, w, n)
    a = a if flags & 0x20 else a[::-1]
    a = palette[a[:, :, 0]] if kind & 7 == 1 and palette is not None else a
    return a[:, :, [2, 1, 0, 3][: a.shape[2]] if a.shape[2] > 1 else [0]].astype(int)


def encode_tga(a: np.ndarray) -> bytes:
    h, w, bands = a.shape
    a = np.clip(np.rint(a), 0, 255).astype(np.uint8)
    n = {1: 1, 3: 3, 4: 4}[bands]
    return struct.pack("<BBBHHBHHHHBB", 0, 0, 3 if n == 1 else 2, 0, 0, 0, 0, 0, w, h, 8 * n, 0x20 | (8 if n == 4 else 0)) + a[:, :, [2, 1, 0, 3][:n] if n > 1 else [0]].tobytes()


# ---------------------------------------------------------------- QOI

def decode_qoi(data: bytes) -> np.ndarray:
    w, h, bands = struct.unpack_from(">IIB", data, 4)
    out, seen, pixel, at, run = np.zeros((w * h, 4), np.uint8), [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), 14, 0
    for i in range(w * h):
        if run:
            run -= 1
        else:
            op = data[at]
            at += 1
            r, g, b, a = pixel
            if op == 254:
                pixel = (*data[at: at + 3], a)
                at += 3
            elif op == 255:
                pixel = tuple(data[at: at + 4])
                at += 4
            elif op >> 6 == 0:
                pixel = seen[op]
            elif op >> 6 == 1:
                pixel = (r + (op >> 4 & 3) - 2) & 255, (g + (op >> 2 & 3) - 2) & 255, (b + (op & 3) - 2) & 255, a
            elif op >> 6 == 2:
                k, more = (op & 63) - 32, data[at]
                at += 1
                pixel = (r + k - 8 + (more >> 4)) & 255, (g + k) & 255, (b + k - 8 + (more & 15)) & 255, a
            else:
                run = op & 63
            r, g, b, a = pixel
            seen[(3 * r + 5 * g + 7 * b + 11 * a) % 64] = pixel
        out[i] = pixel
    return out.reshape(h, w, 4)[:, :, :bands].astype(int)


def encode_qoi(a: np.ndarray) -> bytes:
    h, w, bands = a.shape
    a = np.clip(np.rint(a), 0, 255).astype(np.uint8)
    a = np.repeat(a, 3, 2) if bands == 1 else a
    n = a.shape[2]
    rgba = np.concatenate((a, np.full((h, w, 4 - n), 255, np.uint8)), 2).reshape(-1, 4).tolist()
    out, seen, last, run = bytearray(b"qoif" + struct.pack(">IIBB", w, h, n, 0)), [None] * 64, (0, 0, 0, 255), 0
    for p in map(tuple, rgba):
        if p == last:
            run += 1
            if run == 62:
                out.append(0xC0 | 61)
                run = 0
            continue
        if run:
            out.append(0xC0 | run - 1)
            run = 0
        k = (3 * p[0] + 5 * p[1] + 7 * p[2] + 11 * p[3]) % 64
        if seen[k] == p:
            out.append(k)
        else:
            seen[k] = p
            dr, dg, db = ((p[i] - last[i] + 128 & 255) - 128 for i in range(3))
            if p[3] != last[3]:
                out += bytes((255, *p))
            elif -2 <= dr <= 1 and -2 <= dg <= 1 and -2 <= db <= 1:
                out.append(64 | dr + 2 << 4 | dg + 2 << 2 | db + 2)
            elif -32 <= dg <= 31 and -8 <= dr - dg <= 7 and -8 <= db - dg <= 7:
                out += bytes((128 | dg + 32, dr - dg + 8 << 4 | db - dg + 8))
            else:
                out += bytes((254, *p[:3]))
        last = p
    if run:
        out.append(0xC0 | run - 1)
    return bytes(out + b"\0" * 7 + b"\1")


# ---------------------------------------------------------------- PNG

def _png_rows(raw: np.ndarray, w: int, h: int, bands: int, depth: int) -> np.ndarray:
    """Samples [y, x, band] of filtered rows."""
    step, line = max(1, bands * depth // 8), -(-w * bands * depth // 8)
    out, above = np.zeros((h, line), np.uint8), np.zeros(line, np.uint8)
    for y, (how, row) in enumerate(zip(raw.reshape(h, 1 + line)[:, 0], raw.reshape(h, 1 + line)[:, 1:])):
        if how == 1:
            padded = np.pad(row, (0, -line % step)).reshape(-1, step)
            row = np.cumsum(padded, 0, dtype=np.uint8).reshape(-1)[:line]
        elif how == 2:
            row = row + above
        elif how:
            now, up, was = bytearray(row.tobytes()), above.tolist(), row.tolist()
            for i in range(line):
                a, b, c = (now[i - step] if i >= step else 0), up[i], (up[i - step] if i >= step else 0)
                if how == 3:
                    guess = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                now[i] = was[i] + guess & 255
            row = np.frombuffer(bytes(now), np.uint8)
        out[y] = above = row
    if depth == 16:
        return out.view(">u2").reshape(h, w, bands).astype(int)
    if depth == 8:
        return out.reshape(h, w, bands).astype(int)
    bits = np.unpackbits(out, axis=1)[:, : w * bands * depth].reshape(h, w, bands, depth)
    return (bits * (1 << np.arange(depth)[::-1])).sum(3)


#: First place and step along x and y of the seven interlaced passes. Fixed values.
_PASSES = ((0, 8, 0, 8), (4, 8, 0, 8), (0, 4, 4, 8), (2, 4, 0, 4), (0, 2, 2, 4), (1, 2, 0, 2), (0, 1, 1, 2))


def decode_png(data: bytes) -> np.ndarray:
    """1 to 16 bits, grey, colour, palette, alpha, interlaced too. Grey of under 8 bits is spread to 0..255."""
    at, body, palette, clear = 8, b"", None, None
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8: at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = part
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    bands = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw, a, done = np.frombuffer(zlib.decompress(body), np.uint8), np.zeros((h, w, bands), int), 0
    for x, dx, y, dy in _PASSES if laced else ((0, 1, 0, 1),):
        pw, ph = len(range(x, w, dx)), len(range(y, h, dy))
        if pw and ph:
            size = ph * (1 + -(-pw * bands * depth // 8))
            a[y::dy, x::dx] = _png_rows(raw[done: done + size], pw, ph, bands, depth)
            done += size
    if colour == 3:
        index = a[:, :, 0]
        a = palette[index].astype(int)
        if clear is not None:
            alpha = np.full(256, 255)
            alpha[: len(clear)] = list(clear)
            a = np.concatenate((a, alpha[index][:, :, None]), 2)
    elif clear is not None:  # one colour is clear
        gone = (a == np.frombuffer(clear, ">u2")[:bands]).all(2)
        a = np.concatenate((a, np.where(gone, 0, 65535 if depth == 16 else (1 << depth) - 1)[:, :, None]), 2)
    return a * (255 // ((1 << depth) - 1)) if depth < 8 and colour != 3 else a


def encode_png(a: np.ndarray) -> bytes:
    h, w, bands = a.shape
    deep = bool(np.rint(a).max(initial=0) > 255)
    body = np.clip(np.rint(a), 0, 65535 if deep else 255).astype(">u2" if deep else np.uint8).reshape(h, -1).view(np.uint8)

    def part(kind: bytes, content: bytes) -> bytes:
        return struct.pack(">I", len(content)) + kind + content + struct.pack(">I", zlib.crc32(kind + content))

    head = struct.pack(">IIBBBBB", w, h, 16 if deep else 8, {1: 0, 2: 4, 3: 2, 4: 6}[bands], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(np.pad(body, ((0, 0), (1, 0))).tobytes())) + part(b"IEND", b"")


# ---------------------------------------------------------------- FITS, NIfTI, HDR

_FITS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def decode_fits(data: bytes) -> np.ndarray:
    at, cards = 0, {}
    while "END" not in cards:
        for k in range(36):
            card = data[at + 80 * k: at + 80 * k + 80].decode("ascii")
            cards[card[:8].strip()] = card[10:].split("/")[0].strip() if card[8:10] == "= " else ""
            if card.startswith("END"):
                break
        at += 2880
    shape = [int(cards[f"NAXIS{i}"]) for i in range(int(cards["NAXIS"]), 0, -1)]
    a = np.frombuffer(data, _FITS[int(cards["BITPIX"])], int(np.prod(shape)), at).reshape(shape).astype(float)
    a = a * float(cards.get("BSCALE") or 1) + float(cards.get("BZERO") or 0)
    if a.ndim == 2:
        return a[:, :, None]
    return np.moveaxis(a, 0, 2) if a.ndim == 3 and len(a) in (1, 3, 4) else a.reshape(-1, a.shape[-1], 1)


def encode_fits(a: np.ndarray) -> bytes:
    h, w, bands = a.shape
    cards = ["SIMPLE  =                    T", "BITPIX  =                  -64", f"NAXIS   = {3 if bands > 1 else 2:>20}", f"NAXIS1  = {w:>20}", f"NAXIS2  = {h:>20}"]
    cards += [f"NAXIS3  = {bands:>20}"] if bands > 1 else []
    head = "".join(c.ljust(80) for c in [*cards, "END"]).encode()
    body = np.moveaxis(a, 2, 0).astype(">f8").tobytes()
    return head.ljust(-(-len(head) // 2880) * 2880) + body.ljust(-(-len(body) // 2880) * 2880, b"\0")


_NIFTI = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def decode_nifti(data: bytes) -> np.ndarray:
    order = "<" if 1 <= struct.unpack_from("<h", data, 40)[0] <= 7 else ">"
    dims = struct.unpack_from(order + "8h", data, 40)
    w, h, d = (max(1, n) if i < dims[0] else 1 for i, n in enumerate(dims[1:4]))
    kind, = struct.unpack_from(order + "h", data, 70)
    start, slope, add = struct.unpack_from(order + "3f", data, 108)
    a = np.frombuffer(data, order + _NIFTI[kind], w * h * d, int(start)).reshape(d, h, w).astype(float)
    a = a * (slope or 1) + (add if slope else 0)
    return np.moveaxis(a, 0, 2) if d <= 4 else a.reshape(-1, w, 1)


def encode_nifti(a: np.ndarray) -> bytes:
    h, w, bands = a.shape
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, w, h, bands, 1, 1, 1, 1)
    struct.pack_into("<hh", head, 70, 64, 64)
    struct.pack_into("<8f", head, 76, *[1.0] * 8)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    head[344:348] = b"n+1\0"
    return bytes(head) + np.moveaxis(a, 2, 0).astype("<f8").tobytes()


def decode_hdr(data: bytes) -> np.ndarray:
    head, _, rest = data.partition(b"\n\n")
    size, _, body = rest.partition(b"\n")
    words = size.decode().split()
    h, w, at, rows = int(words[1]), int(words[3]), 0, []
    for _ in range(h):
        if 8 <= w < 32768 and body[at: at + 2] == b"\2\2":
            at, planes = at + 4, []
            for _ in range(4):
                line = bytearray()
                while len(line) < w:
                    n = body[at]
                    if n > 128:
                        line += body[at + 1: at + 2] * (n - 128)
                        at += 2
                    else:
                        line += body[at + 1: at + 1 + n]
                        at += 1 + n
                planes.append(np.frombuffer(bytes(line), np.uint8))
            rows.append(np.stack(planes, 1))
        else:
            rows.append(np.frombuffer(body, np.uint8, 4 * w, at).reshape(w, 4))
            at += 4 * w
    p = np.stack(rows).astype(float)
    a = np.where(p[:, :, 3:] > 0, p[:, :, :3] * 2.0 ** (p[:, :, 3:] - 136), 0)
    a = a[::-1] if words[0] == "+Y" else a
    return a[:, ::-1] if words[2] == "-X" else a


def encode_hdr(a: np.ndarray) -> bytes:
    h, w, _ = a.shape
    top = a.max(2)
    _, e = np.frexp(top)
    scale = np.where(top > 1e-32, 256.0 / 2.0 ** e, 0)[:, :, None]
    p = np.concatenate((np.clip(a * scale, 0, 255), np.where(top > 1e-32, e + 128, 0)[:, :, None]), 2).astype(np.uint8)
    return f"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y {h} +X {w}\n".encode() + p.tobytes()


DECODERS = {"pnm": decode_pnm, "bmp": decode_bmp, "tga": decode_tga, "qoi": decode_qoi, "png": decode_png, "fits": decode_fits, "nifti": decode_nifti, "hdr": decode_hdr,
            "gif": decode_gif, "tiff": decode_tiff, "jpeg": decode_jpeg}
ENCODERS = {"pnm": encode_pnm, "bmp": encode_bmp, "tga": encode_tga, "qoi": encode_qoi, "png": encode_png, "fits": encode_fits, "nifti": encode_nifti, "hdr": encode_hdr,
            "gif": encode_gif, "tiff": encode_tiff, "jpeg": encode_jpeg}


def register(name: str, decoder=None, encoder=None) -> None:
    """Add or replace a format; `sniff` must know it, or it is asked for by name."""
    if decoder:
        DECODERS[name] = decoder
    if encoder:
        ENCODERS[name] = encoder


def identify(files: DataFrame) -> DataFrame:
    """files(image_id, content) with format, null where it is unknown; only the first 352 bytes go to Python."""
    @F.pandas_udf("string")
    def name(head):
        return head.map(lambda x: sniff(bytes(x)) if x is not None else None)

    return files.withColumn("format", name(F.substring("content", 1, 352)))


def decode(files: DataFrame, format: str | None = None) -> DataFrame:
    """files(image_id, content) -> pixels. Unknown formats and damaged files raise."""
    decoders = dict(DECODERS)

    def run(batches):
        for batch in batches:
            for image, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kind = format or sniff(data)
                if kind not in decoders:
                    raise ValueError(f"image {image}: no decoder for {kind}")
                yield from to_rows(image, decoders[kind](data)).to_batches()

    return files.select("image_id", "content").mapInArrow(run, PIXELS)


def encode(pixels: DataFrame, format: str) -> DataFrame:
    """Pixels -> (image_id, content), a file per image."""
    encoder = ENCODERS[format]

    def run(table):
        import pyarrow as pa

        image, a = to_array(table)
        return pa.table({"image_id": pa.array([image], pa.int32()), "content": pa.array([encoder(a)], pa.binary())})

    return pixels.groupBy("image_id").applyInArrow(run, "image_id int, content binary")


def _numbered(files: DataFrame, path: str) -> DataFrame:
    """files with image_id, from 0 in the order of their paths; only the paths are sorted."""
    paths = files.select(F.col(path).alias("of")).distinct().withColumn("image_id", (F.row_number().over(Window.orderBy("of")) - 1).cast("int"))
    return files.join(paths, files[path] == paths["of"]).drop("of")


def load(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """Pixels of all files below a path, numbered in the order of their names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return decode(_numbered(files, "path").select("image_id", "content"), format)


def read_csv_matrix(spark: SparkSession, path: str) -> DataFrame:
    """An image per file, numbered in the order of their names: numbers parted by commas, semicolons, blanks or tabs, # comments left out; clamped to 8 bits and truncated."""
    files = _numbered(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"), "path")
    lines = files.select("image_id", F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x).rlike("^[^#]"))).alias("y", "line"))
    cells = lines.select("image_id", "y", F.posexplode(F.filter(F.split("line", "[,;\\s]+"), lambda x: x != "")).alias("x", "t"))
    return cells.select("image_id", "x", "y", F.lit(0).alias("band"), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col("t").cast("double")))).cast("double").alias("v"))
