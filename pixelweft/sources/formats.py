"""Compressed image files: GIF, TIFF and JPEG (baseline), as functions between bytes and arrays [y, x, band]."""

from __future__ import annotations

import heapq
import struct
import zlib

import numpy as np

# ---------------------------------------------------------------- LZW, as in GIF and TIFF


def lzw_decode(data: bytes, first: int, tiff: bool) -> bytes:
    """Codes of first + 1 bits at first; TIFF packs from the high bits and widens codes one entry early."""
    clear, stop = 1 << first, (1 << first) + 1
    table: list[bytes] = []
    out, last, width, held, bits, at = bytearray(), b"", first + 1, 0, 0, 0
    while True:
        while bits < width:
            if at >= len(data):
                return bytes(out)
            held = held << 8 | data[at] if tiff else held | data[at] << bits
            bits, at = bits + 8, at + 1
        if tiff:
            code, held = held >> bits - width, held & (1 << bits - width) - 1
        else:
            code, held = held & (1 << width) - 1, held >> width
        bits -= width
        if code == clear:
            table, last, width = [bytes((i,)) for i in range(clear)] + [b"", b""], b"", first + 1
            continue
        if code == stop:
            return bytes(out)
        if not table:
            table = [bytes((i,)) for i in range(clear)] + [b"", b""]
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        last = entry
        if len(table) + tiff >= 1 << width and width < 12:
            width += 1


def lzw_encode(data: bytes, first: int) -> bytes:
    """GIF's order of bits."""
    clear, stop = 1 << first, (1 << first) + 1
    out, held, bits = bytearray(), 0, 0

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held | code << bits, bits + width
        while bits >= 8:
            out.append(held & 255)
            held, bits = held >> 8, bits - 8

    table, width, now = {bytes((i,)): i for i in range(clear)}, first + 1, b""
    put(clear)
    for c in data:
        more = now + bytes((c,))
        if more in table:
            now = more
            continue
        put(table[now])
        if len(table) + 2 < 4096:
            table[more] = len(table) + 2
            if len(table) + 2 > 1 << width and width < 12:
                width += 1
        else:
            put(clear)
            table, width = {bytes((i,)): i for i in range(clear)}, first + 1
        now = bytes((c,))
    if now:
        put(table[now])
    put(stop)
    return bytes(out) + (bytes((held,)) if bits else b"")


# ---------------------------------------------------------------- GIF

def decode_gif(data: bytes) -> np.ndarray:
    """All frames as shown, one below the other; RGBA."""
    w, h, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None

    def palette(flags: int) -> np.ndarray:
        nonlocal at
        n = 2 << (flags & 7)
        at += 3 * n
        return np.frombuffer(data, np.uint8, 3 * n, at - 3 * n).reshape(n, 3)

    def blocks() -> bytes:
        nonlocal at
        out = b""
        while data[at]:
            out += data[at + 1: at + 1 + data[at]]
            at += 1 + data[at]
        at += 1
        return out

    if flags & 0x80:
        shared = palette(flags)
    canvas, frames, dispose, clear = np.zeros((h, w, 4), int), [], 0, None
    while at < len(data) and data[at] != 0x3B:
        kind, at = data[at], at + 1
        if kind == 0x21:
            label, at = data[at], at + 1
            body = blocks()
            if label == 0xF9 and len(body) >= 4:
                dispose, clear = body[0] >> 2 & 7, body[3] if body[0] & 1 else None
        elif kind == 0x2C:
            x, y, fw, fh, own = struct.unpack_from("<HHHHB", data, at)
            at += 9
            colours = palette(own) if own & 0x80 else shared
            first, at = data[at], at + 1
            index = np.frombuffer(lzw_decode(blocks(), first, False)[: fw * fh].ljust(fw * fh, b"\0"), np.uint8).reshape(fh, fw)
            if own & 0x40:  # rows by eighths, then the eighths between, quarters and halves
                order = [r for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(start, fh, step)]
                index = index[np.argsort(order)]
            before = canvas.copy()
            shown = np.concatenate((colours[index], np.full((fh, fw, 1), 255)), 2)
            part = canvas[y: y + fh, x: x + fw]
            solid = np.ones((fh, fw), bool) if clear is None else index != clear
            part[solid[: part.shape[0], : part.shape[1]]] = shown[: part.shape[0], : part.shape[1]][solid[: part.shape[0], : part.shape[1]]]
            frames.append(canvas.copy())
            if dispose == 2:
                canvas[y: y + fh, x: x + fw] = 0
            elif dispose == 3:
                canvas = before
            dispose, clear = 0, None
        else:
            raise ValueError("damaged GIF")
    return np.concatenate(frames) if frames else canvas


def encode_gif(a: np.ndarray) -> bytes:
    """Up to 256 colours exactly, otherwise the 252 of a cube of 6, 7 and 6 levels; pixels of alpha below 128 are clear."""
    h, w, bands = a.shape
    a = np.clip(np.rint(a), 0, 255).astype(int)
    rgb = a[:, :, :3] if bands >= 3 else np.repeat(a[:, :, :1], 3, 2)
    gone = a[:, :, -1] < 128 if bands in (2, 4) else np.zeros((h, w), bool)
    colours, index = np.unique(rgb.reshape(-1, 3), axis=0, return_inverse=True)
    if len(colours) + gone.any() > 256:
        levels = np.array([6, 7, 6])
        cell = np.rint(rgb * (levels - 1) / 255).astype(int)
        index = (cell[:, :, 0] * 7 + cell[:, :, 1]) * 6 + cell[:, :, 2]
        colours = np.stack([g.reshape(-1) for g in np.meshgrid(*[np.rint(np.linspace(0, 255, n)) for n in levels], indexing="ij")], 1).astype(int)
    index = index.reshape(h, w).copy()
    index[gone] = len(colours)
    bits = max(2, int(len(colours) + gone.any() - 1).bit_length())
    table = np.zeros((1 << bits, 3), np.uint8)
    table[: len(colours)] = colours
    body = lzw_encode(index.astype(np.uint8).tobytes(), bits)
    parts = b"".join(bytes((len(body[i: i + 255]),)) + body[i: i + 255] for i in range(0, len(body), 255)) + b"\0"
    clear = b"\x21\xf9\x04\x01\0\0" + bytes((len(colours),)) + b"\0" if gone.any() else b""
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x80 | 0x70 | bits - 1, 0, 0) + table.tobytes() + clear + b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0) + bytes((bits,)) + parts + b"\x3b"


# ---------------------------------------------------------------- TIFF

#: Bytes of the field types. Fixed values.
_FIELD = {1: "B", 2: "B", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}


def _unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1: at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1: at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def decode_tiff(data: bytes) -> np.ndarray:
    """All pages of equal size, one below the other: strips or tiles, plain, PackBits, LZW or Deflate, whole numbers of 1, 8 or 16 bits or floats."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    at, pages = struct.unpack_from(order + "I", data, 4)[0], []
    while at:
        n, tags = struct.unpack_from(order + "H", data, at)[0], {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            code = _FIELD.get(kind, "B") * count
            size = struct.calcsize(order + code)
            place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            tags[tag] = struct.unpack_from(order + code, data, place)
        pages.append(_tiff_page(data, tags, order))
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
    return np.concatenate([p for p in pages if p.shape[1:] == pages[0].shape[1:]])


def _tiff_page(data: bytes, tags: dict, order: str) -> np.ndarray:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    w, h, depth, packed, colour, bands = one(256, 0), one(257, 0), one(258, 1), one(259, 1), one(262, 1), one(277, 1)
    separate, guess = one(284, 1) == 2, one(317, 1)
    kind = order + ("f" if one(339, 1) == 3 else "u") + str(max(1, depth // 8))
    tiled = 322 in tags
    bw, bh = (one(322, w), one(323, h)) if tiled else (w, min(h, one(278, h)))
    offsets, counts = (tags[324], tags[325]) if tiled else (tags[273], tags.get(279, (len(data),)))
    each = 1 if separate else bands
    across, down = -(-w // bw), -(-h // bh)
    out = np.zeros((down * bh, across * bw, bands))
    for k, (start, size) in enumerate(zip(offsets, counts)):
        raw = data[start: start + size]
        raw = {1: lambda x: x, 5: lambda x: lzw_decode(x, 8, True), 32773: _unpack_bits, 8: zlib.decompress, 32946: zlib.decompress}[packed](raw)
        plane, place = divmod(k, across * down)
        y, x = place // across * bh, place % across * bw
        rows = bh if tiled else min(bh, h - y)
        if depth == 1:
            stride = -(-bw * each // 8)
            block = np.unpackbits(np.frombuffer(raw, np.uint8, rows * stride).reshape(rows, stride), axis=1)[:, : bw * each].reshape(rows, bw, each) * 255.0
        else:
            block = np.frombuffer(raw, kind, rows * bw * each).reshape(rows, bw, each)
            if guess == 2:
                block = np.cumsum(block, 1, dtype=block.dtype.newbyteorder("="))
        out[y: y + rows, x: x + bw, plane if separate else slice(None)] = block[:, :, 0] if separate else block
    out = out[:h, :w]
    if colour == 0 and bands == 1:
        out = (1 << max(depth, 8)) - 1 - out
    if colour == 3:
        table = np.array(tags[320]).reshape(3, -1).T // 257
        out = table[out[:, :, 0].astype(int)].astype(float)
    return out


def encode_tiff(a: np.ndarray) -> bytes:
    """One strip, Deflate; 8 bits, 16 where a value is above 255, floats where one is not whole."""
    h, w, bands = a.shape
    whole = bool((a == np.rint(a)).all() and a.min(initial=0) >= 0 and a.max(initial=0) <= 65535)
    kind = "<f4" if not whole else "<u2" if a.max(initial=0) > 255 else "<u1"
    body = zlib.compress(np.ascontiguousarray(a).astype(kind).tobytes())
    depth = 8 * np.dtype(kind).itemsize
    fields = [(256, 4, [w]), (257, 4, [h]), (258, 3, [depth] * bands), (259, 3, [8]), (262, 3, [2 if bands >= 3 else 1]), (273, 4, [0]), (277, 3, [bands]),
              (278, 4, [h]), (279, 4, [len(body)]), (284, 3, [1])] + ([(338, 3, [2])] if bands in (2, 4) else []) + [(339, 3, [1 if whole else 3] * bands)]
    at = 8 + 2 + 12 * len(fields) + 4
    extra, rows = b"", b""
    for tag, type_, values in fields:
        if tag == 273:
            rows += b"%STRIP%ABCDE"  # 12 bytes, filled in below
            continue
        content = struct.pack("<" + _FIELD[type_] * len(values), *values)
        if len(content) > 4:
            place, extra = at + len(extra), extra + content + b"\0" * (len(content) % 2)
            content = struct.pack("<I", place)
        rows += struct.pack("<HHI", tag, type_, len(values)) + content.ljust(4, b"\0")
    strip = struct.pack("<HHII", 273, 4, 1, at + len(extra))
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(fields)) + rows.replace(b"%STRIP%ABCDE", strip) + struct.pack("<I", 0) + extra + body


# ---------------------------------------------------------------- JPEG

def _zigzag() -> np.ndarray:
    """Places of the 64 coefficients by diagonals, turning at each."""
    return np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))


ZIGZAG = _zigzag()
_COSINES = np.array([[(np.sqrt(1 / 8) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])

# The quantisation tables (by rows) and the Huffman table of DC sizes (codes of each length, symbols) that the standard gives as examples.
LUMA = (16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
        18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99)
CHROMA = (17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99, *[99] * 32)
DC_TABLE = ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12)))


def _ac_table() -> tuple[tuple[int, ...], tuple[int, ...]]:
    """A Huffman table of all run and size symbols, valid for any image: short codes for short runs and small sizes.

    Not one of the standard's examples: the lengths are those of a Huffman code for weights that fall with run and size. One symbol
    more than there are takes the code of ones only, which the format leaves unused.
    """
    weight = {0x00: 0.3, 0xF0: 2e-3, None: 0.0} | {run << 4 | size: max(2e-4, 0.55 ** run * 0.5 ** size) for size in range(1, 11) for run in range(16)}
    length = dict.fromkeys(weight, 0)
    heap = [(w, k, [symbol]) for k, (symbol, w) in enumerate(weight.items())]
    heapq.heapify(heap)
    while len(heap) > 1:
        (w, k, one), (x, _, two) = heapq.heappop(heap), heapq.heappop(heap)
        for symbol in one + two:
            length[symbol] += 1
        heapq.heappush(heap, (w + x, k, one + two))
    del length[None]
    symbols = sorted(length, key=lambda s: (length[s], -weight[s], s))
    return tuple(sum(n == k for n in length.values()) for k in range(1, 17)), tuple(symbols)


AC_TABLE = _ac_table()


def _codes(table) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol."""
    code, out, symbols = 0, {}, iter(table[1])
    for length, n in enumerate(table[0], 1):
        for _ in range(n):
            out[length, code] = next(symbols)
            code += 1
        code <<= 1
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            self.held = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at, self.n = self.at + 1, self.n + 8
        self.n -= n
        out = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return out

    def symbol(self, fast: list) -> int:
        while self.n < 16:
            self.held = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at, self.n = self.at + 1, self.n + 8
        length, symbol = fast[self.held >> self.n - 16]
        self.n -= length
        self.held &= (1 << self.n) - 1
        return symbol

    def value(self, size: int) -> int:
        if not size:
            return 0
        x = self.take(size)
        return x if x >> size - 1 else x - (1 << size) + 1


def _fast(table) -> list:
    """Length and symbol by the next 16 bits."""
    out = [(16, 0)] * 65536
    for (length, code), symbol in _codes(table).items():
        low = code << 16 - length
        out[low: low + (1 << 16 - length)] = [(length, symbol)] * (1 << 16 - length)
    return out


def decode_jpeg(data: bytes) -> np.ndarray:
    """Baseline sequential images of one or three components; chroma is spread to the luma's size by repetition."""
    at, quant, huffman, parts, adobe, restart = 2, {}, {}, [], None, 0
    while True:
        kind, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4: at + 2 + size], at + 2 + size
        if kind == 0xDB:
            while body:
                n = 128 if body[0] >> 4 else 64
                quant[body[0] & 15] = np.frombuffer(body[1: 1 + n], ">u2" if n == 128 else np.uint8).astype(int)
                body = body[1 + n:]
        elif kind == 0xC4:
            while body:
                counts = tuple(body[1:17])
                huffman[body[0]] = _fast((counts, tuple(body[17: 17 + sum(counts)])))
                body = body[17 + sum(counts):]
        elif kind in (0xC0, 0xC1):
            h, w = struct.unpack_from(">HH", body, 1)
            parts = [{"id": i, "h": s >> 4, "v": s & 15, "q": q} for i, s, q in zip(*[iter(body[6: 6 + 3 * body[5]])] * 3)]
        elif kind in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)) and kind != 0xC8:
            raise ValueError("JPEG that is not baseline")
        elif kind == 0xDD:
            restart = struct.unpack_from(">H", body)[0]
        elif kind == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif kind == 0xDA:
            for i, t in zip(*[iter(body[1: 1 + 2 * body[0]])] * 2):
                next(p for p in parts if p["id"] == i).update(dc=t >> 4, ac=16 | t & 15)
            break
    scans, begin, k = [], at, at
    while k + 1 < len(data):  # entropy-coded stretches between restart markers, stuffed zeros taken out
        if data[k] == 0xFF and data[k + 1] != 0:
            scans.append(data[begin:k].replace(b"\xff\0", b"\xff"))
            if not 0xD0 <= data[k + 1] <= 0xD7:
                break
            begin = k = k + 2
        else:
            k += 1 + (data[k] == 0xFF)
    else:
        scans.append(data[begin:].replace(b"\xff\0", b"\xff"))
    wide, high = max(p["h"] for p in parts), max(p["v"] for p in parts)
    across, down = -(-w // (8 * wide)), -(-h // (8 * high))
    for p in parts:
        p["blocks"] = np.zeros((down * p["v"], across * p["h"], 64))
    units, step = across * down, restart or across * down
    for s, scan in enumerate(scans):
        bits, last = _Bits(scan), [0] * len(parts)
        for unit in range(s * step, min(units, (s + 1) * step)):
            for c, p in enumerate(parts):
                for v in range(p["v"]):
                    for u in range(p["h"]):
                        block = p["blocks"][unit // across * p["v"] + v, unit % across * p["h"] + u]
                        last[c] += bits.value(bits.symbol(huffman[p["dc"]]))
                        block[0], k = last[c], 1
                        while k < 64:
                            symbol = bits.symbol(huffman[p["ac"]])
                            if not symbol & 15:
                                if symbol != 0xF0:
                                    break
                                k += 16
                                continue
                            k += symbol >> 4
                            if k > 63:
                                break
                            block[ZIGZAG[k]] = bits.value(symbol & 15)
                            k += 1
    planes = []
    for p in parts:
        table = np.zeros(64)
        table[ZIGZAG] = quant[p["q"]]
        blocks = (p["blocks"] * table).reshape(*p["blocks"].shape[:2], 8, 8)
        pixels = np.einsum("abuv,ux,vy->axby", blocks, _COSINES, _COSINES)
        plane = pixels.reshape(blocks.shape[0] * 8, blocks.shape[1] * 8) + 128
        planes.append(np.clip(np.rint(plane), 0, 255).repeat(high // p["v"], 0).repeat(wide // p["h"], 1)[:h, :w])
    a = np.stack(planes, 2)
    if len(parts) == 3 and adobe != 0:
        y, cb, cr = a[:, :, 0], a[:, :, 1] - 128, a[:, :, 2] - 128
        a = np.clip(np.rint(np.stack((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb), 2)), 0, 255)
    return a.astype(int)


def encode_jpeg(a: np.ndarray, quality: int = 90) -> bytes:
    """Baseline, chroma at full size; an alpha band is left out."""
    h, w = a.shape[:2]
    a = np.clip(np.rint(a), 0, 255).astype(float)
    if a.shape[2] >= 3:
        r, g, b = a[:, :, 0], a[:, :, 1], a[:, :, 2]
        planes = [0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b]
    else:
        planes = [a[:, :, 0]]
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    tables = [np.clip((np.array(t) * scale + 50) // 100, 1, 255).astype(int) for t in (LUMA, CHROMA)]
    bits, held, n = bytearray(), 0, 0

    def put(code: int, length: int) -> None:
        nonlocal held, n
        held, n = held << length | code, n + length
        while n >= 8:
            byte = held >> n - 8
            bits.append(byte)
            if byte == 0xFF:
                bits.append(0)
            n -= 8
            held &= (1 << n) - 1

    def value(x: int) -> tuple[int, int]:
        size = abs(x).bit_length()
        return size, x if x >= 0 else x + (1 << size) - 1

    dc, ac = ({s: (code, length) for (length, code), s in _codes(t).items()} for t in (DC_TABLE, AC_TABLE))
    coded = []
    for c, plane in enumerate(planes):
        padded = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
        blocks = padded.reshape(padded.shape[0] // 8, 8, padded.shape[1] // 8, 8)
        freq = np.einsum("axby,ux,vy->abuv", blocks, _COSINES, _COSINES).reshape(blocks.shape[0], blocks.shape[2], 64)
        coded.append(np.rint(freq / tables[min(c, 1)]).astype(int)[:, :, ZIGZAG])
    last = [0] * len(planes)
    for y in range(coded[0].shape[0]):
        for x in range(coded[0].shape[1]):
            for c, plane in enumerate(coded):
                block = plane[y, x]
                size, code = value(int(block[0]) - last[c])
                last[c] = int(block[0])
                put(*dc[size])
                put(code, size)
                some, k = np.flatnonzero(block[1:]) + 1, 0
                for j in some.tolist():
                    while j - k > 16:
                        put(*ac[0xF0])
                        k += 16
                    size, code = value(int(block[j]))
                    put(*ac[j - k - 1 << 4 | size])
                    put(code, size)
                    k = j
                if k < 63:
                    put(*ac[0])
    if n:
        put((1 << 8 - n) - 1, 8 - n)

    def part(kind: int, body: bytes) -> bytes:
        return bytes((0xFF, kind)) + struct.pack(">H", len(body) + 2) + body

    used = range(min(2, len(planes)))
    head = struct.pack(">BHHB", 8, h, w, len(planes)) + b"".join(bytes((c + 1, 0x11, min(c, 1))) for c in range(len(planes)))
    huff = b"".join(bytes((k,)) + bytes(t[0]) + bytes(t[1]) for k, t in ((0, DC_TABLE), (16, AC_TABLE)))
    scan = bytes((len(planes),)) + b"".join(bytes((c + 1, 0)) for c in range(len(planes))) + b"\0\x3f\0"
    return (b"\xff\xd8" + part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + b"".join(part(0xDB, bytes((k,)) + bytes(tables[k][ZIGZAG].tolist())) for k in used)
            + part(0xC0, head) + part(0xC4, huff) + part(0xDA, scan) + bytes(bits) + b"\xff\xd9")
