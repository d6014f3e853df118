"""ICC profiles: header, tags, tone curves, primaries and lookup tables, read from bytes and written to them.

What is read are small tables; operators/icc.py turns them into relations that pixels are joined with.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np


def _fixed(data: bytes, at: int, n: int) -> list[float]:
    """Numbers of 16 bits before and 16 after the point."""
    return [v / 65536 for v in struct.unpack_from(f">{n}i", data, at)]


@dataclass(frozen=True)
class Lut:
    """Curves per channel, a matrix for three channels, a grid of colours, and curves for these; all in 0 .. 1."""
    inputs: np.ndarray  # (channels, entries)
    matrix: np.ndarray  # (3, 3)
    grid: int
    colours: np.ndarray  # (grid ^ channels, outputs), the first channel slowest
    outputs: np.ndarray  # (outputs, entries)


@dataclass
class Profile:
    device: str = "RGB "
    connection: str = "XYZ "
    kind: str = "mntr"
    version: int = 0x04000000
    tags: dict[str, bytes] = field(default_factory=dict)

    def xyz(self, tag: str) -> list[float] | None:
        data = self.tags.get(tag, b"")
        return _fixed(data, 8, 3) if data[:4] == b"XYZ " and len(data) >= 20 else None

    def matrix(self) -> np.ndarray | None:
        """From linear red, green and blue to XYZ."""
        columns = [self.xyz(t) for t in ("rXYZ", "gXYZ", "bXYZ")]
        return None if None in columns else np.array(columns).T

    def curve(self, tag: str):
        """A tone curve as a function of arrays in 0 .. 1; None where there is none."""
        data = self.tags.get(tag, b"")
        if data[:4] == b"curv" and len(data) >= 12:
            n, = struct.unpack_from(">I", data, 8)
            if n == 0:
                return lambda x: np.maximum(x, 0)
            table = np.frombuffer(data, ">u2", n, 12)
            if n == 1:
                return lambda x: np.maximum(x, 0) ** (table[0] / 256)
            return lambda x: np.interp(x, np.linspace(0, 1, n), table / 65535)
        if data[:4] == b"para" and len(data) >= 12:
            kind, = struct.unpack_from(">H", data, 8)
            if kind > 4:
                return None
            g, a, b, c, d, e, f = (_fixed(data, 12, (1, 3, 4, 5, 7)[kind]) + [0.0] * 7)[:7]

            def power(x):
                return np.maximum(a * x + b, 0) ** g

            return {
                0: lambda x: np.maximum(x, 0) ** g, 1: lambda x: np.where(x < -b / a, 0, power(x)), 2: lambda x: np.where(x < -b / a, c, power(x) + c),
                3: lambda x: np.where(x < d, c * x, power(x)), 4: lambda x: np.where(x < d, c * x + f, power(x) + e),
            }[kind]
        return None

    def lut(self, tag: str) -> Lut | None:
        """A lookup table of 8 or 16 bits."""
        data = self.tags.get(tag, b"")
        if data[:4] not in (b"mft1", b"mft2") or len(data) < 52:
            return None
        wide = data[:4] == b"mft2"
        channels, outputs, grid = data[8:11]
        n, m = struct.unpack_from(">2H", data, 48) if wide else (256, 256)
        kind, most, at = (">u2", 65535, 52) if wide else (">u1", 255, 48)
        parts = []
        for rows, columns in ((channels, n), (grid ** channels, outputs), (outputs, m)):
            parts.append(np.frombuffer(data, kind, rows * columns, at).reshape(rows, columns) / most)
            at += parts[-1].size * (2 if wide else 1)
        return Lut(parts[0], np.array(_fixed(data, 12, 9)).reshape(3, 3), grid, parts[1], parts[2])


def parse(data: bytes) -> Profile:
    if len(data) < 132 or data[36:40] != b"acsp":
        raise ValueError("not an ICC profile")
    version, = struct.unpack_from(">I", data, 8)
    out = Profile(data[16:20].decode("latin-1"), data[20:24].decode("latin-1"), data[12:16].decode("latin-1"), version)
    count, = struct.unpack_from(">I", data, 128)
    for k in range(count):
        if 144 + 12 * k > len(data):
            break
        name, at, size = struct.unpack_from(">4sII", data, 132 + 12 * k)
        if at + size <= len(data):
            out.tags[name.decode("latin-1")] = data[at: at + size]
    return out


def serialize(profile: Profile) -> bytes:
    body, entries, at = b"", b"", 132 + 12 * len(profile.tags)
    for name, data in profile.tags.items():
        entries += struct.pack(">4sII", name.encode("latin-1"), at + len(body), len(data))
        body += data + b"\0" * (-len(data) % 4)
    head = bytearray(128)
    struct.pack_into(">I", head, 0, at + len(body))
    struct.pack_into(">I4s4s4s", head, 8, profile.version, *(s.encode("latin-1") for s in (profile.kind, profile.device, profile.connection)))
    head[36:40] = b"acsp"
    struct.pack_into(">3i", head, 68, *(round(v * 65536) for v in (0.9642, 1.0, 0.8249)))
    return bytes(head) + struct.pack(">I", len(profile.tags)) + entries + body


def xyz_tag(values) -> bytes:
    return b"XYZ \0\0\0\0" + struct.pack(">3i", *(round(v * 65536) for v in values))


def curve_tag(table) -> bytes:
    """A gamma, or a table of values in 0 .. 1."""
    if isinstance(table, (int, float)):
        return b"curv\0\0\0\0" + struct.pack(">IH", 1, round(table * 256))
    return b"curv\0\0\0\0" + struct.pack(">I", len(table)) + np.rint(np.asarray(table) * 65535).astype(">u2").tobytes()


def parametric_tag(kind: int, values) -> bytes:
    return b"para\0\0\0\0" + struct.pack(">HH", kind, 0) + struct.pack(f">{len(values)}i", *(round(v * 65536) for v in values))


def lut_tag(lut: Lut, wide: bool = True) -> bytes:
    kind, most = (">u2", 65535) if wide else (">u1", 255)
    head = (b"mft2" if wide else b"mft1") + b"\0\0\0\0" + bytes([len(lut.inputs), len(lut.outputs), lut.grid, 0]) + struct.pack(">9i", *(round(v * 65536) for v in lut.matrix.reshape(-1)))
    sizes = struct.pack(">2H", lut.inputs.shape[1], lut.outputs.shape[1]) if wide else b""
    return head + sizes + b"".join(np.floor(a * most + 0.5).astype(kind).tobytes() for a in (lut.inputs, lut.colours, lut.outputs))


def matrix_profile(primaries, curve: bytes) -> bytes:
    """A profile of three primaries, as columns of XYZ, and one tone curve's tag."""
    tags = {f"{c}XYZ": xyz_tag(p) for c, p in zip("rgb", np.asarray(primaries).T)} | {f"{c}TRC": curve for c in "rgb"}
    return serialize(Profile(tags=tags))


def srgb() -> bytes:
    """The common profile of screens, its primaries adapted to D50 and its curve in parametric form. Fixed values."""
    primaries = ((0.4360747, 0.3850649, 0.1430804), (0.2225045, 0.7168786, 0.0606169), (0.0139322, 0.0971045, 0.7141733))
    return matrix_profile(primaries, parametric_tag(3, (2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045)))


def wide_gamut(gamma: float = 2.19921875) -> bytes:
    """Wider primaries, adapted to D50, with a gamma. Fixed values."""
    primaries = ((0.6097559, 0.2052401, 0.1492240), (0.3111242, 0.6256560, 0.0632197), (0.0194811, 0.0608902, 0.7448387))
    return matrix_profile(primaries, curve_tag(gamma))
