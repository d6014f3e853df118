"""Operators that need a whole image as an array: transforms, error diffusion, cropping by entropy.

An image is handed to one Python task by an Arrow group and handed back as pixels, so images are processed in parallel; what
one image needs in memory is the image. Pixel tables stay the only currency between operators.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

PIXELS = "image_id int, x int, y int, band int, v double"
COMPLEX = "image_id int, x int, y int, band int, re double, im double"


def to_array(table) -> tuple[int, np.ndarray]:
    """(image_id, array[y, x, band]) of the rows of one image; missing places are 0."""
    x, y, b, v = (table.column(n).to_numpy() for n in ("x", "y", "band", "v"))
    out = np.zeros((int(y.max()) + 1, int(x.max()) + 1, int(b.max()) + 1))
    out[y.astype(int), x.astype(int), b.astype(int)] = v
    return int(table.column("image_id")[0].as_py()), out


def to_rows(image: int, *planes: np.ndarray, names=("v",)):
    import pyarrow as pa

    y, x, b = (i.reshape(-1).astype(np.int32) for i in np.indices(planes[0].shape))
    keys = {"image_id": pa.array(np.full(len(x), image, np.int32)), "x": pa.array(x), "y": pa.array(y), "band": pa.array(b)}
    return pa.table(keys | {n: pa.array(p.reshape(-1).astype(np.float64)) for n, p in zip(names, planes)})


def per_image(r: DataFrame, function, schema: str = PIXELS) -> DataFrame:
    """function(array[y, x, band]) -> array, or a pair of arrays where the schema is COMPLEX."""
    names = ("re", "im") if schema == COMPLEX else ("v",)

    def run(table):
        image, array = to_array(table)
        out = function(array)
        return to_rows(image, *(out if isinstance(out, tuple) else (out,)), names=names)

    return r.groupBy("image_id").applyInArrow(run, schema)


def fw_fft(r: DataFrame) -> DataFrame:
    """Two-dimensional transform with a factor 1/sqrt(n) along each axis, band by band."""
    def run(a):
        f = np.fft.fft2(a, axes=(0, 1), norm="ortho")
        return f.real, f.imag

    return per_image(r, run, COMPLEX)


def _complex(table) -> tuple[int, np.ndarray]:
    re = table.rename_columns(["v" if n == "re" else n for n in table.column_names])
    im = table.rename_columns(["v" if n == "im" else n for n in table.column_names])
    image, a = to_array(re)
    return image, a + 1j * to_array(im)[1]


def inv_fft(c: DataFrame, real: bool = False) -> DataFrame:
    """Inverse of fw_fft: magnitudes clamped to 8 bits, or the real part."""
    def run(table):
        image, f = _complex(table)
        a = np.fft.ifft2(f, axes=(0, 1), norm="ortho")
        return to_rows(image, a.real if real else np.floor(np.clip(np.round(np.abs(a), 9), 0, 255)))

    return c.groupBy("image_id").applyInArrow(run, PIXELS)


def spectrum(r: DataFrame) -> DataFrame:
    """Logarithm of the magnitudes, the middle at frequency 0, scaled to 255 per band."""
    def run(a):
        m = np.log1p(np.abs(np.fft.fft2(a, axes=(0, 1), norm="ortho")))
        m = np.roll(m, (a.shape[0] // 2, a.shape[1] // 2), (0, 1))
        top = m.max((0, 1), keepdims=True)
        return np.floor(np.round(m / np.where(top == 0, 1, top) * 255, 9))

    return per_image(r, run)


def freqmult(r: DataFrame, mask) -> DataFrame:
    """Multiply the transform by a real mask [y, x] and go back; the mask is an array, or made for each image of its (height, width)."""
    def run(a):
        m = mask(*a.shape[:2]) if callable(mask) else mask
        return np.fft.ifft2(np.fft.fft2(a, axes=(0, 1)) * m[:, :, None], axes=(0, 1)).real

    return per_image(r, run)


def phasecor(a: DataFrame, b: DataFrame) -> DataFrame:
    """Phase correlation of images of equal number: the peak is at their shift. The smaller of two counts as if it had zeros to the right and below."""
    def run(left, right):
        found = [to_array(t) for t in (left, right) if t.num_rows]
        image, size = found[0][0], np.max([x.shape for _, x in found], axis=0)
        x, y = (np.pad(to_array(t)[1], [(0, n - k) for n, k in zip(size, to_array(t)[1].shape)]) if t.num_rows else np.zeros(size) for t in (left, right))
        cross = np.fft.fft2(x, axes=(0, 1)) * np.conj(np.fft.fft2(y, axes=(0, 1)))
        size = np.abs(cross)
        return to_rows(image, np.fft.ifft2(np.where(size > 1e-12, cross / np.where(size > 1e-12, size, 1), 0), axes=(0, 1)).real)

    return a.groupBy("image_id").cogroup(b.groupBy("image_id")).applyInArrow(run, PIXELS)


# The published error-diffusion kernels, as (dx, dy, weight) and their divisor.
DIFFUSION = {
    "floyd_steinberg": (((1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1)), 16),
    "jarvis": (((1, 0, 7), (2, 0, 5), (-2, 1, 3), (-1, 1, 5), (0, 1, 7), (1, 1, 5), (2, 1, 3), (-2, 2, 1), (-1, 2, 3), (0, 2, 5), (1, 2, 3), (2, 2, 1)), 48),
    "stucki": (((1, 0, 8), (2, 0, 4), (-2, 1, 2), (-1, 1, 4), (0, 1, 8), (1, 1, 4), (2, 1, 2), (-2, 2, 1), (-1, 2, 2), (0, 2, 4), (1, 2, 2), (2, 2, 1)), 42),
    "atkinson": (((1, 0, 1), (2, 0, 1), (-1, 1, 1), (0, 1, 1), (1, 1, 1), (0, 2, 1)), 8),
    "burkes": (((1, 0, 8), (2, 0, 4), (-2, 1, 2), (-1, 1, 4), (0, 1, 8), (1, 1, 4), (2, 1, 2)), 32),
    "stevenson_arce": (((2, 0, 32), (-3, 1, 12), (-1, 1, 26), (1, 1, 30), (3, 1, 16), (-2, 2, 12), (0, 2, 26), (2, 2, 12), (-3, 3, 5), (-1, 3, 12), (1, 3, 12), (3, 3, 5)), 200),
    "sierra": (((1, 0, 5), (2, 0, 3), (-2, 1, 2), (-1, 1, 4), (0, 1, 5), (1, 1, 4), (2, 1, 2), (-1, 2, 2), (0, 2, 3), (1, 2, 2)), 32),
}


def dither(r: DataFrame, method: str = "floyd_steinberg", levels: int = 2) -> DataFrame:
    """Error diffusion from left to right and top to bottom, errors gathered in single precision; bands apart."""
    kernel, divisor = DIFFUSION[method]

    def run(a):
        a = a.astype(np.float32)
        h, w, _ = a.shape
        out = np.empty_like(a)
        for y in range(h):
            for x in range(w):
                now = a[y, x].astype(np.float64)
                out[y, x] = np.round(np.clip(now, 0, 255) * (levels - 1) / 255) * 255 // (levels - 1)
                error = now - out[y, x]
                for dx, dy, k in kernel:
                    if 0 <= x + dx < w and y + dy < h:
                        a[y + dy, x + dx] += (error * (k / divisor)).astype(np.float32)
        return out

    return per_image(r, run)


def entropy_crop(r: DataFrame, width: int, height: int) -> DataFrame:
    """Drop the edge row or column of lower entropy until the size is reached; at a tie the bottom or the right one."""
    def entropy(line):
        n = np.bincount(line.astype(int), minlength=256)
        p = n[n > 0] / n.sum()
        return float(-(p * np.log2(p)).sum())

    def run(a):
        t, b, l, e = 0, a.shape[0], 0, a.shape[1]  # noqa: E741
        while b - t > height:
            if entropy(a[t, l:e, 0]) < entropy(a[b - 1, l:e, 0]):
                t += 1
            else:
                b -= 1
        while e - l > width:
            if entropy(a[t:b, l, 0]) < entropy(a[t:b, e - 1, 0]):
                l += 1  # noqa: E741
            else:
                e -= 1
        return a[t:b, l:e]

    return per_image(r, run)
