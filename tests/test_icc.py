"""Profiles to bytes and back, and transforms against a plain evaluation pixel by pixel."""

import numpy as np
import pytest

from pixelweft.operators import icc as op
from pixelweft.sources import icc
from tests.test_arrays import frame, image


def line(table, x):
    return np.interp(x, np.linspace(0, 1, len(table)), table)


def through(lut, x):
    x = np.array([line(t, v) for t, v in zip(lut.inputs, x)])
    if len(x) == 3:
        x = lut.matrix @ x
    at = np.clip(x, 0, 1) * (lut.grid - 1)
    low = np.minimum(at.astype(int), lut.grid - 2)
    colour = np.zeros(lut.colours.shape[1])
    for corner in np.ndindex(*(2,) * len(x)):
        weight = np.prod([f if c else 1 - f for c, f in zip(corner, at - low)])
        colour += weight * lut.colours[np.ravel_multi_index(low + corner, (lut.grid,) * len(x))]
    return np.array([line(t, v) for t, v in zip(lut.outputs, colour)])


def lut(channels, outputs, grid, seed, entries=33):
    rng = np.random.default_rng(seed)
    curve = lambda n: np.sort(rng.random((n, entries)), axis=1)
    matrix = np.eye(3) if channels != 3 else np.eye(3) * 0.9 + 0.05
    return icc.Lut(curve(channels), matrix, grid, rng.random((grid ** channels, outputs)), curve(outputs))


def close(a, b, most):
    return np.allclose(a, b, atol=0.5 / most + 1e-9)


@pytest.mark.parametrize("wide", [True, False])
def test_profiles_to_bytes_and_back(wide):
    one = lut(3, 4, 5, 1, 33 if wide else 256)
    data = icc.serialize(icc.Profile("CMYK", "Lab ", "prtr", tags={"A2B0": icc.lut_tag(one, wide), "wtpt": icc.xyz_tag((0.9642, 1.0, 0.8249)), "rTRC": icc.curve_tag(2.2), "gTRC": icc.curve_tag([0, 0.2, 1]), "bTRC": icc.parametric_tag(4, (2.4, 0.9, 0.1, 0.08, 0.04, 0.01, 0.02))}))
    back = icc.parse(data)
    assert (back.device, back.connection, back.kind) == ("CMYK", "Lab ", "prtr") and np.allclose(back.xyz("wtpt"), (0.9642, 1.0, 0.8249), atol=1e-4)
    got, most = back.lut("A2B0"), 65535 if wide else 255
    assert got.grid == 5 and close(got.inputs, one.inputs, most) and close(got.colours, one.colours, most) and close(got.outputs, one.outputs, most) and np.allclose(got.matrix, one.matrix, atol=1e-4)
    x = np.array([0.0, 0.02, 0.25, 0.75, 1.0])
    assert np.allclose(back.curve("rTRC")(x), x ** (563 / 256)) and np.allclose(back.curve("gTRC")(x), np.interp(x, [0, 0.5, 1], [0, 0.2, 1]), atol=1e-4)
    assert np.allclose(back.curve("bTRC")(x), np.where(x < 0.04, 0.08 * x + 0.02, (0.9 * x + 0.1) ** 2.4 + 0.01), atol=1e-4)
    assert back.lut("B2A0") is None and back.curve("kTRC") is None and back.matrix() is None
    for bad in (b"", data[:100], data[:36] + b"none" + data[40:]):
        with pytest.raises(ValueError):
            icc.parse(bad)


def by_primaries(a, source, target):
    p, q = icc.parse(source), icc.parse(target)
    whole = np.linalg.inv(q.matrix()) @ p.matrix()
    light = np.stack([p.curve(f"{c}TRC")(a[:, :, k] / 255) for k, c in enumerate("rgb")], axis=2) @ whole.T
    codes = np.floor((np.clip(light, 0, 1) * 4095).round(9) + 0.5) / 4095
    out = np.zeros(codes.shape, int)
    for k, c in enumerate("rgb"):
        entries = q.curve(f"{c}TRC")(np.arange(256) / 255)
        far = np.abs(entries[None, :] - codes[:, :, k].reshape(-1, 1))
        out[:, :, k] = (255 - far[:, ::-1].argmin(axis=1)).reshape(codes.shape[:2])  # the higher one at a tie
    return out


@pytest.mark.parametrize("source, target", [(icc.srgb(), icc.wide_gamut()), (icc.wide_gamut(), icc.srgb()), (icc.srgb(), icc.srgb())])
def test_primaries_and_curves(spark, source, target):
    a = np.random.default_rng(2).integers(0, 256, (14, 12, 3))
    assert (image(op.icc_transform(frame(spark, a), source, target)) == by_primaries(a, source, target)).all()
    if source == target:
        assert (by_primaries(a, source, target) == a).mean() > 0.99


def test_alpha_and_grey(spark):
    a = np.random.default_rng(3).integers(0, 256, (9, 8, 4))
    got = image(op.icc_transform(frame(spark, a), icc.srgb(), icc.wide_gamut()))
    assert (got[:, :, :3] == by_primaries(a[:, :, :3], icc.srgb(), icc.wide_gamut())).all() and (got[:, :, 3] == a[:, :, 3]).all()
    grey = image(op.icc_transform(frame(spark, a[:, :, :2]), icc.srgb(), icc.wide_gamut()))
    assert (grey[:, :, :3] == by_primaries(a[:, :, :1].repeat(3, axis=2), icc.srgb(), icc.wide_gamut())).all() and (grey[:, :, 3] == a[:, :, 1]).all()


def lab(p):
    t = p * 65535 / 32768 / np.array([0.96422, 1, 0.82521])
    f = np.where(t > 216 / 24389, np.cbrt(t), (24389 / 27 * t + 16) / 116)
    return np.clip([(116 * f[1] - 16) / 100, (500 * (f[0] - f[1]) + 128) / 256, (200 * (f[1] - f[2]) + 128) / 256], 0, 1)


def xyz(p):
    fy = (p[0] * 100 + 16) / 116
    f = np.array([(p[1] * 256 - 128) / 500 + fy, fy, fy - (p[2] * 256 - 128) / 200])
    return np.clip(np.array([0.96422, 1, 0.82521]) * np.where(f ** 3 > 216 / 24389, f ** 3, (116 * f - 16) / (24389 / 27)) / (65535 / 32768), 0, 1)


@pytest.mark.parametrize("channels, outputs, spaces, intent", [(4, 3, ("Lab ", "Lab "), "perceptual"), (3, 4, ("XYZ ", "Lab "), "relative"), (3, 3, ("Lab ", "XYZ "), "saturation"), (1, 3, ("Lab ", "Lab "), "absolute")])
def test_lookup_tables(spark, channels, outputs, spaces, intent):
    # The second table is only in the perceptual slot, which all intents fall back to.
    one = icc.serialize(icc.Profile("CMYK", spaces[0], tags={f"A2B{op.INTENTS[intent]}": icc.lut_tag(lut(channels, 3, 4, 4)), "A2B0": icc.lut_tag(lut(channels, 3, 4, 5 if intent != "perceptual" else 4))}))
    two = icc.serialize(icc.Profile("RGB ", spaces[1], tags={"B2A0": icc.lut_tag(lut(3, outputs, 5, 6))}))
    a = np.random.default_rng(7).integers(0, 256, (6, 7, channels + 1))
    a[0, 0], a[0, 1] = 0, 255
    first, second = icc.parse(one).lut(f"A2B{op.INTENTS[intent]}"), icc.parse(two).lut("B2A0")
    between = {("Lab ", "Lab "): lambda p: p, ("XYZ ", "Lab "): lab, ("Lab ", "XYZ "): xyz}[spaces]
    want = np.zeros((6, 7, outputs + 1), int)
    for y in range(6):
        for x in range(7):
            o = through(second, between(through(first, a[y, x, :channels] / 255)))
            want[y, x, :outputs] = np.floor((np.clip(o, 0, 1) * 255).round(9) + 0.5)
            want[y, x, outputs] = a[y, x, channels]
    assert (image(op.icc_transform(frame(spark, a), one, two, intent)) == want).all()


def test_profiles_that_do_not_meet(spark):
    with pytest.raises(ValueError):
        op.icc_transform(frame(spark, np.zeros((2, 2, 3), int)), icc.srgb(), icc.serialize(icc.Profile(tags={})))
