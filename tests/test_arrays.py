import numpy as np
import pytest

from pixelweft.operators import arrays as A
from pixelweft.operators import regions as R

SCHEMA = "image_id int, x int, y int, band int, v double"


def frame(spark, *images):
    rows = [(k, x, y, b, float(a[y, x, b])) for k, a in enumerate(images) for y in range(a.shape[0]) for x in range(a.shape[1]) for b in range(a.shape[2])]
    return spark.createDataFrame(rows, SCHEMA)


def image(df, k=0):
    rows = [r for r in df.collect() if r.image_id == k]
    out = np.zeros((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1, max(r.band for r in rows) + 1))
    for r in rows:
        out[r.y, r.x, r.band] = r.v
    return out


@pytest.fixture(scope="module")
def random_images():
    rng = np.random.default_rng(0)
    return [rng.integers(0, 256, (11, 9, 2)), rng.integers(0, 256, (11, 9, 2))]


def test_fft_round_trip(spark, random_images):
    df = frame(spark, *random_images)
    for k, a in enumerate(random_images):
        assert np.allclose(image(A.inv_fft(A.fw_fft(df)), k), a)


def test_phase_correlation_finds_the_shift(spark, random_images):
    a = random_images[0][:, :, :1]
    got = image(A.phasecor(frame(spark, np.roll(a, (3, 2), (0, 1))), frame(spark, a)))
    assert np.unravel_index(got.argmax(), got.shape)[:2] == (3, 2)


def test_freqmult_with_ones_is_identity(spark, random_images):
    a = random_images[0]
    assert np.allclose(image(A.freqmult(frame(spark, a), np.ones(a.shape[:2]))), a)


def test_labels_and_flood(spark):
    rng = np.random.default_rng(4)
    a = (rng.random((14, 17, 1)) < 0.55) * 255
    got = image(R.label_regions(frame(spark, a)))[:, :, 0]
    want, n = np.zeros(a.shape[:2], int), 0
    for y in range(14):
        for x in range(17):
            if a[y, x, 0] and not want[y, x]:
                n, todo = n + 1, [(y, x)]
                while todo:
                    i, j = todo.pop()
                    if 0 <= i < 14 and 0 <= j < 17 and a[i, j, 0] and not want[i, j]:
                        want[i, j] = n
                        todo += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
    assert (got == want).all()
    y, x = np.argwhere(want == want.max())[0]
    flood = image(R.draw_flood(frame(spark, a), int(x), int(y), (9,)))[:, :, 0]
    assert ((flood == 9) == (want == want.max())).all()


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    a = (rng.random((12, 15, 1)) < 0.05) * 1
    a[3, 4] = 1
    points = np.argwhere(a[:, :, 0])
    got = image(R.nearest(frame(spark, a)))[:, :, 0]
    for y in range(12):
        for x in range(15):
            assert got[y, x] == int(np.sqrt(((points - (y, x)) ** 2).sum(1).min()))


def test_dither_keeps_the_mean(spark):
    a = np.full((24, 24, 1), 90)
    for method in A.DIFFUSION:
        got = image(A.dither(frame(spark, a), method))
        assert set(np.unique(got)) <= {0.0, 255.0}
        assert abs(got.mean() - 90) < (40 if method == "atkinson" else 12)


def test_entropy_crop_keeps_the_busy_part(spark):
    a = np.zeros((10, 12, 1))
    a[2:6, 3:8, 0] = np.random.default_rng(1).integers(0, 256, (4, 5))
    assert (image(A.entropy_crop(frame(spark, a), 5, 4)) == a[2:6, 3:8]).all()
