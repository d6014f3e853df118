"""Frames against a canvas that is drawn on and disposed of step by step."""

import numpy as np
import pytest

from pixelweft.operators import frames
from tests.test_arrays import frame

SCHEMA = "anim int, frame int, image_id int, left_ int, top_ int, dispose string, blend string"


def drawn(images, rows):
    """Canvases by (anim, frame)."""
    out = {}
    for anim in sorted({r[0] for r in rows}):
        mine = sorted(r for r in rows if r[0] == anim)
        w, h = max(r[3] + images[r[2]].shape[1] for r in mine), max(r[4] + images[r[2]].shape[0] for r in mine)
        canvas = np.zeros((h, w, 4), int)
        for _, k, image, left, top, dispose, blend in mine:
            a, saved = images[image], canvas.copy()
            for y in range(a.shape[0]):
                for x in range(a.shape[1]):
                    s, d = [int(v) for v in a[y, x]], [int(v) for v in canvas[top + y, left + x]]
                    if blend == "source" or s[3] == 255:
                        canvas[top + y, left + x] = s
                    elif s[3]:
                        alpha = s[3] + (d[3] * (255 - s[3]) + 127) // 255
                        canvas[top + y, left + x] = [min(255, (s[c] * s[3] + d[c] * d[3] * (255 - s[3]) // 255 + alpha // 2) // alpha) for c in range(3)] + [alpha]
            out[anim, k] = canvas.copy()
            if dispose == "background":
                canvas[top: top + a.shape[0], left: left + a.shape[1]] = 0
            elif dispose == "previous":
                canvas = saved
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_like_a_canvas_drawn_step_by_step(spark, seed):
    rng = np.random.default_rng(seed)
    images, rows = [], []
    for anim, n in ((0, 6), (7, 3), (9, 1)):
        for k in range(n):
            a = rng.integers(0, 256, (int(rng.integers(2, 7)), int(rng.integers(2, 8)), 4))
            a[:, :, 3] = rng.choice([0, 90, 200, 255], a.shape[:2])
            rows.append((anim, k, len(images), int(rng.integers(0, 5)), int(rng.integers(0, 4)), str(rng.choice(["none", "background", "previous"])), str(rng.choice(["source", "over"]))))
            images.append(a)
    got = {}
    for r in frames.composed(frame(spark, *images), spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault((r.anim, r.frame), {})[r.y, r.x, r.band] = r.v
    want = drawn(images, rows)
    assert got.keys() == want.keys()
    for k, a in want.items():
        assert got[k] == {p: float(v) for p, v in np.ndenumerate(a)}


def test_frames_without_alpha_are_opaque(spark):
    a = np.full((2, 2, 3), 9)
    rows = [(0, 0, 0, 0, 0, "none", "over"), (0, 1, 0, 1, 1, "none", "over")]
    got = {(r.frame, r.x, r.y): r.v for r in frames.composed(frame(spark, a), spark.createDataFrame(rows, SCHEMA)).where("band = 3").collect()}
    assert got[0, 0, 0] == 255 and got[0, 2, 2] == 0 and got[1, 2, 2] == 255 and got[1, 0, 2] == 0
    assert frames.composed(frame(spark, a), spark.createDataFrame([], SCHEMA)).collect() == []
