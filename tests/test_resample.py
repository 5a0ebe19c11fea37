"""Resampling and projective maps of images: against dense loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgrid.functions import augment
from docgrid.operators import resample, warp


def kernel(mode, scale, i):
    """(source place, weight) of an output place, before the edges."""
    pos = (i + 0.5) * scale - 0.5
    base = math.floor(pos)
    if mode == "nearest":
        return [(math.floor(i * scale), 1.0)]
    if mode == "area" and scale > 1:
        first, last = math.floor(i * scale + 1e-9), math.ceil((i + 1) * scale - 1e-9) - 1
        return [(t, (min((i + 1) * scale, t + 1) - max(i * scale, t)) / scale) for t in range(first, last + 1)]
    if mode == "area":
        first = math.floor(i * scale + 1e-9)
        f = (i + 1) - (first + 1) / scale
        f = 0.0 if f <= 0 else f - math.floor(f)
        return [(first, 1 - f), (first + 1, f)]
    if mode == "linear":
        return [(base, 1 - (pos - base)), (base + 1, pos - base)]
    if mode == "cubic":
        a = -0.75
        near = lambda d: ((a + 2) * d - (a + 3)) * d * d + 1
        far = lambda d: ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
        return [(t, near(abs(pos - t)) if abs(pos - t) <= 1 else far(abs(pos - t))) for t in range(base - 1, base + 3)]
    sinc = lambda d: 1.0 if d < 1e-9 else 4 * math.sin(math.pi * d) * math.sin(math.pi * d / 4) / (math.pi * d) ** 2
    found = [(t, sinc(abs(pos - t)) if abs(pos - t) < 4 else 0.0) for t in range(base - 3, base + 5)]
    return [(t, w / sum(x for _, x in found)) for t, w in found]


def dense(n_in, n_out, mode, before=0, n_all=None):
    out = np.zeros((n_all or n_out, n_in))
    for to in range(len(out)):
        i = min(max(to - before, 0), n_out - 1)
        for t, w in kernel(mode, n_in / n_out, i):
            out[to, min(max(t, 0), n_in - 1)] += w
    return out


CASES = [(7, 5, 14, 9, "linear"), (7, 5, 3, 2, "area"), (6, 8, 9, 20, "area"), (9, 9, 4, 13, "cubic"), (10, 12, 23, 7, "lanczos"), (5, 6, 12, 3, "nearest"), (1, 1, 3, 2, "cubic"), (4, 4, 4, 4, "linear"), (8, 6, 5, 4, "area")]


def test_resampling_matches_dense_matrices(spark):
    rng = np.random.default_rng(1)
    images = [rng.random((h, w, 2)) * 255 for h, w, *_ in CASES]
    rows = [(k, y, x, *map(float, img[y, x])) for k, img in enumerate(images) for y in range(img.shape[0]) for x in range(img.shape[1])]
    pixels = spark.createDataFrame(rows, "image long, y int, x int, a double, b double").withColumn("at", F.lit(1)).withColumn("weight", F.lit(2))
    sizes = spark.createDataFrame([(k, *case) for k, case in enumerate(CASES)], "image long, height int, width int, out_h int, out_w int, mode string")
    found = {(r.image, r.y, r.x): (r.a, r.b) for r in resample.resampled(pixels, sizes, ["image"], ["a", "b"]).collect()}
    for k, (h, w, oh, ow, mode) in enumerate(CASES):
        expected = np.einsum("ih,jw,hwc->ijc", dense(h, oh, mode), dense(w, ow, mode), images[k])
        assert {(i, j) for n, i, j in found if n == k} == {(i, j) for i in range(oh) for j in range(ow)}
        assert all(found[k, i, j] == pytest.approx(tuple(expected[i, j]), abs=1e-6) for i in range(oh) for j in range(ow))


def test_a_border_repeats_the_edge(spark):
    """The resize of an image that is larger than the canvas, with the geometry of the recovery's input."""
    rng = np.random.default_rng(2)
    image = rng.random((6, 4)) * 255
    pixels = spark.createDataFrame([(1, y, x, float(image[y, x])) for y in range(6) for x in range(4)], "image long, y int, x int, v double")
    sizes = spark.createDataFrame([(1, 6, 4, 3, 2, "area", 2, 1, 7, 5)], "image long, height int, width int, out_h int, out_w int, mode string, left int, top int, all_w int, all_h int")
    found = {(r.y, r.x): r.v for r in resample.resampled(pixels, sizes, ["image"], ["v"]).collect()}
    small = np.einsum("ih,jw,hw->ij", dense(6, 3, "area"), dense(4, 2, "area"), image)
    expected = np.pad(small, ((1, 1), (2, 3)), mode="edge")
    assert len(found) == 35 and all(found[i, j] == pytest.approx(expected[i, j], abs=1e-6) for i in range(5) for j in range(7))


def test_bytes_are_rounded_and_cut(spark):
    rows = spark.createDataFrame([(-3.0,), (0.5,), (254.4,), (300.0,)], "v double").select(resample.as_bytes(F.col("v")))
    assert [r[0] for r in rows.collect()] == [0, 1, 254, 255]


def plain_warp(image, h):
    g = np.linalg.inv(np.array(h, float).reshape(3, 3))
    out = np.zeros_like(image)
    for y in range(image.shape[0]):
        for x in range(image.shape[1]):
            u, v, w = g @ (x, y, 1)
            if w == 0:
                continue
            u, v = u / w, v / w
            for a in (math.floor(v), math.floor(v) + 1):
                for b in (math.floor(u), math.floor(u) + 1):
                    if 0 <= a < image.shape[0] and 0 <= b < image.shape[1]:
                        out[y, x] += image[a, b] * (1 - abs(v - a)) * (1 - abs(u - b))
    return out


MAPS = [[1, 0, 0, 0, 1, 0, 0, 0, 1], [1, 0, 5, 0, 1, -3, 0, 0, 1], [0.3, 0.1, 2, -0.1, 0.4, 9, 0, 0, 1], [2.2, 0.3, -9, 0.1, 1.9, -20, 0.004, -0.003, 1], [1, 0.2, 0, 0.1, 1, 0, 0.03, 0.02, -0.5]]


@pytest.mark.parametrize("side", [4, 7, 64])
def test_tiles_match_a_plain_warp(spark, side):
    rng = np.random.default_rng(6)
    images = [rng.random((21, 17)) for _ in MAPS]
    pixels = spark.createDataFrame([(k, y, x, float(img[y, x])) for k, img in enumerate(images) for y in range(21) for x in range(17)], "image long, y int, x int, v double")
    maps = spark.createDataFrame([(k, 21, 17, list(map(float, h))) for k, h in enumerate(MAPS)], "image long, height int, width int, h array<double>")
    found = {(r.image, r.y, r.x): r.v for r in warp.warped_pixels(pixels, maps, ["image"], ["v"], side).collect()}
    for k, image in enumerate(images):
        expected = plain_warp(image, MAPS[k])
        assert all(found.get((k, y, x), 0.0) == pytest.approx(expected[y, x], abs=1e-9) for y in range(21) for x in range(17))


def test_box_corners_land_on_their_pixels(spark):
    """A perspective moves the marks at a box's corners to where it moves the box."""
    quad = [20.0, 15.0, 90.0, 15.0, 90.0, 60.0, 20.0, 60.0]
    boxes = spark.createDataFrame([(k, quad) for k in range(6)], "image long, quad array<double>")
    w, h = F.lit(120), F.lit(80)
    drawn = boxes.withColumn("h", F.array(*augment.corners_map(w, h, augment.drawn_corners(w, h, F.col("image")))))
    moved = {r.image: r.q for r in drawn.select("image", augment.warped(F.col("quad"), [F.col("h")[k] for k in range(9)]).alias("q")).collect()}
    marks = spark.createDataFrame([(k, int(quad[2 * c + 1]), int(quad[2 * c]), c) for k in range(6) for c in range(4)], "image long, y int, x int, c int")
    flags = marks.select("image", "y", "x", *[(F.col("c") == c).cast("double").alias(f"c{c}") for c in range(4)])
    rows = warp.warped_pixels(flags, drawn.select("image", F.lit(80).alias("height"), F.lit(120).alias("width"), "h"), ["image"], [f"c{c}" for c in range(4)], 32).collect()
    for k in range(6):
        for c in range(4):
            own = [(r.x, r.y, r[f"c{c}"]) for r in rows if r.image == k and r[f"c{c}"] > 0]
            mass = sum(m for *_, m in own)
            assert abs(sum(x * m for x, _, m in own) / mass - moved[k][2 * c]) < 0.6 and abs(sum(y * m for _, y, m in own) / mass - moved[k][2 * c + 1]) < 0.6
