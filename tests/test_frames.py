import math

import numpy as np
import pytest

from sievestone.operators import frames, kernels, links, raster

from .test_shapes import array, image


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(4).integers(0, 256, (37, 53))


def padded(a, r, mode):
    return np.pad(a, r, mode=mode)


@pytest.mark.parametrize("shape", [(37, 53), (1, 9), (2, 3), (5, 1)])
def test_weighted_sums(spark, shape):
    a = np.random.default_rng(1).integers(0, 256, shape)
    w = np.outer(frames.BINOMIAL, frames.BINOMIAL)
    for mirrored in (True, False):
        wide = a
        for axis in (0, 1):
            pad = [(2, 2) if k == axis else (0, 0) for k in (0, 1)]
            wide = np.pad(wide, pad, mode="reflect" if mirrored and a.shape[axis] > 1 else "edge")
        want = np.array([[(wide[y : y + 5, x : x + 5] * w).sum() for x in range(a.shape[1])] for y in range(a.shape[0])])
        assert np.array_equal(array(frames.weighted(image(spark, a), frames.BINOMIAL, mirrored), "s"), want)
    if shape == (37, 53):
        wide = np.pad(a, 2, mode="reflect")
        want = np.array([[((wide[y : y + 5, x : x + 5] * w).sum() + 128) // 256 for x in range(53)] for y in range(37)])
        assert np.array_equal(array(frames.smooth5(image(spark, a))), want)


def test_kernels_and_extremes(spark, noise):
    assert frames.ellipse(3) == (0, 1, 0) and frames.ellipse(5) == (0, 2, 2, 2, 0) and frames.ellipse(1) == (0,)
    assert frames.ellipse(13)[0] == 0 and frames.ellipse(13)[6] == 6 and frames.ellipse(13) == frames.ellipse(13)[::-1]
    for size in (3, 7):
        half, r = frames.ellipse(size), size // 2
        for largest in (True, False):
            want = noise.copy()
            for y in range(noise.shape[0]):
                for x in range(noise.shape[1]):
                    near = [noise[y + d, max(0, x - half[d + r]) : x + half[d + r] + 1] for d in range(-r, r + 1) if 0 <= y + d < noise.shape[0]]
                    want[y, x] = (np.max if largest else np.min)(np.concatenate(near))
            assert np.array_equal(array(frames.extreme(image(spark, noise), half, largest)), want)


def plain_equalize(a, clip, n):
    """Tile histograms, clipped and spread, and blended curves, pixel by pixel."""
    h, w = a.shape
    fits = h % n == 0 and w % n == 0
    ph, pw = (0, 0) if fits else (n - h % n, n - w % n)
    wide = np.pad(a, ((0, ph), (0, pw)), mode="reflect")
    th, tw = wide.shape[0] // n, wide.shape[1] // n
    curves = {}
    for i in range(n):
        for j in range(n):
            counts = np.bincount(wide[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            limit = max(1, int(clip * th * tw / 256))
            excess = int(np.maximum(counts - limit, 0).sum())
            counts = np.minimum(counts, limit) + excess // 256
            rest = excess % 256
            for k in range(rest):
                counts[k * max(256 // rest, 1)] += 1
            curves[i, j] = np.minimum(255, np.rint(np.cumsum(counts) * 255.0 / (th * tw)))
    out = np.zeros_like(a)
    for y in range(h):
        for x in range(w):
            fy, fx = y / th - 0.5, x / tw - 0.5
            y0, x0 = math.floor(fy), math.floor(fx)
            ya, xa = fy - y0, fx - x0
            c = lambda i, j: curves[min(max(i, 0), n - 1), min(max(j, 0), n - 1)][a[y, x]]  # noqa: B023, E731
            out[y, x] = round(round((c(y0, x0) * (1 - xa) + c(y0, x0 + 1) * xa) * (1 - ya) + (c(y0 + 1, x0) * (1 - xa) + c(y0 + 1, x0 + 1) * xa) * ya, 6))
    return out


@pytest.mark.parametrize("shape, clip", [((32, 48), 2.0), ((37, 53), 3.0)])
def test_equalize(spark, shape, clip):
    a = np.random.default_rng(2).integers(40, 120, shape)
    a[5:20, 7:30] += 60
    assert np.array_equal(array(frames.equalize(image(spark, a), clip, 4)), plain_equalize(a, clip, 4))


def test_adaptive_threshold(spark):
    a = np.random.default_rng(3).integers(80, 100, (40, 56))
    a[10:20, 10:20] += 90
    even = plain_equalize(a, 2.0, 8)
    w = np.array(frames.gaussian_weights(9))
    wide = np.pad(even, 4, mode="edge")
    mean = np.array([[(wide[y : y + 9, x : x + 9] * np.outer(w, w)).sum() for x in range(56)] for y in range(40)])
    want = np.where(even > np.rint(mean.round(6)) - 2, 255, 0)
    want = 255 - want if (want > 0).mean() > 0.5 else want
    assert np.array_equal(array(frames.adaptive_threshold(image(spark, a), 9, 2)), want)


def test_components_over_many_rows_and_shapes(spark):
    snake = np.zeros((41, 60), int)
    snake[::4, 1:59] = 255
    for k in range(10):  # one long object that winds through all rows
        snake[4 * k : 4 * k + 5, 58 if k % 2 else 1] = 255
    rng = np.random.default_rng(6)
    two = (rng.random((41, 60)) < 0.45) * 255
    df = image(spark, snake, 1).unionByName(image(spark, two, 2))
    made = raster.components(df)
    for run, a in ((1, snake), (2, two)):
        assert np.array_equal(array(made.where(f"run_id = {run}"), "label"), kernels.components(a))
    assert made.where("run_id = 1").agg({"label": "max"}).first()[0] == 1


def test_holes(spark):
    a = np.zeros((30, 40), int)
    a[5:25, 5:35] = 255
    a[8:12, 8:20] = a[20, 20] = 0
    a[5, 30] = a[6, 31] = 0  # a way out by a corner only: stays a hole
    full = np.full((30, 40), 255)
    full[10:20, 10:20] = 0
    df = image(spark, a, 1).unionByName(image(spark, full, 2))
    made = raster.fill_holes(df)
    assert np.array_equal(array(made.where("run_id = 1")), kernels.fill_holes(a)) and np.array_equal(array(made.where("run_id = 2")), full)


def test_cleanup_and_top_hat(spark):
    a = np.zeros((60, 90), int)
    a[20:40, 15:40] = a[20:40, 47:75] = 255
    a[5, 5] = 255
    made = array(frames.cleanup(image(spark, a)))
    assert kernels.components(made).max() == 1 and made[5, 5] == 0
    bright = np.full((30, 30), 20)
    bright[10:13, 10:13] = 50
    hat = array(frames.top_hat(image(spark, bright), 11))
    assert hat[11, 11] == 120 and hat[0, 0] == 0
    assert np.array_equal(array(frames.top_hat(image(spark, bright + 150), 11)), bright + 150)


def test_roots_on_chains_and_stars(spark):
    chain = [(1, k, k + 1) for k in range(300)]
    star = [(2, 500, k) for k in range(100)]
    df = spark.createDataFrame(chain + star + [(3, 5, 5)], "run_id long, a long, b long").repartition(4)
    got = {(r.run_id, r.node): r.root for r in links.roots(df).collect()}
    assert len(got) == 402 and set(got.values()) == {0}
