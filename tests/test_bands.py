import numpy as np
import pytest
from pyspark.sql import functions as F

from sievestone.operators import bands, basins, colours, frames, kernels, links, raster, strategies
from sievestone.sources import specimens

from .test_frames import plain_equalize
from .test_scenes import SMALL, plan
from .test_shapes import array, image


@pytest.fixture(scope="module")
def tall(spark):
    """Higher than two bands, and pixels in no order."""
    a = np.random.default_rng(8).integers(0, 256, (300, 24))
    return a, image(spark, a).repartition(7, "y").sortWithinPartitions(F.rand(1))


def test_pack_holds_each_pixel_once(spark, tall):
    a, px = tall
    lines = bands.pack(px).collect()
    got = np.full(a.shape, -1)
    for r in lines:
        got[r.y, r.x : r.x + r.n] = np.frombuffer(r._p0, r.kind)
    assert np.array_equal(got, a) and len(lines) < a.size // 2


def test_smoothing_over_bands_shuffles_no_pixels(spark, tall):
    a, px = tall
    wide = np.pad(a, 2, mode="reflect")
    w = np.outer(frames.BINOMIAL, frames.BINOMIAL)
    want = (sum(wide[y : y + 300, x : x + 24] * w[y, x] for y in range(5) for x in range(5)) + 128) // 256
    assert np.array_equal(array(frames.smooth5(px)), want)
    assert "Window" not in plan(frames.smooth5(specimens.scenes(spark, SMALL)))


def test_null_and_missing_pixels(spark):
    a = np.arange(48).reshape(6, 8)
    px = image(spark, a).selectExpr("run_id", "y", "x", "CASE WHEN y = 3 AND x = 3 THEN NULL ELSE v END AS v")
    got = {(r.y, r.x): r.v for r in frames.smooth5(px).collect()}
    assert len(got) == 47 or got[3, 3] is None
    assert got[0, 0] is not None and got[3, 4] is None


def test_cleaning_up_over_bands_shuffles_no_pixels(spark):
    a = (np.random.default_rng(9).random((300, 40)) < 0.3) * 255
    a[120:140, 5:30] = a[250:290, 3:37] = 255
    px = image(spark, a)
    want = frames.closed(frames.opened(px, frames.ellipse(3)), frames.ellipse(13), 2)
    made = frames.cleanup(px)
    assert np.array_equal(array(made), array(want)) and "Window" not in plan(made)


def test_adaptive_threshold_over_bands_shuffles_no_pixels(spark):
    a = np.random.default_rng(3).integers(80, 100, (300, 24))
    a[100:150, 5:20] += 90
    even = plain_equalize(a, 2.0, 8)
    w = np.array(frames.gaussian_weights(9))
    wide = np.pad(even, 4, mode="edge")
    mean = np.array([[(wide[y : y + 9, x : x + 9] * np.outer(w, w)).sum() for x in range(24)] for y in range(300)])
    want = np.where(even > np.rint(mean.round(6)) - 2, 255, 0)
    made = frames.adaptive_threshold(image(spark, a), 9, 2)
    assert np.array_equal(array(made), 255 - want if (want > 0).mean() > 0.5 else want) and "Window" not in plan(made)


def test_holes_over_bands_shuffle_no_pixels(spark):
    """A way out that winds through three bands, a hole in two of them, and one that a single corner would open."""
    a = np.full((300, 40), 0)
    a[20:280, 3:37] = 255
    for k in range(22):  # a tunnel to and fro
        a[30 + 10 * k : 41 + 10 * k, 30 if k % 2 else 5] = a[30 + 10 * k, 5:31] = 0
    a[20:31, 5] = a[120:140, 33:36] = a[15, 15] = 0
    a[200:205, 32] = a[205, 33] = 0
    made = links.fill_holes(image(spark, a))
    assert np.array_equal(array(made), kernels.fill_holes(a)) and not np.array_equal(a, kernels.fill_holes(a))
    assert "Window" not in plan(made) and "leftanti" not in plan(made).lower()
    noise = (np.random.default_rng(5).random((270, 50)) < 0.6) * 255
    noise[0] = noise[:, 0] = 0
    assert np.array_equal(array(links.fill_holes(image(spark, noise))), kernels.fill_holes(noise))


def test_tiles_come_from_packed_lines(spark):
    a = np.random.default_rng(7).integers(0, 256, (150, 70))
    px = image(spark, a).selectExpr("run_id", "y", "x", "(v * 7) % 256 AS b", "v AS g", "(v * 3) % 256 AS r").repartition(5)

    def model(tile):
        if tile[0, 0, 1] % 2:
            raise ValueError("odd")
        return (tile[:, :, 2] > 128) * 3

    mask, failed = strategies.tile_mask(px, lambda: model, 32, 8)
    tops, lefts = sorted({min(k, 118) for k in range(0, 150, 24)}), sorted({min(k, 38) for k in range(0, 70, 24)})
    want, bad = np.zeros(a.shape, int), set()
    for y in tops:
        for x in lefts:
            if a[y, x] % 2:
                bad.add((y, x, "ValueError: odd"))
            else:
                want[y : y + 32, x : x + 32] |= np.where(a[y : y + 32, x : x + 32] * 3 % 256 > 128, 255, 0)
    assert np.array_equal(array(mask), want) and {(r.ty, r.tx, r.error) for r in failed.collect()} == bad and bad
    assert "Join" not in plan(mask)


def test_watershed_over_bands(spark):
    """Discs in a column through three bands, one of a pixel's touch, an image without a seed and one without an outside."""
    gy, gx = np.mgrid[:330, :70]
    discs = [(15 + 22 * k, 20 + k, 12) for k in range(14)] + [(128, 55, 11), (262, 58, 9), (290, 55, 12)]
    a = (np.min([(gy - y) ** 2 + (gx - x) ** 2 - r * r for y, x, r in discs], 0) <= 0) * 255
    full = np.full((140, 6), 255)
    px = image(spark, a, 1).unionByName(image(spark, full, 2)).unionByName(image(spark, 0 * full, 3))
    deep = basins.distance2(px).cache()
    found = basins.seeds(deep, 0.2, 10).cache()
    flooded = {(r.y, r.x): r.marker for r in basins.flood(deep.where("d2 > 0"), found).collect()}
    names = {m: k + 1 for k, m in enumerate(sorted(r.marker for r in found.collect()))}
    want = np.array([[names[flooded[y, x]] if (y, x) in flooded else 0 for x in range(70)] for y in range(330)])
    made = basins.watershed(px).cache()
    assert np.array_equal(array(made.where("run_id = 1"), "label"), want) and want.max() > 12
    assert array(made.where("run_id = 2"), "label").min() == 1 and array(made.where("run_id = 3"), "label").max() == 0
    assert "Window" not in plan(basins.watershed(px))
    runs = raster.object_runs(basins.watershed_lines(px)).where("run_id = 1")
    sizes = np.bincount(want.ravel())
    kept = [int(sizes[k]) for k in range(1, len(sizes)) if 300 <= sizes[k] <= 500]
    assert [r.area for r in raster.areas_of_runs(runs, 300, 500).orderBy("label").collect()] == kept and 0 < len(kept) < want.max()
    key = lambda df: sorted(map(tuple, df.select("run_id", "label", "seq", "x", "y").collect()))
    assert key(raster.contours_of_runs(runs)) == key(raster.contours(made.where("run_id = 1")))


def test_foreground_over_bands(spark):
    """Bands share small pixels; what clusters is what ``reduced`` gives, and pixels are packed once."""
    rng = np.random.default_rng(2)
    a = rng.integers(0, 60, (300, 45))
    a[90:210, 10:30] += 150
    px = image(spark, a).selectExpr("run_id", "y", "x", "v * 4 div 5 AS b", "CASE WHEN y = 7 AND x = 9 THEN NULL ELSE v * 9 div 10 END AS g", "v AS r")
    key = lambda df: sorted(map(tuple, df.select("run_id", "y", "x", "b", "g", "r").collect()))
    for side in (100, 70, 640):
        assert key(colours._reduced_lines(bands.pack(px, "bgr"), side)) == key(colours.reduced(px, side))
    made = colours.foreground(px, 100, 2)
    got = array(made)
    assert (got[95:205, 12:28] == 255).mean() > 0.9 and got[7, 9] == 0 and (got[:80] == 0).mean() > 0.9
    assert "Join" not in plan(made)
