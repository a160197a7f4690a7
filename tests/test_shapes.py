import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievestone.operators import geometry, kernels, raster


def image(spark, array, run=1):
    return spark.createDataFrame([(run, y, x, int(v)) for (y, x), v in np.ndenumerate(array)], "run_id long, y long, x long, v long")


def array(df, column="v"):
    rows = df.collect()
    out = np.zeros((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1), np.int64)
    for r in rows:
        out[r.y, r.x] = r[column]
    return out


def test_rectangle(spark):
    corners = [(10, 20), (50, 20), (50, 40), (10, 40)]
    v = spark.createDataFrame([("r", 1, k, x, y) for k, (x, y) in enumerate(corners)], "run_id string, label int, seq int, x int, y int")
    r = geometry.measure(v).first()
    assert (r.area_px, r.perimeter_px, r.bbox_w_px, r.bbox_h_px, r.centroid_x, r.centroid_y) == (800, 120, 41, 21, 30, 30)
    assert (r.length_px, r.width_px, r.solidity, r.convexity, r.aspect_ratio, r.fill_ratio) == (40, 20, 1, 1, 2, 1)
    assert r.circularity == pytest.approx(4 * math.pi * 800 / 120**2) and r.feret_max_px == pytest.approx(math.hypot(40, 20)) and r.eccentricity == 0
    assert r.hu_moments_0 == pytest.approx(math.log1p((40**2 + 20**2) / 12 / 800)) and r.hu_moments_2 == pytest.approx(0, abs=1e-12)


def test_moments_do_not_depend_on_place_turn_or_direction(spark):
    base = np.array([(0, 0), (60, 0), (70, 30), (20, 50), (5, 30)], float)
    turn = lambda a: base @ np.array([[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]])
    kinds = [base, base + 500, base[::-1], turn(0.7) + 200, base * 3]
    v = spark.createDataFrame([("r", k, j, float(x), float(y)) for k, p in enumerate(kinds) for j, (x, y) in enumerate(p)], "run_id string, label int, seq int, x double, y double")
    rows = geometry.hu_moments(v).orderBy("label").collect()
    for k in range(7):
        assert [r[f"hu_moments_{k}"] for r in rows] == pytest.approx([rows[0][f"hu_moments_{k}"]] * 5, rel=1e-6, abs=1e-12)


def test_ellipse_and_hull():
    a = np.linspace(0, 2 * math.pi, 80, endpoint=False)
    p = np.stack([40 * np.cos(a), 15 * np.sin(a)], 1) @ np.array([[math.cos(0.5), math.sin(0.5)], [-math.sin(0.5), math.cos(0.5)]]) + 100
    long, short, angle = geometry.fit_ellipse(p)
    assert (long, short, angle) == pytest.approx((80, 30, math.degrees(0.5)), abs=1e-6)
    assert geometry.fit_ellipse(p[:4]) is None and geometry.fit_ellipse(np.stack([np.arange(9.0)] * 2, 1)) is None
    w, h, _ = geometry.smallest_rectangle(geometry.hull(p))
    assert sorted((w, h)) == pytest.approx([30, 80], rel=0.01)


def test_components_contours_and_areas(spark):
    a = np.zeros((30, 30), int)
    a[2:8, 3:9] = 255
    a[8, 9] = 255  # touches by a corner
    a[20:22, 20:28] = 255
    labels = raster.components(image(spark, a))
    assert {r.label: r.area for r in raster.areas(labels).collect()} == {1: 37, 2: 16}
    kept = raster.filter_area(labels, 10, 20)
    assert {r.label: r.area for r in raster.areas(kept).collect()} == {1: 16}
    c = raster.contours(kept)
    assert {(r.x, r.y) for r in c.collect()} == {(20, 20), (27, 20), (27, 21), (20, 21)}
    assert geometry.polygon_features(c).first().area_px == 7


def test_thresholds_and_polarity(spark):
    a = np.full((60, 60), 10)
    a[25:40, 25:40] = 200
    df = image(spark, a)
    assert raster.otsu_level(df).first().level == 10
    assert (array(raster.otsu(df)) > 0).sum() == 225
    r = raster.border(df).first()
    assert r.polarity == "bright_on_dark" and r.black_background
    assert raster.border(image(spark, 255 - a)).first().polarity == "dark_on_bright"
    assert raster.areas(raster.segment(df)).first().area > 180


def test_kernels():
    a = np.zeros((40, 40), int)
    a[10:30, 10:30] = 255
    hole = a.copy()
    hole[15:20, 15:20] = 0
    assert np.array_equal(kernels.fill_holes(hole), a)
    d = kernels.distance(a > 0)
    y, x = np.nonzero(a == 0)
    assert d[14, 19] == pytest.approx(np.sqrt(((y - 14) ** 2 + (x - 19) ** 2).min()))
    two = np.zeros((60, 90), bool)
    gy, gx = np.mgrid[:60, :90]
    two |= (gy - 30) ** 2 + (gx - 30) ** 2 <= 18**2
    two |= (gy - 30) ** 2 + (gx - 60) ** 2 <= 18**2
    parts = kernels.watershed(two, 0.2)
    assert parts.max() == 2 and (parts > 0).sum() == two.sum() and kernels.components(two * 255).max() == 1
    noise = np.random.default_rng(1).integers(0, 256, (30, 30))
    for method in ("gaussian", "median", "bilateral", "nlm"):
        assert kernels.denoise(noise // 16, method).std() < (noise // 16).std()
    assert kernels.clahe(noise // 4, 2.0, 4).max() > noise.max() // 4
    assert kernels.hull_fill(hole).sum() >= a.sum()


def test_cleanup_bridges_gaps_and_seeds_keep_apart():
    a = np.zeros((80, 120), int)
    a[20:60, 20:55] = a[20:60, 62:100] = 255  # seven pixels of translucent gap
    assert kernels.components(a).max() == 2 and kernels.components(kernels.cleanup(a)).max() == 1
    bar = np.zeros((40, 80), bool)
    bar[15:25, 10:18] = bar[15:25, 22:30] = bar[18:22, 18:22] = True
    assert kernels.watershed(bar, 0.2).max() == 2
    assert kernels.adaptive_threshold(np.full((5, 3), 9), 45, 2).shape == (5, 3)


def test_objects_of_unclear_polarity_are_inverted(spark):
    a = np.full((80, 80), 130)
    a[30:50, 30:50] = 60
    df = image(spark, a)
    assert raster.border(df).first().polarity == "auto"
    made = array(raster.threshold(df, "otsu")) > 0
    assert np.array_equal(made, a == 60)


def test_tiles_cover_and_stitch(spark):
    a = np.random.default_rng(2).integers(0, 255, (50, 70))
    df = image(spark, a)
    size = spark.createDataFrame([(1, 50, 70)], "run_id long, h int, w int")
    tiles = raster.cut_tiles(df, raster.tile_origins(size, 32, 8), 32)
    assert np.array_equal(array(raster.stitch_max(tiles)), a)
    assert np.array_equal(array(raster.stitch_weighted(tiles, F.lit(1.0)).withColumn("v", F.round("v"))), a)
    assert raster.tile_origins(spark.createDataFrame([(1, 10, 10)], "run_id long, h int, w int")).count() == 1
    assert raster.test_time_views(df, size).groupBy("view").count().count() == 9


def points(spark, groups):
    rows = [("r", k, n, float(x), float(y)) for k, p in groups.items() for n, (x, y) in enumerate(p)]
    return spark.createDataFrame(rows, "run_id string, label long, seq long, x double, y double")


def test_widths_without_an_ellipse_are_of_all_points(spark):
    """Of points on a line the hull keeps two, the widths are of all: greatest 9, least 1."""
    rng = np.random.default_rng(1)
    groups = {0: [(0, 0), (4, 0), (5, 0), (9, 0)], 5: [(k * k, 2 * k * k) for k in range(9)], 6: [(3, 3)] * 7} | {n: rng.integers(0, 60, (n, 2)) for n in (1, 2, 3, 4, 40)}
    df = points(spark, groups)
    least = {r.label: r.nearest for r in geometry.least_distances(df).collect()}
    shapes = {r.label: r for r in geometry.whole_shapes(df).collect()}
    assert set(least) == set(shapes) == set(groups)
    for k, p in groups.items():
        d = [math.dist(a, b) for n, a in enumerate(p) for b in p[:n]]
        assert least[k] == pytest.approx(min(d, default=0.0))
        if k != 40:
            assert (shapes[k].feret_max_px, shapes[k].feret_min_px) == pytest.approx((max(d, default=0.0), min(d, default=0.0)))
    assert shapes[0].rot_rect_angle == -90 and shapes[0].orientation_angle == 90 and shapes[0].eccentricity == 0


def test_hulls_and_sums_merge(spark):
    """An object of 300,000 points in many batches, small ones between them, against all points at once."""
    rng = np.random.default_rng(3)
    big = np.round(rng.normal(0, 1, (300_000, 2)) @ np.array([[90, 20], [0, 30]]) + 700)
    rows = spark.range(0, 300_000, 1, 12).select(F.lit("r").alias("run_id"), F.lit(1).cast("long").alias("label"), F.col("id").alias("seq"))
    place = spark.createDataFrame(__import__("pandas").DataFrame({"seq": np.arange(len(big)), "x": big[:, 0], "y": big[:, 1]}))
    small = {k: rng.integers(0, 40, (30, 2)) + 10 * k for k in range(2, 40)}
    df = rows.join(place, "seq").select("run_id", "label", "seq", "x", "y").unionByName(points(spark, small)).repartition(12)
    left = geometry.hull_points(df)
    assert left.where("label = 1").count() < 1000
    made = {r.label: r for r in geometry.whole_shapes(df).collect()}
    assert len(made) == 39
    for k, p in ({1: big} | small).items():
        p = np.array(p, float)
        h, (long, short, turn) = geometry.hull(p), geometry.fit_ellipse(p)
        r = made[k]
        assert r.hull_area_px == pytest.approx(geometry.shoelace(h)) and (r.rot_rect_w_px, r.rot_rect_h_px, r.rot_rect_angle) == pytest.approx(geometry.smallest_rectangle(h))
        assert (r.feret_max_px, r.feret_min_px) == pytest.approx((long, short), rel=1e-6)
        assert abs((r.orientation_angle - turn) % 180 - 90) < 1e-4


def test_rectangle_and_orientation_follow_the_published_convention(spark):
    """The first side runs along an angle from -90 to under 0; the orientation is that of the shorter axis."""
    a = np.linspace(0, 2 * math.pi, 60, endpoint=False)
    flat, tall = np.stack([40 * np.cos(a), 9 * np.sin(a)], 1) + 100, np.stack([9 * np.cos(a), 40 * np.sin(a)], 1) + 100
    made = {r.label: r for r in geometry.whole_shapes(points(spark, {1: flat, 2: tall, 3: [(0, 0), (10, 0), (10, 8), (0, 8)]})).collect()}
    assert made[1].orientation_angle == pytest.approx(90, abs=1e-6) and min(made[2].orientation_angle, 180 - made[2].orientation_angle) == pytest.approx(0, abs=1e-6)
    assert (made[3].rot_rect_w_px, made[3].rot_rect_h_px, made[3].rot_rect_angle) == (8, 10, -90)


def test_hull_fill_by_rows(spark):
    rng = np.random.default_rng(4)
    a = np.zeros((60, 80), int)
    a[5:30, 5:9] = a[26:30, 5:40] = 255
    a[40:55, 50:70] = 255 * (rng.random((15, 20)) > 0.3)
    a[2, 60:75] = 255
    assert np.array_equal(array(raster.hull_fill(image(spark, a))), kernels.hull_fill(a))


def test_hulls_of_many_objects_in_one_batch(spark, capsys):
    """Objects are measured together, as each is alone: lines, repeated points, arcs that lose a point a pass, hulls of over ``STEP`` corners."""
    rng = np.random.default_rng(6)
    k = np.arange(60)
    groups = {n: rng.integers(0, 12, (n, 2)) for n in (1, 2, 3, 30)} | {4: [(n, 2 * n) for n in k], 5: [(3, 3)] * 7, 6: [(n, n * n) for n in k] + [(70, -5000)], 7: [(n, n * n) for n in range(2 * geometry.STEP)]}
    made = geometry.hull_shapes(points(spark, groups))
    made.explain()
    assert "FlatMapGroupsInArrow" not in capsys.readouterr().out
    rows = {r.label: r for r in made.collect()}
    assert set(rows) == set(groups)
    for n, p in groups.items():
        h = geometry.hull(np.array(p, float))
        r = rows[n]
        assert (r.rot_rect_w_px, r.rot_rect_h_px, r.rot_rect_angle, r.widest) == pytest.approx((*geometry.smallest_rectangle(h), geometry.greatest_distance(h)))
        assert r.hull_area_px == pytest.approx(geometry.shoelace(h)) and r.hull_perimeter_px == pytest.approx(sum(math.dist(a, b) for a, b in zip(h, np.roll(h, -1, 0))))


def test_sums_of_objects_are_not_broadcast(spark, capsys):
    sums = geometry.power_sums(points(spark, {1: [(0, 0), (700, 3), (5, 900)], 2: [(1, 1)]}))
    sums.explain()
    assert "Broadcast" not in capsys.readouterr().out
    rows = {r.label: r for r in sums.collect()}
    assert rows[1].p0 == 3 and rows[1].p1 == pytest.approx(0, abs=1e-12) and rows[2].p0 == 1 and rows[2].scale == 1
