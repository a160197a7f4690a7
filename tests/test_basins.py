import numpy as np
import pytest

from sievestone.operators import basins, kernels, raster

from .test_shapes import array, image


def discs(h, w, centres):
    gy, gx = np.mgrid[:h, :w]
    a = np.zeros((h, w), int)
    for y, x, r in centres:
        a[(gy - y) ** 2 + (gx - x) ** 2 <= r * r] = 255
    return a


def kruskal(depth, markers):
    """Plain flooding: pixels and passes one by one from the deepest, two marked parts are never joined."""
    h, w = depth.shape
    parent, mark = {}, {}
    ids = [(y, x) for y in range(h) for x in range(w) if depth[y, x] > 0]

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for p in ids:
        parent[p], mark[p] = p, markers.get(p)
    edges = []
    for y, x in ids:
        for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
            q = (y + dy, x + dx)
            if q in parent:
                edges.append((-min(depth[y, x], depth[q]), (y, x), q))
    for _, p, q in sorted(edges):
        a, b = root(p), root(q)
        if a != b and not (mark[a] is not None and mark[b] is not None):
            parent[b] = a
            mark[a] = mark[a] if mark[a] is not None else mark[b]
    return {p: mark[root(p)] for p in ids}


def test_distances(spark):
    rng = np.random.default_rng(1)
    a = (rng.random((23, 31)) < 0.9) * 255
    made = array(basins.distance2(image(spark, a)), "d2")
    y, x = np.nonzero(a == 0)
    want = [[((y - i) ** 2 + (x - j) ** 2).min() if a[i, j] else 0 for j in range(31)] for i in range(23)]
    assert np.array_equal(made, np.array(want))
    assert basins.distance2(image(spark, np.full((3, 4), 255))).where("d2 IS NULL").count() == 12


def test_touching_discs_and_a_chain(spark):
    two = discs(50, 90, [(25, 25, 15), (25, 52, 15)])
    chain = discs(30, 330, [(15, 12 + 16 * k, 9) for k in range(20)])
    df = image(spark, two, 1).unionByName(image(spark, chain, 2))
    made = basins.watershed(df).cache()
    for run, a, n in ((1, two, 2), (2, chain, 20)):
        got = array(made.where(f"run_id = {run}"), "label")
        assert kernels.components(a).max() == 1 and got.max() == n and np.array_equal(got > 0, a > 0)
        sizes = np.bincount(got.ravel())[1:]
        assert sizes.min() > 0.7 * sizes.max()


def test_flood_against_plain_flooding(spark):
    a = discs(40, 60, [(12, 14, 9), (14, 30, 8), (28, 22, 10), (27, 45, 9), (10, 50, 4)])
    deep = basins.distance2(image(spark, a)).cache()
    found = basins.seeds(deep, 0.2, 6).collect()
    assert len(found) >= 4
    marks = {(r.y, r.x): r.marker for r in found}
    d = array(deep, "d2")
    want = kruskal(d, marks)
    markers = spark.createDataFrame([(1, y, x, m) for (y, x), m in marks.items()], "run_id long, y long, x long, marker long")
    got = {(r.y, r.x): r.marker for r in basins.flood(deep.where("d2 > 0"), markers).collect()}
    assert set(got) == {p for p, m in want.items() if m is not None}
    # equal passes may fall to either side: what is deeper than all passes between two markers must agree
    assert np.mean([got[p] == want[p] for p in got]) > 0.9
    assert all(got[p] == m for p, m in marks.items())


def test_images_without_seeds_and_small_objects(spark):
    none = np.zeros((12, 12), int)
    both = discs(40, 80, [(20, 20, 14), (20, 60, 2)])
    df = image(spark, none, 1).unionByName(image(spark, both, 2))
    made = basins.watershed(df)
    assert array(made.where("run_id = 1"), "label").max() == 0
    got = array(made.where("run_id = 2"), "label")
    assert got[20, 20] == 1 and got[20, 60] == 0  # its peak is too low


def test_marker_sets_and_colour_watershed(spark):
    a = discs(60, 110, [(30, 18, 14), (30, 55, 14), (30, 92, 14)])
    df = image(spark, a)
    got = array(basins.marker_sets(df), "marker")
    clean = a
    for f, times in ((kernels.erode, 2), (kernels.dilate, 4), (kernels.erode, 2), ):
        for _ in range(times):
            clean = f(clean, five())
    d = kernels.distance(clean > 0)
    core = (clean > 0) & (d > 0.4 * d.max())
    reach = clean
    for _ in range(3):
        reach = kernels.dilate(reach, five())
    want = np.where(core, kernels.components(core * 255) + 1, np.where(reach > 0, 0, 1))
    assert np.array_equal(got, want) and got.max() == 4
    colours = df.selectExpr("run_id", "y", "x", "double(v) AS c0", "double(v) AS c1", "double(x) / 1000 AS c2")
    flooded = array(basins.colour_watershed(colours, basins.marker_sets(df)), "marker")
    assert set(np.unique(flooded)) == {-1, 1, 2, 3, 4}
    assert flooded[30, 18] == 2 and flooded[30, 55] == 3 and flooded[30, 92] == 4 and flooded[2, 2] == 1
    assert abs((flooded > 1).sum() - (a > 0).sum()) < 0.25 * (a > 0).sum()


def five():
    from sievestone.operators.frames import ellipse

    return np.array([[abs(x - 2) <= half for x in range(5)] for half in ellipse(5)])


@pytest.mark.parametrize("size", [1, 2])
def test_tiny_images(spark, size):
    made = basins.watershed(image(spark, np.full((size, size), 255)))
    assert made.count() == size * size
    assert raster.components(image(spark, np.zeros((size, size), int))).count() == size * size
