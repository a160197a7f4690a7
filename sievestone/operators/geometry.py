"""Shape features of polygons.

A vertex table (run_id, label, seq, x, y) holds closed contours.  Area, perimeter, moments and
bounding boxes are aggregates over its edges, ellipses come from sums of powers over blocks, and hulls
are made of hulls of batches; only what is left of a hull is held by one task.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievestone.functions.expr import safe_div

from .links import cut

KEYS = ["run_id", "label"]


def edges(vertices: DataFrame) -> DataFrame:
    """Each vertex with the next one, the last with the first: x, y, x2, y2."""
    w = Window.partitionBy(*KEYS).orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return vertices.select(*KEYS, "seq", "x", "y", *(F.coalesce(F.lead(c).over(w), F.first(c).over(whole)).alias(f"{c}2") for c in "xy"))


def polygon_features(vertices: DataFrame) -> DataFrame:
    """area_px, perimeter_px, bounding box, centroid, equivalent diameter, circularity and extent."""
    cross = F.col("x") * F.col("y2") - F.col("x2") * F.col("y")
    made = edges(vertices).groupBy(*KEYS).agg(
        (F.sum(cross) / 2).alias("_a"), (F.sum((F.col("x") + F.col("x2")) * cross) / 6).alias("_mx"), (F.sum((F.col("y") + F.col("y2")) * cross) / 6).alias("_my"),
        F.sum(F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))).alias("perimeter_px"),
        F.min("x").alias("bbox_x"), F.min("y").alias("bbox_y"), (F.max("x") - F.min("x") + 1).alias("bbox_w_px"), (F.max("y") - F.min("y") + 1).alias("bbox_h_px"),
    )
    area = F.abs("_a")
    return made.select(
        *KEYS, area.alias("area_px"), "perimeter_px", "bbox_x", "bbox_y", "bbox_w_px", "bbox_h_px", safe_div(F.col("_mx"), F.col("_a")).alias("centroid_x"), safe_div(F.col("_my"), F.col("_a")).alias("centroid_y"),
        F.sqrt(area * 4 / F.pi()).alias("equivalent_diameter_px"), safe_div(area * 4 * F.pi(), F.col("perimeter_px") * F.col("perimeter_px")).alias("circularity"),
        safe_div(area, (F.col("bbox_w_px") * F.col("bbox_h_px")).cast("double")).alias("extent"),
    )


def moments(vertices: DataFrame) -> DataFrame:
    """Raw moments of the polygon to third order, by Green's theorem, positive orientation."""
    x, y, x2, y2 = (F.col(c).cast("double") for c in ("x", "y", "x2", "y2"))
    cross = x * y2 - x2 * y
    terms = {
        "m00": cross / 2, "m10": cross * (x + x2) / 6, "m01": cross * (y + y2) / 6,
        "m20": cross * (x * x + x * x2 + x2 * x2) / 12, "m11": cross * (x * (2 * y + y2) + x2 * (y + 2 * y2)) / 24, "m02": cross * (y * y + y * y2 + y2 * y2) / 12,
        "m30": cross * (x + x2) * (x * x + x2 * x2) / 20, "m03": cross * (y + y2) * (y * y + y2 * y2) / 20,
        "m21": cross * (x * x * (3 * y + y2) + 2 * x * x2 * (y + y2) + x2 * x2 * (y + 3 * y2)) / 60,
        "m12": cross * (y * y * (3 * x + x2) + 2 * y * y2 * (x + x2) + y2 * y2 * (x + 3 * x2)) / 60,
    }
    made = edges(vertices).groupBy(*KEYS).agg(*(F.sum(t).alias(k) for k, t in terms.items()))
    return made.select(*KEYS, *((F.col(k) * F.signum("m00")).alias(k) for k in terms))


def hu_moments(vertices: DataFrame) -> DataFrame:
    """The seven invariants h as sign(h) * log1p(|h|): hu_moments_0 to hu_moments_6."""
    m = moments(vertices)
    cx, cy = safe_div(F.col("m10"), F.col("m00")), safe_div(F.col("m01"), F.col("m00"))
    m = m.withColumns({"cx": cx, "cy": cy})
    c = F.col
    mu = {
        "20": c("m20") - c("cx") * c("m10"), "02": c("m02") - c("cy") * c("m01"), "11": c("m11") - c("cx") * c("m01"),
        "30": c("m30") - 3 * c("cx") * c("m20") + 2 * c("cx") * c("cx") * c("m10"), "03": c("m03") - 3 * c("cy") * c("m02") + 2 * c("cy") * c("cy") * c("m01"),
        "21": c("m21") - 2 * c("cx") * c("m11") - c("cy") * c("m20") + 2 * c("cx") * c("cx") * c("m01"),
        "12": c("m12") - 2 * c("cy") * c("m11") - c("cx") * c("m02") + 2 * c("cy") * c("cy") * c("m10"),
    }
    m = m.withColumns({f"n{k}": safe_div(v, F.pow("m00", F.lit(1 + (int(k[0]) + int(k[1])) / 2))) for k, v in mu.items()})
    n20, n02, n11, n30, n03, n21, n12 = (c(f"n{k}") for k in ("20", "02", "11", "30", "03", "21", "12"))
    p, q, r, s = n30 + n12, n21 + n03, n30 - 3 * n12, 3 * n21 - n03
    hu = [
        n20 + n02, (n20 - n02) * (n20 - n02) + 4 * n11 * n11, r * r + s * s, p * p + q * q,
        r * p * (p * p - 3 * q * q) + s * q * (3 * p * p - q * q), (n20 - n02) * (p * p - q * q) + 4 * n11 * p * q, s * p * (p * p - 3 * q * q) - r * q * (3 * p * p - q * q),
    ]
    return m.select(*KEYS, *((F.signum(h) * F.log1p(F.abs(h))).alias(f"hu_moments_{k}") for k, h in enumerate(hu)))


def radial_moments(pixels: DataFrame, order: int = 4) -> DataFrame:
    """Means of (r / r_max) ** n over an object's pixels: zernike_moments_0 to _order; (run_id, label, y, x)."""
    centre = pixels.groupBy(*KEYS).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    r = pixels.join(centre, KEYS).select(*KEYS, F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")).alias("r"))
    # the mean of (r / r_max) ** n is the mean of r ** n over r_max ** n: one pass
    made = r.groupBy(*KEYS).agg(F.max("r").alias("most"), *(F.avg(F.pow("r", F.lit(n))).alias(f"r{n}") for n in range(order + 1)))
    most = F.when(F.col("most") > 0, F.col("most")).otherwise(1.0)
    return made.select(*KEYS, *((F.col(f"r{n}") / F.pow(most, F.lit(n))).alias(f"zernike_moments_{n}") for n in range(order + 1)))


def _objects(batch: pa.RecordBatch) -> np.ndarray:
    """A number for the object of each row of a batch."""
    codes = np.zeros(batch.num_rows, np.int64)
    for k in KEYS:
        part = batch.column(k).dictionary_encode("encode")
        codes = codes * (len(part.dictionary) + 1) + part.indices.to_numpy(zero_copy_only=False)
    return codes


def _points(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in "xy"], 1)


def _turns(p: np.ndarray, o: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (p[a, 0] - p[o, 0]) * (p[b, 1] - p[o, 1]) - (p[a, 1] - p[o, 1]) * (p[b, 0] - p[o, 0])


#: Passes over the points of all objects before those that still lose points are walked one by one.
PASSES = 24


def _chain(p: np.ndarray, of: np.ndarray, side: int) -> np.ndarray:
    """Places of the lower (side 1) or upper (-1) hull of each object, of points sorted by object, x and y.

    A point between two others of its object that lies on their line or beyond it is no corner, whatever becomes of the
    two, so all such points of all objects go in one pass.
    """
    keep = np.arange(len(p))
    for _ in range(PASSES):
        o, a, b = keep[:-2], keep[1:-1], keep[2:]
        gone = (of[o] == of[b]) & (side * _turns(p, o, a, b) <= 0)
        if not gone.any():
            return keep
        unsettled = np.unique(of[a[gone]])
        keep = np.r_[keep[:1], a[~gone], keep[-1:]]
    left = np.isin(of[keep], unsettled)
    x, y = p.T.tolist()
    walked: list[int] = []
    first = 0
    for q in keep[left].tolist():
        if walked and of[walked[-1]] != of[q]:
            first = len(walked)
        while len(walked) > first + 1:
            o, a = walked[-2], walked[-1]
            if side * ((x[a] - x[o]) * (y[q] - y[o]) - (y[a] - y[o]) * (x[q] - x[o])) > 0:
                break
            walked.pop()
        walked.append(q)
    return np.sort(np.r_[keep[~left], np.array(walked, np.int64)])


def hull_places(points: np.ndarray, objects: np.ndarray | None = None) -> np.ndarray:
    """Places in ``points`` of the corners of the convex hull, anticlockwise from the least x (monotone chains); of several
    objects one hull after another."""
    if not len(points):
        return np.zeros(0, np.int64)
    of = np.zeros(len(points), np.int64) if objects is None else objects
    at = np.lexsort((points[:, 1], points[:, 0], of))
    at = at[np.r_[True, (np.diff(of[at]) != 0) | (np.diff(points[at], axis=0) != 0).any(1)]]
    p, of = points[at], of[at]
    lower, upper = _chain(p, of, 1), _chain(p, of, -1)
    back = np.setdiff1d(upper, lower, assume_unique=True)  # the ends are in both
    corners = np.r_[lower, back]
    return at[corners[np.lexsort((np.r_[lower, -back], np.repeat([0, 1], [len(lower), len(back)]), of[corners]))]]


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, anticlockwise."""
    return points[hull_places(points)]


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield batch.take(pa.array(hull_places(_points(batch), _objects(batch))))


def hull_points(points: DataFrame, parts: int = 16) -> DataFrame:
    """The points of each object that can be corners of its hull: run_id, label, x, y.

    Hulls merge, so every batch gives only the hull of the points it holds before anything is shuffled;
    what is left of an object is merged by ``parts`` tasks, again in batches.  No task holds an object's points.
    """
    p = points.select(*KEYS, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    dealt = p.mapInArrow(_combine, p.schema).repartition(*KEYS, F.pmod(F.xxhash64("x", "y"), F.lit(parts)))
    return dealt.sortWithinPartitions(*KEYS).mapInArrow(_combine, p.schema)


def _by_object(corners: DataFrame, work: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` on the hulls of whole objects, many in a batch: it gets corners, those of an object together and
    anticlockwise, and where each object starts.  A task holds a batch and the hull of the object that the batch ends in."""

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        return work(batch, np.flatnonzero(np.r_[True, np.diff(_objects(batch)) != 0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            met = batch if held is None else pa.concat_batches([held, batch])
            of = _objects(met)
            places = hull_places(_points(met), of)
            ended = of[places] != of[-1]
            if ended.any():
                yield finish(met.take(pa.array(places[ended])))
            held = met.take(pa.array(places[~ended]))
        if held is not None:
            yield finish(held)

    return corners.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(run, schema)


def shoelace(p: np.ndarray) -> float:
    return abs(float(np.dot(p[:, 0], np.roll(p[:, 1], -1)) - np.dot(p[:, 1], np.roll(p[:, 0], -1)))) / 2 if len(p) > 2 else 0.0


#: Sides or corners of a hull that are held against all its corners at once.
STEP = 256


def smallest_rectangle(p: np.ndarray) -> tuple[float, float, float]:
    """Sides and angle in degrees of the rectangle of least area around hull corners.

    The first side runs along the angle, which is at least -90 and under 0; of equal areas the least angle counts.
    """
    if len(p) < 2:
        return 0.0, 0.0, -90.0
    found = []
    sides = np.roll(p, -1, 0) - p
    for d in np.array_split(sides, range(STEP, len(sides), STEP)):
        turn = np.round(np.degrees(np.arctan2(d[:, 1], d[:, 0])), 9)
        d = d / np.maximum(np.hypot(d[:, 0], d[:, 1]), 1e-300)[:, None]
        w, h = np.ptp(p @ d.T, 0), np.ptp(p @ np.stack([-d[:, 1], d[:, 0]]), 0)
        quarters = np.floor(turn / 90) + 1
        w, h = np.where(quarters % 2, h, w), np.where(quarters % 2, w, h)
        angle = turn - 90 * quarters
        k = np.lexsort((turn, np.round(angle, 6), np.round(w * h, 6)))[0]
        found.append((round(w[k] * h[k], 6), round(angle[k], 6), turn[k], float(w[k]), float(h[k]), float(angle[k])))
    return min(found)[3:]


#: Exponents of the sums that an ellipse is fitted from.
POWERS = [(i, j) for i in range(5) for j in range(5 - i)]
_TERMS = ((2, 0), (1, 1), (0, 2), (1, 0), (0, 1), (0, 0))
_SUMS = np.array([[POWERS.index((a[0] + b[0], a[1] + b[1])) for b in _TERMS] for a in _TERMS])
#: Objects whose points lie on a line but for this share of their extent squared have no ellipse.
FLAT = 1e-12


def fit_ellipses(sums: np.ndarray) -> np.ndarray:
    """Axes (longer first) and angle of the longer in degrees of many objects by direct least squares; NaN if there is none.

    ``sums`` holds for each object the sums of x ** i * y ** j, (i, j) as in ``POWERS``, about the centre.
    """
    full = sums[:, _SUMS]
    n, good = full[:, 5, 5], full[:, 5, 5] >= 5
    s1, s2, s3 = full[:, :3, :3], full[:, :3, 3:], full[:, 3:, 3:]
    good &= np.linalg.det(s3) > FLAT * n**3
    t = -np.linalg.solve(np.where(good[:, None, None], s3, np.eye(3)), s2.transpose(0, 2, 1))
    m = np.array([[0, 0, 0.5], [0, -1, 0], [0.5, 0, 0]]) @ (s1 + s2 @ t)
    vectors = np.real(np.linalg.eig(np.where(good[:, None, None], m, np.eye(3)))[1])
    positive = 4 * vectors[:, 0] * vectors[:, 2] - vectors[:, 1] ** 2
    best = positive.argmax(1)
    each = np.arange(len(sums))
    good &= positive[each, best] > 0
    v = vectors[each, :, best]
    quad = np.where(good[:, None, None], np.stack([v[:, 0], v[:, 1] / 2, v[:, 1] / 2, v[:, 2]], 1).reshape(-1, 2, 2), np.eye(2))
    rest = np.einsum("kij,kj->ki", t, v)
    mid = -np.linalg.solve(2 * quad, rest[:, :2, None])[:, :, 0]
    level = np.einsum("ki,kij,kj->k", mid, quad, mid) - rest[:, 2]
    values, axes = np.linalg.eigh(quad)
    radii = level[:, None] / values
    good &= (radii > 0).all(1)
    long = axes[each, :, radii.argmax(1)]
    made = np.stack([2 * np.sqrt(np.abs(radii.max(1))), 2 * np.sqrt(np.abs(radii.min(1))), np.degrees(np.arctan2(long[:, 1], long[:, 0])) % 180], 1)
    made[~good] = np.nan
    return made


def fit_ellipse(p: np.ndarray) -> tuple[float, float, float] | None:
    """``fit_ellipses`` of one object's points."""
    q = p - p.mean(0)
    scale = float(np.abs(q).max()) or 1.0
    x, y = (q / scale).T
    long, short, angle = fit_ellipses(np.array([[(x**i * y**j).sum() for i, j in POWERS]]))[0]
    return None if math.isnan(long) else (scale * long, scale * short, angle)


#: Side of the blocks that powers of coordinates are summed in.
BLOCK = 256


def power_sums(points: DataFrame) -> DataFrame:
    """Of each object its scale and the sums of ``POWERS`` over its points, about their centre and divided by the scale: p0 to p14.

    Sums are made about the corner of blocks, so that an object of any size is summed by many tasks and whole
    coordinates stay exact; the blocks of an object, not its points, are then moved to its centre.
    """
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    p = points.where("x IS NOT NULL AND y IS NOT NULL").select(*KEYS, x.alias("x"), y.alias("y"), (F.floor(x / BLOCK) * BLOCK).cast("double").alias("ox"), (F.floor(y / BLOCK) * BLOCK).cast("double").alias("oy"))
    power = lambda of, k: reduce(operator.mul, [of] * k) if k else F.lit(1.0)
    sums = [F.sum(power(F.col("x") - F.col("ox"), i) * power(F.col("y") - F.col("oy"), j)).alias(f"b{k}") for k, (i, j) in enumerate(POWERS)]
    blocks = p.groupBy(*KEYS, "ox", "oy").agg(*sums, *(f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))))
    b = {power: F.col(f"b{k}") for k, power in enumerate(POWERS)}
    # over an object's blocks, in the same tasks that sum them up: a join would bring a row for each object to the driver
    own = Window.partitionBy(*KEYS)
    n = F.sum(b[0, 0]).over(own)
    whole = blocks.withColumns({"cx": F.sum(b[1, 0] + F.col("ox") * b[0, 0]).over(own) / n, "cy": F.sum(b[0, 1] + F.col("oy") * b[0, 0]).over(own) / n} | {f"{n}{c}": f(f"{n}{c}").over(own) for c in "xy" for n, f in (("min", F.min), ("max", F.max))})
    scale = F.greatest(*(F.col(f"max{c}") - F.col(f"c{c}") for c in "xy"), *(F.col(f"c{c}") - F.col(f"min{c}") for c in "xy"))
    moved = whole.withColumn("scale", F.when(scale > 0, scale).otherwise(1.0)).withColumns({f"d{c}": F.col(f"o{c}") - F.col(f"c{c}") for c in "xy"})
    # first along x, then along y
    along = lambda d, k, terms: reduce(operator.add, (math.comb(k, a) * power(F.col(d), k - a) * terms(a) for a in range(k + 1)))
    moved = moved.withColumns({f"q{i}{j}": along("dx", i, lambda a: b[a, j]) for i, j in POWERS})
    sums = [F.sum(along("dy", j, lambda c: F.col(f"q{i}{c}"))) / power(F.col("scale"), i + j) for i, j in POWERS]
    return moved.groupBy(*KEYS, "scale").agg(*(total.alias(f"p{k}") for k, total in enumerate(sums)))


def ellipses(points: DataFrame) -> DataFrame:
    """Ellipse of each object: run_id, label, long, short (axes) and turn (angle of the longer), null if there is none."""
    sums = power_sums(points)
    kinds = dict(sums.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fit_ellipses(np.stack([batch.column(f"p{k}").to_numpy(zero_copy_only=False) for k in range(len(POWERS))], 1))
            scale = batch.column("scale").to_numpy(zero_copy_only=False)
            columns = [pa.array(c, from_pandas=True) for c in (made[:, 0] * scale, made[:, 1] * scale, made[:, 2])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEYS), *columns], names=[*KEYS, "long", "short", "turn"])

    return sums.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in KEYS) + ", long double, short double, turn double")


def greatest_distance(p: np.ndarray) -> float:
    return max((float(np.hypot(p[:, :1] - q[:, 0], p[:, 1:] - q[:, 1]).max()) for q in np.array_split(p, range(STEP, len(p), STEP))), default=0.0)


HULL = ("hull_area_px", "hull_perimeter_px", "rot_rect_w_px", "rot_rect_h_px", "rot_rect_angle", "widest")


#: Pairs of a side or corner and a corner of the same object that are held at once.
PAIRS = 1 << 19


def _measures(p: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The values of ``HULL`` of objects whose hull corners follow one another: a row for each."""
    n = np.diff(np.r_[starts, len(p)])
    to = np.arange(1, len(p) + 1)
    to[starts + n - 1] = starts
    x, y = p.T
    out = np.zeros((len(n), len(HULL)))
    out[:, 0] = np.abs(np.add.reduceat(x * y[to] - y * x[to], starts)) / 2 * (n > 2)
    out[:, 1] = np.add.reduceat(np.hypot(x[to] - x, y[to] - y), starts)
    for k in np.flatnonzero(n > STEP):
        h = p[starts[k] : starts[k] + n[k]]
        out[k, 2:] = *smallest_rectangle(h), greatest_distance(h)
    few = np.flatnonzero(n <= STEP)
    for some in np.split(few, np.flatnonzero(np.diff(np.cumsum(n[few] ** 2) // PAIRS)) + 1):
        if len(some):
            out[some, 2:] = _rectangles(p, to, starts[some], n[some])
    return out


def _rectangles(p: np.ndarray, to: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``smallest_rectangle`` and ``greatest_distance`` of some objects, each side and corner against all corners of its object."""
    first = np.cumsum(n) - n
    of = np.repeat(np.arange(len(n)), n)
    own = np.arange(len(of)) - first[of] + starts[of]
    rows = n[of]
    begin = np.cumsum(rows) - rows
    side = np.repeat(np.arange(len(of)), rows)
    other = p[np.arange(len(side)) - begin[side] + starts[of][side]]
    far = np.maximum.reduceat(np.hypot(*(p[own][side] - other).T), begin[first])
    d = p[to[own]] - p[own]
    turn = np.round(np.degrees(np.arctan2(d[:, 1], d[:, 0])), 9)
    d = d / np.maximum(np.hypot(d[:, 0], d[:, 1]), 1e-300)[:, None]
    along, across = (np.maximum.reduceat(v, begin) - np.minimum.reduceat(v, begin) for v in (other[:, 0] * d[side, 0] + other[:, 1] * d[side, 1], other[:, 1] * d[side, 0] - other[:, 0] * d[side, 1]))
    quarters = np.floor(turn / 90) + 1
    w, h = np.where(quarters % 2, across, along), np.where(quarters % 2, along, across)
    angle = turn - 90 * quarters
    best = np.lexsort((turn, np.round(angle, 6), np.round(w * h, 6), of))[first]
    return np.stack([w[best], h[best], angle[best], far], 1)


def hull_shapes(points: DataFrame) -> DataFrame:
    """Area and perimeter of each object's hull, its smallest rectangle and greatest width: ``HULL``; a task holds a hull."""
    corners = hull_points(points)
    kinds = dict(corners.dtypes)

    def work(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        whole = batch.take(pa.array(starts))
        return pa.RecordBatch.from_arrays([*(whole.column(k) for k in KEYS), *(pa.array(c) for c in _measures(_points(batch), starts).T)], names=[*KEYS, *HULL])

    return _by_object(corners, work, ", ".join(f"{k} {kinds[k]}" for k in KEYS) + ", " + ", ".join(f"{c} double" for c in HULL))


def least_distances(points: DataFrame) -> DataFrame:
    """Least distance between two points of each object, repeated ones among them, 0 of a single one: run_id, label, nearest.

    Neighbours in the orders by x and by y bound it; points nearer than that share a cell of the bound's size or lie in
    neighbouring ones.
    """
    p = points.where("x IS NOT NULL AND y IS NOT NULL").select(*KEYS, "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    steps = [F.hypot(*(F.lead(c).over(Window.partitionBy(*KEYS).orderBy(*order, "seq")) - F.col(c) for c in "xy")) for order in ("xy", "yx")]
    bound = p.select(*KEYS, F.least(*steps).alias("d")).groupBy(*KEYS).agg(F.coalesce(F.min("d"), F.lit(0.0)).alias("bound"))
    placed = p.join(bound.where("bound > 0"), KEYS).withColumns({f"g{c}": F.floor(F.col(c) / F.col("bound")) for c in "xy"})
    near = F.explode(F.array(*(F.struct((F.col("gx") + a).alias("gx"), (F.col("gy") + b).alias("gy"), F.lit(a != 0 or b != 0).alias("other")) for a, b in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1)))))
    far = placed.select(*KEYS, near.alias("g"), F.col("seq").alias("seq2"), F.col("x").alias("x2"), F.col("y").alias("y2")).select(*KEYS, "g.*", "seq2", "x2", "y2")
    pairs = placed.join(far, [*KEYS, "gx", "gy"]).where("other OR seq < seq2").groupBy(*KEYS).agg(F.min(F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))).alias("d"))
    return bound.join(pairs, KEYS, "left").select(*KEYS, F.least("bound", "d").alias("nearest"))


SHAPE = ("hull_area_px", "hull_perimeter_px", "rot_rect_w_px", "rot_rect_h_px", "rot_rect_angle", "eccentricity", "orientation_angle", "feret_max_px", "feret_min_px")


def whole_shapes(vertices: DataFrame) -> DataFrame:
    """The features in ``SHAPE`` of each object.

    Widths are the axes of the ellipse, and the orientation is that of its shorter one; without an ellipse they are the
    greatest and least distance of two points and the rectangle's angle.
    """
    found = cut(ellipses(vertices))
    flat = vertices.join(found.where("long IS NULL").select(*KEYS), KEYS, "left_semi")
    made = hull_shapes(vertices).join(found.hint("merge"), KEYS).join(least_distances(flat).hint("merge"), KEYS, "left")
    ratio = F.col("short") / F.col("long")
    return made.select(
        *KEYS, *HULL[:-1], F.coalesce(F.sqrt(F.greatest(F.lit(0.0), 1 - ratio * ratio)), F.lit(0.0)).alias("eccentricity"),
        F.pmod(F.coalesce(F.col("turn") + 90, "rot_rect_angle"), F.lit(180.0)).alias("orientation_angle"), F.coalesce("long", "widest").alias("feret_max_px"), F.coalesce("short", "nearest").alias("feret_min_px"),
    )


def hull_fill(objects: DataFrame) -> DataFrame:
    """Pixels inside the hull of each object of pixels (run_id, label, y, x): run_id, label, y, x; lines of a hull's rows, no whole image."""
    corners = hull_points(objects)
    kinds = dict(corners.dtypes)

    def sides(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        h = _points(batch)
        to = np.arange(1, len(h) + 1)
        to[np.r_[starts[1:], len(h)] - 1] = starts
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEYS), *(pa.array(c) for c in (h[:, 0], h[:, 1], h[to, 0], h[to, 1]))], names=[*KEYS, "x", "y", "x2", "y2"])

    edges = _by_object(corners, sides, ", ".join(f"{k} {kinds[k]}" for k in KEYS) + ", x double, y double, x2 double, y2 double")
    met = edges.select("*", F.explode(F.sequence(F.least("y", "y2").cast("long"), F.greatest("y", "y2").cast("long"))).alias("row"))
    # a side along a row gives both its ends, once from each direction or from its neighbours
    at = F.when(F.col("y") == F.col("y2"), F.col("x")).otherwise(F.col("x") + (F.col("x2") - F.col("x")) * (F.col("row") - F.col("y")) / (F.col("y2") - F.col("y")))
    rows = met.groupBy(*KEYS, F.col("row").alias("y")).agg(F.ceil(F.min(at) - 1e-9).alias("a"), F.floor(F.max(at) + 1e-9).alias("b")).where("a <= b")
    return rows.select(*KEYS, "y", F.explode(F.sequence("a", "b")).alias("x"))


def measure(vertices: DataFrame) -> DataFrame:
    """All features of polygons, without millimetres (``calibration.with_mm`` adds them)."""
    vertices = cut(vertices)  # read several times
    made = polygon_features(vertices).join(whole_shapes(vertices).hint("merge"), KEYS).join(hu_moments(vertices).hint("merge"), KEYS)
    long, short = F.greatest("rot_rect_w_px", "rot_rect_h_px"), F.least("rot_rect_w_px", "rot_rect_h_px")
    made = made.withColumns({"length_px": long, "width_px": short, "major_axis_px": long, "minor_axis_px": short})
    return made.withColumns(
        {
            "solidity": safe_div(F.col("area_px"), F.col("hull_area_px")), "convexity": safe_div(F.col("hull_perimeter_px"), F.col("perimeter_px")),
            "elongation": safe_div(short, long), "aspect_ratio": safe_div(long, short), "fill_ratio": safe_div(F.col("area_px"), F.col("rot_rect_w_px") * F.col("rot_rect_h_px")),
        }
    )
