"""Colours of images: hue, saturation and value, smaller images, and two clusters of each image's colours.

Images are rows (run_id, y, x, b, g, r).  All images are clustered in the same jobs: a round of Lloyd's
method is one aggregate over the distinct colours of every image and the centres of every attempt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bands, frames
from .frames import sizes
from .links import cut

HSV = ("c0", "c1", "c2")
#: Places of the two centres of an attempt.
FIRST, SECOND = ("a0", "a1", "a2"), ("b0", "b1", "b2")
CENTRES = (*FIRST, *SECOND)


def hsv(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """Hue in half degrees (0 to 179), saturation and value (0 to 255) of 8-bit channels, rounded."""
    value = F.greatest(b, g, r)
    spread = value - F.least(b, g, r)
    turn = F.when(value == r, F.try_divide(30.0 * (g - b), spread)).when(value == g, 60 + F.try_divide(30.0 * (b - r), spread)).otherwise(120 + F.try_divide(30.0 * (r - g), spread))
    hue = F.floor(F.coalesce(turn, F.lit(0.0)) + 0.5)
    return F.when(hue < 0, hue + 180).otherwise(hue).cast("long"), F.floor(F.coalesce(F.try_divide(255.0 * spread, value), F.lit(0.0)) + 0.5).cast("long"), value.cast("long")


def reduced(pixels: DataFrame, side: int = 640) -> DataFrame:
    """Images of at most ``side`` pixels a side: a small pixel is the rounded mean of those that fall on it."""
    rows = pixels.join(sizes(pixels), "run_id").withColumn("_m", F.greatest("h", "w"))
    place = lambda at, length: F.expr(f"CASE WHEN _m <= {side} THEN {at} ELSE {at} * greatest(1, {length} * {side} div _m) div {length} END").cast("long")
    means = (F.expr(f"(2 * sum({c}) + count({c})) div (2 * count({c}))").alias(c) for c in "bgr")
    return rows.withColumns({"_y": place("y", "h"), "_x": place("x", "w")}).groupBy("run_id", F.col("_y").alias("y"), F.col("_x").alias("x")).agg(*means)


def in_hsv(pixels: DataFrame) -> DataFrame:
    """run_id, y, x, c0, c1, c2; pixels with a null channel are left out."""
    made = pixels.dropna(subset=["b", "g", "r"])
    return made.select("run_id", "y", "x", *(c.alias(k) for c, k in zip(hsv(F.col("b"), F.col("g"), F.col("r")), HSV)))


def _far(centre: tuple[str, ...]) -> Column:
    """Squared distance of a colour to a centre."""
    parts = [(F.col(c) - F.col(m)) * (F.col(c) - F.col(m)) for c, m in zip(HSV, centre)]
    return parts[0] + parts[1] + parts[2]


def _sums(colours: DataFrame, centres: DataFrame) -> DataFrame:
    """Of each attempt: pixels, sums and squares of the colours nearer to the first and to the second centre (ties to the first)."""
    squares = F.col("n") * (F.col("c0") * F.col("c0") + F.col("c1") * F.col("c1") + F.col("c2") * F.col("c2"))
    weighed = {"n": F.col("n"), "_q": squares} | {f"_s{j}": F.col("n") * F.col(c) for j, c in enumerate(HSV)}
    placed = colours.join(centres, "run_id").select(*centres.columns, (_far(SECOND) < _far(FIRST)).alias("_second"), *(x.alias(name) for name, x in weighed.items()))
    sums = (F.sum(F.when(F.col("_second") == (k == "b"), F.col(name)).otherwise(0)).alias(k + name.lstrip("_")) for k in "ab" for name in weighed)
    return placed.groupBy(*centres.columns).agg(*sums)


def two_means(points: DataFrame, attempts: int = 10, rounds: int = 10, still: float = 1.0, seed: int = 1) -> DataFrame:
    """The two centres of each run's points (run_id, c0, c1, c2 as longs): run_id, a0 to b2.

    An attempt starts at two of the run's colours, the first and the last by a hash of seed, attempt and
    colour.  It ends after ``rounds`` or when no centre moves by more than ``still``; of the attempts the one
    with the least sum of squared distances stays, the earliest of equal ones.  A centre that no colour is near
    stays where it is.  Sums are whole numbers, so results do not depend on how rows are spread.
    """
    colours = cut(points.groupBy("run_id", *HSV).agg(F.count("*").alias("n")))
    hashed = F.md5(F.concat_ws(",", F.lit(seed), "attempt", *HSV))
    tried = colours.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1)))).withColumn("_h", hashed)
    ends = tried.groupBy("run_id", "attempt").agg(F.min_by(F.struct(*HSV), "_h").alias("a"), F.max_by(F.struct(*HSV), "_h").alias("b"))
    centres = cut(ends.select("run_id", "attempt", *(F.col(f"{k}.c{j}").cast("double").alias(f"{k}{j}") for k in "ab" for j in range(3)), F.lit(False).alias("done")))
    for _ in range(rounds):
        made = _sums(colours, centres)
        new = {f"{k}{j}": F.when(~F.col("done") & (F.col(f"{k}n") > 0), F.col(f"{k}s{j}") / F.col(f"{k}n")).otherwise(F.col(f"{k}{j}")) for k in "ab" for j in range(3)}
        moved = made.select("run_id", "attempt", "done", *CENTRES, *(v.alias(f"new_{k}") for k, v in new.items()))
        shift = lambda centre: sum(((F.col(f"new_{m}") - F.col(m)) * (F.col(f"new_{m}") - F.col(m)) for m in centre[1:]), (F.col(f"new_{centre[0]}") - F.col(centre[0])) * (F.col(f"new_{centre[0]}") - F.col(centre[0])))
        rests = F.col("done") | (F.greatest(shift(FIRST), shift(SECOND)) <= still * still)
        centres = cut(moved.select("run_id", "attempt", *(F.col(f"new_{m}").alias(m) for m in CENTRES), rests.alias("done")))
        if not centres.where("NOT done").limit(1).count():
            break
    made = _sums(colours, centres)
    spread = lambda k: F.expr(f"{k}q - 2 * ({k}0 * {k}s0 + {k}1 * {k}s1 + {k}2 * {k}s2) + {k}n * ({k}0 * {k}0 + {k}1 * {k}1 + {k}2 * {k}2)")
    best = made.groupBy("run_id").agg(F.min_by(F.struct(*CENTRES), F.struct(F.round(spread("a") + spread("b"), 3), "attempt")).alias("_m"))
    return best.select("run_id", "_m.*")


def foreground(pixels: DataFrame, side: int = 640, attempts: int = 10, seed: int = 1) -> DataFrame:
    """Foreground (255) of each image by two clusters of its colours: run_id, y, x, v.

    Centres come from the reduced image, and so does the background: the cluster that holds more of its
    edges (corners count for both their edges, ties make the first cluster the background).  A pixel as far
    from both centres as from one is background.  Where nothing or more than nine tenths is foreground, the
    cluster with the greater value is taken.  Pixels with a null channel are 0.
    """
    lines = cut(bands.pack(pixels, "bgr"))  # read three times
    small = cut(in_hsv(_reduced_lines(lines, side)))
    centres = cut(two_means(small, attempts, seed=seed))
    ends = small.groupBy("run_id").agg(F.max("y").alias("_my"), F.max("x").alias("_mx"))
    edges = sum(((F.col(c) == end).cast("long") for c, end in (("x", F.lit(0)), ("y", F.col("_my")), ("x", F.col("_mx")))), (F.col("y") == 0).cast("long"))
    placed = small.join(ends, "run_id").join(centres, "run_id").select("run_id", edges.alias("_e"), (_far(SECOND) < _far(FIRST)).cast("long").alias("_second"))
    # the first cluster is in front
    votes = placed.groupBy("run_id").agg((F.sum(F.col("_e") * F.col("_second")) > F.sum(F.col("_e") * (1 - F.col("_second")))).alias("_first"))
    kind = dict(pixels.dtypes)["run_id"]
    size = cut(bands.sizes(lines))
    beside = frames.by_band(size.select("run_id", "h").join(centres, "run_id", "left"), 0)
    counts = bands.over(lines, _counted, f"run_id {kind}, _n long, _na long, _nb long", planes=3, beside=beside)
    counts = counts.groupBy("run_id").agg(*(F.sum(c).alias(c) for c in ("_n", "_na", "_nb"))).join(votes, "run_id")
    got = F.when(F.col("_first"), F.col("_na")).otherwise(F.col("_nb"))
    turned = (got == 0) | (got > 0.9 * F.col("_n"))
    chosen = counts.join(centres, "run_id").select("run_id", *CENTRES, F.when(turned, F.col("a2") > F.col("b2")).otherwise(F.col("_first")).alias("first"))
    beside = cut(frames.by_band(size.select("run_id", "h").join(chosen, "run_id", "left"), 0))
    return bands.as_pixels(bands.over(lines, _in_front, bands.pixel_schema(lines), planes=3, beside=beside), pixels)


def _hsv_planes(band: bands.Band) -> tuple[np.ndarray, ...]:
    """``hsv`` of a band as doubles, NaN where a channel is null."""
    b, g, r = (p[band.own].astype(np.float64) for p in band.planes)
    value = np.maximum(np.maximum(b, g), r)
    spread = value - np.minimum(np.minimum(b, g), r)
    with np.errstate(divide="ignore", invalid="ignore"):
        turn = np.where(value == r, 30.0 * (g - b) / spread, np.where(value == g, 60 + 30.0 * (b - r) / spread, 120 + 30.0 * (r - g) / spread))
        hue = np.floor(np.where(spread == 0, 0.0, turn) + 0.5)
        return np.where(hue < 0, hue + 180, hue), np.floor(np.where(value == 0, 0.0, 255.0 * spread / value) + 0.5), value


def _distances(band: bands.Band) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of a band's colours to the two centres; NaN where a channel is null."""
    planes = _hsv_planes(band)
    out = []
    for centre in (FIRST, SECOND):
        parts = [(c - band.row[m]) * (c - band.row[m]) for c, m in zip(planes, centre)]
        out.append(parts[0] + parts[1] + parts[2])
    return out[0], out[1]


def _counted(band: bands.Band) -> Iterator[pa.RecordBatch]:
    """Of a band, its pixels, and those nearer to the first and to the second centre."""
    if band.row["a0"] is not None:
        first, second = _distances(band)
        n = first.size if band.there is None else np.count_nonzero(band.there[band.own])
        yield pa.RecordBatch.from_arrays([pa.repeat(band.run_id, 1), *(pa.array([int(k)]) for k in (n, (first < second).sum(), (second < first).sum()))], names=["run_id", "_n", "_na", "_nb"])


def _in_front(band: bands.Band) -> Iterator[pa.RecordBatch]:
    if band.row["a0"] is None:
        yield band.pixels(np.zeros(band.a[band.own].shape, np.int64))
    else:
        first, second = _distances(band)
        yield band.pixels(np.where(first < second if band.row["first"] else second < first, 255, 0))


def _reduced_lines(lines: DataFrame, side: int) -> DataFrame:
    """``reduced`` of packed lines: a band makes the small pixels whose first line it holds, with a margin that holds the rest of them."""
    kind = dict(lines.dtypes)["run_id"]
    size = cut(bands.sizes(lines))
    most = size.agg(F.max(F.greatest("h", "w"))).first()[0] or 1

    def means(band: bands.Band) -> Iterator[pa.RecordBatch]:
        h, w, most = band.row["h"], band.row["w"], max(band.row["h"], band.row["w"])
        place = lambda at, length: at if most <= side else at * max(1, length * side // most) // length
        y, x = place(np.arange(band.first - 1, band.first + len(band.a)), h), place(np.arange(band.a.shape[1]), w)
        begun = y[1:][band.own][y[1:][band.own] != y[:-1][band.own]]
        if not len(begun):
            return
        ours = (y[1:] >= begun[0]) & (y[1:] <= begun[-1])
        ny, nx = int(begun[-1] - begun[0]) + 1, int(x[-1]) + 1
        at = ((y[1:][ours] - begun[0])[:, None] * nx + x).ravel()
        there = np.ones(len(at), bool) if band.there is None else band.there[ours].ravel()
        small = np.flatnonzero(np.bincount(at[there], minlength=ny * nx) > 0)
        columns = []
        for plane in band.planes:
            v = plane[ours].astype(np.float64).ravel()
            known = ~np.isnan(v)
            total, n = np.bincount(at[known], v[known], ny * nx)[small].astype(np.int64), np.bincount(at[known], minlength=ny * nx)[small]
            columns.append(pa.array((2 * total + n) // np.maximum(2 * n, 1), mask=n == 0))
        yield pa.RecordBatch.from_arrays([pa.repeat(band.run_id, len(small)), pa.array(begun[0] + small // nx), pa.array(small % nx), *columns], names=["run_id", "y", "x", *"bgr"])

    margin = -(-most // side) + 1
    return bands.over(lines, means, f"run_id {kind}, y long, x long, b long, g long, r long", margin, planes=3, beside=frames.by_band(size, margin))
