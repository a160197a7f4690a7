"""Neighbourhoods of pixels as frames over the lines of images.

A pixel table (run_id, y, x, v) holds every pixel of its images.  Smoothing, cleaning up and equalising work on bands of
packed lines (``bands``).  Frames run along x within a row of an image, then along y within a column: sums with weights,
and extremes over kernels whose rows are intervals.  A task holds a line or a band of an image at most; these are dealt
out over all tasks, so an image may be larger than any of them.  Tables of pixels are merged with one another, never broadcast:
what the planner knows of their size (files of few bytes a row, exploded rows) is far too little.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bands
from .links import cut

ROW = ("run_id", "y", "x")


def sizes(px: DataFrame) -> DataFrame:
    """Height and width of each image: run_id, h, w."""
    return px.groupBy("run_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def with_size(px: DataFrame) -> DataFrame:
    return px.join(sizes(px), "run_id")


def _line(axis: str):
    return Window.partitionBy("run_id", "y" if axis == "x" else "x").orderBy(axis)


def _neighbour(column: str, step: int, axis: str) -> Column:
    """The value so many places on, null beyond the line's ends."""
    return F.col(column) if not step else (F.lead(column, step) if step > 0 else F.lag(column, -step)).over(_line(axis))


# -- weighted sums

#: Smoothing weights of up to five pixels, as whole numbers.
BINOMIAL = (1, 4, 6, 4, 1)


def gaussian_weights(size: int) -> tuple[float, ...]:
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    w = [math.exp(-((k - size // 2) ** 2) / (2 * sigma * sigma)) for k in range(size)]
    return tuple(x / sum(w) for x in w)


def _continued(px: DataFrame, axis: str, r: int, mirrored: bool) -> DataFrame:
    """Lines with ``r`` more pixels at both ends: mirrored at the end pixels, or copies of these."""
    at, n = F.col(axis), F.col("h" if axis == "y" else "w")
    near = lambda f: F.filter(F.sequence((-F.lit(r)).cast("long"), (n + r - 1).cast("long")), f)
    if mirrored:
        period = F.greatest(2 * (n - 1), F.lit(1))
        ends = near(lambda p: F.least(F.pmod(p, period), period - F.pmod(p, period)) == at)
        ends = F.when(n == 1, F.sequence((-F.lit(r)).cast("long"), F.lit(r).cast("long"))).when((at <= r) | (at >= n - 1 - r), ends)
    else:
        ends = F.when((at == 0) | (at == n - 1), near(lambda p: (p == at) | ((at == 0) & (p < 0)) | ((at == n - 1) & (p >= n))))
    places = F.coalesce(ends, F.array(at.cast("long")))
    return px.select(*(c for c in px.columns if c != axis), F.explode(places).alias(axis))


def weighted(px: DataFrame, weights: Sequence[float], mirrored: bool = True, column: str = "v", out: str = "s") -> DataFrame:
    """Adds the sum over a square of pixels with weights that are products along x and y."""
    r = len(weights) // 2
    own = with_size(px).withColumn("_s", F.col(column))
    for axis in ("x", "y"):
        wide = _continued(own, axis, r, mirrored)
        terms = [_neighbour("_s", k - r, axis) * w for k, w in enumerate(weights)]
        total = terms[0]
        for term in terms[1:]:
            total = total + term
        summed = wide.select(*(c for c in wide.columns if c != "_s"), total.alias("_s"))
        own = summed.where((F.col(axis) >= 0) & (F.col(axis) < F.col("h" if axis == "y" else "w")))
    return own.select(*px.columns, F.col("_s").alias(out))


def smooth5(px: DataFrame) -> DataFrame:
    """Binomial mean of 5 x 5 pixels with mirrored edges, halves up."""
    def smooth(band: bands.Band) -> Iterator[pa.RecordBatch]:
        yield band.pixels(np.floor((bands.weighted(band, band.a, BINOMIAL, True) + 128) / 256))

    lines = bands.pack(px)
    return bands.as_pixels(bands.over(lines, smooth, bands.pixel_schema(lines), len(BINOMIAL) // 2), px)


# -- extremes

def ellipse(size: int) -> tuple[int, ...]:
    """Half widths of an elliptic kernel's rows, halves to even."""
    r = size // 2
    return tuple(round(r * math.sqrt((r * r - d * d) / (r * r))) if r else 0 for d in range(-r, r + 1))


def _turned(kernel: Sequence[int]) -> tuple[int, ...]:
    """The half heights of a kernel's columns, from the half widths of its rows: rows get narrower outwards."""
    r = len(kernel) // 2
    return tuple(max(abs(k - r) for k, half in enumerate(kernel) if half >= abs(d)) for d in range(-max(kernel), max(kernel) + 1))


def extreme(px: DataFrame, kernel: Sequence[int], largest: bool, along: str = "x") -> DataFrame:
    """Greatest or least value over a kernel; what lies outside the image does not count.

    First over intervals ``along`` one axis, then across.  Each neighbour is fetched once, and intervals grow by two
    from one width to the next: sliding frames would read all their values anew at every pixel, for every width.
    """
    of, kernel = F.greatest if largest else F.least, kernel if along == "x" else _turned(kernel)
    reach, r = max(kernel), len(kernel) // 2
    near = px.select(*ROW, F.col("v").alias("_w0"), *(_neighbour("v", k, along).alias(f"_{k}") for k in range(-reach, reach + 1) if k))
    widest = 0
    for d in sorted(set(kernel) - {0}):
        more = [F.col(f"_{k}") for s in range(widest + 1, d + 1) for k in (-s, s)]
        near, widest = near.withColumn(f"_w{d}", of(F.col(f"_w{widest}"), *more)), d
    rows = near.select(*ROW, *(f"_w{d}" for d in sorted(set(kernel))))
    terms = [_neighbour(f"_w{d}", k - r, "y" if along == "x" else "x") for k, d in enumerate(kernel)]
    return rows.select(*ROW, (terms[0] if len(terms) == 1 else of(*terms)).alias("v"))


def _extremes(px: DataFrame, kernel: Sequence[int], kinds: Sequence[bool]) -> DataFrame:
    """Extremes one after another; every second one begins along the lines in which the one before has dealt out and sorted the pixels."""
    axes = "xy" if _turned(_turned(kernel)) == tuple(kernel) else "xx"  # a kernel whose rows widen outwards has no such columns
    for k, largest in enumerate(kinds):
        px = extreme(px, kernel, largest, axes[k % 2])
    return px


def dilate(px: DataFrame, kernel: Sequence[int], times: int = 1) -> DataFrame:
    return _extremes(px, kernel, [True] * times)


def erode(px: DataFrame, kernel: Sequence[int], times: int = 1) -> DataFrame:
    return _extremes(px, kernel, [False] * times)


def opened(px: DataFrame, kernel: Sequence[int], times: int = 1) -> DataFrame:
    return cut(_extremes(px, kernel, [False] * times + [True] * times))


def closed(px: DataFrame, kernel: Sequence[int], times: int = 1) -> DataFrame:
    return cut(_extremes(px, kernel, [True] * times + [False] * times))


def cleanup(binary: DataFrame) -> DataFrame:
    """Opening once and closing twice, with ellipses that grow with the image.

    Images of one kernel size run as one job; the sizes that there are come to the driver.
    """
    lines = cut(bands.pack(binary))
    scale = F.greatest(F.lit(1.0), F.sqrt(F.col("h") * F.col("w") / F.lit(1920.0 * 1080.0)))
    odd = lambda n: F.floor(n * scale).bitwiseOR(F.lit(1)).cast("int")
    size = bands.sizes(lines).select("run_id", odd(3).alias("open"), odd(12).alias("close"))
    kinds = [(r.open, r.close) for r in size.select("open", "close").distinct().collect()]
    made = None
    for o, c in sorted(kinds):
        some = lines if len(kinds) == 1 else lines.join(size.where((F.col("open") == o) & (F.col("close") == c)).select("run_id"), "run_id", "left_semi")
        part = _cleaned(some, ellipse(o), ellipse(c))
        made = part if made is None else made.unionByName(part)
    return binary.select(*ROW, "v") if made is None else bands.as_pixels(made, binary, None)


def _cleaned(lines: DataFrame, small: Sequence[int], large: Sequence[int]) -> DataFrame:
    def clean(band: bands.Band) -> Iterator[pa.RecordBatch]:
        a = band.a
        for kernel, kinds in ((small, (False, True)), (large, (True, True, False, False))):
            for largest in kinds:
                a = bands.extreme(a, kernel, largest)
        yield band.pixels(a[band.own])

    return bands.over(lines, clean, bands.pixel_schema(lines), 2 * (len(small) // 2) + 4 * (len(large) // 2))


def top_hat(px: DataFrame, size: int = 51) -> DataFrame:
    """What rises above the opened image, stretched by at most 4; images with a mean of 120 or more stay as they are."""
    hat = px.select(*ROW, "v").join(opened(px.select(*ROW, "v"), ellipse(size | 1)).withColumnRenamed("v", "_o").hint("merge"), list(ROW)).withColumn("_hat", F.col("v") - F.col("_o"))
    about = hat.groupBy("run_id").agg(F.avg("v").alias("_mean"), F.max("_hat").alias("_most"))
    stretched = F.least(F.lit(255), F.floor(F.col("_hat") * F.least(F.lit(4.0), F.try_divide(F.lit(255.0), F.col("_most")))))
    v = F.when(F.col("_mean") >= 120, F.col("v")).when(F.col("_most") > 0, stretched).otherwise(F.col("_hat"))
    return hat.join(about, "run_id").select(*ROW, v.cast("long").alias("v"))


# -- equalising by tiles

LEVELS = 256


def _curves(counts: np.ndarray, clip: float, pixels: int) -> np.ndarray:
    """Clipped cumulative histograms of tiles of so many pixels: a new value for each of 256 levels.

    What is clipped is spread evenly over all levels, the rest of it at even steps.
    """
    limit = max(1, math.floor(clip * pixels / LEVELS))
    excess = np.maximum(counts - limit, 0).sum(-1, keepdims=True)
    rest, level = excess % LEVELS, np.arange(LEVELS)
    step = np.where(rest > 0, np.maximum(1, LEVELS // np.maximum(rest, 1)), 1)
    spread = np.minimum(counts, limit) + excess // LEVELS + ((level % step == 0) & (level // step < rest))
    return np.minimum(255, np.rint(np.cumsum(spread, -1) * 255.0 / pixels)).astype(np.uint8)


def _tile_curves(lines: DataFrame, size: DataFrame, clip: float, tiles: int) -> DataFrame:
    """run_id, band, th, tw and curves: those of all tiles of the image, for each of its bands.

    Where the tiles do not fit, the image is continued by mirrored rows and columns.
    """
    def count(band: bands.Band) -> Iterator[pa.RecordBatch]:
        h, w = band.row["h"], band.row["w"]
        th, tw = _tile_sides(h, w, tiles)
        a = band.a if band.a.dtype.kind != "f" else np.where(np.isnan(band.a), -1, band.a).astype(np.int64)
        x = bands.continued(w, tw * tiles - w, True)[tw * tiles - w :]
        own = np.arange(band.top, band.end)
        mirrored = 2 * (h - 1) - own
        beyond = own[(mirrored >= h) & (mirrored < th * tiles)]
        counts = np.zeros((tiles, tiles, LEVELS), np.int64)
        for y, line in (*zip(own, own), *zip(2 * (h - 1) - beyond, beyond)):
            values = a[line - band.first][x]
            there = (values >= 0) & (values < LEVELS)
            counts[y // th] += np.bincount((np.arange(tw * tiles) // tw * LEVELS + values)[there], minlength=tiles * LEVELS).reshape(tiles, LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array([band.run_id.as_py()], band.run_id.type), pa.array([h]), pa.array([w]), pa.array([counts.astype(np.int64).tobytes()], pa.binary())], names=["run_id", "h", "w", "counts"])

    def curves(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((tiles, tiles, LEVELS), np.int64)
        for batch in group:
            for held in batch.column("counts"):
                total += np.frombuffer(held.as_py(), np.int64).reshape(total.shape)
        last = batch.slice(batch.num_rows - 1)
        th, tw = _tile_sides(last.column("h")[0].as_py(), last.column("w")[0].as_py(), tiles)
        yield pa.RecordBatch.from_arrays([last.column("run_id"), last.column("h"), last.column("w"), pa.array([_curves(total, clip, th * tw).tobytes()], pa.binary())], names=["run_id", "h", "w", "curves"])

    kind = dict(lines.dtypes)["run_id"]
    counted = bands.over(lines, count, f"run_id {kind}, h long, w long, counts binary", beside=by_band(size, 0))
    return counted.repartition(bands.parts(lines), "run_id").groupBy("run_id").applyInArrow(curves, f"run_id {kind}, h long, w long, curves binary")


def by_band(size: DataFrame, margin: int) -> DataFrame:
    """A row for each band of the images of ``size`` (run_id, h and more)."""
    lines = max(bands.SIZE, 2 * margin)
    return size.withColumn("band", F.explode(F.sequence(F.lit(0), F.floor((F.col("h") - 1) / lines).cast("int"))))


def _tile_sides(h: int, w: int, tiles: int) -> tuple[int, int]:
    fits = h % tiles == 0 and w % tiles == 0
    return tuple((n if fits else n + tiles - n % tiles) // tiles for n in (h, w))


def _equalized(band: bands.Band, tiles: int) -> np.ndarray:
    """All lines of a band by the curves of the four tiles around each pixel, blended by its distance to their centres."""
    h, w = band.row["h"], band.row["w"]
    th, tw = _tile_sides(h, w, tiles)
    curves = np.frombuffer(band.row["curves"], np.uint8).reshape(tiles, tiles, LEVELS)
    y, x = np.arange(band.first, band.first + len(band.a)), np.arange(w)
    cy, cx = np.floor(y / th - 0.5).astype(np.int64), np.floor(x / tw - 0.5).astype(np.int64)
    ya, xa = (y / th - 0.5 - cy)[:, None], (x / tw - 0.5 - cx)[None, :]
    known = (band.a >= 0) & (band.a < LEVELS)
    v = np.where(known, band.a, 0).astype(np.int64)
    near = lambda c: np.clip(c, 0, tiles - 1)
    at = lambda i, j: curves[near(cy + i)[:, None], near(cx + j)[None, :], v]
    blend = (at(0, 0) * (1 - xa) + at(0, 1) * xa) * (1 - ya) + (at(1, 0) * (1 - xa) + at(1, 1) * xa) * ya
    even = np.rint(np.round(blend, 6))
    return even.astype(np.int64) if known.all() else np.where(known, even, np.nan)


def _even_lines(px: DataFrame, clip: float, tiles: int, margin: int) -> tuple[DataFrame, DataFrame]:
    """Packed lines, and the curves beside each band with such a margin."""
    lines = cut(bands.pack(px))  # read three times
    curves = cut(_tile_curves(lines, bands.sizes(lines), clip, tiles))
    return lines, by_band(curves, margin)


def equalize(px: DataFrame, clip: float = 2.0, tiles: int = 8) -> DataFrame:
    """Each pixel's value by the curves of the four tiles around it, blended by its distance to their centres."""
    def even(band: bands.Band) -> Iterator[pa.RecordBatch]:
        yield band.pixels(_equalized(band, tiles)[band.own])

    lines, curves = _even_lines(px, clip, tiles, 0)
    return bands.as_pixels(bands.over(lines, even, bands.pixel_schema(lines), beside=curves), px)


def adaptive_threshold(px: DataFrame, block: int = 45, c: int = 2, clip: float = 2.0, tiles: int = 8) -> DataFrame:
    """Equalised pixels above their Gaussian mean less ``c`` as 255; inverted where these are more than half of an image."""
    weights = gaussian_weights(max(3, block | 1))
    margin = len(weights) // 2

    def above(band: bands.Band) -> Iterator[pa.RecordBatch]:
        even = _equalized(band, tiles)
        mean = bands.weighted(band, even, weights, False)
        yield band.lines(np.where(even[band.own] > np.rint(np.round(mean, 6)) - c, 255, 0).astype(np.uint8))

    def turned(band: bands.Band) -> Iterator[pa.RecordBatch]:
        yield band.pixels(255 - band.a if band.row["on"] > 0.5 else band.a)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = [np.count_nonzero(np.frombuffer(p.as_py(), np.uint8)) for p in batch.column("_p0")]
            yield pa.RecordBatch.from_arrays([batch.column("run_id"), batch.column("y"), batch.column("n").cast(pa.int64()), pa.array(np.array(on, np.int64))], names=["run_id", "y", "n", "on"])

    lines, curves = _even_lines(px, clip, tiles, margin)
    made = cut(bands.over(lines, above, bands.line_schema(px), margin, beside=curves))  # read twice
    counted = made.select("run_id", "y", "n", "_p0").mapInArrow(share, f"run_id {dict(px.dtypes)['run_id']}, y long, n long, on long")
    shares = counted.groupBy("run_id").agg((F.max("y") + 1).alias("h"), (F.sum("on") / F.sum("n")).alias("on"))
    return bands.as_pixels(bands.over(made, turned, bands.pixel_schema(made), beside=by_band(shares, 0)), px)
