"""Pixel tables (run_id, y, x, v): thresholds, polarity, components, tiles and clusters.

Histograms, border means and tile sums are aggregates; neighbourhoods are frames over lines of an image
(``frames``), components and watersheds tables of links (``links``, ``basins``).  Only the smoothing
methods that no strategy uses and the trace of one object's contour call ``kernels``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bands, basins, frames, geometry, kernels, links
from .order import ordinals


def gray(b: Column, g: Column, r: Column) -> Column:
    return F.round(0.299 * r + 0.587 * g + 0.114 * b)


def fixed_threshold(pixels: DataFrame, level: int = 20) -> DataFrame:
    return pixels.withColumn("v", F.when(F.col("v") > level, 255).otherwise(0))


def otsu_level(pixels: DataFrame) -> DataFrame:
    """Per run the level with the greatest variance between classes (the least of equals): run_id, level.

    From a histogram of at most 256 rows per run.
    """
    h = pixels.groupBy("run_id", "v").agg(F.count("*").alias("n"))
    up = Window.partitionBy("run_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("run_id")
    s = h.select("run_id", "v", F.sum("n").over(up).alias("n0"), F.sum(F.col("n") * F.col("v")).over(up).alias("s0"), F.sum("n").over(every).alias("nt"), F.sum(F.col("n") * F.col("v")).over(every).alias("st"))
    n1 = F.col("nt") - F.col("n0")
    gap = F.try_divide(F.col("s0"), F.col("n0")) - F.try_divide(F.col("st") - F.col("s0"), n1)
    between = F.when(n1 > 0, F.col("n0").cast("double") * n1 * gap * gap).otherwise(0.0)
    return s.groupBy("run_id").agg(F.max(F.struct(F.round(between, 4).alias("b"), (-F.col("v")).alias("w"))).alias("m")).select("run_id", (-F.col("m.w")).alias("level"))


def otsu(pixels: DataFrame, dark_on_bright: bool = False) -> DataFrame:
    level = otsu_level(pixels)
    above = F.col("v") > F.col("level")
    return pixels.join(level, "run_id").withColumn("v", F.when(~above if dark_on_bright else above, 255).otherwise(0)).drop("level")


def border(pixels: DataFrame) -> DataFrame:
    """Per run: means of border, centre and all, the polarity, and whether the background is black."""
    size = pixels.groupBy("run_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    p = pixels.join(size, "run_id")
    wide = lambda share, least: F.greatest(F.floor(F.col("h") / share), F.floor(F.col("w") / share), F.lit(least))
    rows = lambda b: (F.col("y") < b) | (F.col("y") >= F.col("h") - b)
    cols = lambda b: (F.col("x") < b) | (F.col("x") >= F.col("w") - b)
    p = p.withColumns({"edge": rows(wide(20, 10)) | cols(wide(20, 10)), "weight": rows(wide(15, 15)).cast("int") + cols(wide(15, 15)).cast("int")})
    made = p.groupBy("run_id").agg(
        F.avg(F.when(F.col("edge"), F.col("v"))).alias("border_mean"), F.avg(F.when(~F.col("edge"), F.col("v"))).alias("center_mean"), F.avg("v").alias("overall_mean"),
        F.try_divide(F.sum(F.col("v") * F.col("weight")), F.sum("weight")).alias("wide_border_mean"),  # corners count twice
    )
    b, c, o = F.col("border_mean"), F.col("center_mean"), F.col("overall_mean")
    polarity = F.when((b < 80) & (o < 120), "bright_on_dark").when(b > 150, "dark_on_bright").when(b < c - 20, "bright_on_dark").otherwise("auto")
    return made.withColumns({"polarity": polarity, "black_background": (F.col("wide_border_mean") < 50) & (o < 100)})


def area_limits(height: Column, width: Column) -> tuple[Column, Column]:
    scale = height * width / F.lit(1920.0 * 1080.0)
    low = F.greatest(F.lit(50), F.floor(30 * scale))
    return low, F.least(F.greatest(F.lit(500_000), F.floor(500_000 * scale)), F.floor(0.1 * height * width))


def _per_image(pixels: DataFrame, make: Callable[[np.ndarray], np.ndarray], out: str = "v") -> DataFrame:
    """Runs a function of the image array once per image and gives a pixel table again."""
    kind = dict(pixels.dtypes)["run_id"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((int(group["y"].max()) + 1, int(group["x"].max()) + 1), np.int64)
        image[group["y"], group["x"]] = group["v"]
        made = make(image)
        y, x = np.nonzero(np.ones_like(made))
        return pd.DataFrame({"run_id": group["run_id"].iloc[0], "y": y, "x": x, out: made.ravel()})

    return pixels.select("run_id", "y", "x", "v").groupBy("run_id").applyInPandas(run, f"run_id {kind}, y long, x long, {out} long")


def components(binary: DataFrame) -> DataFrame:
    """Labels of eight-connected components, numbered by their first pixel in reading order; 0 outside."""
    return links.labels(binary)


def filter_area(labels: DataFrame, low: int | Column, high: int | Column) -> DataFrame:
    """Objects whose pixels number between the limits, relabelled 1, 2, ... in the order of their labels."""
    low, high = (F.lit(x) if isinstance(x, int) else x for x in (low, high))
    sizes = labels.where("label > 0").groupBy("run_id", "label").agg(F.count("*").alias("area")).where(F.col("area").between(low, high))
    numbered = ordinals(sizes, ["run_id"], "label", "new").select("run_id", "label", (F.col("new") + 1).alias("new"))
    return labels.join(numbered.hint("merge"), ["run_id", "label"], "left").select("run_id", "y", "x", F.coalesce("new", F.lit(0)).alias("label"))


def areas(labels: DataFrame) -> DataFrame:
    return labels.where("label > 0").groupBy("run_id", "label").agg(F.count("*").alias("area"))


def adaptive_threshold(pixels: DataFrame, block: int = 45, c: int = 2) -> DataFrame:
    return frames.adaptive_threshold(pixels, block, c)


def denoise(pixels: DataFrame, method: str = "gaussian") -> DataFrame:
    return frames.smooth5(pixels) if method == "gaussian" else _per_image(pixels, lambda image: kernels.denoise(image, method))


def equalize(pixels: DataFrame, clip: float = 2.0, tiles: int = 8) -> DataFrame:
    return frames.equalize(pixels, clip, tiles)


def top_hat(pixels: DataFrame, size: int = 51) -> DataFrame:
    return frames.top_hat(pixels, size)


def cleanup(binary: DataFrame) -> DataFrame:
    return frames.cleanup(binary)


def fill_holes(binary: DataFrame) -> DataFrame:
    return links.fill_holes(binary)


def hull_fill(binary: DataFrame) -> DataFrame:
    """Every component's convex hull."""
    filled = geometry.hull_fill(components(binary).where("label > 0")).select("run_id", "y", "x", F.lit(255).alias("_in")).distinct()
    return binary.join(filled.hint("merge"), ["run_id", "y", "x"], "left").select("run_id", "y", "x", F.coalesce("_in", F.when(F.col("v") > 0, 255).otherwise(0)).cast("long").alias("v"))


def distance(binary: DataFrame) -> DataFrame:
    """Distance to the nearest background pixel, in thousandths."""
    return _per_image(binary, lambda image: np.round(1000 * kernels.distance(image > 0)).astype(np.int64))


def watershed(binary: DataFrame, peak_share: float = 0.2) -> DataFrame:
    """Labels after separating objects that touch."""
    return basins.watershed(binary, peak_share)


def contours(labels: DataFrame) -> DataFrame:
    """Vertex table of the outer contour of every labelled object: a task holds one object, not its image."""
    kind = dict(labels.dtypes)["run_id"]

    def trace(group: pd.DataFrame) -> pd.DataFrame:
        top, left = int(group["y"].min()), int(group["x"].min())
        on = np.zeros((int(group["y"].max()) - top + 1, int(group["x"].max()) - left + 1), bool)
        on[group["y"] - top, group["x"] - left] = True
        rows = [(n, x + left, y + top) for n, (x, y) in enumerate(kernels.outer_contour(on))]
        return pd.DataFrame(rows, columns=["seq", "x", "y"]).assign(run_id=group["run_id"].iloc[0], label=group["label"].iloc[0])[["run_id", "label", "seq", "x", "y"]]

    return labels.where("label > 0").select("run_id", "label", "y", "x").groupBy("run_id", "label").applyInPandas(trace, f"run_id {kind}, label long, seq long, x long, y long")


def object_runs(lines: DataFrame) -> DataFrame:
    """Runs of pixels of one label, from packed lines of labels: run_id, label, y, x0, x1."""

    def split(band: bands.Band) -> Iterator[pa.RecordBatch]:
        a = band.a[band.own] if band.there is None else np.where(band.there, band.a, 0)[band.own].astype(np.int64)
        new = np.ones(a.shape, bool)
        new[:, 1:] = a[:, 1:] != a[:, :-1]
        y, x = np.nonzero(new)
        end = np.append(np.where(y[1:] == y[:-1], x[1:], a.shape[1]), a.shape[1])
        label = a[y, x].astype(np.int64)
        on = label > 0
        yield pa.RecordBatch.from_arrays([pa.repeat(band.run_id, np.count_nonzero(on)), *(pa.array(c[on]) for c in (label, band.top + y, x, end - 1))], names=["run_id", "label", "y", "x0", "x1"])

    return bands.over(lines, split, f"run_id {dict(lines.dtypes)['run_id']}, label long, y long, x0 long, x1 long")


def areas_of_runs(runs: DataFrame, low: int, high: int) -> DataFrame:
    """Objects of ``object_runs`` whose pixels number between the limits, relabelled as by ``filter_area``: run_id, label, area, and the old label as _was."""
    sizes = runs.groupBy("run_id", "label").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area")).where(F.col("area").between(low, high))
    return ordinals(sizes, ["run_id"], "label", "new").select("run_id", (F.col("new") + 1).alias("label"), "area", F.col("label").alias("_was"))


def contours_of_runs(runs: DataFrame) -> DataFrame:
    """``contours`` of objects that are runs of pixels."""

    def trace(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(group))
        y, x0, x1 = (table.column(c).to_numpy() for c in ("y", "x0", "x1"))
        top, left = y.min(), x0.min()
        on = bands.painted((int(y.max() - top) + 1, int(x1.max() - left) + 1), y - top, x0 - left, x1 - left, np.ones(len(y), bool))
        x, y = np.array(kernels.outer_contour(on), np.int64).T
        n = len(x)
        yield pa.RecordBatch.from_arrays([pa.repeat(table.column("run_id")[0], n), pa.repeat(table.column("label")[0], n), pa.array(np.arange(n)), pa.array(x + left), pa.array(y + top)], names=["run_id", "label", "seq", "x", "y"])

    dealt = runs.select("run_id", "label", "y", "x0", "x1").repartition(bands.parts(runs), "run_id", "label")
    return dealt.groupBy("run_id", "label").applyInArrow(trace, f"run_id {dict(runs.dtypes)['run_id']}, label long, seq long, x long, y long")


def threshold(pixels: DataFrame, method: str = "adaptive") -> DataFrame:
    """Objects as 255: a fixed level on black backgrounds, else ``adaptive`` or ``otsu``, which inverts all but bright objects on dark."""
    flagged = pixels.join(border(pixels).select("run_id", "polarity", "black_background"), "run_id")
    black = fixed_threshold(flagged.where("black_background").select("run_id", "y", "x", "v"))
    other = flagged.where("NOT black_background")
    if method == "adaptive":
        return black.unionByName(adaptive_threshold(other.select("run_id", "y", "x", "v")))
    bright = otsu(other.where("polarity = 'bright_on_dark'").select("run_id", "y", "x", "v"))
    dark = otsu(other.where("polarity != 'bright_on_dark'").select("run_id", "y", "x", "v"), dark_on_bright=True)
    return black.unionByName(bright).unionByName(dark)


def segment(pixels: DataFrame, separate: bool = True, method: str = "adaptive") -> DataFrame:
    """Threshold, clean up, label, filter by area, part what touches and filter again: a label table (the classical strategy)."""
    low, high = area_limits(F.col("h"), F.col("w"))
    limits = frames.sizes(pixels).select("run_id", low.alias("low"), high.alias("high"))
    binary = links.cut(fill_holes(cleanup(threshold(pixels, method))))
    labels = links.cut(_filter_by_run(components(binary), limits))
    if not separate:
        return labels
    return _filter_by_run(watershed(labels.select("run_id", "y", "x", F.when(F.col("label") > 0, 255).otherwise(0).alias("v"))), limits)


def _filter_by_run(labels: DataFrame, limits: DataFrame) -> DataFrame:
    sizes = areas(labels).join(limits, "run_id").where("area BETWEEN low AND high")
    numbered = ordinals(sizes, ["run_id"], "label", "new").select("run_id", "label", (F.col("new") + 1).alias("new"))
    return labels.join(numbered.hint("merge"), ["run_id", "label"], "left").select("run_id", "y", "x", F.coalesce("new", F.lit(0)).alias("label"))


def tile_origins(size: DataFrame, tile: int = 512, overlap: int = 64) -> DataFrame:
    """Origins of overlapping tiles, the last ones shifted inward: run_id, ty, tx from (run_id, h, w)."""
    step = tile - overlap
    starts = lambda n: F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1), F.lit(step)), lambda k: F.greatest(F.lit(0), F.least(k, n - tile))))
    return size.select("run_id", F.explode(starts(F.col("h").cast("int"))).alias("ty"), "w").select("run_id", "ty", F.explode(starts(F.col("w").cast("int"))).alias("tx"))


def cut_tiles(pixels: DataFrame, origins: DataFrame, tile: int = 512) -> DataFrame:
    """Each pixel once for every tile that covers it: run_id, ty, tx, y, x, v."""
    inside = F.col("y").between(F.col("ty"), F.col("ty") + tile - 1) & F.col("x").between(F.col("tx"), F.col("tx") + tile - 1)
    return pixels.join(origins, "run_id").where(inside).select("run_id", "ty", "tx", "y", "x", "v")


def stitch_max(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("run_id", "y", "x").agg(F.max("v").alias("v"))


def stitch_weighted(tiles: DataFrame, weight: Column) -> DataFrame:
    return tiles.groupBy("run_id", "y", "x").agg(F.try_divide(F.sum(F.col("v") * weight), F.sum(weight)).alias("v"))


def test_time_views(pixels: DataFrame, size: DataFrame) -> DataFrame:
    """Nine turned and mirrored views of each image: run_id, view, y, x, v."""
    y, x, h, w = (F.col(c) for c in ("y", "x", "h", "w"))
# turned to the left by 0 to 3 quarters, mirrored top to bottom and left to right, then turned by 1 to 3 quarters and mirrored top to bottom
    places = [(y, x), (w - 1 - x, y), (h - 1 - y, w - 1 - x), (x, h - 1 - y), (h - 1 - y, x), (y, w - 1 - x), (x, y), (y, w - 1 - x), (w - 1 - x, h - 1 - y)]
    views = F.explode(F.array(*(F.struct(F.lit(k).alias("view"), a.cast("int").alias("y"), b.cast("int").alias("x")) for k, (a, b) in enumerate(places))))
    return pixels.join(size, "run_id").select("run_id", "v", views.alias("p")).select("run_id", "p.view", "p.y", "p.x", "v")


def undo_views(views: DataFrame, size: DataFrame) -> DataFrame:
    """Pixels of the nine views back at their places in the image: run_id, view, y, x, v."""
    y, x, h, w = (F.col(c) for c in ("y", "x", "h", "w"))
    back = [(y, x), (x, w - 1 - y), (h - 1 - y, w - 1 - x), (h - 1 - x, y), (h - 1 - y, x), (y, w - 1 - x), (x, y), (y, w - 1 - x), (h - 1 - x, w - 1 - y)]
    place = F.element_at(F.array(*(F.struct(a.cast("int").alias("y"), b.cast("int").alias("x")) for a, b in back)), F.col("view") + 1)
    return views.join(size, "run_id").select("run_id", "view", "v", place.alias("p")).select("run_id", "view", "p.y", "p.x", "v")


def tile_weight(tile: int = 512) -> Column:
    """Weight of a pixel by its distance to the middle of its tile: 1 there, a Gaussian of a sixth of the tile."""
    dy, dx = F.col("y") - F.col("ty") - tile // 2, F.col("x") - F.col("tx") - tile // 2
    return F.exp(-(dy * dy + dx * dx) / (2 * (tile / 6) ** 2))


def label_colours(labels: DataFrame) -> DataFrame:
    """A hue for each label, evenly spaced over the half-degrees 0 to 179, as red, green and blue: run_id, label, hue, r, g, b."""
    seen = labels.where("label > 0").select("run_id", "label").distinct()
    counts = seen.groupBy("run_id").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy("label")) - 1
    hue = F.floor(F.when((rank > 0) & (rank == F.col("n") - 1), 179.0).when(F.col("n") > 1, rank * (179.0 / (F.col("n") - 1))).otherwise(0.0))
    sixth = lambda shift: (F.col("hue") / 30.0 + shift) % 6
    channel = lambda shift: F.round(255 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.abs(sixth(shift) - 3) - 1))).cast("int")
    return seen.join(counts, "run_id").select("run_id", "label", hue.alias("hue")).withColumns({"r": channel(0), "g": channel(4), "b": channel(2)})


def distances(binary: DataFrame) -> DataFrame:
    """Distance of each object pixel to the nearest pixel outside, and its view scaled to 0 to 255: run_id, y, x, d, view.

    In an image with no pixel outside, all are as far as it has pixels, and one more.
    """
    kind = dict(binary.dtypes)["run_id"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((int(group["y"].max()) + 1, int(group["x"].max()) + 1), bool)
        image[group["y"], group["x"]] = group["v"] > 0
        d = kernels.distance(image)
        y, x = np.nonzero(np.ones_like(image))
        view = np.floor(d / d.max() * 255) if d.max() > 0 else np.zeros_like(d)
        return pd.DataFrame({"run_id": group["run_id"].iloc[0], "y": y, "x": x, "d": d.ravel(), "view": view.ravel().astype(np.int64)})

    return binary.select("run_id", "y", "x", "v").groupBy("run_id").applyInPandas(run, f"run_id {kind}, y long, x long, d double, view long")


def first_with_objects(strategies: dict[str, DataFrame | None]) -> DataFrame:
    """Label tables of several strategies: of each run those of the first that found an object, with its name.

    A strategy that is not there is None; runs in which none finds an object keep the last one's pixels.
    """
    there = [(name, df.select("run_id", "y", "x", "label")) for name, df in strategies.items() if df is not None]
    rows = None
    for k, (name, df) in enumerate(there):
        part = df.withColumns({"method": F.lit(name), "_k": F.lit(k)})
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ValueError("no strategy is available")
    best = rows.groupBy("run_id").agg(F.coalesce(F.min(F.when(F.col("label") > 0, F.col("_k"))), F.max("_k")).alias("_best"))
    return rows.join(best, "run_id").where("_k = _best").drop("_k", "_best")
