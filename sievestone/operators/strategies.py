"""Ways to find objects in colour images (run_id, y, x, b, g, r): a model over tiles, clustering, thresholds, and which of them an image takes.

Images travel as pixels; a task holds a tile, whose side is a parameter, and never an image.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bands, basins, colours, frames, raster
from .links import cut

#: A model gives an image of height x width x 3 (blue, green, red) an array of labels, 0 outside objects.
Model = Callable[[np.ndarray], np.ndarray]
Loader = Callable[[], Model]

# fixed values: names of the ways
MODEL, CLUSTERING, CLASSICAL = "model", "kmeans_watershed", "classical"


def available(load: Loader | None) -> Loader | None:
    """``load`` if it gives a model here, else None."""
    if load is None:
        return None
    try:
        load()
    except Exception as why:
        logging.getLogger(__name__).warning("no model: %s", why)
        return None
    return load


def _starts(first: Column, last: Column, n: Column, tile: int, overlap: int) -> Column:
    """Origins along an axis of length ``n`` of the tiles that hold any of the places from first to last."""
    step, end = tile - overlap, F.greatest(F.lit(0), n.cast("int") - tile)
    first, last = first.cast("int"), last.cast("int")
    steps = F.sequence(F.greatest(F.lit(0), F.floor((first - tile) / step).cast("int") + 1), F.least(F.floor(last / step).cast("int") + 1, F.floor((n - 1) / step).cast("int")))
    return F.filter(F.array_distinct(F.transform(steps, lambda k: F.least(k * step, end))), lambda k: (k <= last) & (first < k + tile))


def tiled(pixels: DataFrame, tile: int = 512, overlap: int = 64) -> DataFrame:
    """Each pixel once for every tile of ``raster.tile_origins`` that covers it, with ty and tx: computed from its place, without a join of pixels and tiles."""
    starts = lambda c, n: F.explode(_starts(F.col(c), F.col(c), F.col(n), tile, overlap))
    return frames.with_size(pixels).withColumn("ty", starts("y", "h")).withColumn("tx", starts("x", "w")).drop("h", "w")


def tiled_lines(lines: DataFrame, tile: int = 512, overlap: int = 64) -> DataFrame:
    """What tiles hold of packed lines of three channels, with ty and tx."""
    made = lines.join(bands.sizes(lines), "run_id").withColumn("ty", F.explode(_starts(F.col("y"), F.col("y"), F.col("h"), tile, overlap)))
    made = made.withColumn("tx", F.explode(_starts(F.col("x"), F.col("x") + F.col("n") - 1, F.col("w"), tile, overlap)))
    made = made.withColumns({"_a": F.greatest("x", "tx"), "_b": F.least(F.col("x") + F.col("n"), F.col("tx") + tile), "_item": F.substring("kind", 2, 1).cast("int")})
    part = lambda c: F.substring(c, ((F.col("_a") - F.col("x")) * F.col("_item") + 1).cast("int"), ((F.col("_b") - F.col("_a")) * F.col("_item")).cast("int"))
    return made.select("run_id", "ty", "tx", "y", F.col("_a").alias("x"), (F.col("_b") - F.col("_a")).cast("int").alias("n"), "kind", *(part(c).alias(c) for c in bands.names("bgr")))


def infer(tiles: DataFrame, load: Loader) -> DataFrame:
    """A model's masks of tiles as packed lines: run_id, ty, tx, y, x, n, kind, _p0 (1 in objects), error.

    A task loads the model once.  A tile on which it fails, or of which it gives labels of another shape, is a row with
    the error and no place, and holds no object; so is every tile of a task that cannot load it.
    """
    loaded: list[Model] = []

    def run(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(group))
        run_id, top, left = table.column("run_id")[0], table.column("ty")[0].as_py(), table.column("tx")[0].as_py()
        y, n = table.column("y"), table.column("n")
        x = pa.array(table.column("x").to_numpy() - left)
        first, planes, _ = bands.assembled(table.set_column(table.schema.get_field_index("x"), "x", x), 3)
        image = np.zeros((first - top + len(planes[0]), planes[0].shape[1], 3), np.uint8)
        for k, plane in enumerate(planes):
            image[first - top :, :, k] = np.nan_to_num(plane)
        error = None
        try:
            if not loaded:
                loaded.append(load())
            made = np.asarray(loaded[0](image))
            if made.shape != image.shape[:2]:
                raise ValueError(f"labels of shape {made.shape} for a tile of {image.shape[:2]}")
            on = made.astype(np.int64) > 0
        except Exception as why:
            error, on = f"{type(why).__name__}: {why}", np.zeros(image.shape[:2], bool)
        bits = [on[a - top, b : b + c].tobytes() for a, b, c in zip(y.to_pylist(), x.to_pylist(), n.to_pylist())]
        failed = [] if error is None else [None]
        m = len(bits) + len(failed)
        columns = [pa.repeat(run_id, m), pa.array(np.full(m, top, np.int32)), pa.array(np.full(m, left, np.int32))]
        columns += [pa.array(c.to_pylist() + failed, c.type) for c in (y, table.column("x"), n)]
        columns += [pa.array(["u1"] * m), pa.array(bits + failed, pa.binary()), pa.array([None] * len(bits) + [error] * len(failed), pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["run_id", "ty", "tx", "y", "x", "n", "kind", "_p0", "error"])

    kind = dict(tiles.dtypes)["run_id"]
    dealt = tiles.repartition(bands.parts(tiles), "run_id", "ty", "tx")
    return dealt.groupBy("run_id", "ty", "tx").applyInArrow(run, f"run_id {kind}, ty int, tx int, y long, x long, n int, kind string, _p0 binary, error string")


def _whitened(band: bands.Band) -> Iterator[pa.RecordBatch]:
    yield band.pixels(np.where(band.a > 0, 255, 0))


def tile_mask(pixels: DataFrame, load: Loader, tile: int = 512, overlap: int = 64) -> tuple[DataFrame, DataFrame]:
    """Pixels that a tile's labels hold as 255, the others and those of failed tiles alone as 0; and the failed tiles with their errors."""
    lines = cut(bands.pack(pixels, "bgr"))  # read twice
    made = cut(infer(tiled_lines(lines, tile, overlap), load))
    pieces = made.where("error IS NULL").select("run_id", "y", "x", "n", "kind", "_p0")
    mask = bands.over(pieces, _whitened, bands.pixel_schema(pieces), largest=True)
    return bands.as_pixels(mask, pixels), made.where("error IS NOT NULL").select("run_id", "ty", "tx", "error")


def _within_limits(labels: DataFrame, pixels: DataFrame) -> DataFrame:
    low, high = raster.area_limits(F.col("h"), F.col("w"))
    sized = frames.sizes(pixels).select("run_id", low.alias("low"), high.alias("high"))
    return raster._filter_by_run(labels, sized)


def by_model(pixels: DataFrame, load: Loader, tile: int = 512, overlap: int = 64) -> tuple[DataFrame, DataFrame]:
    """Objects of a model, from the mask of all tiles as connected components within the limits of area; and the failed tiles."""
    mask, failed = tile_mask(pixels, load, tile, overlap)
    return _within_limits(raster.components(cut(mask)), pixels), failed


def by_clustering(pixels: DataFrame, side: int = 640, attempts: int = 10) -> DataFrame:
    """Objects of the nearer of two colours, parted by the watershed of colours from sure cores, within the limits of area."""
    markers = cut(basins.marker_sets(cut(colours.foreground(pixels, side, attempts))))
    flooded = basins.colour_watershed(pixels, markers, ("b", "g", "r"))
    return _within_limits(flooded.select("run_id", "y", "x", F.when(F.col("marker") > 1, F.col("marker")).otherwise(0).cast("long").alias("label")), pixels)


def by_thresholds(pixels: DataFrame) -> DataFrame:
    """Objects of ``raster.segment``."""
    return raster.segment(cut(pixels.select("run_id", "y", "x", raster.gray(F.col("b"), F.col("g"), F.col("r")).cast("long").alias("v"))))


def cascade(pixels: DataFrame, model: bool = False, load: Loader | None = None, clustering: bool = False, tile: int = 512, overlap: int = 64, side: int = 640, attempts: int = 10) -> tuple[DataFrame, DataFrame | None]:
    """Labels with the way they were found (run_id, y, x, label, method), and the failed tiles if a model ran.

    With ``model``, images in which it finds an object keep what it finds; the others, and all if none can be loaded, are
    clustered.  Else all are clustered or go by thresholds.  A way runs on no image that does not need it.
    """
    named = lambda df, way: df.select("run_id", "y", "x", "label", F.lit(way).alias("method"))
    if not model:
        return (named(by_clustering(pixels, side, attempts), CLUSTERING) if clustering else named(by_thresholds(pixels), CLASSICAL)), None
    load = available(load)
    if load is None:
        return named(by_clustering(pixels, side, attempts), CLUSTERING), None
    labels, failed = by_model(pixels, load, tile, overlap)
    labels = cut(labels)
    hit = labels.where("label > 0").select("run_id").distinct()
    rest = cut(pixels.join(hit, "run_id", "left_anti"))
    kept = named(labels.join(hit, "run_id", "left_semi"), MODEL)
    return (kept.unionByName(named(by_clustering(rest, side, attempts), CLUSTERING)) if rest.limit(1).count() else kept), failed
