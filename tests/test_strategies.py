import numpy as np
import pytest
from pyspark.sql import functions as F

from sievestone.operators import raster, strategies


def bright(image):
    """Finds what is bright in red; fails on tiles with a planted pixel."""
    if (image[:, :, 0] == 251).any():
        raise RuntimeError("planted")
    return (image[:, :, 2] > 150).astype(int)


@pytest.fixture(scope="module")
def images(spark):
    """Two images of 64 x 80 with two squares each: warm and bright in the first, dim in the second."""
    px = spark.range(2 * 64 * 80).select((F.col("id") / 5120).cast("long").alias("run_id"), (F.floor(F.col("id") / 80) % 64).alias("y"), (F.col("id") % 80).alias("x"))
    inside = (F.col("y").between(8, 20) & F.col("x").between(6, 18)) | (F.col("y").between(40, 53) & F.col("x").between(45, 60))
    made = px.select("*", inside.alias("on")).select("run_id", "y", "x", F.when(F.col("on"), 40).otherwise(90).alias("b"), F.when(F.col("on"), 90).otherwise(80).alias("g"), F.when(F.col("on"), F.when(F.col("run_id") == 0, 220).otherwise(140)).otherwise(30).alias("r"))
    return made.cache()


def sizes(labels):
    return sorted((r.run_id, r.n) for r in labels.where("label > 0").groupBy("run_id", "label").agg(F.count("*").alias("n")).collect())


def test_tiles_from_places_are_those_of_the_origins(images):
    size = images.groupBy("run_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    for tile, overlap in ((32, 8), (20, 0), (100, 10), (64, 63)):
        want = raster.cut_tiles(images.withColumn("v", F.col("r")), raster.tile_origins(size, tile, overlap), tile).select("run_id", "ty", "tx", "y", "x")
        made = strategies.tiled(images, tile, overlap).select("run_id", "ty", "tx", "y", "x")
        assert made.exceptAll(want).count() == want.exceptAll(made).count() == 0


def test_a_model_over_tiles_and_tiles_on_which_it_fails(images):
    planted = images.withColumn("b", F.when((F.col("run_id") == 0) & (F.col("y") == 0) & (F.col("x") == 79), 251).otherwise(F.col("b")))
    labels, failed = strategies.by_model(planted, lambda: bright, 32, 8)
    assert sizes(labels) == [(0, 169), (0, 224)]
    assert [(r.run_id, r.ty, r.tx, r.error) for r in failed.collect()] == [(0, 0, 48, "RuntimeError: planted")]
    hidden = images.withColumn("b", F.when((F.col("run_id") == 0) & (F.col("y") == 45) & (F.col("x") == 50), 251).otherwise(F.col("b")))
    labels, failed = strategies.by_model(hidden, lambda: bright, 32, 8)
    assert failed.count() > 0 and (0, 169) in sizes(labels) and (0, 224) not in sizes(labels)
    wrong, failed = strategies.tile_mask(images, lambda: lambda image: image[:3, :, 0], 64, 8)
    assert wrong.where("v > 0").count() == 0 and failed.count() == 4 and "shape" in failed.first().error


def test_each_image_takes_the_first_way_that_finds_something(images):
    found, failed = strategies.cascade(images, True, lambda: bright, tile=32, overlap=8, side=80, attempts=2)
    assert {(r.run_id, r.method) for r in found.select("run_id", "method").distinct().collect()} == {(0, strategies.MODEL), (1, strategies.CLUSTERING)}
    assert failed.count() == 0
    n = sizes(found)
    assert [k for k, _ in n] == [0, 0, 1, 1] and n[:2] == [(0, 169), (0, 224)] and all(100 < size < 260 for _, size in n[2:])


def test_without_a_model(images):
    def broken():
        raise ImportError("no such model")

    assert strategies.available(broken) is None and strategies.available(None) is None
    found, failed = strategies.cascade(images.where("run_id = 0"), True, broken, side=80, attempts=2)
    assert failed is None and {r.method for r in found.select("method").distinct().collect()} == {strategies.CLUSTERING}
    assert np.array_equal([k for k, _ in sizes(found)], [0, 0])


def test_ways_without_a_model_asked_for(images):
    dim = images.where("run_id = 0")
    found, failed = strategies.cascade(dim)
    assert failed is None and {r.method for r in found.select("method").distinct().collect()} == {strategies.CLASSICAL}
    assert found.count() == 64 * 80
