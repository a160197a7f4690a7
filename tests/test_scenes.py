import re

from pyspark.sql import functions as F

from sievestone.operators import basins, frames, links, strategies
from sievestone.sources import specimens

SMALL = "/root/testdata/sf0.001"
#: A broadcast of rows that are found by their place, and so are as many as pixels.
BY_PLACE = re.compile(r"BroadcastHashJoin \[run_id#\d+L?, y#\d+L?")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scenes_broadcast_no_pixels(spark):
    made = plan(specimens.scenes(spark, SMALL))
    assert "Broadcast" not in made and "Join" not in made


def test_lines_of_scenes_are_dealt_to_all_tasks(spark):
    assert specimens.scenes(spark, SMALL).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_pixels_are_not_broadcast(spark):
    px = specimens.scenes(spark, SMALL).where("y < 12 AND x < 12").withColumn("v", F.when(F.col("v") >= 150, 255).otherwise(0).cast("long"))
    for made in (frames.weighted(px, frames.BINOMIAL), frames.equalize(px), frames.top_hat(px, 5), links.labels(px), links.fill_holes(px)):
        assert not BY_PLACE.search(plan(made))


def test_weighted_keeps_columns(spark):
    px = spark.createDataFrame([(1, y, x, 10 * y + x, y - x) for y in range(3) for x in range(4)], "run_id long, y long, x long, v long, more long")
    got = {(r.y, r.x): r for r in frames.weighted(px, (0, 1, 0)).collect()}
    assert len(got) == 12 and all((r.v, r.more, r.s) == (10 * y + x, y - x, 10 * y + x) for (y, x), r in got.items())


def test_extremes_share_lines_and_fetch_neighbours_once(spark):
    sizes = ((5, 9), (7, 4), (3, 3))
    value = lambda r, y, x: (y * 37 + x * 101 + r * 13 + y * x * 7) % 251
    px = spark.createDataFrame([(r, y, x, value(r, y, x)) for r, (h, w) in enumerate(sizes) for y in range(h) for x in range(w)], "run_id long, y long, x long, v long")
    for kernel in (frames.ellipse(5), frames.ellipse(13), (3, 1, 3)):
        for along in "xy" if kernel != (3, 1, 3) else "x":
            for largest in (True, False):
                got = {(r.run_id, r.y, r.x): r.v for r in frames.extreme(px, kernel, largest, along).collect()}
                reach = len(kernel) // 2
                for r, (h, w) in enumerate(sizes):
                    for y in range(h):
                        for x in range(w):
                            near = [value(r, y + d, x + e) for d in range(-reach, reach + 1) for e in range(-kernel[d + reach], kernel[d + reach] + 1) if 0 <= y + d < h and 0 <= x + e < w]
                            assert got[r, y, x] == (max if largest else min)(near)
    assert plan(frames.dilate(px, frames.ellipse(13), 2)).count("Exchange hashpartitioning") == 3


def test_what_makes_pixels_runs_once(spark):
    px = specimens.scenes(spark, SMALL).where("y < 12 AND x < 12")
    binary = px.withColumn("v", F.when(F.col("v") >= 150, 255).otherwise(0).cast("long"))
    coloured = px.select("run_id", "y", "x", *(F.col("v").alias(c) for c in "bgr"))
    for made in (links.fill_holes(binary), basins.watershed(binary), *strategies.tile_mask(coloured, lambda: lambda image: image[:, :, 2], 8, 2)):
        assert "part.parquet" not in "".join(made.inputFiles())
