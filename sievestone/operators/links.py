"""Connected components of pixels and of other nodes of runs, by hooking and shortcutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bands
from .order import ordinals


def new_folder(spark: SparkSession, tag: str) -> str:
    """A path in the session's checkpoint folder; in local mode one is made if there is none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return f"{sc.getCheckpointDir()}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table in the session's checkpoint folder, so that lineage, and what the planner knows of it, ends there."""
    path = new_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def roots(links: DataFrame) -> DataFrame:
    """(run_id, node, root) for links (run_id, a, b) of longs: the least node of a run that can be reached.

    A node's pointer never rises.  In a round it takes the least pointer among its own, those of its
    neighbours and that of the node it points to, hands what it found to the node it pointed to, and
    follows the result one step; chains settle in rounds that grow with the logarithm of their length.
    """
    links = cut(links.select("run_id", "a", "b").where("a != b").distinct())
    both = links.unionByName(links.select("run_id", F.col("b").alias("a"), F.col("a").alias("b")))
    state = both.groupBy("run_id", F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root"))
    state = cut(state)
    while True:
        other = state.select("run_id", F.col("node").alias("b"), F.col("root").alias("_far"))
        seen = both.join(other.hint("merge"), ["run_id", "b"]).groupBy("run_id", F.col("a").alias("node")).agg(F.min("_far").alias("_seen"))
        found = state.join(seen.hint("merge"), ["run_id", "node"]).select("run_id", "node", "root", F.least("root", "_seen").alias("_next"))
        # what a node has found is for the node that it pointed to as well
        offers = found.select("run_id", "node", "_next").unionByName(found.select("run_id", F.col("root").alias("node"), "_next"))
        least = offers.groupBy("run_id", "node").agg(F.min("_next").alias("_next"))
        step = least.select("run_id", F.col("node").alias("_next"), F.col("_next").alias("_then"))
        moved = least.join(step.hint("merge"), ["run_id", "_next"], "left").select("run_id", "node", F.least("_next", F.coalesce("_then", "_next")).alias("to"))
        after = cut(state.join(moved.hint("merge"), ["run_id", "node"]).select("run_id", "node", F.col("to").alias("root"), (F.col("to") != F.col("root")).alias("_moved")))
        if not after.where("_moved").limit(1).count():
            return after.select("run_id", "node", "root")
        state = after.select("run_id", "node", "root")


def segments(px: DataFrame, background: bool = False) -> DataFrame:
    """Pixels of objects (or outside them) with the run of neighbours in their row that they belong to: run_id, y, x, node.

    The node is the place of the run's first pixel, y * 2 ** 32 + x, so nodes are in reading order.
    """
    there = px.where("v = 0" if background else "v > 0").select("run_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    row = Window.partitionBy("run_id", "y").orderBy("x")
    first = there.withColumn("_first", F.when(F.coalesce(F.lag("x").over(row), F.lit(-2)) != F.col("x") - 1, F.col("x")))
    return first.select("run_id", "y", "x", (F.col("y") * (1 << 32) + F.max("_first").over(row.rowsBetween(Window.unboundedPreceding, 0))).alias("node"))


def components(px: DataFrame, eight: bool = True, background: bool = False) -> DataFrame:
    """run_id, y, x and root of the pixels of objects (or outside them): the first pixel of their component as a node.

    Runs of pixels are the nodes; those of neighbouring rows that touch are linked, whatever task they are in.
    """
    own = cut(segments(px, background))  # read three times
    steps = F.array(*(F.lit(d).cast("long") for d in ((-1, 0, 1) if eight else (0,))))
    below = own.select("run_id", (F.col("y") + 1).alias("y"), F.explode(F.transform(steps, lambda d: F.col("x") + d)).alias("x"), F.col("node").alias("a"))
    links = below.join(own.withColumnRenamed("node", "b").hint("merge"), ["run_id", "y", "x"]).select("run_id", "a", "b").distinct()
    found = roots(links)
    return own.join(found.hint("merge"), ["run_id", "node"], "left").select("run_id", "y", "x", F.coalesce("root", "node").alias("root"))


def numbered(rooted: DataFrame) -> DataFrame:
    """run_id, root and label: 1, 2, ... in the order of the roots of a run."""
    return ordinals(rooted.select("run_id", "root").distinct(), ["run_id"], "root", "label").withColumn("label", F.col("label") + 1)


def labels(px: DataFrame, eight: bool = True) -> DataFrame:
    """run_id, y, x and label of all pixels: objects numbered by their first pixel in reading order, 0 outside."""
    rooted = cut(components(px, eight))
    named = rooted.join(numbered(rooted).hint("merge"), ["run_id", "root"]).select("run_id", "y", "x", "label")
    return px.select("run_id", "y", "x").join(named.hint("merge"), ["run_id", "y", "x"], "left").select("run_id", "y", "x", F.coalesce("label", F.lit(0).cast("long")).alias("label"))


#: What a row of a band's look at its background is: a run in the line below the band or in its own first line, a corner, counts of the image's border.
_BELOW, _FIRST, _CORNER, _BORDER = range(4)


def _background(band: bands.Band) -> tuple[np.ndarray, ...]:
    """Runs of background in a band's lines and the one below: line, first and last place, and the node of their component's first pixel there."""
    y, x0, x1, root = bands.component_runs(band.a[band.own.start : band.own.stop + 1] == 0, False)
    return y, x0, x1, (band.top + y[root]) * (1 << 32) + x0[root]


def _look(band: bands.Band) -> Iterator[pa.RecordBatch]:
    y, x0, x1, node = _background(band)
    own = band.a[band.own]
    h, w = own.shape
    is_top, is_end = band.top == 0, len(band.a) == band.own.stop
    corner = (is_top & (y == 0) | is_end & (y == h - 1)) & ((x0 == 0) | (x1 == w - 1))
    times = np.zeros(own.shape, np.int64)
    times[:, 0] += 1
    times[:, -1] += 1
    times[0] += is_top
    times[-1] += is_end
    rows = [(_BELOW, y == h), (_FIRST, (y == 0) & (not is_top)), (_CORNER, corner)]
    what, picked = np.concatenate([np.full(np.count_nonzero(on), k) for k, on in rows]), np.concatenate([np.flatnonzero(on) for _, on in rows])
    columns = [np.append(what, _BORDER), np.append(band.top + y[picked], 0), np.append(x0[picked], (times * (own == 255)).sum()), np.append(node[picked], times.sum())]
    n = len(picked) + 1
    yield pa.RecordBatch.from_arrays([pa.repeat(band.run_id, n), pa.array(np.full(n, band.band, np.int32)), *(pa.array(c.astype(np.int64)) for c in columns)], names=["run_id", "band", "what", "y", "x", "node"])


def _filled(band: bands.Band) -> Iterator[pa.RecordBatch]:
    own = band.a[band.own]
    if not band.row["full"]:
        y, x0, x1, node = _background(band)
        hole = (y < len(own)) & ~np.isin(node, np.array(band.row["reached"] or [], np.int64))
        own = np.where(bands.painted(own.shape, y[hole], x0[hole], x1[hole], np.ones(np.count_nonzero(hole), bool)), 255, own)
    yield band.pixels(own)


def fill_holes(px: DataFrame) -> DataFrame:
    """Background that no corner reaches over its four neighbours becomes 255; images whose border is mostly objects stay.

    A band joins the background of its lines and of the line below, so what it shares with the next band are the runs of
    that line: only these, and the corners, are rows.
    """
    lines = cut(bands.pack(px.select("run_id", "y", "x", "v")))  # read twice
    seen = cut(bands.over(lines, _look, f"run_id {dict(px.dtypes)['run_id']}, band int, what long, y long, x long, node long", 1))
    at = lambda k, name: seen.where(F.col("what") == k).select("run_id", "y", "x", F.col("node").alias(name))
    root = roots(at(_BELOW, "a").join(at(_FIRST, "b").hint("merge"), ["run_id", "y", "x"]).select("run_id", "a", "b"))
    ours = seen.where(F.col("what") != _BORDER).join(root.hint("merge"), ["run_id", "node"], "left").select("run_id", "band", "what", "node", F.coalesce("root", "node").alias("root"))
    ours = cut(ours)
    reached = ours.where(F.col("what") == _CORNER).select("run_id", "root").distinct()
    reached = ours.join(reached.hint("merge"), ["run_id", "root"], "left_semi").groupBy("run_id", "band").agg(F.collect_set("node").alias("reached"))
    border = seen.where(F.col("what") == _BORDER)
    full = border.groupBy("run_id").agg((F.sum("x") / F.sum("node") > 0.5).alias("full"))
    beside = border.select("run_id", "band").join(full, "run_id").join(reached.hint("merge"), ["run_id", "band"], "left")
    return bands.as_pixels(bands.over(lines, _filled, bands.pixel_schema(lines), 1, beside=cut(beside)), px, None)
