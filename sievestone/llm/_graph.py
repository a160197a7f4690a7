"""Connected components by hooking and shortcutting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import dropped, written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for links (a, b) of longs: component is the least node that can be reached.

    Every node points to one that is not larger.  A round lets each node, and the node it points to,
    take the least that a neighbour's pointer leads to, then every pointer is followed one step
    further.  Whole trees move with their roots, so a chain in any order settles in rounds that grow
    with the logarithm of its length.  Least values are combined before the shuffle; nothing is
    gathered by component.  Rounds end when no pointer changes.
    """
    links = links.where("a != b")
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
    points = _followed(first.select("node", F.lit(None).cast("long").alias("was"), F.least("node", "near").alias("to")))
    while True:
        seen = both.join(points, F.col("b") == F.col("node")).groupBy(F.col("a").alias("n")).agg(F.min("far").alias("least"))
        near = points.join(seen, F.col("node") == F.col("n")).select("node", "to", F.least("far", "least").alias("next"))
        near = written(near, "near")
        hooked = near.groupBy(F.col("to").alias("n")).agg(F.min("next").alias("least"))
        moved = near.join(hooked, F.col("node") == F.col("n"), "left").select("node", F.col("to").alias("was"), F.least("next", "least").alias("to"))
        after = _followed(moved)
        dropped(points, near)
        points = after
        if not points.where("to != was OR far != to").limit(1).count():
            dropped(both)
            found = points.select("node", F.col("to").alias("component"))
            found.shared_folder = points.shared_folder
            return found


def _followed(points: DataFrame) -> DataFrame:
    """node, was, to and, one step further, far: a table."""
    step = points.select(F.col("node").alias("n"), F.col("to").alias("far"))
    held = points.join(step, F.col("to") == F.col("n"), "left")
    return written(held.select("node", "was", "to", F.coalesce("far", "to").alias("far")), "points")
