"""Distances, seeds, markers and watersheds as tables of pixels, pointers and basins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bands, frames
from .bands import Band
from .frames import ROW, sizes
from .links import components, cut, labels, numbered
from .order import ordinals

_SHIFT = 1 << 32
#: Steps to the four neighbours that follow in reading order.
_NEXT = ((0, 1), (1, -1), (1, 0), (1, 1))


def node(y: Column, x: Column) -> Column:
    return y.cast("long") * _SHIFT + x.cast("long")


def distance2(px: DataFrame) -> DataFrame:
    """Adds d2, the squared distance of each object pixel to the nearest pixel outside: 0 outside, null where there is none.

    Distances within columns come from frames.  A pixel then looks along its row only as far as its own
    column's distance, as what lies farther off cannot be nearer.
    """
    column = Window.partitionBy("run_id", "x").orderBy("y")
    free = F.when(F.col("v") <= 0, F.col("y"))
    above = F.last(free, ignorenulls=True).over(column.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first(free, ignorenulls=True).over(column.rowsBetween(0, Window.unboundedFollowing))
    g = px.select(*ROW, "v", F.least(F.col("y") - above, below - F.col("y")).cast("long").alias("g"))
    inside = g.where("v > 0").join(sizes(px).select("run_id", "w"), "run_id")
    far = F.coalesce(F.col("g") - 1, F.col("w"))
    looks = inside.select("run_id", "y", "x", F.explode(F.sequence(F.greatest(F.lit(0), F.col("x") - far), F.least(F.col("w") - 1, F.col("x") + far))).alias("at"))
    met = looks.join(g.where("g IS NOT NULL").select("run_id", "y", F.col("x").alias("at"), F.col("g").alias("h")).hint("merge"), ["run_id", "y", "at"])
    dx = F.col("x") - F.col("at")
    least = met.groupBy(*ROW).agg(F.min(dx * dx + F.col("h") * F.col("h")).alias("d2"))
    return px.join(least.hint("merge"), list(ROW), "left").withColumn("d2", F.when(F.col("v") > 0, F.col("d2")).otherwise(F.lit(0).cast("long")))


def _widest(px: DataFrame, column: Column, r: int, most: bool) -> DataFrame:
    """Adds _e: the extreme of a column over squares of pixels."""
    of = F.max if most else F.min
    rows = px.withColumn("_e", of(column).over(Window.partitionBy("run_id", "y").orderBy("x").rowsBetween(-r, r)))
    return rows.withColumn("_e", of("_e").over(Window.partitionBy("run_id", "x").orderBy("y").rowsBetween(-r, r)))


def seeds(deep: DataFrame, share: float = 0.2, gap: int = 10) -> DataFrame:
    """run_id, y, x and marker of peaks: pixels as deep as any within ``gap`` and deeper than a share of the image's
    greatest depth.  Of peaks of one depth that see each other, those after the first in reading order go."""
    deepest = deep.groupBy("run_id").agg(F.max("d2").alias("_most"))
    p = _widest(deep.select(*ROW, "d2"), F.col("d2"), gap, True).join(deepest, "run_id")
    # lengths are compared by their squares
    own = F.when((F.col("d2") > 0) & (F.col("d2") == F.col("_e")) & (F.col("d2") > share * share * F.col("_most")), node(F.col("y"), F.col("x")))
    first = _widest(p.select(*ROW, own.alias("_own")), F.col("_own"), gap, False)
    return first.where("_own = _e").select(*ROW, F.col("_own").alias("marker"))


def followed(points: DataFrame) -> DataFrame:
    """(run_id, node, to) with every pointer at its end: the distance covered doubles each round."""
    points = cut(points.select("run_id", "node", "to"))
    while True:
        step = points.select("run_id", F.col("node").alias("to"), F.col("to").alias("_then"))
        moved = points.join(step.hint("merge"), ["run_id", "to"], "left").select("run_id", "node", F.coalesce("_then", "to").alias("to"), (F.col("_then") != F.col("to")).alias("_moved"))
        moved = cut(moved)
        points = moved.select("run_id", "node", "to")
        if not moved.where("_moved").limit(1).count():
            return points


def _pairs(deep: DataFrame, depth: str) -> DataFrame:
    """Neighbouring pixels (eight), each pair once, with both depths: run_id, a, b, da, db."""
    steps = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in _NEXT)))
    here = deep.select("run_id", "y", "x", F.col(depth).alias("da"), steps.alias("s"))
    here = here.select("run_id", node(F.col("y"), F.col("x")).alias("a"), "da", node(F.col("y") + F.col("s.dy"), F.col("x") + F.col("s.dx")).alias("b"))
    return here.join(deep.select("run_id", node(F.col("y"), F.col("x")).alias("b"), F.col(depth).alias("db")).hint("merge"), ["run_id", "b"]).select("run_id", "a", "b", "da", "db")


def steepest(deep: DataFrame, depth: str = "d2") -> DataFrame:
    """(run_id, node, to): each pixel points to the deepest of its neighbours and itself, the first of equals."""
    pairs = _pairs(deep, depth)
    either = pairs.select("run_id", F.col("a").alias("node"), F.col("b").alias("_o"), F.col("db").alias("_d")).unionByName(pairs.select("run_id", F.col("b").alias("node"), F.col("a").alias("_o"), F.col("da").alias("_d")))
    own = deep.select("run_id", node(F.col("y"), F.col("x")).alias("node")).withColumn("_o", F.col("node")).join(deep.select("run_id", node(F.col("y"), F.col("x")).alias("node"), F.col(depth).alias("_d")).hint("merge"), ["run_id", "node"])
    best = either.unionByName(own).groupBy("run_id", "node").agg(F.max(F.struct("_d", (-F.col("_o")).alias("_o"))).alias("m"))
    return best.select("run_id", "node", (-F.col("m._o")).alias("to"))


def _joined(passes: DataFrame, held: DataFrame) -> DataFrame:
    """Basins (run_id, basin, marker) with the marker that they join over passes (run_id, a, b, depth), the deepest first."""
    held = cut(held.withColumn("group", F.col("basin")))
    while True:
        of = [held.select("run_id", F.col("basin").alias(c), F.col("group").alias(f"_{c}"), F.col("marker").alias(f"_m{c}")) for c in "ab"]
        open_ = passes.join(of[0].hint("merge"), ["run_id", "a"]).join(of[1].hint("merge"), ["run_id", "b"]).where("_a != _b AND (_ma IS NULL OR _mb IS NULL)")
        # the pass itself decides between equals, alike from both sides
        rank = F.struct("depth", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))
        from_ = [open_.where(f"_m{c} IS NULL").select("run_id", F.col(f"_{c}").alias("group"), F.col(f"_{d}").alias("other"), rank.alias("rank")) for c, d in ("ab", "ba")]
        chosen = cut(from_[0].unionByName(from_[1]).groupBy("run_id", "group").agg(F.max_by("other", "rank").alias("other")))
        if not chosen.limit(1).count():
            break
        back = chosen.select("run_id", F.col("group").alias("other"), F.col("other").alias("_back"))
        mutual = (F.col("_back") == F.col("group")) & (F.col("group") < F.col("other"))
        hooks = chosen.join(back.hint("merge"), ["run_id", "other"], "left").select("run_id", F.col("group").alias("node"), F.when(mutual, F.col("group")).otherwise(F.col("other")).alias("to"))
        ended = followed(hooks).select("run_id", F.col("node").alias("group"), "to")
        after = held.join(ended.hint("merge"), ["run_id", "group"], "left").withColumn("group", F.coalesce("to", "group")).drop("to", "marker")
        own = held.where("marker IS NOT NULL").select("run_id", "group", "marker").distinct()
        held = cut(after.join(own.hint("merge"), ["run_id", "group"], "left").select("run_id", "basin", "group", "marker"))
    return held


def flood(deep: DataFrame, markers: DataFrame, depth: str = "d2") -> DataFrame:
    """run_id, y, x and marker of the pixels that markers reach, the deepest passes first.

    ``deep`` holds the pixels that may be flooded, ``markers`` (run_id, y, x, marker) some of them.
    Pixels point to their steepest neighbour, those of a marker to its first pixel, and what leads to one
    end is a basin.  Basins without a marker then join a neighbour over their deepest pass, round by
    round; passes are in a total order, so that only the two basins of one pass can choose each other.
    """
    marked = markers.select("run_id", node(F.col("y"), F.col("x")).alias("node"), "marker")
    first = marked.groupBy("run_id", "marker").agg(F.min("node").alias("_first"))
    forced = marked.join(first.hint("merge"), ["run_id", "marker"]).select("run_id", "node", "_first")
    points = steepest(deep, depth).join(forced.hint("merge"), ["run_id", "node"], "left").select("run_id", "node", F.coalesce("_first", "to").alias("to"))
    basin = followed(points)
    pairs = cut(_pairs(deep, depth))
    ends = [basin.select("run_id", F.col("node").alias(c), F.col("to").alias(f"_{c}")) for c in "ab"]
    passes = pairs.join(ends[0].hint("merge"), ["run_id", "a"]).join(ends[1].hint("merge"), ["run_id", "b"]).where("_a != _b")
    low, high = F.least("_a", "_b"), F.greatest("_a", "_b")
    passes = cut(passes.groupBy("run_id", low.alias("a"), high.alias("b")).agg(F.max(F.least("da", "db")).alias("depth")))
    held = basin.select("run_id", F.col("to").alias("basin")).distinct().join(first.select("run_id", F.col("_first").alias("basin"), "marker").hint("merge"), ["run_id", "basin"], "left")
    held = _joined(passes, held)
    named = held.where("marker IS NOT NULL").select("run_id", F.col("basin").alias("to"), "marker")
    return basin.join(named.hint("merge"), ["run_id", "to"]).select("run_id", F.floor(F.col("node") / _SHIFT).alias("y"), (F.col("node") % _SHIFT).alias("x"), "marker")


# -- the watershed of bands

#: Columns whose distances are handed from band to band at once.
_COLUMNS = 4096
_NONE = 1 << 30
#: What a row of a band's look at its basins is: a seed, a pixel of its first or last line and where it leads, a pass, an end of pointers.
_SEED, _BORDER, _PASS, _END = range(4)


def _depths(lines: DataFrame) -> DataFrame:
    """Packed lines of d2 of ``distance2`` (-1 where there is no pixel outside), with each line's greatest as most.

    A band needs of the others only where each column's last pixel outside above it is, and the first below.
    """
    kind = dict(lines.dtypes)["run_id"]

    def outside(band: Band) -> Iterator[pa.RecordBatch]:
        free, y = ~(band.a > 0), np.arange(band.top, band.end)[:, None]
        last, first = np.where(free, y, -_NONE).max(0), np.where(free, y, _NONE).min(0)
        at = range(0, len(last), _COLUMNS)
        columns = [pa.repeat(band.run_id, len(at)), pa.array(np.arange(len(at))), pa.array(np.full(len(at), band.band, np.int32))]
        yield pa.RecordBatch.from_arrays(columns + [pa.array([v[k : k + _COLUMNS].tobytes() for k in at], pa.binary()) for v in (last, first)], names=["run_id", "chunk", "band", "last", "first"])

    def carried(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(group)).sort_by("band")
        last, first = (np.stack([np.frombuffer(v, np.int64) for v in table.column(c).to_pylist()]) for c in ("last", "first"))
        none = np.full((1, last.shape[1]), _NONE)
        above = np.maximum.accumulate(np.concatenate([-none, last[:-1]]))
        below = np.minimum.accumulate(np.concatenate([first[1:], none])[::-1])[::-1]
        yield from table.select(["run_id", "chunk", "band"]).append_column("above", pa.array([v.tobytes() for v in above], pa.binary())).append_column("below", pa.array([v.tobytes() for v in below], pa.binary())).combine_chunks().to_batches()

    def deep(band: Band) -> Iterator[pa.RecordBatch]:
        on, y = band.a > 0, np.arange(band.top, band.end)[:, None]
        above, below = (np.frombuffer(b"".join(p[c] for p in band.row["parts"]), np.int64) for c in ("above", "below"))
        up = np.maximum.accumulate(np.concatenate([above[None], np.where(on, -_NONE, y)]))[1:]
        down = np.minimum.accumulate(np.concatenate([np.where(on, _NONE, y), below[None]])[::-1])[::-1][:-1]
        g = np.minimum(np.minimum(y - up, down - y), _NONE)
        if (g >= _NONE // 2).all():
            d2 = np.where(on, -1, 0)
        else:
            far = g * g
            d2, step = far.copy(), 1
            while step < on.shape[1] and step * step < d2.max():  # what lies farther off along a row cannot be nearer
                d2[:, step:] = np.minimum(d2[:, step:], far[:, :-step] + step * step)
                d2[:, :-step] = np.minimum(d2[:, :-step], far[:, step:] + step * step)
                step += 1
        made = band.lines(d2)
        yield pa.RecordBatch.from_arrays([*made.columns, pa.array(d2.max(1))], names=[*made.schema.names, "most"])

    seen = bands.over(lines, outside, f"run_id {kind}, chunk long, band int, last binary, first binary")
    seen = seen.repartition(bands.parts(lines), "run_id", "chunk").groupBy("run_id", "chunk").applyInArrow(carried, f"run_id {kind}, chunk long, band int, above binary, below binary")
    beside = seen.groupBy("run_id", "band").agg(F.sort_array(F.collect_list(F.struct("chunk", "above", "below"))).alias("parts"))
    return bands.over(lines, deep, bands.line_schema(lines) + ", most long", beside=cut(beside))


def _box(a: np.ndarray, r: int, largest: bool) -> np.ndarray:
    """Greatest or least value over squares; what lies outside the array does not count."""
    of, worst = (np.maximum, np.iinfo(a.dtype).min) if largest else (np.minimum, np.iinfo(a.dtype).max)
    for _ in range(2):
        n, held, size = len(a), np.pad(a, ((r, r), (0, 0)), constant_values=worst), 1
        while 2 * size <= 2 * r + 1:
            held, size = of(held[:-size], held[size:]), 2 * size
        a = np.ascontiguousarray(of(held[:n], held[2 * r + 1 - size :][:n]).T)
    return a


def _led(band: Band, share: float, gap: int) -> tuple[np.ndarray, ...]:
    """Of a band's own lines and one more above and below, and a column more at each side: depths, nodes, seeds, and the node at which a pixel's pointers end.

    Pointers end at seeds, at pixels deeper than all their neighbours, and at the lines above and below, which belong to other bands.
    """
    d2 = band.a.astype(np.int64)
    h, w = d2.shape
    place = (band.first + np.arange(h))[:, None] * _SHIFT + np.arange(w)
    peak = (d2 > 0) & (d2 == _box(d2, gap, True)) & (d2 > share * share * band.row["most"])
    own = np.where(peak, place, np.iinfo(np.int64).max)
    seed = peak & (_box(own, gap, False) == own)
    wide = lambda a, none: np.pad(a, ((1, 1), (1, 1)), constant_values=none)[band.own.start : band.own.stop + 2]
    deep, node, seed = wide(d2, 0), wide(place, -1), wide(seed, False)
    at = np.arange(deep.size).reshape(deep.shape)
    best, to = np.full((deep.shape[0] - 2, w), -2), at[1:-1, 1:-1].copy()
    for dy in range(3):  # in reading order, so that the first of equals stays
        for dx in range(3):
            near = deep[dy : dy + len(best), dx : dx + w]
            more = near > best
            best, to = np.where(more, near, best), np.where(more, at[dy : dy + len(best), dx : dx + w], to)
    lead = at.copy()
    lead[1:-1, 1:-1] = np.where(seed[1:-1, 1:-1] | (deep[1:-1, 1:-1] <= 0), at[1:-1, 1:-1], to)
    lead = lead.ravel()
    while True:
        after = lead[lead]
        if np.array_equal(after, lead):
            break
        lead = after
    return deep, node, seed, node.ravel()[lead].reshape(deep.shape)


def _basins(band: Band, share: float, gap: int) -> Iterator[pa.RecordBatch]:
    deep, node, seed, end = _led(band, share, gap)
    inside = slice(1, -1)
    on = deep > 0
    rows = [(_SEED, node[inside, inside][seed[inside, inside]], None, None)]
    for line, there in ((1, band.top > 0), (-2, len(band.a) > band.own.stop)):
        moved = (on & (end != node))[line] & there
        rows.append((_BORDER, node[line][moved], end[line][moved], None))
    low, high, depth = [], [], []
    for dy, dx in _NEXT:  # the line above is the other band's
        a = (slice(1, -1), slice(1, -1))
        b = (slice(1 + dy, deep.shape[0] - 1 + dy), slice(1 + dx, deep.shape[1] - 1 + dx))
        meet = on[a] & on[b] & (end[a] != end[b])
        low.append(np.minimum(end[a][meet], end[b][meet]))
        high.append(np.maximum(end[a][meet], end[b][meet]))
        depth.append(np.minimum(deep[a][meet], deep[b][meet]))
    low, high, depth = (np.concatenate(v) for v in (low, high, depth))
    order = np.lexsort((depth, high, low))
    low, high, depth = low[order], high[order], depth[order]
    last = np.ones(len(low), bool)
    last[:-1] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    rows += [(_PASS, low[last], high[last], depth[last]), (_END, np.unique(end[inside][on[inside]]), None, None)]
    what = np.concatenate([np.full(len(a), k) for k, a, _, _ in rows])
    columns = [np.concatenate([np.zeros(len(r[1]), np.int64) if r[k] is None else r[k] for r in rows]) for k in (1, 2, 3)]
    yield pa.RecordBatch.from_arrays([pa.repeat(band.run_id, len(what)), pa.array(np.full(len(what), band.band, np.int32)), pa.array(what), *(pa.array(c) for c in columns)], names=["run_id", "band", "what", "a", "b", "d"])


def _named(band: Band, share: float, gap: int) -> Iterator[pa.RecordBatch]:
    deep, _, _, end = _led(band, share, gap)
    deep, end = deep[1:-1, 1:-1], end[1:-1, 1:-1]
    named = sorted((p["a"], p["label"]) for p in band.row["ends"] or [])
    keys, labels = np.array([k for k, _ in named], np.int64), np.array([v for _, v in named], np.int64)
    yield band.lines(np.where(deep > 0, labels[np.minimum(np.searchsorted(keys, end), len(keys) - 1)], 0) if len(keys) else np.zeros(deep.shape, np.int64))


def _parted(lines: DataFrame, share: float, gap: int) -> tuple[DataFrame, DataFrame]:
    """Packed lines of labels of all images, as if each had a seed, and the seeds (run_id, marker).

    A band follows its pixels' pointers to their ends.  Rows are only what bands cannot know: where the pixels of their
    first and last lines lead, passes between ends, and the ends themselves.
    """
    kind = dict(lines.dtypes)["run_id"]
    deep = cut(_depths(lines))
    margin = 2 * gap + 1
    most = cut(deep.groupBy("run_id").agg((F.max("y") + 1).alias("h"), F.max("most").alias("most")))
    beside = frames.by_band(most, margin)
    seen = cut(bands.over(deep, lambda band: _basins(band, share, gap), f"run_id {kind}, band int, what long, a long, b long, d long", margin, beside=beside))
    of = lambda k: seen.where(F.col("what") == k)
    ways = followed(of(_BORDER).select("run_id", F.col("a").alias("node"), F.col("b").alias("to")))
    to = lambda c: ways.select("run_id", F.col("node").alias(c), F.col("to").alias(f"_{c}")).hint("merge")
    passes = of(_PASS).join(to("a"), ["run_id", "a"], "left").join(to("b"), ["run_id", "b"], "left").select("run_id", F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "d").where("a != b")
    passes = cut(passes.groupBy("run_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("d").alias("depth")))
    ends = cut(of(_END).join(to("a"), ["run_id", "a"], "left").select("run_id", "band", "a", F.coalesce("_a", "a").alias("basin")))
    found = cut(of(_SEED).select("run_id", F.col("a").alias("marker")))
    held = ends.select("run_id", "basin").distinct().join(found.select("run_id", F.col("marker").alias("basin"), "marker").hint("merge"), ["run_id", "basin"], "left")
    names = ordinals(found, ["run_id"], "marker", "label").withColumn("label", F.col("label") + 1)
    named = _joined(passes, held).where("marker IS NOT NULL").select("run_id", "basin", "marker").join(names.hint("merge"), ["run_id", "marker"]).select("run_id", "basin", "label")
    labelled = ends.join(named.hint("merge"), ["run_id", "basin"], "left").groupBy("run_id", "band").agg(F.collect_list(F.struct("a", F.coalesce("label", F.lit(0).cast("long")).alias("label"))).alias("ends"))
    beside = cut(beside.join(labelled.hint("merge"), ["run_id", "band"], "left"))
    return bands.over(deep, lambda band: _named(band, share, gap), bands.line_schema(lines), margin, beside=beside), found


def watershed_lines(px: DataFrame, share: float = 0.2, gap: int | None = None) -> DataFrame:
    """``watershed`` as packed lines of labels."""
    lines = cut(bands.pack(px.select("run_id", "y", "x", "v")))  # read several times
    kinds = {gap: None}
    if gap is None:
        wide = F.greatest(F.lit(10), F.floor(10 * F.sqrt(F.col("h") * F.col("w") / F.lit(1920.0 * 1080.0)))).cast("int")
        gaps = cut(bands.sizes(lines).select("run_id", wide.alias("_gap")))
        kinds = {r[0]: gaps.where(F.col("_gap") == r[0]).select("run_id") for r in gaps.select("_gap").distinct().collect()}  # a few sizes of images
    made = None
    for k, runs in sorted(kinds.items()):
        some = lines if len(kinds) == 1 else lines.join(runs, "run_id", "left_semi")
        parted, found = _parted(some, share, k)
        seeded = found.select("run_id").distinct()
        bare = some.join(seeded, "run_id", "left_anti")
        if bare.limit(1).count():
            whole = labels(bands.over(bare, _as_pixels, bands.pixel_schema(bare)))
            parted = parted.join(seeded, "run_id", "left_semi").unionByName(bands.pack(whole, ["label"]))
        made = parted if made is None else made.unionByName(parted)
    return lines if made is None else made


def _as_pixels(band: Band) -> Iterator[pa.RecordBatch]:
    yield band.pixels(band.a)


def watershed(px: DataFrame, share: float = 0.2, gap: int | None = None) -> DataFrame:
    """run_id, y, x and label of all pixels: objects parted where the distance to the outside is small.

    Labels are 1, 2, ... in the order of the seeds of a run.  An image without seeds has its components;
    an object without one has label 0 where others have seeds.  Without ``gap`` seeds keep ten pixels
    apart, more in images of over 1920 x 1080.
    """
    made = cut(watershed_lines(px, share, gap))
    return bands.as_pixels(bands.over(made, _as_pixels, bands.pixel_schema(made)), px).withColumnRenamed("v", "label")


# -- markers of colour clusters

def marker_sets(mask: DataFrame, share: float = 0.4, size: int = 5) -> DataFrame:
    """run_id, y, x and marker: 1 for what is surely outside, 2 and more for the cores of objects, 0 for what is open.

    The mask is opened and closed twice; cores lie deeper than a share of the greatest distance, what
    three dilations add is open, but for the cores.
    """
    kernel = frames.ellipse(size)
    clean = cut(frames.closed(frames.opened(mask.select(*ROW, "v"), kernel, 2), kernel, 2))
    reach = frames.dilate(clean, kernel, 3).where("v > 0").select(*ROW)
    deep = distance2(clean)
    deepest = deep.groupBy("run_id").agg(F.max("d2").alias("_most"))
    core = cut(deep.join(deepest, "run_id").where((F.col("d2") > 0) & (F.col("d2") > share * share * F.col("_most"))).select(*ROW))
    unknown = reach.join(core.hint("merge"), list(ROW), "left_anti").withColumn("_open", F.lit(True))
    cores = cut(components(core.withColumn("v", F.lit(255))))
    named = cores.join(numbered(cores).hint("merge"), ["run_id", "root"]).select(*ROW, (F.col("label") + 1).alias("_core"))
    made = mask.select(*ROW).join(named.hint("merge"), list(ROW), "left").join(unknown.hint("merge"), list(ROW), "left")
    return made.select(*ROW, F.when(F.col("_open"), 0).otherwise(F.coalesce("_core", F.lit(1))).cast("long").alias("marker"))


def unevenness(colours: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """run_id, y, x and rise: the greatest difference of any colour to one of the four neighbours."""
    rise = F.lit(0.0)
    for axis in ("x", "y"):
        line = Window.partitionBy("run_id", "y" if axis == "x" else "x").orderBy(axis)
        for c in columns:
            rise = F.greatest(rise, F.abs(F.col(c) - F.lag(c).over(line)), F.abs(F.col(c) - F.lead(c).over(line)))
    return colours.select(*ROW, rise.alias("rise"))


def colour_watershed(colours: DataFrame, markers: DataFrame, columns: tuple[str, ...] = ("c0", "c1", "c2")) -> DataFrame:
    """run_id, y, x and marker: markers flood what is open over the evenest colours; -1 where two of them meet."""
    even = cut(unevenness(colours, columns).select(*ROW, (-F.col("rise")).alias("d")))
    flooded = cut(flood(even, cut(markers.where("marker > 0")), "d"))
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, 0)))))
    moved = flooded.select("run_id", "y", "x", F.col("marker").alias("_m"), steps.alias("s")).select("run_id", (F.col("y") + F.col("s.a")).alias("y"), (F.col("x") + F.col("s.b")).alias("x"), "_m")
    apart = flooded.join(moved.hint("merge"), list(ROW)).where("marker != _m").select(*ROW).distinct().withColumn("_edge", F.lit(True))
    return flooded.join(apart.hint("merge"), list(ROW), "left").select(*ROW, F.when(F.col("_edge"), -1).otherwise(F.col("marker")).alias("marker"))
