"""Images as packed lines, and functions of bands of lines.

A pixel table is packed where it is read: what a batch of rows holds of an image's line becomes one row of bytes, about
a byte a pixel.  Lines are dealt out to bands of ``SIZE`` lines with a margin above and below, so a task holds a band
and never an image, and a pixel crosses the network as a byte or a few, not as a row.  Values that are
missing (null, or pixels that a table does not hold) are NaN in an array of doubles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a band at least; it is twice the margin where that is more.
SIZE = 128
_KINDS = ("u1", "i2", "i4", "i8")


def _numbers(column: pa.Array) -> np.ndarray:
    """Whole numbers as they are, others as doubles; null is NaN."""
    if pa.types.is_boolean(column.type):
        column = column.cast(pa.int8())
    if column.null_count or not pa.types.is_integer(column.type):
        return column.cast(pa.float64()).to_numpy(zero_copy_only=False)
    return column.to_numpy(zero_copy_only=False)


def _least_kind(planes: Sequence[np.ndarray]) -> str:
    if any(p.dtype.kind == "f" for p in planes):
        return "f8"
    low, high = min(int(p.min()) for p in planes), max(int(p.max()) for p in planes)
    return next(k for k in _KINDS if np.iinfo(k).min <= low and high <= np.iinfo(k).max)


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _data(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """Bytes and offsets of a binary column."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    return memoryview(column.buffers()[2] or b"")[offsets[0] : offsets[-1]], offsets - offsets[0]


def names(columns: Sequence[str]) -> list[str]:
    return [f"_p{k}" for k in range(len(columns))]


def line_schema(px: DataFrame, planes: int = 1) -> str:
    return f"run_id {dict(px.dtypes)['run_id']}, y long, x long, n int, kind string, " + ", ".join(f"_p{k} binary" for k in range(planes))


def pack(px: DataFrame, columns: Sequence[str] = ("v",)) -> DataFrame:
    """Lines of images, or pieces of lines: run_id, y, x (of the first pixel), n, kind, and a column of bytes for each of ``columns``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in pieces(batches):
            held, n = [*held, batch], n + batch.num_rows
            if n > 4096:  # a few lines at a time would take longer to hand on than to make
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for again in (False, True):
                y, x = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "x"))
                image = batch.column("run_id").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new = np.ones(len(y), bool)
                new[1:] = (image[1:] != image[:-1]) | (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)
                if again or new.sum() <= len(y) // 4:
                    break
                batch = batch.take(pa.array(np.lexsort((x, y, image))))  # pixels in no order
            planes = [_numbers(batch.column(c)) for c in columns]
            kind = _least_kind(planes)
            at = np.flatnonzero(new)
            bounds = np.append(at, len(y))
            made = [batch.column("run_id").take(pa.array(at)), pa.array(y[at]), pa.array(x[at]), pa.array(np.diff(bounds).astype(np.int32)), pa.array([kind] * len(at))]
            yield pa.RecordBatch.from_arrays(made + [_binary(p.astype(kind), bounds) for p in planes], names=["run_id", "y", "x", "n", "kind", *names(columns)])

    wanted = px.select("run_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *columns)
    return wanted.mapInArrow(run, line_schema(px, len(columns)))


def sizes(lines: DataFrame) -> DataFrame:
    """Height and width of each image: run_id, h, w."""
    return lines.groupBy("run_id").agg((F.max("y") + 1).alias("h"), F.max(F.col("x") + F.col("n")).alias("w"))


def assembled(table: pa.Table, planes: int = 1, largest: bool = False) -> tuple[int, list[np.ndarray], np.ndarray | None]:
    """First line, arrays of the lines that there are, and which pixels there are, None for all.

    Of a pixel that comes several times the last value stays, or the ``largest``.
    """
    y, x, n = (table.column(c).to_numpy() for c in ("y", "x", "n"))
    first, w = int(y.min()), int((x + n).max())
    shape = (int(y.max()) + 1 - first, w)
    kinds = table.column("kind").to_pylist()
    start, n = (y - first) * w + x, n.astype(np.int64)
    at, there = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum()), None
    if largest or len(at) != shape[0] * w:
        there = np.zeros(shape, bool)
        there.reshape(-1)[at] = True
        there = None if there.all() else there
    out = []
    for k in range(planes):
        data, offsets = _data(table.column(f"_p{k}").combine_chunks())
        if len(set(kinds)) == 1:
            values = np.frombuffer(data, kinds[0])
        else:
            wide = "f8" if "f8" in kinds else max(kinds, key=_KINDS.index)
            values = np.concatenate([np.frombuffer(data[offsets[j] : offsets[j + 1]], kind).astype(wide) for j, kind in enumerate(kinds)])
        image = np.empty(shape, values.dtype) if there is None else np.full(shape, np.nan)
        order = np.argsort(values, kind="stable") if largest else slice(None)
        image.reshape(-1)[at[order]] = values[order]
        out.append(image)
    return first, out, there


@dataclass
class Band:
    """The lines of an image from ``first`` on: a band's own (``top`` to ``end``), and those of its margin that there are."""

    run_id: pa.Scalar
    band: int
    first: int
    top: int
    end: int
    planes: list[np.ndarray]
    is_last: bool  #: whether the image ends with the lines that are there
    there: np.ndarray | None  #: which pixels there are, None for all
    row: dict  #: further columns

    @property
    def a(self) -> np.ndarray:
        return self.planes[0]

    @property
    def own(self) -> slice:
        return slice(self.top - self.first, self.end - self.first)

    def pixels(self, *planes: np.ndarray) -> pa.RecordBatch:
        """run_id, y, x and the values of the band's own lines as columns v, v1, ..."""
        h, w = planes[0].shape
        y, x = np.repeat(np.arange(self.top, self.top + h), w), np.tile(np.arange(w), h)
        columns = [p.ravel() for p in planes]
        if self.there is not None:
            there = self.there[self.own].ravel()
            y, x, columns = y[there], x[there], [c[there] for c in columns]
        columns = [pa.array(c.astype(np.int64)) if c.dtype.kind != "f" else pa.array(c, from_pandas=True).cast(pa.int64()) for c in columns]
        return pa.RecordBatch.from_arrays([pa.repeat(self.run_id, len(y)), pa.array(y), pa.array(x), *columns], names=["run_id", "y", "x", *("v" if not k else f"v{k}" for k in range(len(columns)))])

    def lines(self, *planes: np.ndarray) -> pa.RecordBatch:
        """The band's own lines as rows of a table of lines."""
        h, w = planes[0].shape
        kind = _least_kind(planes) if planes[0].size else "u1"
        bounds = np.arange(h + 1) * w
        made = [pa.repeat(self.run_id, h), pa.array(np.arange(self.top, self.top + h)), pa.array(np.zeros(h, np.int64)), pa.array(np.full(h, w, np.int32)), pa.array([kind] * h)]
        return pa.RecordBatch.from_arrays(made + [_binary(p.astype(kind), bounds) for p in planes], names=["run_id", "y", "x", "n", "kind", *(f"_p{k}" for k in range(len(planes)))])


def parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def over(lines: DataFrame, make: Callable[[Band], Iterator[pa.RecordBatch]], schema: str, margin: int = 0, planes: int = 1, beside: DataFrame | None = None, largest: bool = False) -> DataFrame:
    """What ``make`` yields for each band of each image.

    ``beside`` (run_id, band and more) holds at most one row for each band, whose columns the band gets as ``row``.
    """
    size = max(SIZE, 2 * margin)

    def run(group: Iterator[pa.RecordBatch], row: dict | None = None) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(group))
        run_id, band = table.column("run_id")[0], table.column("band")[0].as_py()
        first, arrays, there = assembled(table, planes, largest)
        top, end = band * size, min((band + 1) * size, first + len(arrays[0]))
        if top < end:  # else a margin beyond the image
            yield from make(Band(run_id, band, first, top, end, arrays, first + len(arrays[0]) < (band + 1) * size + margin or not margin, there, row or {}))

    def alone(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(group)

    def both(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        made = list(run(iter(left.to_batches()), right.to_pylist()[0] if right.num_rows else None)) if left.num_rows else []
        return pa.Table.from_batches(made) if made else empty

    to = F.sequence(F.greatest(F.lit(0), F.floor((F.col("y") - margin) / size)).cast("int"), F.floor((F.col("y") + margin) / size).cast("int"))
    # few bytes would else be few tasks
    spread = lines.withColumn("band", F.explode(to)).repartition(parts(lines), "run_id", "band")
    if beside is None:
        return spread.groupBy("run_id", "band").applyInArrow(alone, schema)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    empty = to_arrow_schema(_parse_datatype_string(schema)).empty_table()
    return spread.groupBy("run_id", "band").cogroup(beside.repartition(parts(lines), "run_id", "band").groupBy("run_id", "band")).applyInArrow(both, schema)


def pixel_schema(lines: DataFrame, *more: str) -> str:
    return f"run_id {dict(lines.dtypes)['run_id']}, y long, x long, " + ", ".join(f"{c} long" for c in ("v", *more))


def as_pixels(made: DataFrame, px: DataFrame, v: str | None = "long") -> DataFrame:
    """Places in the types of ``px``; v too where no type is named."""
    kinds = dict(px.dtypes)
    return made.select("run_id", *(F.col(c).cast(kinds[c]).alias(c) for c in ("y", "x")), F.col("v").cast(v or kinds["v"]).alias("v"))


# -- functions of arrays

def continued(n: int, r: int, mirrored: bool) -> np.ndarray:
    """Places of a line of ``n`` and of ``r`` more at both ends."""
    at = np.arange(-r, n + r)
    if not mirrored:
        return np.clip(at, 0, n - 1)
    period = max(2 * (n - 1), 1)
    at %= period
    return np.minimum(at, period - at)


def weighted(band: Band, a: np.ndarray, weights: Sequence[float], mirrored: bool) -> np.ndarray:
    """Of the band's own lines, sums over a square with weights that are products along x and y."""
    r, w = len(weights) // 2, a.shape[1]
    a = a if a.dtype.kind == "f" else a.astype(np.int64)

    def summed(wide: np.ndarray, n: int) -> np.ndarray:
        total = wide[:n] * weights[0]
        for k in range(1, len(weights)):
            total = total + wide[k : k + n] * weights[k]
        return total

    across = np.ascontiguousarray(summed(a.T[continued(w, r, mirrored)], w).T)
    y = np.arange(band.top - r, band.end + r)
    if band.is_last:
        y = continued(band.first + len(a), r, mirrored)[band.top : band.end + 2 * r]
    elif mirrored:
        y = np.abs(y)
    else:
        y = np.maximum(y, 0)
    return summed(across[y - band.first], band.end - band.top)


def extreme(a: np.ndarray, kernel: Sequence[int], largest: bool) -> np.ndarray:
    """Greatest or least value over a kernel with rows of these half widths; what lies outside the array does not count."""
    of = (np.fmax if largest else np.fmin) if a.dtype.kind == "f" else (np.maximum if largest else np.minimum)
    worst = (-np.inf if largest else np.inf) if a.dtype.kind == "f" else (np.iinfo(a.dtype).min if largest else np.iinfo(a.dtype).max)
    (h, w), r, reach = a.shape, len(kernel) // 2, max(kernel)
    wide = np.full((h, w + 2 * reach), worst, a.dtype)
    wide[:, reach : reach + w] = a
    rows, made = {0: a}, a
    for d in range(1, reach + 1):
        made = of(of(made, wide[:, reach - d : reach - d + w]), wide[:, reach + d : reach + d + w])
        rows[d] = made
    out = rows[kernel[r]].copy()
    for k, d in enumerate(kernel):
        s = k - r
        if s < 0 and -s < h:
            out[-s:] = of(out[-s:], rows[d][:s])
        elif 0 < s < h:
            out[:-s] = of(out[:-s], rows[d][s:])
    return out


def runs(on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, first and last place of all runs in the lines of an array of flags, in reading order."""
    wide = np.zeros((on.shape[0], on.shape[1] + 1), np.int8)
    wide[:, :-1] = on
    step = np.diff(wide.ravel(), prepend=0)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1
    w = on.shape[1] + 1
    return start // w, start % w, end % w


def united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 and links between them, the least node of each one's component."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            after = root[root]
            if np.array_equal(after, root):
                break
            root = after
    return root


def component_runs(on: np.ndarray, eight: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Line, first and last place of all runs, and the first run of the component of each."""
    y, x0, x1 = runs(on)
    w, reach = on.shape[1] + 2, int(eight)
    low = np.searchsorted(y * w + x1, (y + 1) * w + x0 - reach)
    high = np.searchsorted(y * w + x0, (y + 1) * w + x1 + reach, "right")
    n = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(y)), n)
    b = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(a))
    return y, x0, x1, united(len(y), a, b)


def painted(shape: tuple[int, int], y: np.ndarray, x0: np.ndarray, x1: np.ndarray, value: np.ndarray) -> np.ndarray:
    """An array with runs of these values, 0 elsewhere."""
    out = np.zeros(shape, value.dtype).ravel()
    n = x1 - x0 + 1
    out[np.repeat(y * shape[1] + x0 - (np.cumsum(n) - n), n) + np.arange(n.sum())] = np.repeat(value, n)
    return out.reshape(shape)
