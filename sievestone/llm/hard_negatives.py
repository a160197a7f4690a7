"""Hard negatives by a blocked dense product of anchors and candidates.

Components are quantised to whole numbers, so an inner product is a whole number, and a product of
float64 matrices gives it exactly while no sum can reach 2 ** 53; blocks whose largest components
allow more are multiplied as Python's integers.

Anchors are packed into blocks of a fixed number of bytes.  A wave takes as many blocks as ``WAVE``
holds and broadcasts them; candidates stream past them twice.  In the first pass every task keeps
each anchor's best rows of its own label, which merge by rank; in the second the positives stand
beside their anchors, and every task keeps, for each of them, the best rows of other labels whose
score lies in the positive's window.  A task's memory is one block of candidates, the wave, and a
few rows per anchor; what it emits is bounded by the wave too.

Defined cases: rows with a null label or vector, or with a null or non-finite component take no
part; a shorter vector counts as if continued by zeros; a row is no candidate for an anchor of the
same identifier; repeated rows count each by themselves, as anchors too; ties go to the smaller
identifier, rows without one come last and are returned as null; scores beyond 64 bits are held at
their ends; an anchor without positives, and a positive without negatives, give no rows; an empty
table gives none; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import dropped, table, written

#: Bytes of float64 components in a block of anchors, in one of candidates, and in a broadcast wave.
ANCHOR_BYTES, BLOCK_BYTES, WAVE = 1 << 18, 1 << 21, 16 << 20
POSITIVES, NEGATIVES = 5, 3
#: A row without an identifier is ranked as if it had this one.
_LAST = np.iinfo(np.int64).max
_EXACT = 2.0**53


@dataclass
class Rows:
    """A block: identifiers, labels and quantised components, shorter vectors continued by zeros."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    largest: float = field(init=False)

    def __post_init__(self):
        self.largest = float(np.abs(self.x).max(initial=0.0))


def products(a: Rows, b: Rows) -> np.ndarray:
    """Inner products of all rows of both blocks: float64 where that is exact, else clipped int64."""
    n = min(a.x.shape[1], b.x.shape[1])
    if a.largest * b.largest * n < _EXACT:
        return a.x[:, :n] @ b.x[:, :n].T
    whole = [np.array([[int(v) for v in row] for row in m.x[:, :n]], object).reshape(len(m.x), n) for m in (a, b)]
    return np.clip(whole[0] @ whole[1].T, -(2**63), 2**63 - 1).astype(np.int64)


def unpacked(batch: pa.RecordBatch, most: int = BLOCK_BYTES) -> Iterator[Rows]:
    """Blocks of at most ``most`` bytes from rows of (id, label, vector), in the order of identifiers."""
    ids, labels = batch.column("id").fill_null(_LAST).to_numpy(), batch.column("label").to_numpy()
    vectors = batch.column("vector")
    width = vectors.value_lengths().to_numpy()
    start = vectors.offsets.to_numpy()[:-1]
    flat = vectors.values.to_numpy()
    order, at = np.argsort(ids, kind="stable"), 0
    while at < len(order):
        widest = np.maximum.accumulate(width[order[at:]])
        over = np.flatnonzero(8 * widest * np.arange(1, len(widest) + 1) > most)
        rows = order[at : at + max(1, over[0] if len(over) else len(widest))]
        at += len(rows)
        x = np.zeros((len(rows), max(int(width[rows].max()), 1)))
        inside = np.arange(x.shape[1]) < width[rows, None]
        x[inside] = flat[np.repeat(start[rows], width[rows]) + np.arange(width[rows].sum()) - np.repeat(np.cumsum(width[rows]) - width[rows], width[rows])]
        yield Rows(ids[rows], labels[rows], x)


class Best:
    """For each of ``n`` places the ``k`` best (score, id): higher scores first, ties by smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.place = k, np.zeros(0, np.int64)
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(n, np.iinfo(np.int64).min)

    def add(self, place: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        place, ids, scores = (np.concatenate(x) for x in ((self.place, place), (self.ids, ids), (self.scores, scores.astype(np.int64))))
        order = np.lexsort((ids, -1 - scores, place))  # -1 - x turns the order of all 64-bit values
        place, ids, scores = place[order], ids[order], scores[order]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        held = rank < self.k
        self.place, self.ids, self.scores = place[held], ids[held], scores[held]
        full = rank == self.k - 1
        self.least[place[full]] = scores[full]


def quantised(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """The rows that take part as (id, label, vector of whole numbers)."""
    v = F.col("v")
    good = v.isNotNull() & F.col("label").isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where(good).select("id", "label", F.transform("v", lambda x: F.floor(x * float(scale)).cast("double")).alias("vector"))


def _blocks(anchors: DataFrame) -> DataFrame:
    """Anchors as blocks: a number, their count and bytes, and lists of identifiers, labels, widths and components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for b in unpacked(batch, ANCHOR_BYTES):
                columns = [[number], [len(b.ids)], [b.x.nbytes], [b.ids], [b.labels], [b.x.tobytes()]]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["block", "n", "bytes", "ids", "labels", "x"])
                number += 1

    return anchors.mapInArrow(run, "block long, n long, bytes long, ids array<long>, labels array<long>, x binary")


def _waves(blocks: DataFrame) -> Iterator[list[int]]:
    """Numbers of blocks, as many at a time as a wave holds: a row per block of anchors comes to the driver."""
    held, size = [], 0
    for r in blocks.select("block", "bytes").orderBy("block").toLocalIterator():
        if held and size + r.bytes > WAVE:
            yield held
            held, size = [], 0
        held.append(r.block)
        size += r.bytes
    if held:
        yield held


def _batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    names = [part.split()[0] for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], names=names)


def _ranked(rows: DataFrame, keys: list[str], score: str, by: str, k: int) -> DataFrame:
    """The ``k`` best rows of each key with ``rank``; ranks beyond ``k`` go before the shuffle too."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), by)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _positives(rows: DataFrame, wave: Broadcast, k: int) -> DataFrame:
    """anchor (its place in the wave), positive and score: the best rows of the anchor's label."""
    schema = "anchor long, positive long, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(len(a.ids), k) for a in wave.value]
        for batch in batches:
            for b in unpacked(batch):
                for a, top in zip(wave.value, best):
                    scores = products(a, b)
                    place, at = np.nonzero((a.labels[:, None] == b.labels) & (a.ids[:, None] != b.ids) & (scores >= top.least[:, None]))
                    top.add(place, b.ids[at], scores[place, at])
        first = 0
        for a, top in zip(wave.value, best):
            yield _batch(schema, top.place + first, top.ids, top.scores)
            first += len(a.ids)

    return _ranked(rows.mapInArrow(run, schema), ["anchor"], "score", "positive", k)


def _negatives(rows: DataFrame, wave: Broadcast, positives: Broadcast, k: int) -> DataFrame:
    """pair (its place among the positives), negative and score: the best rows of other labels in the window."""
    schema = "pair long, negative long, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, low, high = positives.value
        first = np.cumsum([0, *(len(a.ids) for a in wave.value)])
        cuts = np.searchsorted(anchor, first)
        best = [Best(n, k) for n in np.diff(cuts)]
        for batch in batches:
            for b in unpacked(batch):
                for j, (a, top) in enumerate(zip(wave.value, best)):
                    pairs = slice(cuts[j], cuts[j + 1])
                    own = anchor[pairs] - first[j]
                    scores = products(a, b)
                    least = np.maximum(low[pairs], top.least)
                    other = a.labels[:, None] != b.labels
                    for step in range(0, len(own), 256):  # a few pairs at a time: a matrix of them, not of all
                        of = own[step : step + 256]
                        s = scores[of]
                        pair, at = np.nonzero(other[of] & (s >= least[step : step + 256, None]) & (s <= high[pairs][step : step + 256, None]))
                        top.add(pair + step, b.ids[at], s[pair, at])
        for at, top in zip(cuts, best):
            yield _batch(schema, top.place + at, top.ids, top.scores)

    return _ranked(rows.mapInArrow(run, schema), ["pair"], "score", "negative", k)


def window(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole score between half and 95 hundredths of a positive's, without leaving 64 bits."""
    return -(-positive // 2), positive - -(-positive // 20)


def hard_negatives(
    vectors: DataFrame,
    anchor: Column | None = None,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    scale: int = 256,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: a table.

    ``anchor`` is a condition on ``id`` and ``label``; without it every row is an anchor.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, label_col, vector_col, scale)
    blocks = written(_blocks(rows if anchor is None else rows.where(anchor)), "anchors")
    found: DataFrame | None = None
    parts: list[DataFrame] = []
    for numbers in _waves(blocks):
        # at most WAVE bytes, and one block of any size if it alone is larger
        mine = blocks.where(F.col("block").between(numbers[0], numbers[-1])).orderBy("block").collect()
        wave = spark.sparkContext.broadcast([Rows(np.array(r.ids), np.array(r.labels), np.frombuffer(bytes(r.x), np.float64).reshape(r.n, -1)) for r in mine])
        ids = np.concatenate([a.ids for a in wave.value])
        top = np.array(sorted((r.anchor, r.rank, r.positive, r.score) for r in _positives(rows, wave, positives).collect()), np.int64).reshape(-1, 4)
        low, high = window(top[:, 3])
        pairs = spark.sparkContext.broadcast((top[:, 0].copy(), low, high))
        kept = _negatives(rows, wave, pairs, negatives).select("pair", "rank", "negative", "score")
        numbered = spark.createDataFrame(pa.table({"k": np.arange(len(top)), "anchor_id": ids[top[:, 0]], "positive_id": top[:, 2], "positive_score": top[:, 3]}))
        parts.append(written(kept.join(F.broadcast(numbered), F.col("pair") == F.col("k")), "negatives"))
        found = parts[-1] if found is None else found.unionByName(parts[-1])
        wave.unpersist()
        pairs.unpersist()
    dropped(blocks)
    if found is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    named = lambda c: F.when(F.col(c) != int(_LAST), F.col(c)).alias(c)
    return found.select(named("anchor_id"), named("positive_id"), "rank", F.when(F.col("negative") != int(_LAST), F.col("negative")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_blocked_gemm(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", "embedding", label.alias("label")), F.col("id") % 50 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id != b.vec_id WHERE a.vec_id % 50 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
    n AS (SELECT p.*, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
        FROM p JOIN s ON p.anchor_id = s.anchor_id WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
