"""Quality of documents by random-indexing word vectors, pooled, and a two-layer network.

Terms are runs of letters, digits and other non-punctuation, and runs of ASCII punctuation; a word
that repeats one of the two terms before it counts as one term of its own, ``AGAIN``.  Terms fall
into ``TERMS`` places by hash, and every place has a random index vector with a few entries of 1 or
-1.  Random indexing sums, over all texts, the index vectors of a term's neighbours: tasks add up
whole numbers for all places, which merge by chunks of places, so what is shuffled, collected and
broadcast is bounded by the table's size, and its values depend on the texts only.  A word vector is
the direction of that sum next to the term's own index vector.

A document is the mean of its terms' vectors and the logarithm of their number.  The network is
fitted in numpy on at most ``TRAIN_ROWS`` labelled documents (those with the least hashes), a fifth
of which is kept back to fit the temperature that divides its logits.  Everything else covers all rows.

Defined cases: null and empty texts are the zero vector and are scored like others; texts of any
length are read whole, one at a time; rows are scored each by its text alone, so repeated rows and
ties get equal scores; a row with a null identifier is scored and is not held out; labels other than
0 and 1 are left out, and so are identifiers with labels of both kinds; of rows that share a labelled
identifier the one with the least vector trains; without labels of both kinds every score is their
smoothed share; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as t
from ._store import dropped, table, written

#: Places of terms, dimensions and entries of an index vector, neighbours on each side.
TERMS, DIMENSIONS, ENTRIES, REACH = 1 << 14, 64, 4, 2
AGAIN = 0
#: Places that are merged as one row, and tasks per core that make partial sums.
CHUNK, TASKS = 256, 4
#: Whole numbers that stand for 1 in a word vector; terms that are pooled at once.
UNIT, AT_ONCE = 1000, 1 << 15
TRAIN_ROWS = 20_000
HIDDEN, PASSES, BATCH, RATE, DECAY = 32, 30, 256, 3e-3, 1e-4
THRESHOLD = 0.3
_SPACE, _SYMBOL, _WORD = 0, 1, 2
_KIND = np.full(256, _WORD, np.uint8)
_KIND[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = _SYMBOL
_KIND[list(b" \t\n\x0b\x0c\r")] = _SPACE


@cache
def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For every place the dimensions of its index vector that are not zero, and their signs."""
    rng = np.random.default_rng(12)
    return rng.permuted(np.tile(np.arange(DIMENSIONS), (TERMS, 1)), axis=1)[:, :ENTRIES].copy(), rng.choice([-1, 1], (TERMS, ENTRIES))


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of every term."""
    n = len(data)
    kind = _KIND[data]
    first = np.ones(n, bool)
    if n:
        first[1:] = kind[1:] != kind[:-1]
        first[offsets[:-1][offsets[:-1] < n]] = True
    start = np.flatnonzero(first)
    end = np.append(start[1:], n)[: len(start)]
    held = kind[start] != _SPACE
    start, end = start[held], end[held]
    row = np.searchsorted(offsets, start, "right") - 1
    h = t.span_hashes(data, start, end)
    again = np.zeros(len(h), bool)
    for back in (1, 2):
        again[back:] |= (h[back:] == h[:-back]) & (row[back:] == row[:-back])
    place = 1 + (h % np.uint64(TERMS - 1)).astype(np.int64)
    return row, np.where(again & (kind[start] == _WORD), AGAIN, place)


def add_contexts(sums: np.ndarray, row: np.ndarray, place: np.ndarray) -> None:
    """Adds the index vectors of each term's neighbours in the same row to the sums (places x dimensions, flat)."""
    at, sign = index_vectors()
    for step in range(0, len(place), AT_ONCE):
        for back in range(1, REACH + 1):
            here = np.arange(max(step, back), min(step + AT_ONCE, len(place)))
            here = here[row[here] == row[here - back]]
            for a, b in ((place[here], place[here - back]), (place[here - back], place[here])):
                sums += np.bincount((a[:, None] * DIMENSIONS + at[b]).ravel(), sign[b].ravel(), len(sums)).astype(np.int64)


def context_sums(docs: DataFrame) -> np.ndarray:
    """Places x dimensions: the sums over all texts."""
    spark = docs.sparkSession
    chunks = TERMS // CHUNK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, pack = np.zeros(TERMS * DIMENSIONS, np.int64), zstandard.ZstdCompressor(level=1)
        for _, data, offsets in t.slices(batches, "text"):
            add_contexts(sums, *terms(data, offsets))
        parts = sums.reshape(chunks, -1)
        some = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([pack.compress(parts[k].tobytes()) for k in some], pa.binary())], names=["chunk", "sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sums, unpack = None, None, zstandard.ZstdDecompressor()
        done = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["chunk", "sums"])
        for batch in batches:
            for chunk, packed in zip(batch.column("chunk").to_pylist(), batch.column("sums")):
                if chunk != last:
                    if last is not None:
                        yield done()
                    last, sums = chunk, np.zeros(CHUNK * DIMENSIONS, np.int64)
                sums += np.frombuffer(unpack.decompress(packed.as_py()), np.int64)
        if last is not None:
            yield done()

    schema = "chunk int, sums binary"
    partial = docs.select("text").coalesce(TASKS * spark.sparkContext.defaultParallelism).mapInArrow(count, schema)
    merged = partial.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(merge, schema)
    out = np.zeros((chunks, CHUNK * DIMENSIONS), np.int64)
    for r in merged.collect():  # TERMS x DIMENSIONS numbers in all
        out[r.chunk] = np.frombuffer(r.sums, np.int64)
    return out.reshape(TERMS, DIMENSIONS)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Context directions and own index vectors side by side, as whole numbers of ``1 / UNIT``."""
    at, sign = index_vectors()
    own = np.zeros((TERMS, DIMENSIONS))
    np.put_along_axis(own, at, sign / math.sqrt(ENTRIES), 1)
    length = np.sqrt((sums.astype(np.float64) ** 2).sum(1, keepdims=True))
    context = np.divide(sums, length, out=np.zeros(sums.shape), where=length > 0)
    return np.rint(UNIT * np.concatenate([context, own], 1)).astype(np.int32)


def pooled(vectors: np.ndarray, row: np.ndarray, place: np.ndarray, rows: int) -> np.ndarray:
    """Rows x features: means of the terms' vectors, and the logarithm of one more than their number."""
    sums, counts = np.zeros((rows, vectors.shape[1]), np.int64), np.bincount(row, minlength=rows)
    for step in range(0, len(row), AT_ONCE):
        of = row[step : step + AT_ONCE]
        first = np.flatnonzero(t.first_of_runs(of))
        sums[of[first]] += np.add.reduceat(vectors[place[step : step + AT_ONCE]], first, axis=0)
    return np.concatenate([sums / np.maximum(counts, 1)[:, None] / UNIT, np.log1p(counts)[:, None]], 1).astype(np.float32)


@dataclass
class Network:
    """Standardised features, one hidden layer, and a logit divided by a temperature; or one share for all."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    share: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(x), self.share)
        # the last places of a product depend on the rows that are multiplied at once
        return np.round(_sigmoid(self.logits(x.astype(np.float64)) / self.temperature), 9)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def loss(z: np.ndarray, y: np.ndarray) -> float:
    """Mean negative logarithm of the probability of what came."""
    return float(np.mean(np.logaddexp(0, -z) * y + np.logaddexp(0, z) * (1 - y)))


def fit_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits between 1/8 and 8 with the least loss, by golden section of its logarithm."""
    low, high, golden = -math.log(8), math.log(8), (math.sqrt(5) - 1) / 2
    f = lambda u: loss(z / math.exp(u), y)
    for _ in range(40):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if f(a) <= f(b) else (a, high)
    return math.exp((low + high) / 2)


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Rows in a given order; each fifth row is kept back for the temperature."""
    features = x.shape[1]
    if len(np.unique(y)) < 2:
        zero = np.zeros(features)
        return Network(zero, zero + 1, np.zeros((features, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, share=(float(y.sum()) + 1) / (len(y) + 2))
    x, y, rng = x.astype(np.float64), y.astype(np.float64), np.random.default_rng(7)
    back = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[~back])) < 2 or len(np.unique(y[back])) < 2:
        back[:] = False
    own, target = x[~back], y[~back]
    scale = own.std(0)
    net = Network(own.mean(0), np.where(scale > 1e-9, scale, 1.0), rng.normal(size=(features, HIDDEN)) / math.sqrt(features), np.zeros(HIDDEN), rng.normal(size=HIDDEN) / math.sqrt(HIDDEN), 0.0)
    own = (own - net.mean) / net.scale
    held = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held], 0
    for _ in range(PASSES):
        order = rng.permutation(len(own))
        for a in range(0, len(own), BATCH):
            xs, ys = own[order[a : a + BATCH]], target[order[a : a + BATCH]]
            hidden = np.tanh(xs @ held[0] + held[1])
            off = (_sigmoid(hidden @ held[2] + held[3][0]) - ys) / len(ys)
            back_off = off[:, None] * held[2] * (1 - hidden**2)
            slopes = [xs.T @ back_off + DECAY * held[0], back_off.sum(0), hidden.T @ off + DECAY * held[2], np.array([off.sum()])]
            step += 1
            for p, g, m, v in zip(held, slopes, first, second):  # Adam
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(held[3][0])
    net.temperature = fit_temperature(net.logits(x[back]), y[back]) if back.any() else 1.0
    return net


def _features(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id and x, the features of each row as bytes: a table."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # TERMS x 2 DIMENSIONS whole numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in t.slices(batches, "text"):
            x = pooled(shared.value, *terms(data, offsets), rows.num_rows)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    return written(docs.mapInArrow(run, "doc_id long, x binary"), "features")


def _held_out(doc_id: Column, parts: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == 0, F.lit(False))


def _training(features: DataFrame, labels: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``TRAIN_ROWS`` documents, in the order of a hash of their identifiers."""
    known = labels.where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~_held_out(F.col("id"), parts))
    known = known.groupBy("id").agg(F.min("label").alias("low"), F.max("label").alias("label")).where("low = label").select("id", "label")
    there = features.where("doc_id IS NOT NULL").select("doc_id").distinct()
    some = known.join(there, F.col("id") == F.col("doc_id"), "left_semi").orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS)
    rows = features.join(F.broadcast(some), F.col("doc_id") == F.col("id"))  # TRAIN_ROWS rows at most
    rows = rows.groupBy("id", "label").agg(F.min("x").alias("x")).orderBy(F.xxhash64("id"), "id").collect()
    if not rows:
        return np.zeros((0, 2 * DIMENSIONS + 1), np.float32), np.zeros(0)
    return np.frombuffer(b"".join(bytes(r.x) for r in rows), np.float32).reshape(len(rows), -1), np.array([r.label for r in rows])


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", parts: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Labels are learned only where the remainder of the identifier's crc32 by ``parts`` is not 0.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    features = _features(docs, word_vectors(context_sums(docs)))
    net = fit(*_training(features, labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("label")), parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(net.score(x))], names=["doc_id", "score"])

    scored = features.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", _held_out(F.col("doc_id"), parts).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op12_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
