"""Approximate nearest neighbours by largest inner product: inverted file and product quantisation.

Coarse centroids and codebooks are fitted on a bounded sample; every row is then put into its list
with the codes of its residual.  A query is compared with the lists of the centroids that promise
most, by one table of partial products per query (asymmetric distances); the best of them are
scored again on the original vectors, in double precision.  How far a code is from its vector, and the
vectors of a list from its centroid, is known, so what those scores do not rule out is compared as well:
further lists first, then vectors.  No nearest vector is lost by codes or lists, whatever the data.

Copies of a vector are one entry, with the smallest identifiers that any answer can need.  Entries
are dealt to groups of about ``GROUP`` by identifier, each with its own part of all lists, so that no
group is larger because a list is; queries stream past a group, which gives its best entries of each.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part; rows of one identifier are one vector; ties go to the smaller identifier;
fewer candidates than wanted are all returned; an empty table gives no rows; further columns are
ignored.  Recall of the 20 nearest is measured in ``tests/llm/test_ivf_pq.py``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import table, written

#: Rows on which centroids and codebooks are fitted, at most.
SAMPLE = 20_000
LISTS, PARTS, CODES = 1024, 16, 256
#: Distinct vectors of a group at most, those of groups while there are fewer groups than tasks, and tasks that compare
#: at least (a group's queries are split among them).
GROUP, LEAST_GROUP, TASKS = 1 << 17, 1 << 14, 32
#: Rows that a list should have, share of the lists that a query is compared with first, and rows in them at least.
PER_LIST, PROBE_SHARE, LEAST_ROWS = 1000, 0.1, 2000
#: Candidates of each query for the exact scores that tell what else may be near, and vectors scored at once.
RERANK, AT_ONCE = 400, 1 << 15
#: Share of lengths that rounding may take from a sum of single and of double precision.
ROUNDING, EXACT = 4e-6, 1e-12


@dataclass
class Model:
    centroids: np.ndarray  # lists x dimensions
    books: list[np.ndarray]  # per part: codes x its dimensions
    cuts: list[tuple[int, int]]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = nearest(x, self.centroids)
        rest = x - self.centroids[lists]
        return lists, np.stack([nearest(rest[:, a:b], book).astype(np.uint8) for (a, b), book in zip(self.cuts, self.books)], 1)

    def slack(self, x: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """By how much, for each unit of a query's length, a product with a vector may exceed that with its code."""
        rest = np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], 1)
        length = lambda v: np.sqrt((v**2).sum(1))
        whole = length(self.centroids)[lists] + len(self.books) * length(rest) + length(x)
        return length(x - self.centroids[lists] - rest) + ROUNDING * whole

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """Per part: queries x codes of partial inner products."""
        return [q[:, a:b] @ book.T for (a, b), book in zip(self.cuts, self.books)]


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres**2).sum(1)
    return np.concatenate([np.argmax(x[k : k + 2048] @ centres.T - half, 1) for k in range(0, len(x), 2048)]) if len(x) else np.zeros(0, np.int64)


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        sizes = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        full = sizes > 0
        centres[full] = sums[full] / sizes[full, None]
        if not full.all():
            centres[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centres


def fit(x: np.ndarray, rows: int, seed: int = 1) -> Model:
    """A model for ``rows`` vectors from a sample of distinct ones."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    lists = int(min(LISTS, max(64, rows // PER_LIST), max(1, len(x) // 20)))
    centroids = k_means(x, lists, 8, rng)
    rest = x - centroids[nearest(x, centroids)]
    parts = min(PARTS, x.shape[1])
    edges = np.linspace(0, x.shape[1], parts + 1).astype(int)
    cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
    return Model(centroids, [k_means(rest[:, a:b], min(CODES, len(x)), 8, rng) for a, b in cuts], cuts)


def usable(vector: Column) -> Column:
    """Whether all components are finite numbers, and not all are zero."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda v: v != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", probe_share: float = PROBE_SHARE, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best vectors for each row of ``queries``.

    Both tables have ``id_col`` and ``vector_col``; a query's own identifier is no candidate for it.
    """
    spark = vectors.sparkSession
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v"))).dropDuplicates(["vec_id"])
    own = written(clean(vectors), "vectors")
    size = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    names = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return spark.createDataFrame([], names)
    own = own.where(F.size("v") == size.d)
    asked = clean(queries).where(F.size("v") == size.d).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    # of equal vectors an answer holds the k smallest identifiers, besides the query's own
    few = own.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    entries = written(few.groupBy("v").agg(F.min("vec_id").alias("entry"), F.collect_list("vec_id").alias("ids")), "entries")
    some = entries.orderBy(F.xxhash64("entry"), "entry").limit(sample).select("v").toArrow()
    many = entries.count()
    fitted = fit(_matrix(some.column("v")), many)
    model = spark.sparkContext.broadcast(fitted)  # bounded: LISTS centroids and CODES rows of books

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _matrix(part.column("v"))
                lists, codes = model.value.encode(x)
                columns = [pa.array(lists.astype(np.int64)), part.column("entry"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(model.value.slack(x, lists, codes)), part.column("v")]
                yield pa.RecordBatch.from_arrays(columns, names=["list", "entry", "code", "slack", "v"])

    coded = written(entries.select("entry", "v").mapInArrow(encode, "list long, entry long, code binary, slack double, v array<double>"), "codes")
    counts = {r["list"]: r["count"] for r in coded.groupBy("list").count().collect()}  # LISTS rows at most
    sizes = np.array([counts.get(j, 0) for j in range(len(fitted.centroids))])
    groups = max(-(-many // GROUP), min(TASKS, -(-many // LEAST_GROUP)))
    splits = -(-TASKS // groups)

    def probed(promise: np.ndarray) -> np.ndarray:
        """Per query and list, whether they are compared."""
        order = np.argsort(-promise, 1, kind="stable")
        found = np.cumsum(sizes[order], 1)
        least = np.maximum(int(np.ceil(probe_share * order.shape[1])), (found < min(LEAST_ROWS, found[0, -1])).sum(1) + 1)  # at least so many rows
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, np.arange(order.shape[1]) < least[:, None], 1)
        return out

    numbers = lambda n: F.explode(F.array(*(F.lit(j).cast("long") for j in range(n))))
    none = F.lit(None)
    held = coded.select(F.pmod(F.xxhash64("entry"), F.lit(groups)).alias("group"), numbers(splits).alias("split"), F.lit(0).alias("kind"), "list", F.col("entry").alias("id"), "code", "slack", F.col("v").alias("q"))
    wanted = asked.select(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")).alias("all"), F.pmod(F.xxhash64("query_id"), F.lit(splits)).alias("split"), "query_id", "q")
    wanted = wanted.select(F.explode("all").alias("group"), "split", F.lit(1).alias("kind"), none.cast("long").alias("list"), F.col("query_id").alias("id"), none.cast("binary").alias("code"), none.cast("double").alias("slack"), "q")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, fresh = None, [], True
        for batch in batches:
            group, split, kind = (np.asarray(batch.column(c)) for c in ("group", "split", "kind"))
            cut = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (split[1:] != split[:-1]) | (kind[1:] != kind[:-1])])) if len(group) else []
            for a, b in zip(cut, np.append(cut[1:], len(group))):
                if (group[a], split[a]) != key:
                    key, parts, fresh = (group[a], split[a]), [], True
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(b - a, -1)
                    parts.append((np.asarray(part.column("list")), np.asarray(part.column("id")), codes, np.asarray(part.column("slack")), _matrix(part.column("q"))))
                elif parts:
                    if fresh:
                        lists, ids, codes, slack, x = (np.concatenate(x) for x in zip(*parts))
                        order = np.lexsort((ids, lists))
                        parts, fresh = [(np.searchsorted(lists[order], np.arange(len(sizes) + 1)), ids[order], np.ascontiguousarray(codes[order].T), slack[order], x[order])], False
                    for at in range(0, b - a, 64):
                        yield best(part.slice(at, 64), *parts[0])

    def best(asked: pa.RecordBatch, starts: np.ndarray, ids: np.ndarray, codes: np.ndarray, slack: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        q = _matrix(asked.column("q"))
        long = np.sqrt((q**2).sum(1))
        promise = q @ model.value.centroids.T
        tables = [part.astype(np.float32) for part in model.value.tables(q)]
        near = np.full((len(q), len(ids)), -np.inf, np.float32)
        there = np.flatnonzero(np.diff(starts))
        # no vector of a list promises more than its centroid and the way to the farthest of them
        reach = np.zeros(len(sizes))
        for j in there:
            rest = x[starts[j] : starts[j + 1]] - model.value.centroids[j]
            reach[j] = np.sqrt((rest**2).sum(1).max()) + EXACT * np.sqrt((x[starts[j] : starts[j + 1]] ** 2).sum(1).max())

        def scan(compared: np.ndarray) -> None:
            for j in there:
                who, a, b = np.flatnonzero(compared[:, j]), starts[j], starts[j + 1]
                if len(who):
                    sums = np.repeat(promise[who, j].astype(np.float32)[:, None], b - a, 1)
                    for values, code in zip(tables, codes):
                        sums += values[who].take(code[a:b], 1)
                    near[who, a:b] = sums

        first = probed(promise)
        scan(first)
        # one entry may be the query's own
        wanted, least, known = k + 1, np.full(len(q), -np.inf), []
        for n in range(len(q)):
            top = np.argpartition(-near[n], RERANK - 1)[:RERANK] if len(ids) > RERANK else np.arange(len(ids))
            top = top[near[n, top] > -np.inf]
            score = x[top] @ q[n]
            known.append((top, score))
            if len(top) >= wanted:
                least[n] = np.partition(score, -wanted)[-wanted]
        scan(~first & (promise + long[:, None] * reach + EXACT * np.abs(promise) >= least[:, None]))
        out = []
        for n, (top, score) in enumerate(known):
            open_ = near[n] + long[n] * slack >= least[n]
            open_ &= near[n] > -np.inf
            open_[top] = False
            more = np.flatnonzero(open_)
            score = np.concatenate([score, *(x[more[at : at + AT_ONCE]] @ q[n] for at in range(0, len(more), AT_ONCE))])
            top = np.concatenate([top, more])
            if len(top) > wanted:
                # what rounding may have parted stays together
                keep = score >= np.partition(score, -wanted)[-wanted] - EXACT * long[n] * np.sqrt((x[top] ** 2).sum(1))
                top, score = top[keep], score[keep]
            out.append((np.full(len(top), n), top, score))
        who, top, score = (np.concatenate(c) for c in zip(*out))
        return pa.RecordBatch.from_arrays([asked.column("id").take(pa.array(who)), pa.array(ids[top]), pa.array(score)], names=["query_id", "c", "near"])

    rows = held.unionByName(wanted).repartition("group", "split").sortWithinPartitions("group", "split", "kind")
    found = rows.mapInArrow(compare, "query_id long, c long, near double")
    pairs = found.select("query_id", "c").join(entries, F.col("c") == F.col("entry")).select("query_id", "entry", "ids", "v")
    pairs = pairs.join(asked.withColumnRenamed("query_id", "i"), F.col("query_id") == F.col("i"))
    score = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    ranked = lambda df, by: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), by)))
    # each entry has an identifier that is not the query's, but one at most
    good = ranked(pairs.select("query_id", "entry", "ids", score.alias("score")), "entry").where(F.col("rank") <= k + 1)
    good = good.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id != query_id")
    return ranked(good, "vec_id").where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
