"""Best-fit packing by bin completion.

A packing depends only on how many pieces there are of each length, and lengths are at most the
capacity.  So the plan is made from a histogram of at most ``capacity`` rows, whatever the number
of documents, and consists of at most as many patterns: a pattern is a filling of one sequence,
used as often as its lengths last.  Spark counts the lengths, and places the pieces by a join on
their rank among the pieces of their length.

Defined cases: null and empty texts are a document of only the end id; repeated identifiers are
packed as rows of their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import table, written
from ._tokens import default_path, encoded

#: Nodes of the search tree that may be visited for one largest piece, and fillings tried at each.
NODES, FILLINGS = 2000, 4
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int"


def fillings(stock: dict[int, int], room: int, most: int = 64) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` by pieces in stock, the fullest first.

    A filling is dominated if another has in place of some of its pieces larger ones that fit the
    same room, or more pieces.  Only fillings to which no piece in stock can be added are listed,
    and of those with one piece only that with the largest, which dominates the others.
    """
    lengths = sorted((x for x, n in stock.items() if n > 0 and x <= room), reverse=True)
    if not lengths:
        return [()]
    found, smallest = [(lengths[0],)], lengths[-1]
    budget = 4 * most

    def extend(chosen: list[int], left: int, at: int) -> None:
        nonlocal budget
        for k in range(at, len(lengths)):
            x = lengths[k]
            if x > left or chosen.count(x) >= stock[x]:
                continue
            if budget <= 0 or len(found) >= most:
                return
            budget -= 1
            chosen.append(x)
            if left - x < smallest or not extendable(chosen, left - x):
                found.append(tuple(chosen))
            else:
                extend(chosen, left - x, k)
            chosen.pop()
            if found and sum(found[-1]) == room:
                return  # a full sequence dominates every emptier one with these first pieces

    def extendable(chosen: list[int], left: int) -> bool:
        return any(x <= left and chosen.count(x) < stock[x] for x in reversed(lengths))

    extend([], room, 0)
    return sorted(dict.fromkeys(found), key=lambda f: (room - sum(f), len(f)))


def best_fit(stock: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing, pattern by pattern: [(lengths, times)]."""
    stock, plan = {x: n for x, n in stock.items() if n > 0}, []
    lengths = np.array(sorted(stock), np.int64)
    alive = np.ones(len(lengths), bool)
    while stock:
        filling, left, used = [], capacity, {}
        live = lengths[alive]
        while True:
            k = int(np.searchsorted(live, left, "right")) - 1
            while k >= 0 and used.get(int(live[k]), 0) >= stock[int(live[k])]:
                k -= 1
            if k < 0:
                break
            x = int(live[k])
            take = min(left // x, stock[x] - used.get(x, 0))
            used[x] = used.get(x, 0) + take
            filling += [x] * take
            left -= x * take
        times = min(stock[x] // n for x, n in used.items())
        for x, n in used.items():
            stock[x] -= n * times
            if not stock[x]:
                del stock[x]
                alive[np.searchsorted(lengths, x)] = False
        plan.append((tuple(filling), times))
    return plan


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Least number of sequences: pieces over half the capacity each need one of their own, and for
    each k up to half of it the pieces of k or more must fit beside those that leave room for them."""
    n = np.zeros(capacity + 1, np.int64)
    for x, c in counts.items():
        n[x] = c
    pieces, tokens = np.append(np.cumsum(n[::-1])[::-1], 0), np.append(np.cumsum((n * np.arange(capacity + 1))[::-1])[::-1], 0)
    half, best = capacity // 2 + 1, -(-int(tokens[0]) // capacity)
    for k in range(1, capacity // 2 + 1):
        large = pieces[capacity - k + 1]  # these share a sequence with no piece of k or more
        middle, load = pieces[half] - large, tokens[half] - tokens[capacity - k + 1]
        spare = middle * capacity - load
        best = max(best, int(large + middle) + max(0, -(-int(tokens[k] - tokens[half] - spare) // capacity)))
    return best


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The fewest sequences found: [(lengths, times)].

    Best-fit decreasing is the first incumbent.  Then sequences are completed around the largest
    piece in stock: each undominated filling of the rest is a branch, taken as often as its
    lengths last.  A branch whose waste so far and the least number of sequences for what is left
    cannot beat the incumbent is cut off, and every node offers its best-fit rest as a new
    incumbent.  The search ends at the bound by total length, or after ``NODES`` nodes.
    """
    counts = {x: n for x, n in counts.items() if n > 0}
    total = sum(x * n for x, n in counts.items())
    size = lambda plan: sum(n for _, n in plan)
    bound = lower_bound(counts, capacity)
    best, nodes = best_fit(counts, capacity), 0
    if not counts or size(best) == bound:
        return best
    stack = [(dict(counts), [], 0, 0)]  # stock, plan so far, sequences, waste
    allowed = lambda: (size(best) - 1) * capacity - total  # noqa: E731  waste with which a plan still beats the incumbent
    while stack and nodes < NODES and size(best) > bound:
        stock, plan, sequences, waste = stack.pop()
        nodes += 1
        if not stock or waste > allowed():
            continue
        if nodes % 16 == 1:
            rest = best_fit(stock, capacity)
            if sequences + size(rest) < size(best):
                best = plan + rest
        largest = max(stock)
        left = dict(stock)
        left[largest] -= 1
        for filling in reversed(fillings(left, capacity - largest)[:FILLINGS]):
            used: dict[int, int] = {}
            for x in (largest, *filling):
                used[x] = used.get(x, 0) + 1
            times = min(stock[x] // n for x, n in used.items())
            lost = waste + times * (capacity - largest - sum(filling))
            if lost > allowed():
                continue
            after = {x: n - used.get(x, 0) * times for x, n in stock.items() if n > used.get(x, 0) * times}
            step = [*plan, ((largest, *filling), times)]
            if not after and sequences + times < size(best):
                best = step
            stack.append((after, step, sequences + times, lost))
    return best


def cut_pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of at most ``capacity`` ids; of a longer document only the first is shorter."""
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId()
        for rows, ids in encoded(batches, path, end_id):
            out: list[tuple[int | None, int, int, int, int]] = []
            for doc_id, value in zip(rows.column("doc_id").to_pylist(), ids):
                n = len(value) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n else [0, 0]
                out += [(doc_id, k, a, b - a, zlib.crc32(value[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(x, kind) for x, kind in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(out), salt, np.int32))], names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces (a table that is read more than once, with ``salt``).

    Ranks within a length are dealt by (length, salt), salt being any division of the rows, so a
    length that a third of all pieces have is spread over many tasks.
    """
    spark = pieces.sparkSession
    groups = written(pieces.groupBy("length", "salt").count(), "lengths")
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most ``capacity`` rows
    slots, sequence, ranks = [], 0, dict.fromkeys(counts, 0)
    for filling, times in plan_packing(counts, capacity):
        offset = 0
        for x in sorted(set(filling), reverse=True):
            n = filling.count(x)
            slots.append((x, ranks[x], ranks[x] + n * times, n, sequence, offset))
            ranks[x] += n * times
            offset += n * x
        sequence += times
    slots.sort()
    lengths = sorted(counts)
    by_length = _grouped(slots)
    plan = spark.createDataFrame(
        [(x, [s[0] for s in by_length[x]], [dict(zip(("first", "each", "sequence", "place"), (s[0], s[2], s[3], s[4]))) for s in by_length[x]]) for x in lengths],
        "len long, firsts array<long>, slots array<struct<first:long,each:long,sequence:long,place:long>>",
    )
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = groups.select(F.col("length").alias("l"), F.col("salt").alias("s"), before.alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    ranked = pieces.withColumn("_within", within).join(bases, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s")))
    ranked = ranked.withColumn("_rank", F.col("_within") + F.col("base")).join(F.broadcast(plan), F.col("length") == F.col("len"))
    at = F.aggregate("firsts", F.lit(0), lambda n, x: n + F.when(x <= F.col("_rank"), 1).otherwise(0))
    slot = ranked.withColumn("_slot", F.element_at("slots", at))
    inside = F.col("_rank") - F.col("_slot.first")
    each = F.col("_slot.each")
    return slot.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_slot.sequence") + F.floor(inside / each)).alias("sequence_id"),
        (F.col("_slot.place") + (inside % each) * F.col("length")).alias("offset"),
    )


def _grouped(slots: list[tuple]) -> dict[int, list[tuple]]:
    found: dict[int, list[tuple]] = {}
    for s in slots:
        found.setdefault(s[0], []).append(s[1:])
    return found


def pack_documents(docs: DataFrame, capacity: int = 2048) -> DataFrame:
    return pack(written(cut_pieces(docs, capacity), "pieces"), capacity)


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
