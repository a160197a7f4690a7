"""Exact Jaccard join of n-gram sets over prefix trees.

* Every set is kept in one global order, that of its shingles' hashes, so a set is a path and sets
  that begin alike share one.
* For sets up to a size, the order is cut into one segment more than the number of shingles in
  which two sets that link can differ.  Two that link therefore agree in a whole segment, and only
  sets that agree in one meet.  Segments hold several shingles each, so unlike single shingles
  they are hardly ever shared by chance, however large the corpus is.
* Sets that meet in a segment first meet its least document only, and of these the one with which
  they share most.  The candidates of a document stand side by side in the global order, so that they are a prefix tree walked in preorder: the
  overlap is kept for the path that one candidate has in common with the one before, and a subtree
  is left as soon as the elements that remain cannot bring the overlap that is needed.
* What these walks join needs no further test, since only components are asked for.  Where a segment
  still has documents of different components, all of these meet, in blocks; no pair between
  different components is left out.  Pairs are never rows: a task first gives a forest of those that
  may link by the counts of their sets' parts, the trees of all forests are clusters, and the sets of a
  cluster are compared in one place, which again gives a forest, of links.

Defined cases: texts without words, empty or null, have an empty set and link with nothing; fewer
words than ``words`` are one shingle; repeated rows are one document; a null identifier has a count, links with
nothing and is of no component (null), as in the SQL; an empty table gives no rows; further columns
are ignored; a text of any length is one set, held whole by one task at a time.  ``keep_first`` tells rows without
identifier apart by their texts, so their near copies go too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import exp, sqrt

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text as t
from ._graph import connected_components
from ._store import dropped, table, unused, written

#: At most so many identifiers, or pairs of them, are broadcast; more are joined by a shuffle, of texts or sets too.
BROADCAST_IDS = 500_000
#: Candidates of one document that are compared in one task, and documents of a segment or cluster in one block.
PER_TASK, BLOCK = 512, 1024
#: Shingles of a document that weigh as much as one document in a block of sets.
SHINGLES = 512
#: Postings (each a segment of a document) that a task holds before it deals them out.
HELD = 1 << 20
#: Ratio of the largest set sizes of neighbouring bands, at least.
BAND = 1.5
#: Parts of all shingles, at least; what two sets share is at most the sum over parts of the smaller counts.
PARTS = 64
#: Bytes of a shingle's hash that sets are compared by.
KEY_BYTES = 6
#: Stand-ins for null identifiers are hashes from here on, larger than identifiers.
_UNNAMED = 1 << 62
POSTING = np.dtype([("token", "<u8"), ("doc", "<i8"), ("n", "<u4"), ("hub", "<i8"), ("m", "<u4")])
_EMPTY = np.uint64(0x2545F4914F6CDD1D)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of every shingle of lower-cased words, repeated ones too, by row."""
    data = t.lower(data)
    row, start, end = t.word_spans(data, offsets)
    hashes = t.span_hashes(data, start, end)
    n = max(len(hashes) - words + 1, 0)
    full = np.flatnonzero(row[:n] == row[words - 1 :]) if n else np.zeros(0, np.int64)
    counts = np.bincount(row, minlength=len(offsets) - 1)
    short = np.flatnonzero((counts > 0) & (counts < words))
    first = np.searchsorted(row, short)
    rows = np.concatenate([row[full], short])
    keys = t.run_hashes(hashes, np.concatenate([full, first]), np.concatenate([full + words, first + counts[short]]))
    if len(short):
        order = np.argsort(rows, kind="stable")
        rows, keys = rows[order], keys[order]
    return rows, keys


def ordered_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and keys of each row's set in the global order."""
    rows, keys = shingles(data, offsets, words)
    bounds = np.searchsorted(rows, np.arange(len(offsets)))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        keys[a:b].sort()
    new = t.first_of_runs(rows, keys)
    return np.concatenate([[0], np.cumsum(new)])[bounds], keys[new]


@cache
def bands(percent: int) -> tuple[tuple[int, int, int], ...]:
    """(largest size, most differences of two linked sets of the band, segments) of each band.

    There are so many segments more than differences that a set hardly ever has as many empty ones;
    in bands too small for that, as many as bring it nearest.
    """

    def short(m: int) -> float:
        empty = m * exp(-r / m)
        return empty + 4 * sqrt(empty) + 2 + k - m

    out, r = [], 1
    while r < 1 << 40:
        k = (100 - percent) * 2 * r // (100 + percent)
        m = k + 1
        while k and (lacks := short(m)) > 0 and short(more := m + 1 + int(lacks)) < lacks:
            m = more
        out.append((r, k, m))
        r = max(r + 1, int(BAND * r), 100 * r // percent)
    return tuple(out)


def segments(bounds: np.ndarray, keys: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and token of the segments by which each set meets others.

    A set has the segments of its band, and those of the next one if it can link with a set there.
    Two sets that link agree in at least one segment more than their differences leave; as a set with
    too many empty segments for one of these to hold anything also names its empty ones, two sets
    that link have a token in common.
    """
    n = np.diff(bounds)
    sizes, differ, pieces = (np.array(x, np.int64) for x in zip(*bands(percent)))
    own = np.searchsorted(sizes, n)
    values = np.zeros(len(keys) + 1, np.uint64)
    np.cumsum(t.mix(keys), out=values[1:])
    rows, tokens = [], []
    for step in (0, 1):
        use = (n > 0) & ((100 * n // percent > sizes[own]) if step else True)
        row = np.flatnonzero(use)
        if not len(row):
            continue
        band = own[row] + step
        place = np.repeat(np.arange(len(row)), n[row])
        at = np.arange(len(place)) - np.repeat(np.cumsum(n[row]) - n[row], n[row]) + bounds[:-1][row][place]
        piece = ((keys[at] >> np.uint64(32)).astype(np.float64) * (pieces[band][place] / 2.0**32)).astype(np.int64)
        new = np.flatnonzero(t.first_of_runs(place, piece))
        begin, end = at[new], at[np.append(new[1:], len(at)) - 1] + 1
        place, piece = place[new], piece[new]
        name = t.mix((band[place].astype(np.uint64) << np.uint64(40)) + piece.astype(np.uint64))
        rows.append(row[place])
        tokens.append(t.mix(values[end] - values[begin] + name))
        # sets with too many empty segments name these as well
        empty = pieces[band] - np.bincount(place, minlength=len(row))
        most = np.minimum(differ[band], n[row] * (100 - percent) // percent)
        for k in np.flatnonzero(empty > pieces[band] - most - 1):
            gone = np.setdiff1d(np.arange(pieces[band[k]]), piece[place == k])
            rows.append(np.full(len(gone), row[k]))
            tokens.append(t.mix(t.mix((np.uint64(band[k]) << np.uint64(40)) + gone.astype(np.uint64)) ^ _EMPTY))
    return (np.concatenate(rows), np.concatenate(tokens)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def packed_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and keys (big-endian, in global order) of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in t.slices(batches, "text"):
            bounds, keys = ordered_sets(data, offsets, words)
            at = pa.array((KEY_BYTES * bounds).astype(np.int32)).buffers()[1]
            high = keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
            packed = pa.Array.from_buffers(pa.binary(), rows.num_rows, [None, at, pa.py_buffer(high.tobytes())])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), packed], names=["doc_id", "keys"])

    return docs.select("doc_id", "text").mapInArrow(t.giving_back(run), "doc_id long, keys binary")


def _unpacked_set(keys: bytes) -> np.ndarray:
    """Keys of a packed set; two that are equal in the bytes kept count once."""
    wide = np.zeros((len(keys) // KEY_BYTES, 8), np.uint8)
    wide[:, 8 - KEY_BYTES :] = np.frombuffer(keys, np.uint8).reshape(-1, KEY_BYTES)
    out = wide.reshape(-1).view(">u8").astype(np.uint64)
    return out[t.first_of_runs(out)]


def set_sizes(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n and a 128-bit print of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in t.slices(batches, "text"):
            bounds, keys = ordered_sets(data, offsets, words)
            columns = [pa.array(x) for x in (np.diff(bounds), *_prints(bounds, keys))]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *columns], names=["doc_id", "n", "print_1", "print_2"])

    return docs.select("doc_id", "text").mapInArrow(t.giving_back(run), "doc_id long, n long, print_1 long, print_2 long")


def set_parts(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and how many elements of the set fall into each of its parts, as 32-bit numbers.

    There are ``PARTS`` or, in larger sets, so many times two that a part holds eight elements at most on average.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in t.slices(batches, "text"):
            bounds, keys = ordered_sets(data, offsets, words)
            counts = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                many = PARTS << max(0, ((b - a - 1) // (8 * PARTS)).bit_length())
                counts.append(np.bincount((keys[a:b] % np.uint64(many)).astype(np.int64), minlength=many).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(counts, pa.binary())], names=["doc_id", "parts"])

    return docs.select("doc_id", "text").mapInArrow(t.giving_back(run), "doc_id long, parts binary")


def _prints(bounds: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, ...]:
    return tuple(t.run_hashes(x, bounds[:-1], bounds[1:]).view(np.int64) for x in (keys, keys + np.uint64(1)))


def _postings(docs: DataFrame, words: int, percent: int, buckets: int) -> DataFrame:
    """Per task, packed postings by bucket.

    Of one task's documents with equal sets only the first gives postings.  Where a task has a token
    more than once, the posting of the least document goes to the token's bucket and the others,
    already tied to that document, to buckets of their own, so no bucket gets more of a token than
    one posting each time a task deals out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        prints: set[tuple[int, int]] = set()
        held: list[np.ndarray] = []
        size = 0
        for rows, data, offsets in t.slices(batches, "text"):
            bounds, keys = ordered_sets(data, offsets, words)
            ids, n = np.asarray(rows.column("doc_id")), np.diff(bounds)
            first = np.zeros(len(n), bool)
            for k, both in enumerate(zip(*(x.tolist() for x in _prints(bounds, keys)))):
                if n[k] and both not in prints:
                    prints.add(both)
                    first[k] = True
            row, tokens = segments(bounds, keys, percent)
            pick = first[row]
            made = np.zeros(int(pick.sum()), POSTING)
            made["token"], made["doc"], made["n"] = tokens[pick], ids[row[pick]], n[row[pick]]
            held.append(made)
            size += len(made)
            if size > HELD:
                yield from _dealt(held, buckets, pack)
                held, size = [], 0
        yield from _dealt(held, buckets, pack)

    return docs.select("doc_id", "text").mapInArrow(t.giving_back(run), "bucket long, packed binary")


def _tied(rows: np.ndarray) -> np.ndarray:
    """The postings by token and document, each with the least document of its token as ``hub``."""
    rows = rows[np.lexsort((rows["doc"], rows["token"]))]
    new = np.flatnonzero(t.first_of_runs(rows["token"]))
    times = np.diff(np.append(new, len(rows)))
    rows["hub"], rows["m"] = np.repeat(rows["doc"][new], times), np.repeat(rows["n"][new], times)
    return rows


def _dealt(held: list[np.ndarray], buckets: int, pack: zstandard.ZstdCompressor) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    rows = _tied(np.concatenate(held))
    spread = rows["token"] + np.where(rows["doc"] == rows["hub"], 0, rows["doc"]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bucket = (t.mix(spread) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((rows["doc"], bucket))  # one document's postings side by side pack best
    rows, bucket = rows[order], bucket[order]
    ends = np.searchsorted(bucket, np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(ends))
    columns = lambda x: b"".join(x[k].tobytes() for k in POSTING.names)
    packed = [pack.compress(columns(rows[ends[k] : ends[k + 1]])) for k in full]
    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int64)), pa.array(packed, pa.binary())], names=["bucket", "packed"])


def _unpacked(data: bytes) -> np.ndarray:
    n, at = len(data) // POSTING.itemsize, 0
    rows = np.empty(n, POSTING)
    for k in POSTING.names:
        kind = POSTING[k]
        rows[k] = np.frombuffer(data, kind, n, at)
        at += n * kind.itemsize
    return rows


def _ties(packed: DataFrame, percent: int) -> DataFrame:
    """token, a and b (a before b), and whether their sizes allow for a link, for all tokens that two documents share.

    The ties of a token are a tree that holds all its documents.
    """

    def run(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        rows = np.concatenate([_unpacked(open_.decompress(x.as_py())) for batch in group for x in batch.column("packed")])
        least = rows["doc"] == rows["hub"]
        met = _tied(rows[least])
        rows = np.concatenate([rows[~least], met[met["doc"] != met["hub"]]])
        n, m = rows["n"].astype(np.int64), rows["m"].astype(np.int64)
        fits = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
        for k in range(0, len(rows), 100_000):
            part = rows[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part["token"].view(np.int64)), pa.array(part["hub"].copy()), pa.array(part["doc"].copy()), pa.array(fits[k : k + 100_000])], names=["token", "a", "b", "fits"])

    return packed.groupBy("bucket").applyInArrow(run, "token long, a long, b long, fits boolean")


def _handed(rows: DataFrame) -> DataFrame:
    """A table of identifiers, broadcast up to a size that the planner, which knows the size of its files, does not choose by itself."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def _in_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is among ``ids`` (a table with one column i, distinct)."""
    return docs.join(_handed(ids), F.col("doc_id") == F.col("i"), "left_semi")


def verify(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The linked of pairs (a, b), a table, of documents (doc_id, text): a table."""
    many = pairs.groupBy(F.col("a").alias("c")).agg(F.count("*").alias("many"))
    salted = pairs.join(many, F.col("a") == F.col("c")).select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("many") / PER_TASK).cast("long")).alias("salt"))
    heads = salted.select("a", "salt").distinct().select("a", "salt", F.lit(0).alias("kind"), F.col("a").alias("b"))
    asked = written(heads.unionByName(salted.select("a", "salt", F.lit(1).alias("kind"), "b")), "asked")
    ids = written(asked.select(F.col("b").alias("i")).distinct(), "ids")
    sets = packed_sets(_in_ids(docs, ids), words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, walk = None, None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for a, kind, b, keys in zip(*(batch.column(k).to_pylist() for k in range(4))):
                keys = _unpacked_set(keys)
                if kind == 0:
                    own, walk = a, PreorderWalk(keys, percent)
                elif walk is not None and own == a and walk.links(keys):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])

    rows = sets.join(_handed(asked), F.col("doc_id") == F.col("b")).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind", "keys")
    linked = written(rows.select("a", "kind", "b", "keys").mapInArrow(t.giving_back(run), "a long, b long"), "linked")
    dropped(asked, ids)
    return linked


class PreorderWalk:
    """Compares one set with others that come in preorder of their prefix tree.

    ``path`` holds the elements of the last one down to where its subtree was left, ``overlap[k]``
    how many of the first k are in the set.
    """

    STEP = 64

    def __init__(self, keys: np.ndarray, percent: int):
        self.keys, self.percent = keys, percent
        self.path, self.overlap = np.zeros(0, np.uint64), np.zeros(1, np.int64)

    def links(self, other: np.ndarray) -> bool:
        n = min(len(self.path), len(other))
        differs = np.flatnonzero(self.path[:n] != other[:n])
        depth = int(differs[0]) if len(differs) else n
        need = -(-self.percent * (len(self.keys) + len(other)) // (100 + self.percent))
        overlaps = [self.overlap[: depth + 1]]
        have = int(overlaps[0][-1])
        while depth < len(other):
            passed = int(np.searchsorted(self.keys, other[depth - 1], "right")) if depth else 0
            if have + min(len(other) - depth, len(self.keys) - passed) < need:
                break  # what remains on either side is too little
            part = other[depth : depth + self.STEP]
            at = np.minimum(np.searchsorted(self.keys, part), len(self.keys) - 1)
            overlaps.append(have + np.cumsum(self.keys[at] == part))
            have = int(overlaps[-1][-1])
            depth += len(part)
        self.path, self.overlap = other[:depth], np.concatenate(overlaps)
        return depth == len(other) and have >= need


def _needed(n: np.ndarray, m: np.ndarray | int, percent: int) -> np.ndarray:
    """Elements that sets of these sizes must share."""
    return -(-percent * (n + m) // (100 + percent))


def _may_link(n: np.ndarray, counts: list[np.ndarray], k: int, at: np.ndarray, percent: int) -> np.ndarray:
    """Those of ``at`` that may link with the set at ``k`` by their sizes and the counts of their parts."""
    at = at[100 * np.minimum(n[at], n[k]) >= percent * np.maximum(n[at], n[k])]
    if not len(at):
        return at
    own, most = counts[k], np.empty(len(at), np.int64)
    lengths = np.array([len(counts[j]) for j in at.tolist()])
    for length in np.unique(lengths):
        pick = np.flatnonzero(lengths == length)
        p = min(int(length), len(own))  # finer counts are added up to the coarser ones
        mine = own.reshape(-1, p).sum(0)
        wide = np.stack([counts[j] for j in at[pick].tolist()]).reshape(len(pick), -1, p).sum(1)
        most[pick] = np.minimum(wide, mine).sum(1)
    return at[most >= _needed(n[at], n[k], percent)]


def _by_key(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The rows of each key, of rows sorted by it."""
    rest: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table_ = pa.Table.from_batches([x for x in (rest, batch) if x is not None]).combine_chunks()
        batch = table_.to_batches()[0]
        starts = np.flatnonzero(t.first_of_runs(*(np.asarray(batch.column(k)) for k in keys)))
        for a, b in zip(starts, starts[1:]):
            yield batch.slice(a, b - a)
        rest = batch.slice(starts[-1])
    if rest is not None:
        yield rest


def _placed(members: DataFrame, key: str, weight: Column) -> DataFrame:
    """Members of a key in blocks of about ``BLOCK`` by weight; every two of a key are together in one (block, other)."""
    many = members.groupBy(F.col(key).alias("k")).agg(F.ceil(F.sum(weight) / BLOCK).cast("long").alias("blocks"))
    placed = members.join(many, F.col(key) == F.col("k")).withColumn("home", F.pmod(F.xxhash64("doc"), F.col("blocks")))
    placed = placed.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return placed.select(key, F.least("home", "j").alias("block"), F.greatest("home", "j").alias("other"), "home", "doc")


def _near(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of a forest that joins all documents of which two share a token and may link.

    members: token, block, other, home, doc, component, n, parts; those of one (token, block, other)
    meet.  A task gives no pairs, but at most one link a member, however many pairs there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, ("token", "block", "other")):
            doc, component, n, home = (np.asarray(rows.column(k)) for k in ("doc", "component", "n", "home"))
            apart = rows.column("block")[0] != rows.column("other")[0]
            counts = [np.frombuffer(x, "<u4").astype(np.int32) for x in rows.column("parts").to_pylist()]
            label = np.arange(len(doc))
            for k in range(len(doc) - 1):
                may = (label[k + 1 :] != label[k]) & (component[k + 1 :] != component[k])
                if apart:
                    may &= home[k + 1 :] != home[k]
                at = _may_link(n, counts, k, np.flatnonzero(may) + k + 1, percent)
                if len(at):
                    label[np.isin(label, np.append(label[at], label[k]))] = min(label[k], label[at].min())
            joined = np.flatnonzero(label != np.arange(len(doc)))
            if len(joined):
                yield pa.RecordBatch.from_arrays([pa.array(doc[label[joined]]), pa.array(doc[joined])], names=["a", "b"])

    # by document: most tokens of near copies then have the same least one
    dealt = members.repartition("token", "block", "other").sortWithinPartitions("token", "block", "other", "doc")
    return dealt.mapInArrow(t.giving_back(run), "a long, b long").distinct()


def _linked(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all of a cluster's documents that lead to one another by links.

    members: cluster, block, other, home, doc, component, n, parts, keys; all of one (cluster, block,
    other) are compared but those that are already joined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, ("cluster", "block", "other")):
            doc, component, n, home = (np.asarray(rows.column(k)) for k in ("doc", "component", "n", "home"))
            apart = rows.column("block")[0] != rows.column("other")[0]
            counts = [np.frombuffer(x, "<u4").astype(np.int32) for x in rows.column("parts").to_pylist()]
            packed = rows.column("keys").to_pylist()
            order = np.array(sorted(range(len(doc)), key=packed.__getitem__))  # preorder of the prefix tree
            label = np.unique(component, return_inverse=True)[1]
            links: list[tuple[int, int]] = []
            for k in order.tolist():
                may = (label != label[k]) & (doc > doc[k])
                if apart:
                    may &= home != home[k]
                at = _may_link(n, counts, k, order[may[order]], percent)
                if not len(at):
                    continue
                walk = PreorderWalk(_unpacked_set(packed[k]), percent)
                for j in at.tolist():
                    if label[j] != label[k] and walk.links(_unpacked_set(packed[j])):
                        links.append((doc[k], doc[j]))
                        label[label == label[j]] = label[k]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], names=["a", "b"])

    dealt = members.repartition("cluster", "block", "other").sortWithinPartitions("cluster", "block", "other")
    return dealt.mapInArrow(t.giving_back(run), "a long, b long")


def _open_members(ties: DataFrame, apart: DataFrame) -> DataFrame:
    """token and doc of all tokens that a pair of ``apart`` shares, one token of those with the same documents: a table."""
    open_ = ties.join(apart, ["a", "b"], "left_semi").select(F.col("token").alias("k")).distinct()
    members = ties.join(open_, F.col("token") == F.col("k"), "left_semi").select("token", F.explode(F.array("a", "b")).alias("doc")).distinct()
    members = written(members, "members")
    # a passage that documents share gives many tokens with the same documents
    both = [F.sum(F.xxhash64("doc", F.lit(k)).cast("decimal(20,0)")).alias(f"print_{k}") for k in (1, 2)]
    prints = members.groupBy("token").agg(F.count("*").alias("many"), *both)
    one = prints.groupBy("many", "print_1", "print_2").agg(F.min("token").alias("k"))
    fewer = written(members.join(one.select("k"), F.col("token") == F.col("k"), "left_semi"), "fewer")
    dropped(members)
    return fewer


def _of_documents(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """Pairs (a, b and further columns) of which a and b are of different components."""
    one, two = (components.select(F.col("node").alias(f"node_{x}"), F.col("component").alias(f"of_{x}")) for x in "ab")
    both = pairs.join(one, F.col("a") == F.col("node_a"), "left").join(two, F.col("b") == F.col("node_b"), "left")
    return both.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select(*pairs.columns)


def _settled(links: list[DataFrame], before: DataFrame | None = None) -> DataFrame:
    """Components by all links so far."""
    both = links[0]
    for x in links[1:]:
        both = both.union(x)
    after = connected_components(both)
    if before is not None:
        dropped(before)
    return after


def _components(docs: DataFrame, sizes: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, component) of documents that have links: a table."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = sizes.where("n > 0 AND doc_id IS NOT NULL")
    first = full.groupBy("print_1", "print_2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first != last")
    first = written(first.drop("last"), "first")
    same = full.join(first, ["print_1", "print_2"]).where("doc_id != first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    same = written(same.distinct(), "same")
    ties = written(_ties(_postings(docs, words, percent, buckets), percent), "ties")
    # copies of one set stand for one document from here on
    stand = same.select(F.col("b").alias("node"), F.col("a").alias("component"))
    pairs = written(_of_documents(ties.groupBy("a", "b").agg(F.count("*").alias("tokens"), F.first("fits").alias("fits")), stand), "pairs")
    # each document meets the one with which it shares most tokens
    best = pairs.where("fits").groupBy("b").agg(F.max_by("a", F.struct("tokens", -F.col("a"))).alias("a")).select("a", "b")
    best = written(best, "best")
    links = [same, verify(best, docs, words, percent)]
    components = _settled(links)
    # then those of different components that still share a token
    apart = written(_of_documents(pairs.select("a", "b"), components), "apart")
    dropped(pairs, best)
    if apart.limit(1).count():
        members = _open_members(ties, apart)
        dropped(ties, apart)
        ids = written(members.select(F.col("doc").alias("i")).distinct(), "ids")
        parts = set_parts(_in_ids(docs, ids), words).withColumnRenamed("doc_id", "i").dropDuplicates(["i"])
        known = sizes.select(F.col("doc_id").alias("j"), "n").dropDuplicates(["j"])
        own = components.select(F.col("node").alias("c"), "component")
        about = ids.join(parts, "i").join(known, F.col("i") == F.col("j")).join(own, F.col("i") == F.col("c"), "left")
        about = written(about.select("i", "parts", "n", F.coalesce("component", "i").alias("component")), "about")
        near = written(_near(_placed(members, "token", F.lit(1)).join(about, F.col("doc") == F.col("i")).drop("i"), percent), "near")
        dropped(members, ids)
        if near.limit(1).count():
            clusters = connected_components(near)
            ids = written(clusters.select(F.col("node").alias("i")), "ids")
            sets = packed_sets(_in_ids(docs, ids), words).dropDuplicates(["doc_id"])
            sized = clusters.join(about.select("i", "n"), F.col("node") == F.col("i")).select(F.col("component").alias("cluster"), F.col("node").alias("doc"), "n")
            placed = _placed(sized, "cluster", F.greatest(F.lit(1), F.col("n") / SHINGLES))
            met = placed.join(about, F.col("doc") == F.col("i")).drop("i").join(sets, F.col("doc") == F.col("doc_id")).drop("doc_id")
            links.append(written(_linked(met, percent), "linked"))
            components = _settled(links, components)
            dropped(ids, clusters)
        dropped(about, near)
    else:
        dropped(ties, apart)
    dropped(*links, first)
    return components


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links lead to) of every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sizes = written(set_sizes(docs, words), "sizes")
    components = _components(docs.where("doc_id IS NOT NULL"), sizes, words, percent)  # others link with nothing
    joined = sizes.join(components, F.col("doc_id") == F.col("node"), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op6_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component: the one whose doc_id is the component's.

    Rows with a null doc_id come after all others, in the order of a hash of their text; of equal
    texts with words one row stays, and all rows without words, which link with nothing.
    """
    name, head, size, gone, rank = unused(docs.columns, "_key", "_first", "_size", "_gone", "_rank")
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit(_UNNAMED - 1)).bitwiseOR(F.lit(_UNNAMED)))
    keyed = docs.withColumn(name, key)
    known = jaccard_components(keyed.select(name, "text"), name, words=5, percent=80)
    known = known.groupBy(F.col("doc_id").alias(head)).agg(F.max("n_shingles").alias(size), F.max(F.col("component_id") != F.col("doc_id")).alias(gone))
    known = written(known, "first")
    # those that go are far fewer than those that stay, and are handed to the tasks that read the texts
    named = docs.where("doc_id IS NOT NULL").join(_handed(known.where(gone).select(head)), F.col("doc_id").cast("long") == F.col(head), "left_anti")
    unnamed = keyed.where("doc_id IS NULL").join(known.where(f"NOT {gone}").drop(gone), F.col(name) == F.col(head))
    one = F.row_number().over(Window.partitionBy(name).orderBy(F.col(name)))
    texts = unnamed.where(F.col(size) > 0).withColumn(rank, one).where(F.col(rank) == 1)
    own = [F.col(f"`{c}`") for c in docs.columns]
    return named.unionByName(texts.select(*own)).unionByName(unnamed.where(F.col(size) == 0).select(*own))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 3], ' ') END AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
    linked AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
    either AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
    reach AS (SELECT a, b FROM either UNION SELECT r.a, l.b FROM reach r JOIN either l ON r.b = l.a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(c, w.doc_id)) AS component_id FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY 1) r ON w.doc_id = r.a
"""
