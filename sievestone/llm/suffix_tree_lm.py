"""A probabilistic suffix tree over words, and the log10 probability of texts under it.

Contexts are the last one or two tokens.  A context is a state of the tree if it came eight times or more
and its next-token distribution diverges from that of its suffix; the longest state that is a
suffix of what came before gives a token's probability.  A state's distribution lists tokens that
followed it four times or more, discounted; the rest of its mass goes to its suffix's distribution, and at the
root to the smoothed counts of all tokens, so every distribution sums to one.

Counts are exact and cover all training texts, and the least counts do not depend on the corpus's size
(``Shares`` may ask for more, as in the original construction).  The tree grows with the corpus: it is a table that
no task and no driver holds.  Texts become windows of token hashes once.  A window asks for its distinct tokens and
pairs, then for the triples of which both pairs are frequent, by sorted keys, packed for each range of keys (``_asked``); what
holds a range answers each window in the order of its keys, first with counts, at last with what the tree says of them.

Defined cases: a null or empty text is only its end; a null identifier is held out (its text form
is empty, whose crc32 is 0); repeated rows are learned from and scored each; with no training text
all tokens are unknown and equally likely; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as t
from ._store import dropped, table, written

LEAST_COUNT, DISCOUNT, DIVERGENCE = 4, 0.5, 0.05
#: Tokens of a window, which is one text at least.
WINDOW = 1 << 19
_END = np.uint64(0x51ED270B4D2C7F13)


@dataclass(frozen=True)
class Shares:
    """Least shares of all training tokens, beside the least counts."""

    listed: float = 0.0  #: of a listed pair of a context and a token
    context: float = 0.0  #: of a context


def token_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, an end after each, and the rows' bounds."""
    data = t.lower(data)
    row, start, end = t.word_spans(data, offsets)
    n = len(offsets) - 1
    bounds = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n) + 1)])
    out = np.full(bounds[-1], _END, np.uint64)
    out[np.arange(len(row)) + row] = t.span_hashes(data, start, end)
    return out, bounds


def gram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a context (or token) followed by a token."""
    return t.mix(t.mix(a) * np.uint64(0x9FB21C651E98DF25) + b)


def grams(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places with one and with two tokens before them in their row, and their hashes with those."""
    depth = np.arange(len(tokens)) - np.repeat(bounds[:-1], np.diff(bounds))
    one = np.flatnonzero(depth >= 1)
    two = np.flatnonzero(depth >= 2)
    pair = np.zeros(len(tokens), np.uint64)
    pair[one] = gram(tokens[one - 1], tokens[one])
    return one, pair[one], two, gram(pair[two - 1], tokens[two])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _packed(x: np.ndarray) -> bytes:
    """Numbers by planes of their bytes: of small ones most planes are empty."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def count_tokens(training: DataFrame) -> DataFrame:
    """(token, n), a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in t.slices(batches, "text"):
            token, n = np.unique(token_stream(data, offsets)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(token), pa.array(n)], names=["token", "n"])

    counted = training.select("text").mapInArrow(t.giving_back(run), "token long, n long")
    return written(counted.groupBy("token").agg(F.sum("n").alias("n")), "tokens")


# -- windows, and what they ask for

_WINDOW = "window long, ids array<long>, held binary, bounds binary, words binary, places binary, trained long, high binary"


def windows(docs: DataFrame) -> DataFrame:
    """Texts (doc_id, text, held_out) as windows of token hashes: distinct ones, and the place of each token among them."""

    def made(number: int, held: list[tuple]) -> pa.RecordBatch:
        tokens, out = np.concatenate([h[0] for h in held]), np.concatenate([h[2] for h in held])
        n = np.concatenate([np.diff(h[1]) for h in held])
        words, places = np.unique(tokens, return_inverse=True)
        ids = pa.concat_arrays([h[3] for h in held])
        cells = [_packed(out), _packed(np.concatenate([[0], np.cumsum(n)])), _packed(np.diff(words, prepend=np.uint64(0))), _packed(places.astype(np.uint32))]
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([c], pa.binary()) for c in cells), pa.array([int(n[~out].sum())]), pa.array([None], pa.binary())],
            names=["window", "ids", "held", "bounds", "words", "places", "trained", "high"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for rows, data, offsets in t.slices(batches, "text"):
            tokens, bounds = token_stream(data, offsets)
            held.append((tokens, bounds, rows.column("held_out").to_numpy(zero_copy_only=False).astype(bool), rows.column("doc_id")))
            size += len(tokens)
            if size >= WINDOW:
                yield made(number, held)
                number, held, size = number + 1, [], 0
        if held:
            yield made(number, held)

    return written(docs.select("doc_id", "text", "held_out").mapInArrow(t.giving_back(run), _WINDOW), "windows")


class Keys:
    """Distinct keys of a window, sorted, the place of each of its keys among them, and their number in training texts."""

    def __init__(self, keys: np.ndarray, out: np.ndarray):
        order = np.argsort(keys)
        sorted_ = keys[order]
        new = t.first_of_runs(sorted_)
        at = np.flatnonzero(new)
        self.keys, self.place = sorted_[at], np.empty(len(keys), np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.counts = np.add.reduceat(~out[order], at, dtype=np.int64).astype(np.uint32) if len(at) else np.zeros(0, np.uint32)


class Window:
    """Tokens of a window, and its pairs, that end at ``one``, and triples, that end at ``two``, as far as they may be in the tree.

    ``high`` tells of the distinct pairs, then of the triples, which come often enough in all training texts; a triple is asked
    for if both its pairs do.  Its keys are first tokens and pairs, then triples, at last what is often enough.
    """

    def __init__(self, row: dict):
        self.bounds, held = _unpacked(row["bounds"], np.int64), _unpacked(row["held"], np.bool_)
        self.held = held
        self.tokens = np.cumsum(_unpacked(row["words"], np.uint64))[_unpacked(row["places"], np.uint32)]
        self.out = np.repeat(held, np.diff(self.bounds))
        depth = np.arange(len(self.tokens)) - np.repeat(self.bounds[:-1], np.diff(self.bounds))
        self.one, self.two = np.flatnonzero(depth >= 1), np.flatnonzero(depth >= 2)
        self.pairs = np.zeros(len(self.tokens), np.uint64)
        self.pairs[self.one] = gram(self.tokens[self.one - 1], self.tokens[self.one])
        self.high, self.triple = [], np.zeros(0, np.uint64)
        packed = row["high"] and zstandard.ZstdDecompressor().decompress(row["high"])
        if packed:
            self._mark(packed)

    def _mark(self, packed: bytes) -> None:
        """Keeps the pairs, and the triples, that are marked."""
        pairs = Keys(self.pairs[self.one], self.out[self.one])
        bits = np.unpackbits(np.frombuffer(packed, np.uint8))
        self.high = [bits[: len(pairs.keys)]]
        good = np.zeros(len(self.tokens), bool)
        good[self.one] = self.high[0][pairs.place] > 0
        self.two = self.two[good[self.two] & good[self.two - 1]]
        self.triple = gram(self.pairs[self.two - 1], self.tokens[self.two])
        self.one = np.flatnonzero(good)
        more = packed[-(-len(pairs.keys) // 8) :]
        if more:
            triples = Keys(self.triple, self.out[self.two])
            self.high.append(np.unpackbits(np.frombuffer(more, np.uint8))[: len(triples.keys)])
            mine = self.high[1][triples.place] > 0
            self.two, self.triple = self.two[mine], self.triple[mine]

    def asks(self) -> Keys:
        tokens, pairs, triples = (self.tokens, self.out), (self.pairs[self.one], self.out[self.one]), (self.triple, self.out[self.two])
        wanted = ((tokens, pairs), (triples,), (tokens, pairs, triples))[len(self.high)]
        return Keys(np.concatenate([k for k, _ in wanted]), np.concatenate([out for _, out in wanted]))


def _marked(row: dict, high: np.ndarray) -> bytes:
    """The window's marks and those of the keys that it has asked for, on whole bytes."""
    before = zstandard.ZstdDecompressor().decompress(row["high"]) if row["high"] else b""
    return zstandard.ZstdCompressor(level=1).compress(before + np.packbits(high).tobytes() + (b"" if len(high) else b"\0"))


def _asked(texts: DataFrame, bits: int) -> DataFrame:
    """(part, window, keys, counts): for each range of keys, of which there are 2 ** bits, those of a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                asks = Window(row).asks()
                keys, counts = asks.keys, asks.counts
                part = (keys >> np.uint64(64 - bits)).astype(np.int64)
                at = np.append(np.flatnonzero(t.first_of_runs(part)), len(keys))
                pieces = [(_packed(np.diff(keys[a:b], prepend=np.uint64(0))), _packed(counts[a:b])) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[at[:-1]]), pa.array(np.full(len(pieces), row["window"])), *(pa.array([p[k] for p in pieces], pa.binary()) for k in (0, 1))],
                    names=["part", "window", "keys", "counts"],
                )

    wanted = texts.drop("ids").withColumn("ids", F.lit(None).cast("array<long>"))
    return wanted.mapInArrow(t.giving_back(run), "part long, window long, keys binary, counts binary")


def _questions(asked: pa.Table) -> tuple[pa.Table, list[np.ndarray]]:
    asked = asked.sort_by("window")
    return asked, [np.cumsum(_unpacked(k.as_py(), np.uint64)) for k in asked.column("keys")]


def _answers(asked: pa.Table, columns: dict[str, list[bytes]]) -> pa.Table:
    made = asked.select(["window", "part"])
    for name, cells in columns.items():
        made = made.append_column(name, pa.array(cells, pa.binary()))
    return made


_FIRST = np.uint32(1 << 31)


def _totals(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of one range: the number of each key in all training texts; the first window that trains on it gets a mark."""
    asked, keys = _questions(pa.Table.from_batches(list(group)))
    counts = np.concatenate([_unpacked(c.as_py(), np.uint32) for c in asked.column("counts")])
    sizes, all_ = [len(k) for k in keys], np.concatenate(keys)
    order = np.argsort(all_, kind="stable")
    starts = np.flatnonzero(t.first_of_runs(all_[order]))
    runs = np.diff(np.append(starts, len(all_)))
    trains = counts[order] > 0
    mine = np.cumsum(trains)  # of a key's windows the first that trains on it
    first = trains & (mine - np.repeat(mine[starts] - trains[starts], runs) == 1)
    out = np.empty(len(all_), np.uint32)
    out[order] = np.repeat(np.minimum(np.add.reduceat(counts[order], starts, dtype=np.int64), (1 << 31) - 1).astype(np.uint32), runs) | np.where(first, _FIRST, np.uint32(0))
    yield from _answers(asked, {"totals": [_packed(x) for x in np.split(out, np.cumsum(sizes)[:-1])]}).combine_chunks().to_batches()


_FOUND = "gram long, n long, context long, suffix long, token long, size long"


def _counted(texts: DataFrame, bits: int, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gram, n, context, suffix, token, size): of what windows ask for all training tokens, and pairs and triples that come
    ``least`` times; a table.  And the windows with marks of the latter, and the table that holds both.

    suffix: of a triple the pair without its first token; columns that would repeat another one are 0.
    """
    names = [c.split(" ")[0] for c in f"{_FOUND}, {_WINDOW}".split(", ")]

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        w = Window(row)
        asks = w.asks()
        totals = np.concatenate([np.zeros(0, np.uint32), *(_unpacked(v.as_py(), np.uint32) for v in right.sort_by("part").column("totals"))])
        mine, totals = totals >= _FIRST, (totals & ~_FIRST).astype(np.int64)
        n = len(w.tokens)
        none = np.zeros(n, np.uint64)
        if w.high:
            kinds = [(3, asks.place, w.triple, w.pairs[w.two - 1], w.pairs[w.two], w.tokens[w.two])]
        else:
            before, own = w.tokens[w.one - 1], w.tokens[w.one]
            kinds = [(1, asks.place[:n], none, none, none, w.tokens), (2, asks.place[n:], w.pairs[w.one], before, none, own)]
        out, high = [], None
        for size, at, gram_, context, suffix, token in kinds:
            good = np.flatnonzero(mine[at] & (totals[at] >= (least if size > 1 else 1)))
            _, once = np.unique(at[good], return_index=True)
            good = good[once]
            out.append([gram_[good].view(np.int64), totals[at[good]], *(c[good].view(np.int64) for c in (context, suffix, token)), np.full(len(good), size)])
            high = totals[np.unique(at)] >= least  # in the order of the distinct keys
        found = pa.table([np.concatenate(c) for c in zip(*out)], names=names[:6])
        m = found.num_rows
        marked = left.set_column(left.schema.get_field_index("high"), "high", pa.array([_marked(row, high)], pa.binary()))
        columns = [pa.concat_arrays([found.column(c).combine_chunks(), pa.nulls(1, pa.int64())]) for c in names[:6]]
        columns += [pa.concat_arrays([pa.nulls(m, marked.schema.field(c).type), marked.column(c).combine_chunks()]) for c in names[6:]]
        return pa.table(columns, names=names)

    # a table, so that what was asked is gone before the windows are dealt out
    answers = written(_asked(texts, bits).groupBy("part").applyInArrow(_totals, "window long, part long, totals binary"), "answers")
    made = written(texts.groupBy("window").cogroup(answers.groupBy("window")).applyInArrow(run, f"{_FOUND}, {_WINDOW}"), "grams")
    dropped(answers)
    return made.where("size IS NOT NULL").select(*names[:6]), made.where("window IS NOT NULL").select(*names[6:]), made


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Tree:
    """Sorted keys and values of a tree that fits in memory."""

    total: int
    distinct: int
    tokens: tuple[np.ndarray, np.ndarray]  # frequent tokens: counts
    states: tuple[tuple[np.ndarray, np.ndarray], ...]  # by length: state -> mass left to its suffix
    listed: tuple[tuple[np.ndarray, np.ndarray], ...]  # by length: state and token -> probability

    def root(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.1) / (self.total + 0.1 * (self.distinct + 1))

    def steps(self, tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token a and b: its probability is a + b * (its probability at the root)."""
        one, pair, two, triple = grams(tokens, bounds)
        pairs = np.zeros(len(tokens), np.uint64)
        pairs[one] = pair
        a, b = np.zeros(len(tokens)), np.ones(len(tokens))
        for (states, left), (listed, share), at, context, key in (
            (self.states[0], self.listed[0], one, tokens[one - 1], pair),
            (self.states[1], self.listed[1], two, pairs[two - 1], triple),
        ):
            state = _find(states, context)
            at, key, state = at[state >= 0], key[state >= 0], state[state >= 0]
            hit = _find(listed, key)
            own = np.where(hit >= 0, share[hit] if len(share) else 0.0, 0.0)
            a[at] = own + left[state] * a[at]
            b[at] *= left[state]
        return a, b


@dataclass
class Grown:
    """A tree as tables."""

    total: int
    distinct: int
    tokens: DataFrame  # token, n
    states: tuple[DataFrame, ...]  # by length: s, left (the mass left to its suffix)
    listed: tuple[DataFrame, ...]  # by length: gram (state and token), share (its probability)
    texts: DataFrame  # the windows, with marks of what may be in the tree


def _range_bits(texts: DataFrame) -> int:
    """Ranges of keys, as many as there are windows: a task holds about as many keys of a range as of a window."""
    return max(6, math.ceil(math.log2(max(1, texts.count()))))


def grow(texts: DataFrame, shares: Shares = Shares()) -> Grown:
    """The tree of the training texts of windows, a table that goes when its successor is there."""
    total, bits = texts.agg(F.coalesce(F.sum("trained"), F.lit(0))).first()[0], _range_bits(texts)
    least = max(LEAST_COUNT, math.ceil(shares.listed * total))
    least_context = max(2 * LEAST_COUNT, math.ceil(shares.context * total))
    found, paired, held = _counted(texts, bits, least)
    dropped(texts)
    more, marked, _ = _counted(paired, bits, least)
    vocabulary = written(found.where("size = 1").select("token", "n"), "tokens")
    distinct = vocabulary.count()
    smooth = F.lit(float(total + 0.1 * (distinct + 1)))
    states, listed = [], []
    # tokens as contexts: what they list, against the root
    common = vocabulary.where(F.col("n") >= least)
    root = common.select(F.col("token").alias("t"), ((F.col("n") + 0.1) / smooth).alias("below"))
    contexts = common.where(F.col("n") >= least_context).select(F.col("token").alias("c"), F.col("n").alias("all"))
    below = found.where("size = 2").join(root, F.col("token") == F.col("t"))
    for size in (2, 3):
        kept = below.join(contexts, F.col("context") == F.col("c"))
        kept = kept.withColumns({"p": F.col("n") / F.col("all"), "share": (F.col("n") - DISCOUNT) / F.col("all")})
        state = kept.groupBy(F.col("context").alias("s")).agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("below"))).alias("d"), (1 - F.sum("share")).alias("left"))
        state = written(state.where(F.col("d") >= DIVERGENCE).select("s", "left"), "states")
        kept = written(kept.join(state, F.col("context") == F.col("s"), "left_semi").select("gram", "share"), "listed")
        states.append(state)
        listed.append(kept)
        if size == 2:  # pairs as contexts: against the distribution of their last token
            pairs = found.where("size = 2").select(F.col("gram").alias("g"), F.col("n").alias("all"), F.col("token").alias("last"))
            contexts = pairs.where(F.col("all") >= least_context).select(F.col("g").alias("c"), "all", "last").join(state.select(F.col("s").alias("s1"), F.col("left").alias("left1")), F.col("last") == F.col("s1"), "left")
            contexts = contexts.select("c", "all", F.coalesce("left1", F.lit(1.0)).alias("left1"))
            share = kept.select(F.col("gram").alias("g2"), F.col("share").alias("share1"))
            below = more.join(root, F.col("token") == F.col("t")).join(share, F.col("suffix") == F.col("g2"), "left")
            below = below.join(contexts.select(F.col("c").alias("c2"), "left1"), F.col("context") == F.col("c2"))
            below = below.withColumn("below", F.coalesce("share1", F.lit(0.0)) + F.col("left1") * F.col("below"))
            contexts = contexts.drop("left1")
    dropped(held)
    return Grown(total, distinct, vocabulary, tuple(states), tuple(listed), marked)


def build_tree(vocabulary: DataFrame, training: DataFrame, shares: Shares = Shares()) -> Tree:
    """The tree of a corpus that is small enough for it to come to the driver."""
    grown = grow(windows(training.select("text", F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("held_out"))), shares)
    least = max(LEAST_COUNT, math.ceil(shares.listed * grown.total))
    tokens = _pairs(vocabulary.where(F.col("n") >= least), "token", "n")
    return Tree(grown.total, grown.distinct, tokens, tuple(_pairs(x, "s", "left") for x in grown.states), tuple(_pairs(x, "gram", "share") for x in grown.listed))


def _pairs(df: DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    rows = df.select(key, F.col(value).cast("double")).toArrow()
    keys = np.asarray(rows.column(0)).astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.asarray(rows.column(1)).astype(np.float64)[order]


_COUNT, _LEFT, _SHARE = range(3)


def _looked_up(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
    """Answers of one range: each key's count as a token, the mass that it leaves as a state, and its share as listed."""
    asked, keys = _questions(left)
    of, what, value = (right.column(c).to_numpy() for c in ("key", "what", "value"))
    out = {}
    for k, name, none, kind in ((_COUNT, "n", 0, np.uint32), (_LEFT, "left", 1.0, np.float64), (_SHARE, "share", 0.0, np.float64)):
        mine = np.flatnonzero(what == k)
        known = of[mine].view(np.uint64)
        order = np.argsort(known)
        known, values = known[order], value[mine][order].astype(kind)
        cells = []
        for wanted in keys:
            at = _find(known, wanted)
            cells.append(_packed(np.where(at >= 0, values[at], kind(none)).astype(kind) if len(values) else np.full(len(wanted), none, kind)))
        out[name] = cells
    return _answers(asked, out)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shares: Shares = Shares()) -> DataFrame:
    """Learns from the training rows of ``docs`` and scores all: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score (tokens one by one) and score (the tree)."""
    identifier = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    texts = windows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.crc32(identifier) % 10 == 0).alias("held_out")))
    bits = _range_bits(texts)
    tree = grow(texts, shares)
    total, smooth = tree.total, tree.total + 0.1 * (tree.distinct + 1)
    row = lambda df, key, what, value: df.select(F.col(key).alias("key"), F.lit(what).alias("what"), F.col(value).cast("double").alias("value"))
    rows = row(tree.tokens, "token", _COUNT, "n")
    for state, kept in zip(tree.states, tree.listed):
        rows = rows.unionByName(row(state, "s", _LEFT, "left")).unionByName(row(kept, "gram", _SHARE, "share"))
    rows = rows.withColumn("part", F.shiftrightunsigned("key", 64 - bits))

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        w, right = Window(left.to_pylist()[0]), right.sort_by("part")
        place = w.asks().place
        n, mass, share = (np.concatenate([_unpacked(v.as_py(), kind) for v in right.column(c)]) for c, kind in (("n", np.uint32), ("left", np.float64), ("share", np.float64)))
        token, pair, triple = np.split(place, [len(w.tokens), len(w.tokens) + len(w.one)])
        pairs = np.full(len(token), -1)
        pairs[w.one] = pair
        a, b = np.zeros(len(token)), np.ones(len(token))
        depth = np.arange(len(token)) - np.repeat(w.bounds[:-1], np.diff(w.bounds))
        # a state leaves its mass to its suffix for all tokens, also those that it does not list
        for at, context, listed in ((np.flatnonzero(depth >= 1), token, (w.one, pair)), (np.flatnonzero(depth >= 2), pairs, (w.two, triple))):
            state = context[at - 1]
            at, state = at[state >= 0], state[state >= 0]
            own = np.zeros(len(token))
            own[listed[0]] = share[listed[1]]
            a[at] = own[at] + mass[state] * a[at]
            b[at] *= mass[state]
        counts = n[token].astype(np.int64)
        root = (counts + 0.1) / smooth
        add = lambda x: pa.array(np.add.reduceat(x, w.bounds[:-1]))  # noqa: E731  every row has its end
        columns = [left.column("ids")[0].values, pa.array(w.held), pa.array(np.diff(w.bounds)), add((counts > 0).astype(np.int64)), pa.array(np.full(len(w.held), total)), add(np.log10(root)), add(np.log10(a + b * root))]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    texts = tree.texts
    answers = written(_asked(texts, bits).groupBy("part").cogroup(rows.groupBy("part")).applyInArrow(_looked_up, "window long, part long, n binary, left binary, share binary"), "answers")
    dropped(tree.tokens, *tree.states, *tree.listed)  # the answers hold what texts need of them
    return texts.groupBy("window").cogroup(answers.groupBy("window")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
