"""Exact removal of repeated byte strings by sorted suffixes.

A byte goes if a ``SPAN``-byte string over it also starts in a document with a smaller identifier.

* Suffixes are taken in runs that share a landmark: of the ``LEAD``-byte strings inside a span, the
  one with the least hash.  Equal spans have the same landmark at the same place, so only suffixes
  whose landmarks are equal need be compared, and a run of neighbouring spans is sent once, as one
  short string, with the landmark's bytes as its leading tokens.
* Sampled splitters part the leading tokens into ranges of about equal size.  A splitter never
  parts equal leading tokens, so whatever could be equal across a boundary is on one side of it.
* A bucket sorts its suffixes by multikey quicksort over eight-byte words, word by word and only
  where all words before were equal, and compares neighbours.
* Strings that a task's own documents repeat are settled in the task; only the one with the
  smallest identifier is sent on, so a passage that many documents share reaches a bucket once per
  task.

Defined cases: null and empty texts have no bytes; repeats inside one document stay; rows of one
identifier are one document; a null identifier counts as the smallest; an empty table gives no
rows; further columns are ignored.  Where the kept bytes are decoded, parts of a character that was
cut through are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as t
from ._store import table, unused, written

SPAN, LEAD = 50, 12
#: Text whose strings are held and compared in a task at once, and text per bucket.
CHUNK, BUCKET = 8 << 20, 4 << 20
#: Spans that a bucket sorts at once (more only if one landmark has more), and strings held against them.
SPANS_AT_ONCE, ENTRIES_AT_ONCE = 250_000, 20_000
#: Documents from which splitters are taken (they steer sizes only, never results).
SAMPLE = 2000
_PLACE_BITS = np.uint64(28)
_NULL_ID = -(1 << 63)


def runs_of_spans(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, lead: int = LEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First span, end of the last span, and landmark of every run of spans with one landmark."""
    n = len(data)
    if n < span:
        return (np.zeros(0, np.int64),) * 3
    at = np.arange(n - lead + 1)
    least = (t.span_hashes(data, at, at + lead) << _PLACE_BITS) | at.astype(np.uint64)
    width, have = span - lead + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if width > have:
        least = np.minimum(least[: n - span + 1], least[width - have : width - have + n - span + 1])
    inside = np.zeros(n + 1, np.int32)
    ends = offsets[1:]
    np.add.at(inside, np.maximum(ends - span + 1, offsets[:-1]), 1)  # no span of a document starts here or later
    np.add.at(inside, ends, -1)
    start = np.flatnonzero(np.cumsum(inside)[: n - span + 1] == 0)
    mark = (least[start] & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(t.first_of_runs(mark))
    last = np.append(new[1:], len(start)) - 1
    return start[new], start[last[: len(new)]] + span, mark[new]


def word_at(data: np.ndarray, at: np.ndarray, size: int = 8) -> np.ndarray:
    """``size`` bytes from each place as a big-endian number."""
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = (out << np.uint64(8)) | data[at + k]
    return out


def multikey_runs(data: np.ndarray, at: np.ndarray, group: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings of ``span`` bytes at ``at`` within ``group``, and where new ones begin.

    Multikey quicksort with words of eight bytes as characters: after each word only strings that
    are still equal to a neighbour are sorted by the next.
    """
    order = np.argsort(group, kind="stable")
    new = t.first_of_runs(group[order])
    for depth in range(0, span, 8):
        size = min(8, span - depth)
        tied = ~(new & np.append(new[1:], True))
        places = np.flatnonzero(tied)
        if not len(places):
            break
        run = np.cumsum(new)[places]
        words = word_at(data, at[order[places]] + depth, size)
        inner = np.lexsort((words, run))
        order[places] = order[places][inner]
        run, words = run[inner], words[inner]
        new[places] |= t.first_of_runs(run, words)
    return order, new


def _prints(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of strings that come in order of place, a slice of the bytes at a time."""
    one, two, at = np.empty(len(first), np.uint64), np.empty(len(first), np.uint64), 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(first, first[at] + t.SLICE)))
        base, stop = first[at], end[at:to].max()
        one[at:to] = t.span_hashes(data[base:stop], first[at:to] - base, end[at:to] - base)
        two[at:to] = t.span_hashes(data[base:stop], first[at:to] - base, end[at:to] - base, 3)
        at = to
    return one, two


def _settled(one: np.ndarray, two: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By equal strings: which come from the least identifier, and which repeat a smaller one's."""
    order = np.lexsort((docs, two, one))
    new = np.flatnonzero(t.first_of_runs(one[order], two[order]))
    sizes = np.diff(np.append(new, len(order)))
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(docs[order][new], sizes)
    return docs == least, docs > least


def _gather(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of strings one behind another."""
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - size), size)
    return data[at]


_FIELDS = (("size", "u1"), ("mark", "u1"), ("doc", "<i8"), ("at", "<u4"))


def _packed(data: np.ndarray, rows: dict[str, np.ndarray], pick: np.ndarray, pack: zstandard.ZstdCompressor) -> bytes:
    text = _gather(data, rows["first"][pick], rows["size"][pick].astype(np.int64))
    return pack.compress(len(pick).to_bytes(8, "little") + b"".join(rows[k][pick].astype(kind).tobytes() for k, kind in _FIELDS) + text.tobytes())


def _opened(packed: bytes) -> tuple[dict[str, np.ndarray], np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n, at, rows = int.from_bytes(raw[:8], "little"), 8, {}
    for k, kind in _FIELDS:
        rows[k] = np.frombuffer(raw, kind, n, at).astype(np.int64)
        at += n * np.dtype(kind).itemsize
    return rows, np.frombuffer(raw, np.uint8, offset=at)


def _marked(docs: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per document: doc_id and its spans, merged, as pairs of 32-bit numbers."""
    if not len(docs):
        return
    order = np.lexsort((start, docs))
    docs, start, end = docs[order], start[order], end[order]
    base = np.cumsum(t.first_of_runs(docs)) * (1 << 33)  # so that no document's ends reach into the next
    reach = np.maximum.accumulate(base + end)
    new = np.ones(len(docs), bool)
    new[1:] = base[1:] + start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    pairs = np.stack([start[at], (reach - base)[np.append(at[1:], len(docs)) - 1]], 1).astype("<u4")
    docs = docs[at]
    heads = np.flatnonzero(t.first_of_runs(docs))
    bounds = np.append(heads, len(docs))
    for k in range(0, len(heads), 20_000):
        part = range(k, min(k + 20_000, len(heads)))
        yield pa.RecordBatch.from_arrays([pa.array(docs[heads[k : k + 20_000]]), pa.array([pairs[bounds[j] : bounds[j + 1]].tobytes() for j in part], pa.binary())], names=["doc_id", "spans"])


def _strings(docs: DataFrame, splitters: np.ndarray, span: int, lead: int) -> DataFrame:
    """Per task and range: packed strings; and, with a null range, spans settled in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pack = zstandard.ZstdCompressor(level=3)
        held: list[tuple[np.ndarray, dict[str, np.ndarray]]] = []
        size = 0

        def dealt() -> Iterator[pa.RecordBatch]:
            data = np.concatenate([d for d, _ in held])
            shift = np.cumsum([0, *(len(d) for d, _ in held)])[:-1]
            rows = {k: np.concatenate([r[k] + (s if k == "first" else 0) for (_, r), s in zip(held, shift)]) for k in held[0][1]}
            send, drop = _settled(*_prints(data, rows["first"], rows["first"] + rows["size"]), rows["doc"])
            for part in _marked(rows["doc"][drop], rows["at"][drop], rows["at"][drop] + rows["size"][drop]):
                yield pa.RecordBatch.from_arrays([pa.array([-1] * part.num_rows, pa.int64()), part.column(0), part.column(1)], names=["bucket", "doc_id", "packed"])
            pick = np.flatnonzero(send)
            token = word_at(data, rows["first"][pick] + rows["mark"][pick])
            order = np.argsort(token, kind="stable")
            pick = pick[order]
            bounds = np.concatenate([[0], np.searchsorted(token[order], splitters, "left"), [len(pick)]])
            full = np.flatnonzero(np.diff(bounds))
            for k in full:
                yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int64()), pa.nulls(1, pa.int64()), pa.array([_packed(data, rows, pick[bounds[k] : bounds[k + 1]], pack)], pa.binary())], names=["bucket", "doc_id", "packed"])

        for rows, data, offsets in t.slices(batches, "text"):
            first, end, mark = runs_of_spans(data, offsets, span, lead)
            row = np.searchsorted(offsets, first, "right") - 1
            ids = np.asarray(rows.column("doc_id").fill_null(_NULL_ID))
            if len(first):
                held.append((data, {"first": first, "size": end - first, "mark": mark - first, "doc": ids[row], "at": first - offsets[row]}))
                size += len(data)
            if size >= CHUNK:
                yield from dealt()
                held, size = [], 0
        if held:
            yield from dealt()

    return docs.select("doc_id", "text").mapInArrow(t.giving_back(run), "bucket long, doc_id long, packed binary")


def _compared(strings: DataFrame, span: int, lead: int, buckets: int) -> DataFrame:
    """Spans that repeat a smaller identifier's, by document and bucket: doc_id, spans."""

    def run(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in group:
            own = pa.compute.less(batch.column("bucket"), 0)
            settled = batch.filter(own)
            if settled.num_rows:
                yield pa.RecordBatch.from_arrays([settled.column("doc_id"), settled.column("packed")], names=["doc_id", "spans"])
            parts += [_opened(x.as_py()) for x in batch.filter(pa.compute.invert(own)).column("packed")]
        if parts:
            yield from _compare(parts, span, lead)

    own = F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("doc_id"), F.lit(buckets))).otherwise(F.col("bucket"))
    return strings.groupBy(own.alias("range")).applyInArrow(run, "doc_id long, spans binary")


def _compare(parts: list, span: int, lead: int) -> Iterator[pa.RecordBatch]:
    data = np.concatenate([x for _, x in parts])
    rows = {k: np.concatenate([r[k] for r, _ in parts]) for k, _ in _FIELDS}
    parts.clear()
    first = np.cumsum(rows["size"]) - rows["size"]
    one, two = _prints(data, first, first + rows["size"])
    token, rest = word_at(data, first + rows["mark"]), word_at(data, first + rows["mark"] + 8, lead - 8)
    order = np.lexsort((rest, token))
    new = np.flatnonzero(t.first_of_runs(token[order], rest[order]))
    sizes = np.diff(np.append(new, len(order)))
    doc = rows["doc"][order]
    low, high = np.minimum.reduceat(doc, new), np.maximum.reduceat(doc, new)
    order = order[np.repeat(low != high, sizes)]  # landmarks of one document only repeat nothing
    if not len(order):
        return
    group = np.cumsum(t.first_of_runs(token[order], rest[order]))
    first, size, doc, at, one, two = first[order], rows["size"][order], rows["doc"][order], rows["at"][order], one[order], two[order]
    # equal strings once, with their least identifier
    order = np.lexsort((doc, two, one, group))
    first, size, doc, at, group = (x[order] for x in (first, size, doc, at, group))
    kind = np.cumsum(t.first_of_runs(group, one[order], two[order])) - 1
    heads = np.flatnonzero(t.first_of_runs(kind))
    # spans of all kinds of whole landmarks, some at a time: sorted, and the least identifier of each
    spans = size[heads] - span + 1
    landmark = np.flatnonzero(t.first_of_runs(group[heads]))
    begin = np.concatenate([[0], np.cumsum(spans)])
    cuts, k = [0], 0
    while k < len(heads):
        k = int(np.searchsorted(begin, begin[k] + SPANS_AT_ONCE))
        after = np.searchsorted(landmark, k)
        k = int(landmark[after]) if after < len(landmark) else len(heads)
        cuts.append(k)
    found = []
    entries = np.append(heads, len(doc))
    for a, b in zip(cuts, cuts[1:]):
        owner = np.repeat(np.arange(a, b), spans[a:b])
        place = first[heads[owner]] + np.arange(begin[a], begin[b]) - begin[owner]
        sorted_, fresh = multikey_runs(data, place, group[heads[owner]], span)
        runs = np.flatnonzero(fresh)
        least = np.empty(len(owner), np.int64)
        least[sorted_] = np.repeat(np.minimum.reduceat(doc[heads[owner]][sorted_], runs), np.diff(np.append(runs, len(owner))))
        for k in range(entries[a], entries[b], ENTRIES_AT_ONCE):  # each document's spans against them
            e = np.arange(k, min(k + ENTRIES_AT_ONCE, entries[b]))
            n = spans[kind[e]]
            entry = np.repeat(e, n)
            inner = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)
            hit = least[begin[kind[entry]] - begin[a] + inner] < doc[entry]
            # neighbouring spans of one entry as one
            entry, inner = entry[hit], inner[hit]
            if len(entry):
                new = np.flatnonzero(np.concatenate([[True], (entry[1:] != entry[:-1]) | (inner[1:] != inner[:-1] + 1)]))
                last = np.append(new[1:], len(entry)) - 1
                found.append((doc[entry[new]], at[entry[new]] + inner[new], at[entry[new]] + inner[last] + span))
    if found:
        yield from _marked(*(np.concatenate(x) for x in zip(*found)))


def _splitters(docs: DataFrame, buckets: int, rows: int, lead: int, span: int) -> np.ndarray:
    """Leading tokens of sampled documents that part their landmarks into ranges of equal size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in t.slices(batches, "text"):
            _, _, mark = runs_of_spans(data, offsets, span, lead)
            tokens = word_at(data, mark)[:: max(1, len(mark) // 500)]
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64))], names=["token"])

    some = docs.sample(min(1.0, SAMPLE / max(rows, 1)), seed=7).select("text").limit(2 * SAMPLE)
    tokens = np.sort(np.array([r.token for r in some.mapInArrow(t.giving_back(run), "token long").collect()], np.int64).view(np.uint64))
    return np.unique(tokens[np.linspace(0, len(tokens) - 1, buckets + 1).astype(int)[1:-1]]) if len(tokens) else np.zeros(0, np.uint64)


def repeated_spans(docs: DataFrame, span: int = SPAN, lead: int = LEAD) -> DataFrame:
    """doc_id and packed spans (a document may have several rows) that repeat smaller identifiers'."""
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = max(1, -(-size // BUCKET))
    strings = _strings(docs, _splitters(docs, buckets, rows, lead, span) if buckets > 1 else np.zeros(0, np.uint64), span, lead)
    return written(_compared(strings, span, lead, buckets), "spans")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, lead: int = LEAD, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept text of each row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spans = repeated_spans(docs, span, lead).groupBy(F.col("doc_id").alias("d")).agg(F.collect_list("spans").alias("spans"))
    joined = docs.join(spans, F.coalesce("doc_id", F.lit(_NULL_ID)) == F.col("d"), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, mine in zip(*(batch.column(k) for k in range(3))):
                raw = (text.as_py() or "").encode()
                cuts = merged(b"".join(mine.as_py() or ()), len(raw))
                keep, at = [], 0
                for a, b in cuts:
                    keep.append(raw[at:a])
                    at = b
                kept = b"".join([*keep, raw[at:]])
                out.append((doc.as_py(), len(raw), len(raw) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), (kept if cuts else raw).decode("utf-8", "ignore") if with_text and text.is_valid else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    made = joined.mapInArrow(t.giving_back(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    return made if with_text else made.drop("kept")


def merged(packed: bytes, size: int) -> list[tuple[int, int]]:
    """Spans in order, those that touch as one, none beyond ``size``."""
    pairs = np.frombuffer(packed, "<u4").reshape(-1, 2).astype(np.int64)
    out: list[tuple[int, int]] = []
    for a, b in np.minimum(pairs[np.argsort(pairs[:, 0], kind="stable")], size).tolist():
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif b > a:
            out.append((a, b))
    return out


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def keep_unrepeated(docs: DataFrame) -> DataFrame:
    """``docs`` with the kept text (and ``n_chars``, where there is one); rows of which nothing but white space is left go.

    Identifiers whose rows differ in text stay whole, as a span does not tell which of the rows it is of.
    """
    doc, kept, low, high = unused(docs.columns, "_doc", "_kept", "_low", "_high")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = own.groupBy(F.col("doc_id").alias(doc)).agg(F.min(F.xxhash64("text")).alias(low), F.max(F.xxhash64("text")).alias(high))
    mixed = prints.where(F.col(low) != F.col(high)).select(doc)
    made = remove_repeats(own).where("n_removed > 0").select(F.col("doc_id").alias(doc), F.col("kept").alias(kept))
    made = made.join(mixed, doc, "left_anti").dropDuplicates([doc])
    changed = docs.join(made, F.col("doc_id").cast("long") == F.col(doc), "left")
    cut = F.col(doc).isNotNull()
    changed = changed.where(~cut | (F.length(F.trim(F.regexp_replace(kept, "[\\s]", ""))) > 0))
    new = {"text": F.when(cut, F.col(kept)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return changed.withColumns(new).select(*(F.col(f"`{c}`") for c in docs.columns))


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    k AS (SELECT doc_id, 500 * k AS start, length(h) // 2 AS n, substr(h, 1000 * k + 1, 1098) AS part FROM (SELECT doc_id, h, unnest(range((length(h) // 2 + 499) // 500)) AS k FROM d)),
    b AS (SELECT doc_id, start + j AS i, substr(part, 2 * j + 1, 2) AS byte, CASE WHEN start + j + 50 <= n THEN substr(part, 2 * j + 1, 100) END AS span
        FROM (SELECT *, unnest(range(least(500, n - start))) AS j FROM k)),
    m AS (SELECT span, min(doc_id) AS low FROM b WHERE span IS NOT NULL GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
    f AS (SELECT doc_id, i, byte, (low IS NOT NULL AND doc_id > low)::INT AS f FROM b LEFT JOIN m ON b.span = m.span),
    c AS (SELECT doc_id, i, byte, max(f) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
    g AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) AS before FROM c)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(r, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256 FROM d
    LEFT JOIN (SELECT doc_id, sum(gone) AS n, count(*) FILTER (gone = 1 AND before = 0) AS r, string_agg(byte, '' ORDER BY i) FILTER (gone = 0) AS k FROM g GROUP BY 1) x ON d.doc_id = x.doc_id
"""
