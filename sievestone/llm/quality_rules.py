"""Quality rules by cross-document line frequency.

``line_frequency_verdict`` hashes the normalised lines of every text, counts for each line of a
host the distinct documents that hold it (exact copies of a text count once), takes lines above
the limit as removed everywhere but in the document with the smallest id that has them, and
rejects documents that are depleted by that.  ``keep_good`` hands on what is left of the others:
their text without those lines.

Defined cases: null and empty texts have no words and fail the base rule; a null host is a host
of its own; repeated rows are judged alike, and rows that share an identifier but not the text or
host each by themselves; a row with a null identifier is judged like others, counts among the texts
that hold a line and keeps its own lines, as in the SQL; ties do not arise; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as t
from ._store import table, unused, written

#: Frequent lines of all hosts that tasks are handed; more are joined.
BROADCAST_LINES = 1_000_000
#: Words, and share of its words, that a document must keep when frequent lines go.
MIN_WORDS_LEFT, MIN_SHARE_LEFT = 20, 0.3
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_PROFILE = (
    "doc_id long, host string, print long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, text_key long, line_keys array<long>, line_words array<int>"
)
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place: whether its (row, key) is found twice or more, and whether an earlier place has it."""
    order = np.lexsort((np.arange(len(keys)), keys, rows))
    new = t.first_of_runs(rows[order], keys[order])
    run = np.cumsum(new) - 1
    twice, earlier = np.empty(len(keys), bool), np.empty(len(keys), bool)
    twice[order] = np.bincount(run, minlength=1)[run] > 1 if len(keys) else False
    earlier[order] = ~new
    return twice, earlier


def _lines(data: np.ndarray, offsets: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, end, start of the next, row, first word and word after the last of every line that has a word."""
    # lines end at \n and at the ends of texts
    line_start = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offsets[:-1]]))
    line_start = line_start[line_start < len(data)]
    after = np.append(line_start[1:], len(data))[: len(line_start)]
    line_end = after - (data[after - 1] == 10)
    line_doc = np.searchsorted(offsets, line_start, "right") - 1
    word_from, word_to = np.searchsorted(start, line_start), np.searchsorted(start, line_end)
    full = word_to > word_from
    return tuple(x[full] for x in (line_start, line_end, after, line_doc, word_from, word_to))


def _line_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray, word_from: np.ndarray, word_to: np.ndarray) -> np.ndarray:
    """Keys of normalised lines: lower-cased words, whatever white space lies between."""
    return t.run_hashes(t.span_hashes(t.lower(data), start, end), word_from, word_to).view(np.int64)


def without_lines(text: str, gone: list[int]) -> str:
    """``text`` without the lines whose keys are in ``gone``."""
    data = np.frombuffer(text.encode(), np.uint8)
    offsets = np.array([0, len(data)])
    _, start, end = t.word_spans(data, offsets)
    line_start, _, after, _, word_from, word_to = _lines(data, offsets, start)
    cut = np.zeros(len(data) + 1, np.int32)
    taken = np.isin(_line_keys(data, start, end, word_from, word_to), gone)
    cut[line_start[taken]] += 1
    np.add.at(cut, after[taken], -1)
    return data[np.cumsum(cut[:-1]) == 0].tobytes().decode()


def _profile_slice(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray | list]:
    rows = len(offsets) - 1
    doc, start, end = t.word_spans(data, offsets)
    in_word = np.zeros(len(data) + 1, np.int32)
    in_word[start] += 1
    in_word[end] -= 1  # a span never starts where another ends
    in_word = np.cumsum(in_word[:-1]) > 0
    word_at = np.searchsorted(doc, np.arange(rows + 1))
    words = t.span_hashes(data, start, end)
    # words in eight-word windows found twice or more
    n = max(len(words) - 7, 0)
    whole = doc[:n] == doc[7:] if n else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    windows = t.run_hashes(words, at, at + 8)
    twice, _ = repeated(doc[at], windows)
    cover = np.zeros(len(words) + 1, np.int32)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 8, -1)
    covered = np.cumsum(cover[:-1]) > 0
    line_start, line_end, _, line_doc, word_from, word_to = _lines(data, offsets, start)
    _, again = repeated(line_doc, t.span_hashes(data, line_start, line_end))
    keys = _line_keys(data, start, end, word_from, word_to)
    line_at = np.searchsorted(line_doc, np.arange(rows + 1))
    return {
        "n_words": np.diff(word_at),
        "word_chars": t.per_row(in_word & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": t.per_row(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(line_doc[again], minlength=rows),
        "n_repeat_words": np.bincount(doc[covered], minlength=rows),
        "text_key": t.span_hashes(data, offsets[:-1], offsets[1:], 7).view(np.int64),
        "line_keys": pa.ListArray.from_arrays(line_at.astype(np.int32), pa.array(keys)),
        "line_words": pa.ListArray.from_arrays(line_at.astype(np.int32), pa.array((word_to - word_from).astype(np.int32))),
    }


def profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Counts of each whole text, and the key and words of each of its lines that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in t.slices(batches, "text"):
            made = _profile_slice(data, offsets)
            names = ["doc_id", "host", "print", *made]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names[:3]), *(x if isinstance(x, pa.Array) else pa.array(x.astype(np.int64)) for x in made.values())], names=names)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("print"))
    return picked.mapInArrow(t.giving_back(run), _PROFILE)


def _frequent(docs: DataFrame, id_col: str, text_col: str, host_col: str, min_docs: int, max_share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The profiles of all rows, their lines, and the frequent lines (h, k, first_doc): a table."""
    base = written(profile(docs, id_col, text_col, host_col), "profile")
    texts = base.groupBy("host", "text_key").agg(F.min("doc_id").alias("doc_id"))
    limits = texts.groupBy("host").agg(F.greatest(F.lit(float(min_docs)), F.count("*") * max_share).alias("most"))
    lines = base.select("doc_id", "host", "print", "text_key", F.explode(F.arrays_zip("line_keys", "line_words")).alias("line"))
    lines = lines.select("doc_id", "host", "print", "text_key", F.col("line.line_keys").alias("key"), F.col("line.line_words").alias("words"))
    # one document stands for the copies of a text: count distinct texts, and rows only once per text and line
    counts = lines.groupBy("host", "key", "text_key").agg(F.min("doc_id").alias("doc_id")).groupBy("host", "key").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))
    frequent = counts.where(F.col("docs") > min_docs).join(limits.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).where("docs > most")
    return base, lines, written(frequent.select(F.col("host").alias("h"), F.col("key").alias("k"), "first_doc"), "frequent")


def _judged(base: DataFrame, lines: DataFrame, frequent: DataFrame, min_words_left: int, min_share_left: float) -> DataFrame:
    """The verdict of every row with its host and the print of its text, and the keys of the lines it loses."""
    taken = (
        lines.join(frequent, F.col("host").eqNullSafe(F.col("h")) & (F.col("key") == F.col("k")) & (F.col("doc_id") != F.col("first_doc")))
        .groupBy("doc_id", "host", "print")
        .agg(F.sum("words").cast("long").alias("taken"), F.collect_set("key").alias("gone"))
        .select(F.col("doc_id").alias("d"), F.col("host").alias("h"), F.col("print").alias("p"), "taken", "gone")
    )
    copies = base.where("doc_id IS NOT NULL").groupBy("doc_id", "host", "print").count().where("count > 1").select(F.col("doc_id").alias("d"), F.col("host").alias("h"), F.col("print").alias("p"), F.col("count").alias("rows"))
    judged = base.select("doc_id", "host", "print", *_COUNTS)
    for more in (taken, copies):
        same = (F.col("doc_id") == F.col("d")) & F.col("host").eqNullSafe(F.col("h")) & (F.col("print") == F.col("p"))
        judged = judged.join(more, same, "left").drop("d", "h", "p")
    removed = F.floor(F.coalesce(F.col("taken"), F.lit(0)) / F.coalesce(F.col("rows"), F.lit(1)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((left < min_words_left) | (left < min_share_left * F.col("n_words")))
    return judged.withColumn("n_removed_words", removed).select("doc_id", "host", "print", "gone", *_COUNTS, "n_removed_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))


def line_frequency_verdict(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = 50,
    max_share: float = 0.02,
    min_words_left: int = 20,
    min_share_left: float = 0.3,
) -> DataFrame:
    """One row per input row: the counts, words removed with frequent lines, and the verdict.

    A line of a host is frequent in more than ``max(min_docs, max_share * texts of the host)``
    distinct documents.  A document is depleted when frequent lines took words from it and fewer
    than ``min_words_left`` words or ``min_share_left`` of its words stay.
    """
    judged = _judged(*_frequent(docs, id_col, text_col, host_col, min_docs, max_share), min_words_left, min_share_left)
    return judged.drop("host", "print", "gone")


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency_verdict(table(spark, sf_dir, "documents"))


def keep_good(docs: DataFrame, min_docs: int = 50, max_share: float = 0.02) -> DataFrame:
    """The rows of ``docs`` that the verdict keeps, with the text (and ``n_chars``) that is left without frequent lines.

    The verdict belongs to an identifier (null or not), host and text.  With the frequent lines at
    hand it needs nothing else, so texts are read again and judged where they are, not shuffled;
    more frequent lines than ``BROADCAST_LINES`` meet the rows by a join.
    """
    base, lines, frequent = _frequent(docs.select("doc_id", "text", "source"), "doc_id", "text", "source", min_docs, max_share)
    if frequent.count() > BROADCAST_LINES:
        return _kept_by_join(docs, _judged(base, lines, frequent, MIN_WORDS_LEFT, MIN_SHARE_LEFT))
    doc, host, lost = unused(docs.columns, "_doc", "_host", "_lost")
    held: dict[str | None, list[tuple[int, int]]] = {}
    for r in frequent.where("first_doc IS NOT NULL").collect():
        held.setdefault(r.h, []).append((r.k, r.first_doc))
    shared = docs.sparkSession.sparkContext.broadcast({h: np.array(sorted(x), np.int64).T for h, x in held.items()})
    at, names = docs.columns.index("text"), [*docs.columns, lost]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in t.slices(batches, "text"):
            keep, gone = _verdicts(data, offsets, rows.column(doc).to_pylist(), rows.column(host).to_pylist(), shared.value)
            columns = [rows.column(c) for c in names[:-1]]
            changed = {k: x for k, x in gone.items() if keep[k]}
            if changed:
                texts = columns[at].to_pylist()
                for k, x in changed.items():
                    texts[k] = without_lines(texts[k], x)
                columns[at] = pa.array(texts, columns[at].type)
            marks = np.zeros(rows.num_rows, bool)
            marks[list(changed)] = True
            yield pa.RecordBatch.from_arrays([*columns, pa.array(marks)], names=names).filter(pa.array(keep))

    own = [F.col(f"`{c}`") for c in docs.columns]
    read = docs.select(*own, F.col("doc_id").cast("long").alias(doc), F.col("source").cast("string").alias(host))
    out = read.mapInArrow(t.giving_back(run), docs.select(*own, F.lit(False).alias(lost)).schema)
    return _recounted(out, docs, lost)


def _verdicts(data: np.ndarray, offsets: np.ndarray, ids: list, hosts: list, frequent: dict) -> tuple[np.ndarray, dict[int, list[int]]]:
    """Which rows are kept, and the keys of the frequent lines that a row loses."""
    made = _profile_slice(data, offsets)
    n, repeats = made["n_words"], made["n_repeat_words"]
    at, keys, words = np.asarray(made["line_keys"].offsets), np.asarray(made["line_keys"].values), np.asarray(made["line_words"].values)
    taken, gone = np.zeros(len(n), np.int64), {}
    for k in np.flatnonzero(np.diff(at)).tolist():
        if ids[k] is None or hosts[k] not in frequent:
            continue
        known, first = frequent[hosts[k]]
        mine = keys[at[k] : at[k + 1]]
        place = np.minimum(np.searchsorted(known, mine), len(known) - 1)
        hit = (known[place] == mine) & (first[place] != ids[k])
        if hit.any():
            taken[k], gone[k] = words[at[k] : at[k + 1]][hit].sum(), np.unique(mine[hit]).tolist()
    left = n - taken
    depleted = (taken > 0) & ((left < MIN_WORDS_LEFT) | (left < MIN_SHARE_LEFT * n))
    return ~((n < 20) | (100 * repeats > 30 * n)) & ~depleted, gone


def _recounted(out: DataFrame, docs: DataFrame, lost: str) -> DataFrame:
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(lost), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(lost)


def _kept_by_join(docs: DataFrame, judged: DataFrame) -> DataFrame:
    doc, host, print_, kept, gone, lost = unused(docs.columns, "_doc", "_host", "_print", "_kept", "_gone", "_lost")
    changed = judged.where("NOT kept OR gone IS NOT NULL").select(F.col("doc_id").alias(doc), F.col("host").alias(host), F.col("print").alias(print_), F.col("kept").alias(kept), F.col("gone").alias(gone))
    changed = written(changed.dropDuplicates([doc, host, print_]), "changed")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & F.col("source").cast("string").eqNullSafe(F.col(host)) & (F.xxhash64("text") == F.col(print_))
    at = docs.columns.index("text")
    names = [*docs.columns, lost]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, lines = [batch.column(k) for k in range(len(names))], batch.column(len(names))
            if lines.null_count < len(lines):
                texts = columns[at].to_pylist()
                for k in np.flatnonzero(np.asarray(lines.is_valid())):
                    texts[k] = without_lines(texts[k], lines[int(k)].as_py())
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    own = [F.col(f"`{c}`") for c in docs.columns]
    left = docs.join(changed, same, "left").where(F.coalesce(kept, F.lit(True))).select(*own, F.col(gone).isNotNull().alias(lost), gone)
    out = left.mapInArrow(t.giving_back(run), left.select(*own, lost).schema)
    return _recounted(out, docs, lost)


ORACLE = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM d),
    l AS (SELECT doc_id, host, text, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS lw
        FROM (SELECT doc_id, host, text, unnest(ls) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
    dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY 1),
    win AS (SELECT doc_id, i, CASE WHEN i + 8 <= n THEN array_to_string(ws[i + 1 : i + 8], ' ') END AS key FROM (SELECT doc_id, ws, len(ws) AS n, unnest(range(len(ws))) AS i FROM w)),
    twice AS (SELECT doc_id, i, (key IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, key) > 1)::INT AS f FROM win),
    rep AS (SELECT doc_id, sum(c) AS n_repeat_words FROM (SELECT doc_id, max(f) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c FROM twice) GROUP BY 1),
    texts AS (SELECT host, text, min(doc_id) AS id FROM d GROUP BY 1, 2),
    lim AS (SELECT host, greatest(50.0, 0.02 * count(*)) AS most FROM texts GROUP BY 1),
    held AS (SELECT l.host, array_to_string(lw, ' ') AS key, count(DISTINCT t.id) AS docs, min(t.id) AS first_id FROM l JOIN texts t ON l.host IS NOT DISTINCT FROM t.host AND l.text = t.text GROUP BY 1, 2),
    freq AS (SELECT held.* FROM held JOIN lim ON held.host IS NOT DISTINCT FROM lim.host WHERE docs > most),
    taken AS (SELECT doc_id, sum(len(lw)) AS n FROM l JOIN freq f ON l.host IS NOT DISTINCT FROM f.host AND array_to_string(lw, ' ') = key AND doc_id != first_id GROUP BY 1),
    base AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols FROM w),
    c AS (SELECT b.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        coalesce(taken.n, 0)::BIGINT AS n_removed_words FROM base b LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN taken USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < 20 OR n_words - n_removed_words < 0.3 * n_words)) AS kept FROM c
"""
