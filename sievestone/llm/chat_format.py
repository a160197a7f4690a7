"""Chat formatting with typed content parts.

Each turn becomes one segment of marked text; a conversation's text is its segments in order of
turn (ties: by the segment itself).  A visitor flattens the parts of a turn: text is escaped, any
other part becomes a placeholder that carries its kind, its place in the turn and the number of
tokens it expands to, and its reference is recorded as an attachment.

A user's segment is ``[INST] text [/INST]``, an assistant's `` text </s>``, any other role's
``[ROLE=role] text [/ROLE]``.  Inside texts and roles ``\\``, ``[`` and ``<`` are preceded by
``\\``, so no control string can stand there, and taking these away again gives the text back.

Defined cases: a null text is empty; a null role is the empty role; a null list of parts, or a null
part, is nothing; repeated rows are turns of their own; an empty table gives no rows; further
columns are ignored.  Memory is bounded by a batch of turns, however long a conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import table, written

#: Tokens that a part without a count of its own expands to.
TOKENS = {"image": 576, "audio": 750, "document": 1024}
PROBE = "</s>[INST] ok [/INST]"
_ESCAPED = re.compile(r"\\(.)", re.S)
_SEGMENT = re.compile(r"(?:\[INST\] (?P<user>.*) \[/INST\]| (?P<assistant>.*) </s>|\[ROLE=(?P<role>(?:\\.|[^\\\]])*)\] (?P<other>.*) \[/ROLE\])", re.S)
_PLACE = re.compile(r"((?:\\.|[^\\<])+)|<\|(\w+):(\d+):(\d+)\|>", re.S)


def escape(text: Column) -> Column:
    for c in "\\[<":
        text = F.replace(text, F.lit(c), F.lit("\\" + c))
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def visit(parts: Column) -> tuple[Column, Column, Column]:
    """Flattened text, attachments (kind, place, uri, tokens) and expanded tokens of a list of parts."""
    tokens = lambda p: F.coalesce(p["tokens"], *(F.when(p["type"] == k, n) for k, n in TOKENS.items()), F.lit(0)).cast("int")
    shown = lambda p, k: F.concat(F.lit("<|"), p["type"], F.lit(":"), k.cast("string"), F.lit(":"), tokens(p).cast("string"), F.lit("|>"))
    text = F.transform(parts, lambda p, k: F.when(p["type"] == "text", F.coalesce(escape(p["text"]), F.lit(""))).otherwise(F.coalesce(shown(p, k), F.lit(""))))
    placed = F.transform(parts, lambda p, k: F.struct(p["type"].alias("type"), k.alias("place"), p["uri"].alias("uri"), tokens(p).alias("tokens")))
    attached = F.filter(placed, lambda p: p["type"] != "text")
    return F.coalesce(F.array_join(text, ""), F.lit("")), F.coalesce(attached, F.array().cast("array<struct<type:string,place:int,uri:string,tokens:int>>")), F.aggregate(F.coalesce(F.transform(attached, lambda p: p["tokens"]), F.array().cast("array<int>")), F.lit(0), lambda a, b: a + b)


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """One segment per turn: conv_id, turn, segment, loss_from, loss_to, attachments, attachment_tokens.

    ``parts_col``: array<struct<type:string,text:string,uri:string,tokens:int>>; without it a turn
    is one text part.  Code points loss_from (0-based) to loss_to of the segment are under the loss
    mask: an assistant's text.  No shuffle: a segment depends on its turn only.
    """
    parts = F.col(parts_col) if parts_col else F.array(F.struct(F.lit("text").alias("type"), F.col(text_col).alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("int").alias("tokens")))
    role = F.coalesce(F.col(role_col), F.lit(""))
    body, attached, tokens = visit(parts)
    head = F.when(role == "user", "[INST] ").when(role == "assistant", " ").otherwise(F.concat(F.lit("[ROLE="), F.replace(escape(role), F.lit("]"), F.lit("\\]")), F.lit("] ")))
    tail = F.when(role == "user", " [/INST]").when(role == "assistant", " </s>").otherwise(" [/ROLE]")
    made = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("_role"), head.alias("_head"), body.alias("_body"), tail.alias("_tail"), attached.alias("attachments"), tokens.alias("attachment_tokens"))
    begins, masked = F.length("_head"), F.col("_role") == "assistant"
    return made.select(
        "conv_id", "turn", F.concat("_head", "_body", "_tail").alias("segment"),
        F.when(masked, begins).otherwise(0).alias("loss_from"), F.when(masked, begins + F.length("_body")).otherwise(0).alias("loss_to"),
        "attachments", "attachment_tokens",
    )


class Turn(NamedTuple):
    role: str
    text: str
    parts: list[tuple[str, int, int]]


def parse_segment(segment: str) -> Turn:
    """Role, unescaped text and (kind, place, tokens) of placeholders."""
    m = _SEGMENT.fullmatch(segment)
    if m is None:
        raise ValueError(f"not a segment: {segment[:80]!r}")
    kind = m.lastgroup if m.lastgroup != "other" else "role"
    body = m["other"] if kind == "role" else m[kind]
    role = unescape(m["role"]) if kind == "role" else kind
    text, parts = plain(body)
    return Turn(role, text, parts)


def plain(body: str) -> tuple[str, list[tuple[str, int, int]]]:
    text, parts = [], []
    for m in _PLACE.finditer(body):
        if m[2]:
            parts.append((m[2], int(m[3]), int(m[4])))
        else:
            text.append(unescape(m[1]))
    return "".join(text), parts


def digests(segments: DataFrame) -> DataFrame:
    """Reads segments back: one row per conversation, hashed turn by turn in sorted partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turns, chars, shown = None, 0, 0, 0
        every = loss = None
        out: list[tuple] = []
        for batch in batches:
            for conv, segment, a, b in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if every is None or conv != now:
                    if every is not None:
                        out.append((now, turns, every.hexdigest(), chars, loss.hexdigest(), shown))
                    now, turns, chars, shown, every, loss = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                turn = parse_segment(segment)
                every.update(f"{turn.role}\n{turn.text}\n".encode())
                masked, _ = plain(segment[a:b])
                loss.update(masked.encode())
                turns, chars, shown = turns + 1, chars + len(masked), shown + len(segment)
            if len(out) >= 1000:
                yield _rows(out)
                out = []
        if every is not None:
            out.append((now, turns, every.hexdigest(), chars, loss.hexdigest(), shown))
        if out:
            yield _rows(out)

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return ordered.select("conv_id", "segment", "loss_from", "loss_to").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op10_typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return digests(written(format_turns(turns.unionByName(probe)), "segments"))


ORACLE = r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    shown AS (SELECT *, replace(replace(replace(text, '\', '\\'), '[', '\['), '<', '\<') AS body FROM turns),
    segments AS (SELECT *, CASE role WHEN 'user' THEN '[INST] ' || body || ' [/INST]' WHEN 'assistant' THEN ' ' || body || ' </s>'
        ELSE '[ROLE=' || replace(replace(replace(replace(role, '\', '\\'), '[', '\['), '<', '\<'), ']', '\]') || '] ' || body || ' [/ROLE]' END AS segment FROM shown)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, segment)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, segment) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(segment)) AS BIGINT) AS formatted_chars
FROM segments GROUP BY conv_id
"""
