"""Token ids of whole texts by a public tokenizer, through a cache of its results for words.

A text is cut only before single spaces and single newlines that stand between two characters
that are not white space.  The byte-level pattern never joins characters across such a place and
looks no further than the next one, so the pieces' ids in order are the whole text's ids
(``tests/llm/test_tokens.py`` compares them).  Everything else goes to the tokenizer in one piece.
The vocabulary's control strings get their own ids where a text holds them, as the tokenizer does by
default; they hold no white space, so no cut falls inside one, and where one could, texts are not cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: Pieces kept in a worker's cache before it is emptied.
CACHE_PIECES = 1_000_000
_CUT = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)")
_encoders: dict[str, "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: Whether an added token may reach over white space, so that texts are never cut.
        self.uncut = any(x.lstrip or x.rstrip or any(c.isspace() for c in x.content) for x in added)
        self.cache: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.last_id = max(vocabulary.values())
        self.id_bytes = np.zeros(self.last_id + 1, np.int64)
        for token, k in vocabulary.items():
            self.id_bytes[k] = len(token)  # byte-level tokens have one character for each byte

    def _fill(self, pieces: Iterable[str]) -> None:
        missing = [p for p in pieces if p not in self.cache]
        joins = [not self.uncut and len(p) > 1 and p[0] in " \n" and not p[1].isspace() and not p[-1].isspace() for p in missing]
        alone = [p for p, j in zip(missing, joins) if not j]
        for k in range(0, len(alone), 1024):
            part = alone[k : k + 1024]
            for piece, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.cache[piece] = np.array(e.ids, "<u4").tobytes()
        self._fill_joined([p for p, j in zip(missing, joins) if j])

    def _fill_joined(self, pieces: list[str]) -> None:
        """Encodes pieces one behind another, since texts may be cut before each, and parts their ids by bytes."""
        for k in range(0, len(pieces), 2048):
            part = pieces[k : k + 2048]
            (e,) = self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            ends = np.cumsum([len(p.encode()) for p in part])
            to = np.searchsorted(np.cumsum(self.id_bytes[ids]), ends, "left") + 1
            data, at = ids.tobytes(), 0
            for piece, end in zip(part, (4 * to).tolist()):
                self.cache[piece] = data[at:end]
                at = end

    def encode(self, texts: list[str]) -> list[bytes]:
        cut, distinct = [], set()
        for text in texts:
            pieces = [text] if self.uncut else _CUT.split(text) if self._odd(text) else self._words(text)
            cut.append(pieces)
            distinct.update(pieces)
        distinct.discard("")
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        self._fill(distinct)
        self.cache[""] = b""
        get = self.cache.__getitem__
        return [b"".join(map(get, pieces)) for pieces in cut]

    @staticmethod
    def _odd(text: str) -> bool:
        """Whether there is white space other than single spaces and newlines inside."""
        return text.replace("\n", " ") != " ".join(text.split())

    @staticmethod
    def _words(text: str) -> list[str]:
        parts = text.replace("\n", " \n").split(" ")
        return parts[:1] + [p if p[0] == "\n" else " " + p for p in parts[1:]]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int | None, text_col: str = "text", bytes_at_once: int = 1 << 22) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """(rows, ids of each row's whole text with the end id) for runs of whole rows."""
    enc, end = encoder(path), b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    for batch in batches:
        texts = batch.column(text_col)
        sizes = np.cumsum(np.asarray(pa.compute.binary_length(texts).fill_null(0)), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + bytes_at_once, "right")))
            rows = batch.slice(at, to - at)
            yield rows, [ids + end for ids in enc.encode([x or "" for x in rows.column(text_col).to_pylist()])]
            at = to
