"""Sorted-string-table shards of token ids.

A shard holds documents in ascending order of identifier:

* data blocks: entries of (length of the prefix shared with the key before, rest of the key,
  value), the first key of a block in full; the block is compressed and carries a crc32;
* a sparse index: the last key, place and length of each block;
* a Bloom filter over the keys;
* a footer of fixed length: places of index and filter, counts, format name.

Keys are big-endian unsigned 64-bit identifiers with the sign bit flipped, so that bytes sort as
numbers do, followed by a 32-bit ordinal that tells rows of one identifier apart.  Values are
token ids, in 2 bytes each where all ids of the shard's vocabulary fit.

Defined cases: a null or empty text has no ids but the end id; a null identifier sorts first, as
the smallest long; repeated identifiers are kept, in any order among themselves; an empty table
gives no shard; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text as t
from ._store import new_folder, table, written
from ._tokens import default_path, encoded, encoder

MAGIC = b"SSTTOK01"
_FOOTER = struct.Struct("<QIQIQQB7x8s")
#: Bytes of uncompressed values in a block.
BLOCK_BYTES = 1 << 16
BLOOM_BITS_PER_KEY = 10


def key_of(doc_id: int | None, ordinal: int = 0) -> bytes:
    return struct.pack(">QI", (-(1 << 63) if doc_id is None else doc_id) + (1 << 63), ordinal)


def id_of(key: bytes) -> int:
    return struct.unpack(">QI", key)[0] - (1 << 63)


def _bloom_places(ids: np.ndarray, bits: int) -> np.ndarray:
    """Seven places for each key, by double hashing."""
    h = t.mix(ids.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step = t.mix(h) | np.uint64(1)
    return (h[:, None] + step[:, None] * np.arange(7, dtype=np.uint64)) % np.uint64(bits)


class ShardWriter:
    """Writes entries, which must come in ascending order of key, holding one block in memory."""

    def __init__(self, sink, width: int = 4):
        self.sink, self.width, self.at = sink, width, 0
        self.block, self.before, self.ordinal = bytearray(), b"", 0
        self.index: list[tuple[bytes, int, int]] = []
        self.ids: list[int] = []
        self.values = 0
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """``ids``: little-endian unsigned 32-bit integers."""
        key = key_of(doc_id)
        self.ordinal = self.ordinal + 1 if self.ids and id_of(key) == self.ids[-1] else 0
        key = key_of(doc_id, self.ordinal)
        value = np.frombuffer(ids, "<u4").astype("<u2").tobytes() if self.width == 2 else ids
        shared = next((k for k in range(len(self.before)) if key[k] != self.before[k]), len(self.before)) if self.block else 0
        self.block += struct.pack("<BBI", shared, len(key) - shared, len(value)) + key[shared:] + value
        self.before = key
        self.ids.append(id_of(key))
        self.values += len(ids) // 4
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _put(self, data: bytes) -> tuple[int, int]:
        self.sink.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _end_block(self) -> None:
        if self.block:
            packed = self.pack.compress(bytes(self.block))
            self.index.append((self.before, *self._put(packed + struct.pack("<I", zlib.crc32(packed)))))
            self.block.clear()

    def close(self) -> None:
        self._end_block()
        index = self._put(b"".join(struct.pack("<12sQI", *x) for x in self.index))
        bits = max(64, BLOOM_BITS_PER_KEY * len(self.ids))
        bloom = np.zeros((bits + 7) // 8 * 8, bool)
        if self.ids:
            bloom[_bloom_places(np.array(self.ids, np.int64), bits).ravel().astype(np.int64)] = True
        bloom = struct.pack("<Q", bits) + np.packbits(bloom).tobytes()
        self._put(bloom)
        self._put(_FOOTER.pack(*index, index[0] + index[1], len(bloom), len(self.ids), self.values, self.width, MAGIC))


class Shard:
    """Reads a shard: all entries in order, or one by binary search of the sparse index."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        source.seek(source.tell() - _FOOTER.size)
        index_at, index_len, bloom_at, bloom_len, self.docs, self.values, self.width, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        source.seek(index_at)
        self.index = list(struct.iter_unpack("<12sQI", source.read(index_len)))
        source.seek(bloom_at)
        self.bloom = source.read(bloom_len)

    def block(self, place: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, size = self.index[place]
        self.source.seek(at)
        data = self.source.read(size)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {place} is damaged")
        data, at, key = zstandard.ZstdDecompressor().decompress(data[:-4]), 0, b""
        while at < len(data):
            shared, rest, size = struct.unpack_from("<BBI", data, at)
            at += 6
            key = key[:shared] + data[at : at + rest]
            value = data[at + rest : at + rest + size]
            at += rest + size
            yield key, np.frombuffer(value, "<u2").astype("<u4").tobytes() if self.width == 2 else value

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for place in range(len(self.index)):
            yield from self.block(place)

    def may_hold(self, doc_id: int) -> bool:
        bits = struct.unpack_from("<Q", self.bloom)[0]
        flags = np.frombuffer(self.bloom, np.uint8, offset=8)
        places = _bloom_places(np.array([doc_id], np.int64), bits)[0]
        return all(flags[int(p) >> 3] >> (7 - (int(p) & 7)) & 1 for p in places)

    def lookup(self, doc_id: int) -> bytes | None:
        """The ids of a document, or None."""
        if not self.index or not self.may_hold(doc_id):
            return None
        place = bisect_left(self.index, key_of(doc_id), key=lambda x: x[0])
        if place < len(self.index):
            for key, value in self.block(place):
                if id_of(key) == doc_id:
                    return value
        return None


def open_shard(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def write_sstables(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Encodes every text and writes one shard for each range of identifiers.

    Returns one row per shard: shard (in order of identifiers), uri, docs, tokens.  A task writes
    under a name of its own attempt, so a lost or doubled attempt leaves a file that no row names.
    """
    path = tokenizer or default_path()
    fs_from = folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c = TaskContext.get()
        store, place = fs.FileSystem.from_uri(fs_from)
        store.create_dir(place, recursive=True)
        name = f"shard-{c.partitionId():06d}-{c.taskAttemptId()}.sst"
        writer = sink = None
        for rows, ids in encoded(batches, path, end_id):
            if writer is None:
                sink = store.open_output_stream(f"{place}/{name}")
                writer = ShardWriter(sink, width=2 if max(encoder(path).last_id, end_id or 0) < 1 << 16 else 4)
            for doc_id, value in zip(rows.column("doc_id").to_pylist(), ids):
                writer.add(doc_id, value)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"shard": [c.partitionId()], "uri": [f"{fs_from}/{name}"], "docs": [len(writer.ids)], "tokens": [writer.values]})

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    return written(docs.mapInArrow(run, "shard long, uri string, docs long, tokens long"), "manifest")


def read_sstables(manifest: DataFrame) -> DataFrame:
    """The documents of the shards that the manifest names: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it.  The window runs over one short row per
    shard, not over documents.
    """
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = max(1, manifest.count())
    placed = manifest.withColumn("base", before).repartitionByRange(n, "shard").select("uri", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist()):
                out: list[tuple[int, int, int, int]] = []
                with open_shard(uri) as source:
                    for key, value in Shard(source):
                        out.append((id_of(key), start, len(value) // 4, zlib.crc32(value)))
                        start += len(value) // 4
                        if len(out) == 10_000:
                            yield _rows(out)
                            out = []
                if out:
                    yield _rows(out)

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op1_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return read_sstables(write_sstables(docs, new_folder(spark, "sstables")))
