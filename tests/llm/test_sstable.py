import io
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from sievestone.llm._store import new_folder
from sievestone.llm._tokens import default_path
from sievestone.llm.sstable import Shard, ShardWriter, id_of, op1_sstable, open_shard, read_sstables, write_sstables

SCHEMA = "doc_id long, text string, start string, n_tokens string"


def expected(rows):
    whole, out, start = Tokenizer.from_file(default_path()), [], 0
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        out.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = [tuple(r) for r in op1_sstable(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()]
    assert got == expected(rows)


def test_nulls_long_texts_and_clashing_columns(spark):
    rows = [(5, None), (-3, ""), (9, "x y " * 100_000), (2**62, "\n\n"), (0, "é")]
    df = spark.createDataFrame([(i, x, "a", "b") for i, x in rows], SCHEMA).repartition(3)
    manifest = write_sstables(df, new_folder(spark, "t"), shards=3)
    assert sorted(tuple(r) for r in read_sstables(manifest).collect()) == expected(rows)
    found = {}
    for r in manifest.collect():
        with open_shard(r.uri) as source:
            shard = Shard(source)
            found |= {i: shard.lookup(i) for i, _ in rows if shard.lookup(i) is not None}
            assert shard.lookup(77) is None
    assert set(found) == {i for i, _ in rows}


def test_vocabulary_beyond_two_bytes(spark, tmp_path):
    wide = Tokenizer.from_file(default_path())
    wide.add_tokens([f"<|x{k}|>" for k in range(20_000)])
    wide.save(str(tmp_path / "wide.json"))
    df = spark.createDataFrame([(1, "a <|x19999|> b <|endoftext|>", "", "")], SCHEMA)
    manifest = write_sstables(df, new_folder(spark, "t"), tokenizer=str(tmp_path / "wide.json"))
    with open_shard(manifest.first().uri) as source:
        ids = np.frombuffer(Shard(source).lookup(1), "<u4").tolist()
    assert ids == [*wide.encode("a <|x19999|> b <|endoftext|>", add_special_tokens=False).ids, 0] and max(ids) > 65_535


def test_empty_and_repeated(spark):
    assert read_sstables(write_sstables(spark.createDataFrame([], SCHEMA), new_folder(spark, "t"))).count() == 0
    df = spark.createDataFrame([(1, "a", "", ""), (1, "a", "", ""), (None, "b", "", "")], SCHEMA)
    out = read_sstables(write_sstables(df, new_folder(spark, "t"))).orderBy("start").collect()
    assert [r.doc_id for r in out] == [-(2**63), 1, 1]


def test_blocks_index_filter_and_damage():
    sink = io.BytesIO()
    writer = ShardWriter(sink, width=4)
    for k in range(0, 6000, 2):
        writer.add(k, np.arange(k, k + k % 50, dtype="<u4").tobytes())
    writer.close()
    shard = Shard(io.BytesIO(sink.getvalue()))
    assert len(shard.index) > 3 and shard.docs == 3000
    assert [id_of(k) for k, _ in shard] == list(range(0, 6000, 2))
    assert all(np.frombuffer(shard.lookup(k), "<u4").tolist() == list(range(k, k + k % 50)) for k in range(0, 6000, 74))
    assert not any(shard.lookup(k) for k in range(1, 6000, 2))
    assert sum(shard.may_hold(k) for k in range(1, 6000, 2)) < 90
    bad = bytearray(sink.getvalue())
    bad[20] ^= 1
    with pytest.raises(ValueError):
        list(Shard(io.BytesIO(bytes(bad))))
