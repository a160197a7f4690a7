import hashlib
import random

import numpy as np

from sievestone.llm import suffix_dedup
from sievestone.llm.suffix_dedup import keep_unrepeated, multikey_runs, op3_suffix_array, remove_repeats

SCHEMA = "doc_id long, text string, source string, d string, spans string, n_chars long"


def brute(rows, span=50):
    least = {}
    for i, text in rows:
        raw = (text or "").encode()
        for k in range(len(raw) - span + 1):
            s = raw[k : k + span]
            least[s] = min(i, least.get(s, i))
    out = set()
    for i, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - span + 1):
            if least[raw[k : k + span]] < i:
                gone[k : k + span] = True
        runs = int(np.sum(gone & ~np.concatenate([[False], gone[:-1]]))) if len(raw) else 0
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.add((i, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(df):
    return {tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rng.choice([8, 12, 14, 30, 60])) for _ in range(12)] + ["ab" * 60, "x" * 130, "é" * 40]
    rows = []
    for i in range(150):
        body = [text(rng.choice([0, 3, 20, 80]))]
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            p = rng.choice(shared)
            a = rng.randint(0, 10)
            body += [p[a : len(p) - rng.randint(0, 10)], text(rng.randint(0, 12))]
        rows.append((rng.randint(0, 10**6) * 200 + i, "".join(body)))
    rows += [(10**9 + k, rng.choice(rows)[1]) for k in range(20)]
    return rows


def test_against_brute_force(spark, monkeypatch):
    for seed, bucket in ((1, 8 << 20), (2, 3000), (3, 900)):
        monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
        rows = corpus(seed)
        df = spark.createDataFrame([(i, x, "", "", "", 0) for i, x in rows], SCHEMA).repartition(7)
        assert rows_of(remove_repeats(df)) == brute(rows)


def test_edge_cases(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    long = " ".join(f"word{k % 977}x{k}" for k in range(60_000))
    rows = [(9, None), (8, ""), (1, "a" * 49), (2, "a" * 49), (3, "b" * 50), (4, "b" * 51), (5, "c" * 500), (6, long), (7, long[1000:5000]), (-5, long[300_000:])]
    df = spark.createDataFrame([(i, x, "", "", "", 0) for i, x in rows], SCHEMA)
    assert rows_of(remove_repeats(df)) == brute(rows)
    twice = spark.createDataFrame([(1, "z" * 60, "", "", "", 0)] * 2 + [(None, "z" * 60, "", "", "", 0)], SCHEMA)
    assert sorted(r.n_removed for r in remove_repeats(twice).collect()) == [0, 60, 60]


def test_on_the_small_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert rows_of(op3_suffix_array(spark, "/root/testdata/sf0.001")) == brute(rows)


def test_stage(spark):
    text = "This passage is repeated and has far more than fifty bytes of text."
    df = spark.createDataFrame([(1, text, "s", "", "", 0), (2, "own " + text, "s", "", "", 0), (3, text, "s", "", "", 0), (4, None, "s", "", "", 7)], SCHEMA)
    out = {r.doc_id: (r.text, r.n_chars) for r in keep_unrepeated(df).collect()}
    assert out == {1: (text, 0), 2: ("own ", 4), 4: (None, 7)}


def test_multikey_order():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 5000).astype(np.uint8)
    data[1000:1400] = data[3000:3400]
    at = rng.permutation(4900)[:3000]
    group = at % 3
    order, new = multikey_runs(data, at, group, 50)
    keys = [(group[k], bytes(data[at[k] : at[k] + 50])) for k in order]
    assert keys == sorted(keys)
    assert new.tolist() == [k == 0 or keys[k] != keys[k - 1] for k in range(len(keys))]
