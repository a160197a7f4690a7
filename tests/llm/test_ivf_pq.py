import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sievestone.llm import ivf_pq
from sievestone.llm.ivf_pq import op7_ivf_pq, search

SCHEMA = "vec_id long, embedding array<float>, label int, v string, list string"


def exact(rows, queries, k=20):
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids], np.float64)
    out = {}
    for q in queries:
        s = x @ np.array(rows[q], np.float64)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), s[j]) for j in order]
    return out


def compare(got, want):
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == set(want)
    hits = 0
    for q, mine in found.items():
        assert len(mine) == len(want[q]) and len({i for i, _ in mine}) == len(mine)
        assert mine == sorted(mine, key=lambda x: (-x[1], x[0]))
        hits += len({i for i, _ in mine} & {i for i, _ in want[q]})
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("where", ["sf0.01", "sf0.1"])
def test_recall(spark, where):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"/root/testdata/{where}/embeddings.parquet").collect()}
    got = op7_ivf_pq(spark, f"/root/testdata/{where}").collect()
    want = exact(rows, [i for i in rows if i % 20 == 0])
    assert compare(got, want) >= 0.95
    scores = {(q, i): s for q, x in want.items() for i, s in x}
    assert all(abs(r.score - scores[r.query_id, r.vec_id]) < 1e-9 for r in got if (r.query_id, r.vec_id) in scores)


def test_odd_vectors_copies_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = {i: rng.normal(size=8).astype(np.float32).tolist() for i in range(300)}
    rows |= {i: rows[7] for i in range(300, 900)}
    bad = [(1000, None), (1001, [0.0] * 8), (1020, [float("nan")] * 8), (1040, [1.0] * 7 + [None]), (1060, [float("inf")] + [1.0] * 7), (1080, [1.0] * 5), (1100, []), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, x, 0, "", "") for i, x in [*rows.items(), *bad]] + [(7, rows[7], 0, "", "")], SCHEMA).repartition(5)
    got = search(df, df.where("vec_id % 20 = 0")).collect()
    assert compare(got, exact(rows, [i for i in rows if i % 20 == 0])) >= 0.99


def test_few_and_none(spark):
    assert search(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(0, [1.0, 0.0], 0, "", ""), (1, [0.5, 0.5], 0, "", ""), (2, [0.5, 0.5], 0, "", "")], SCHEMA)
    got = search(df, df.where("vec_id % 20 = 0")).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    one = df.where("vec_id = 0")
    assert search(one, one).count() == 0


def test_clusters_with_many_copies(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 32))
    own = rng.integers(0, 60, 110_000)
    x = (centres[own] + 0.5 * rng.normal(size=(len(own), 32))).astype(np.float32)
    x[1000:21_000] = x[7]
    x = (x / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]).astype(np.float32)
    path = str(tmp_path / "vectors.parquet")
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 32).cast(pa.list_(pa.float32()))}), path)
    df = spark.read.parquet(path)
    asked = [7, 20_999, *(int(i) for i in np.flatnonzero(own == own[7])[-40:]), *range(30_000, 110_000, 800)]
    got = search(df, df.where(F.col("vec_id").isin(asked))).collect()
    scores = x[asked].astype(np.float64) @ x.T.astype(np.float64)
    want = {}
    for q, s in zip(asked, scores):
        s[q] = -np.inf
        best = np.flatnonzero(s >= np.partition(s, -20)[-20] - 1e-12)
        want[q] = [(int(j), s[j]) for j in sorted(best, key=lambda j: (-round(s[j], 12), j))[:20]]
    assert compare(got, want) >= 0.95
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 20_999] == [7, *range(1000, 1019)]


def test_groups(spark, monkeypatch):
    monkeypatch.setattr(ivf_pq, "GROUP", 700)
    rng = np.random.default_rng(3)
    rows = {i: rng.normal(size=8).astype(np.float32).tolist() for i in range(3000)}
    df = spark.createDataFrame([(i, x, 0, "", "") for i, x in rows.items()], SCHEMA)
    got = search(df, df.where("vec_id % 50 = 0")).collect()
    assert compare(got, exact(rows, [i for i in rows if i % 50 == 0])) >= 0.95


@pytest.mark.parametrize("kind", ["one mean", "near copies", "lengths"])
def test_rows_of_other_shapes(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 32))
    if kind == "one mean":
        x = 0.1 * x + rng.normal(size=32)
    elif kind == "near copies":
        x = np.repeat(rng.normal(size=(4, 32)), 1000, 0) + 1e-4 * x
        x /= np.linalg.norm(x, axis=1)[:, None]
    else:
        x *= np.exp(rng.normal(size=(4000, 1)))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = search(df, df.where("vec_id % 100 = 0")).collect()
    assert compare(got, exact(dict(enumerate(x)), range(0, 4000, 100))) >= 0.999
