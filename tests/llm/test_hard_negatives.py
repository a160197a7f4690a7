import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievestone.llm import hard_negatives as h

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, score string, id string"


def brute(rows, every=50, scale=256, positives=5, negatives=3):
    """Rows (id, vector, label) that take part, one by one, in Python's integers."""
    good = [(i, [math.floor(scale * x) for x in v], c) for i, v, c in rows if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda i: math.inf if i is None else i
    out = []
    for a, v, c in good:
        if a is None or a % every:
            continue
        near = sorted(((-sum(x * y for x, y in zip(v, w)), last(i), i, d) for i, w, d in good if i != a), key=lambda r: r[:2])
        for p, _, i, d in [r for r in near if r[3] == c][:positives]:
            fit = [(n, j) for n, _, j, e in near if e != c and 50 * -p <= 100 * -n <= 95 * -p]
            out += [(a, i, k, j, -p, -n) for k, (n, j) in enumerate(fit[:negatives], 1)]
    return sorted(out, key=str)


def mined(df, **more):
    return sorted(map(tuple, h.hard_negatives(df, F.col("id") % 50 == 0, **more).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 12))
    made = [(i, (centres[i % 4] + rng.normal(size=12) * (0.3 + i % 3)).round(2).tolist(), int(rng.integers(3))) for i in range(900)]
    made += [(i, made[100][1], i % 3) for i in range(900, 1200)]  # copies: ties of hundreds
    made += [made[50], made[50], made[150], (None, made[3][1], 1), (None, made[3][1], 2)]
    return made


def test_against_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA).repartition(7)
    got = mined(df)
    assert got == brute(rows) and len(got) > 100


def test_many_waves_and_small_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(h, "WAVE", 1000)
    monkeypatch.setattr(h, "ANCHOR_BYTES", 400)
    df = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA).repartition(3)
    assert mined(df) == brute(rows)


def test_rows_that_take_no_part_and_uneven_vectors(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(0, None, 1), (50, [nan, 1.0], 1), (100, [inf, 1.0], 1), (150, [1.0, None], 1), (200, [1.0, 1.0], None)]
    good = [(250, [1.0, 2.0, 3.0], 1), (300, [2.0, 1.0], 1), (1, [2.0], 1), (2, [1.5, 0.1, 0.1], 2), (3, [], 2), (4, [1.9, 0.2], 2), (350, [], 2), (5, [0.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, "", "", "") for r in bad + good], SCHEMA)
    assert mined(df) == brute(bad + good)
    assert {r[0] for r in mined(df)} <= {250, 300, 350}


def test_beyond_float64(spark):
    rng = np.random.default_rng(5)
    big = [(i, (rng.integers(1, 2**21, 4) + 0.25).tolist(), i % 2) for i in range(120)]
    df = spark.createDataFrame([(*r, "", "", "") for r in big], SCHEMA)
    got = mined(df)
    assert got == brute(big) and max(r[4] for r in got) > 2**55
    huge = [(0, [1e18, 1.0], 0), (1, [1e18, 2.0], 0), (2, [7e17, 1.0], 1)]
    assert {r[4] for r in mined(spark.createDataFrame([(*r, "", "", "") for r in huge], SCHEMA))} <= {2**63 - 1}


def test_few_and_none(spark):
    assert h.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(0, [1.0], 0, "", "", "")], SCHEMA)
    assert h.hard_negatives(one).count() == 0
    assert h.op11_blocked_gemm(spark, "/root/testdata/sf0.01").columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_query(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    rows = [(r.vec_id, list(map(float, r.embedding)), (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in table]
    assert sorted(map(tuple, h.op11_blocked_gemm(spark, "/root/testdata/sf0.01").collect()), key=str) == brute(rows)
