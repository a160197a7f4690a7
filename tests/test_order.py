import numpy as np
import pytest
from pyspark.sql import functions as F

from sievestone.operators import order, reporting, statistics

SHARES = (0.05, 0.25, 0.5, 0.75, 0.95)


@pytest.mark.parametrize("rate, per", [(1, 1), (2, 3), (4096, 256)])
def test_quantiles_modes_and_ordinals(spark, rate, per):
    rng = np.random.default_rng(rate)
    groups = {"a": rng.normal(size=300).round(1), "b": np.full(50, 7.0), "c": rng.integers(0, 4, 200).astype(float), "d": np.array([2.5]), None: rng.normal(size=40)}
    rows = [(k, float(v), j) for k, vs in groups.items() for j, v in enumerate(vs)] + [("e", None, 0), ("a", None, 999)]
    df = spark.createDataFrame(rows, "run_id string, value double, label long").repartition(5)
    counted = order.values(df, ["run_id"], "value")
    got = {r.run_id: r.q for r in order.quantiles(counted, ["run_id"], "value", SHARES, rate, per).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k] == pytest.approx(np.quantile(vs, SHARES))
    for r in order.modes(counted, ["run_id"], "value").collect():
        v, n = np.unique(groups[r.run_id], return_counts=True)
        assert r.mode == v[n.argmax()]
    placed = order.ordinals(df, ["run_id"], "label", "pos", rate, per)
    assert placed.columns == ["run_id", "value", "label", "pos"]
    for k in groups:
        mine = sorted((r.pos, r.label) for r in placed.collect() if r.run_id == k)
        assert [p for p, _ in mine] == list(range(len(mine))) and [x for _, x in mine] == sorted(x for _, x in mine)


def test_a_run_of_five_million_rows_is_ranked_in_blocks(spark):
    n = 5_000_000
    value = F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40))
    df = spark.range(n).select(F.lit("r").alias("run_id"), F.lit("m").alias("metric"), F.col("id").alias("label"), value.alias("value"))
    counted = order.values(df, ["run_id", "metric"], "value")
    sizes = [r["count"] for r in order.blocks(counted, ["run_id", "metric"], "value").groupBy("_block").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 2 * order.RATE * order.PER
    got = order.quantiles(counted, ["run_id", "metric"], "value", (0.25, 0.5, 0.75)).first().q
    assert got[1] == 0.5 and got[0] == pytest.approx(0.375, abs=2e-3) and got[2] == pytest.approx(0.625, abs=2e-3)
    plan = statistics.outliers(df)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition(" in line]
    ranked = [line for line in windows if "label" in line or "value" in line]
    assert ranked and all("_block" in line for line in ranked)


def test_zip_join_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(order, "RATE", 1)
    left = spark.createDataFrame([("r", k) for k in range(0, 100, 2)], "run_id string, label long")
    right = spark.createDataFrame([("r", k, f"c{k}") for k in range(70)], "run_id string, label long, c string")
    got = sorted((r.label, r.c) for r in reporting.zip_join(left, right).collect())
    assert got == [(2 * k, f"c{k}") for k in range(50)]
