"""Order statistics and ordinals of groups of any size.

Groups with many values are cut into blocks at splitters: values whose hash falls into a fixed
share, sorted, one of every ``per``.  Splitters depend on the values only, so every branch of a plan
cuts alike.  Rows are then ranked within (group, block), and what lies before a block comes from the
blocks' counts.  Equal values share a block, and are one row with a count where only values matter.
No task ranks or holds a group; it ranks about ``rate * per`` distinct values of one at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One value in so many is a candidate for a splitter, and so many candidates make a block: 1 << 20 distinct values.
RATE, PER = 4096, 256


def _splitters(values: DataFrame, keys: Sequence[str], by: str, rate: int, per: int) -> DataFrame:
    """Groups with more than one block: keys (as _0, _1, ...) and _cuts."""
    some = values.where(F.pmod(F.xxhash64(by), F.lit(rate)) == 0).groupBy(*(F.col(k).alias(f"_{j}") for j, k in enumerate(keys)))
    some = some.agg(F.array_sort(F.collect_set(by)).alias("_some")).where(F.size("_some") > per)
    return some.select(*(f"_{j}" for j in range(len(keys))), F.transform(F.sequence(F.lit(per), F.size("_some") - 1, F.lit(per)), lambda k: F.get("_some", k)).alias("_cuts"))


def _same(keys: Sequence[str], prefix: str = "_") -> Column:
    test = F.lit(True)
    for j, k in enumerate(keys):
        test = test & F.col(k).eqNullSafe(F.col(f"{prefix}{j}"))
    return test


def blocks(rows: DataFrame, keys: Sequence[str], by: str, rate: int = RATE, per: int = PER) -> DataFrame:
    """Adds _block: higher blocks of a group hold higher values of ``by``."""
    cuts = _splitters(rows.where(F.col(by).isNotNull()), keys, by, rate, per)
    cut = rows.join(cuts, _same(keys), "left").withColumn("_block", F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col(by))), F.lit(0)))
    return cut.drop("_cuts", *(f"_{j}" for j in range(len(keys))))


def _ranked(rows: DataFrame, keys: Sequence[str], by: str, n: Column, rate: int, per: int) -> DataFrame:
    """Adds _before, the number of the group's rows in front of a row, and _total, that of all."""
    placed = blocks(rows.withColumn("_n", n), keys, by, rate, per)
    counts = placed.groupBy(*(F.col(k).alias(f"_{j}") for j, k in enumerate(keys)), F.col("_block").alias("_b")).agg(F.sum("_n").alias("_in"))
    group = [f"_{j}" for j in range(len(keys))]  # a row per block of a group
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, "_b", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_start"), F.sum("_in").over(Window.partitionBy(*group)).alias("_total"))
    inside = Window.partitionBy(*keys, "_block").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    joined = local.join(counts.hint("shuffle_hash"), _same(keys) & (F.col("_block") == F.col("_b")))
    return joined.withColumn("_before", F.col("_start") + F.col("_local")).drop("_b", "_block", "_local", "_start", *group)


def values(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Distinct values that are there, with their number n: combined before the shuffle."""
    return rows.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("n"))


def quantiles(counted: DataFrame, keys: Sequence[str], column: str, shares: Sequence[float], rate: int = RATE, per: int = PER) -> DataFrame:
    """Exact quantiles of ``values``, interpolated between neighbours: keys and q, an array in the order of ``shares``."""
    ranked = _ranked(counted, keys, column, F.col("n"), rate, per)
    low = [F.floor(F.lit(float(p)) * (F.col("_total") - 1)) for p in shares]
    high = [F.ceil(F.lit(float(p)) * (F.col("_total") - 1)) for p in shares]
    at = lambda place: F.max(F.when((F.col("_before") <= place) & (place < F.col("_before") + F.col("n")), F.col(column)))
    found = ranked.groupBy(*keys).agg(F.max("_total").alias("_total"), *(at(p).alias(f"_l{k}") for k, p in enumerate(low)), *(at(p).alias(f"_h{k}") for k, p in enumerate(high)))
    part = [F.lit(float(p)) * (F.col("_total") - 1) - low[k] for k, p in enumerate(shares)]
    return found.select(*keys, F.array(*(F.col(f"_l{k}") * (1 - part[k]) + F.col(f"_h{k}") * part[k] for k in range(len(shares)))).alias("q"))


def modes(counted: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The most frequent of ``values``, the least of equals: keys and mode."""
    return counted.groupBy(*keys).agg(F.max(F.struct("n", (-F.col(column)).alias("v"))).alias("m")).select(*keys, (-F.col("m.v")).alias("mode"))


def ordinals(rows: DataFrame, keys: Sequence[str], by: str, name: str = "pos", rate: int = RATE, per: int = PER) -> DataFrame:
    """Adds the place of each row in its group, from 0, in the order of a column; nulls come first, equals in any order."""
    ranked = _ranked(rows, keys, by, F.lit(1), rate, per)
    return ranked.withColumn(name, F.col("_before")).drop("_n", "_total", "_before")
