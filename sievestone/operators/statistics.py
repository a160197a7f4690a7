"""Descriptive statistics, normality, outliers and correlation, by run and metric.

Input is long: (run_id, metric, label, value).  Each operator is one aggregate on (run_id, metric),
or a join of its result with the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievestone.functions.expr import finite, pearson, t_quantile

from . import order

KEYS = ("run_id", "metric")
#: Metrics that are described for every run.
METRICS = (
    "area_px", "perimeter_px", "length_px", "width_px", "major_axis_px", "minor_axis_px", "aspect_ratio", "circularity", "solidity",
    "convexity", "eccentricity", "elongation", "extent", "equivalent_diameter_px", "feret_max_px", "feret_min_px", "fill_ratio", "orientation_angle",
)
MM_METRICS = ("length_mm", "width_mm", "area_mm2", "perimeter_mm")
SHAPIRO_ROWS = (3, 5000)


def to_long(wide: DataFrame, metrics: Sequence[str], run: str = "run_id", label: str = "label") -> DataFrame:
    """One row per metric that the table has; NaN and infinities become null."""
    here = [m for m in metrics if m in wide.columns]
    picked = wide.select(F.col(run).alias("run_id"), F.col(label).alias("label"), *(finite(F.col(m).cast("double")).alias(m) for m in here))
    return picked.unpivot(["run_id", "label"], here, "metric", "value")


#: Quantiles of a description, in the order of their names.
SHARES = {"p5": 0.05, "p10": 0.10, "q1": 0.25, "median": 0.5, "q3": 0.75, "p90": 0.90, "p95": 0.95}


def describe(long: DataFrame) -> DataFrame:
    """21 statistics per (run_id, metric) over values that are there; groups without any are left out.

    Moments are one aggregate; mode and quantiles come from counts of distinct values (``order``).
    """
    v = F.col("value")
    n = F.count(v)
    made = long.where(v.isNotNull()).groupBy(*KEYS).agg(
        n.alias("count"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.coalesce(F.var_samp(v), F.lit(0.0)).alias("variance"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std_dev"),
        F.when(n > 2, F.skewness(v)).otherwise(0.0).alias("skewness"), F.when(n > 3, F.kurtosis(v)).otherwise(0.0).alias("kurtosis"),
    )
    counted = order.values(long, KEYS, "value")
    made = _with(_with(made, order.modes(counted, KEYS, "value")), order.quantiles(counted, KEYS, "value", tuple(SHARES.values())))
    q = {name: F.col("q")[k] for k, name in enumerate(SHARES)}
    half = t_quantile(F.col("count") - 1) * F.col("std_dev") / F.sqrt("count")
    return made.select(
        *KEYS, "count", "mean", q["median"].alias("median"), "mode", "min", "max", (F.col("max") - F.col("min")).alias("range"), "variance", "std_dev",
        F.when((F.col("mean") != 0) & (F.col("count") > 1), F.try_divide("std_dev", "mean") * 100).otherwise(0.0).alias("cv"),
        *(q[k].alias(k) for k in ("q1", "q3")), (q["q3"] - q["q1"]).alias("iqr"), *(q[k].alias(k) for k in ("p5", "p10", "p90", "p95")), "skewness", "kurtosis",
        F.when(F.col("count") > 1, F.col("mean") - half).otherwise(F.col("mean")).alias("ci_95_lower"), F.when(F.col("count") > 1, F.col("mean") + half).otherwise(F.col("mean")).alias("ci_95_upper"),
    )


def _with(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of the same run, null or not, and metric side by side."""
    named = right.withColumnsRenamed({k: f"_{k}" for k in KEYS})
    return left.join(named, F.col("run_id").eqNullSafe(F.col("_run_id")) & (F.col("metric") == F.col("_metric"))).drop("_run_id", "_metric")


def totals(wide: DataFrame) -> DataFrame:
    """Rows per run, empty values included, and whether the run has millimetres."""
    return wide.groupBy("run_id").agg(F.count("*").alias("total_grains"), F.coalesce(F.bool_or(F.col("pixels_per_mm") > 0), F.lit(False)).alias("calibrated"))


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """W and p of Royston's 1995 approximation, for 3 to 5000 values that are not all equal."""
    x, n, normal = np.sort(x), len(x), NormalDist()
    if n == 3:
        weights = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        m = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
        u, c = 1 / math.sqrt(n), m / math.sqrt(float(m @ m))
        last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, c[-1]], u)
        if n <= 5:
            phi = (float(m @ m) - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            weights = m / math.sqrt(phi)
        else:
            second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, c[-2]], u)
            phi = (float(m @ m) - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            weights = m / math.sqrt(phi)
            weights[[1, -2]] = -second, second
        weights[[0, -1]] = -last, last
    centred = x - x.mean()
    w = min(1.0, float(weights @ x) ** 2 / float(centred @ centred))
    if n == 3:
        return w, min(1.0, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    if w >= 1:
        return w, 1.0
    y, ln = math.log(1 - w), math.log(n)
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if y >= gamma:
            return w, 1e-99
        y = -math.log(gamma - y)
        mu, sigma = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        mu, sigma = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return w, 1 - normal.cdf((y - mu) / sigma)


def normality(long: DataFrame) -> DataFrame:
    """shapiro_stat, shapiro_p and is_normal (p > 0.05); null outside 3 to 5000 values or if all are equal.

    Groups beyond 5000 values are told apart by a count first, so a task never holds a larger one.
    """
    there = long.where("value IS NOT NULL").select(*KEYS, "value")
    counts = there.groupBy(*KEYS).agg(F.count("*").alias("n"), (F.min("value") < F.max("value")).alias("varies"))
    low, high = SHAPIRO_ROWS
    fit = counts.where(F.col("n").between(low, high) & F.col("varies")).select(*KEYS)

    def test(group: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro_wilk(group["value"].to_numpy())
        return group.iloc[:1][list(KEYS)].assign(shapiro_stat=w, shapiro_p=p, is_normal=p > 0.05)

    kinds = f"run_id {dict(long.dtypes)['run_id']}, metric string, shapiro_stat double, shapiro_p double, is_normal boolean"
    tested = there.join(fit, list(KEYS)).groupBy(*KEYS).applyInPandas(test, kinds)
    return counts.select(*KEYS).join(tested, list(KEYS), "left")


def outliers(long: DataFrame, fence: float = 1.5, z: float = 3.0) -> DataFrame:
    """Positions (from 0, by label, among values that are there) beyond the quartile fences and beyond
    ``z`` population deviations, with the fences; empty and null for fewer than four values."""
    there = long.where("value IS NOT NULL")
    v = F.col("value")
    spread = there.groupBy(*KEYS).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"))
    bounds = _with(spread, order.quantiles(order.values(there, KEYS, "value"), KEYS, "value", (0.25, 0.75)))
    q1, q3 = F.col("q")[0], F.col("q")[1]
    bounds = bounds.select(*KEYS, "n", "mean", "sd", F.when(F.col("n") >= 4, q1 - fence * (q3 - q1)).alias("iqr_lower"), F.when(F.col("n") >= 4, q3 + fence * (q3 - q1)).alias("iqr_upper"))
    placed = _with(order.ordinals(there, KEYS, "label"), bounds)
    far = (v < F.col("iqr_lower")) | (v > F.col("iqr_upper"))
    beyond = (F.col("n") >= 4) & (F.abs(F.try_divide(v - F.col("mean"), F.col("sd"))) > z)
    listed = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("pos"))))
    return placed.groupBy(*KEYS, "iqr_lower", "iqr_upper").agg(listed(far).alias("iqr_outliers"), listed(beyond).alias("zscore_outliers"))


def outlier_counts(found: DataFrame) -> DataFrame:
    """How many values of each metric lie beyond the fences and beyond the deviations."""
    return found.select(*KEYS, F.size("iqr_outliers").alias("n_iqr"), F.size("zscore_outliers").alias("n_zscore"))


def with_empty_runs(runs: DataFrame, described: DataFrame) -> DataFrame:
    """All runs; one without objects has one row with ``error``."""
    return runs.select("run_id").join(described, "run_id", "left").withColumn("error", F.when(F.col("metric").isNull(), "No grains to analyze"))


def correlation(wide: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of metrics that the table has, in one pass: run_id, m1, m2, r."""
    here = [m for m in metrics if m in wide.columns]
    if len(here) < 2:
        return wide.select("run_id", F.lit("").alias("m1"), F.lit("").alias("m2"), F.lit(0.0).alias("r")).limit(0)
    x = {m: finite(F.col(m).cast("double")) for m in here}
    pairs = [(a, b) for i, a in enumerate(here) for b in here[i:]]
    made = wide.groupBy("run_id").agg(*(F.bround(pearson(x[a], x[b]), 4).alias(f"r{k}") for k, (a, b) in enumerate(pairs)))
    rows = [F.struct(F.lit(m).alias("m1"), F.lit(n).alias("m2"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs) for m, n in dict.fromkeys([(a, b), (b, a)])]
    return made.select("run_id", F.explode(F.array(*rows)).alias("c")).select("run_id", "c.*")
