"""Labels of each object by size relative to its run, or by millimetres."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import order

#: Labels in order of priority for the primary category.
PRIORITY = ("broken_grain", "abnormal_grain", "oversized_grain", "undersized_grain", "long_grain", "medium_grain", "short_grain", "whole_grain")


@dataclass(frozen=True)
class Thresholds:
    long_mm: float = 6.0
    medium_mm: float = 5.0
    long_ratio: float = 1.15
    medium_ratio: float = 0.85
    broken: float = 0.75
    oversized: float = 1.8
    undersized: float = 0.4
    solidity: float = 0.85
    circularity: float = 0.3
    eccentricity: float = 0.95


def classify(rows: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Adds categories (size, broken or whole, over- or undersized, abnormal) and primary_category.

    Needs run_id, length_px and area_px; uses length_mm, area_mm2 and pixels_per_mm, solidity,
    circularity and eccentricity if they are there; a missing circularity column counts as 0, a null shape
    value as normal.  Medians are
    joined back by run, so no task sorts all rows of a run.
    """
    have = lambda c, null, missing: F.coalesce(F.col(c), F.lit(null)) if c in rows.columns else F.lit(missing)
    ppm = have("pixels_per_mm", 0.0, 0.0)
    unit = lambda mm, px: F.coalesce(F.when(ppm > 0, F.col(mm)), F.col(px)) if mm in rows.columns else F.col(px)
    sized = rows.withColumns({"_length": unit("length_mm", "length_px"), "_area": unit("area_mm2", "area_px")})
    both = sized.select("run_id", F.col("_length").cast("double").alias("length"), F.col("_area").cast("double").alias("area")).unpivot("run_id", ["length", "area"], "_of", "_v")
    medians = order.quantiles(order.values(both, ["run_id", "_of"], "_v"), ["run_id", "_of"], "_v", (0.5,))
    of = lambda name: F.max(F.when(F.col("_of") == name, F.col("q")[0]))
    medians = medians.groupBy(F.col("run_id").alias("_run")).agg(of("length").alias("_ml"), of("area").alias("_ma"))
    known = sized.join(medians, F.col("run_id").eqNullSafe(F.col("_run")), "left")
    length, area, ml, ma = (F.col(c) for c in ("_length", "_area", "_ml", "_ma"))
    in_mm = (ppm > 0) & (F.col("length_mm").isNotNull() if "length_mm" in rows.columns else F.lit(False))
    by_mm = F.when(length >= limits.long_mm, "long_grain").when(length >= limits.medium_mm, "medium_grain").otherwise("short_grain")
    by_px = F.when(length >= limits.long_ratio * ml, "long_grain").when(length >= limits.medium_ratio * ml, "medium_grain").otherwise("short_grain")
    size = F.when(in_mm, by_mm).otherwise(by_px)
    broken = F.when((ml > 0) & (F.try_divide(length, ml) < limits.broken), "broken_grain").otherwise("whole_grain")
    share = F.when(ma > 0, F.try_divide(area, ma)).otherwise(1.0)
    over = F.when(share > limits.oversized, "oversized_grain").when(share < limits.undersized, "undersized_grain")
    odd = (have("solidity", 1.0, 1.0) < limits.solidity) | (have("circularity", 1.0, 0.0) < limits.circularity) | (have("eccentricity", 0.0, 0.0) > limits.eccentricity)
    categories = F.array_compact(F.array(size, broken, over, F.when(odd, "abnormal_grain")))
    labelled = known.withColumn("categories", categories).drop("_length", "_area", "_ml", "_ma", "_run")
    primary = F.lit("whole_grain")
    for name in reversed(PRIORITY):
        primary = F.when(F.array_contains("categories", name), name).otherwise(primary)
    return labelled.withColumn("primary_category", primary)


def category_counts(classified: DataFrame) -> DataFrame:
    """How often each label comes in each run."""
    return classified.select("run_id", F.explode("categories").alias("category")).groupBy("run_id", "category").agg(F.count("*").alias("count"))
