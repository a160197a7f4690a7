"""Quality of each run: one row per run from one aggregate, in pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievestone.functions.expr import circular_mean, circular_std

SIZES = ("long_grain", "medium_grain", "short_grain")


def _cv(c: str) -> Column:
    """Population coefficient of variation in percent; 0 if the mean is not positive."""
    mean = F.avg(c)
    return F.when(mean > 0, F.try_divide(F.stddev_pop(c), mean) * 100).otherwise(0.0)


def quality(classified: DataFrame) -> DataFrame:
    """Needs run_id, categories, length_px, width_px, area_px; uses aspect_ratio, circularity,
    orientation_angle, image_height and image_width if they are there."""
    rows = classified
    for c in ("aspect_ratio", "circularity", "orientation_angle", "image_height", "image_width"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(0.0))
    share = lambda name: 100.0 * F.avg(F.array_contains("categories", name).cast("int"))
    image = F.coalesce(F.max(F.col("image_height").cast("double") * F.col("image_width")), F.lit(0.0))
    sizes = {f"{c}_{what}": f(f"{c}_px") for c in ("length", "width", "area") for what, f in (("mean", F.avg), ("std", F.stddev_pop))}
    made = rows.groupBy("run_id").agg(
        F.count("*").alias("total_grains"), share("broken_grain").alias("broken_pct"), share("abnormal_grain").alias("abnormal_pct"),
        *(x.alias(k) for k, x in sizes.items()), _cv("length_px").alias("cv_length"), _cv("area_px").alias("cv_area"),
        F.avg("aspect_ratio").alias("average_aspect_ratio"), _cv("circularity").alias("_cv_circularity"),
        F.sum("area_px").alias("_area"), image.alias("_image"),
        F.avg("orientation_angle").alias("orientation_mean"), F.stddev_pop("orientation_angle").alias("orientation_std"),
        circular_mean(F.col("orientation_angle")).alias("circular_mean"), circular_std(F.col("orientation_angle")).alias("circular_std"),
        *(F.count_if(F.array_contains("categories", s)).alias(f"{s}_count") for s in SIZES),
    )
    density = F.when(F.col("_image") > 0, F.col("_area") / F.col("_image")).otherwise(0.0)
    spacing = F.when(F.col("_image") > 0, F.sqrt(F.col("_image") / F.col("total_grains")) - F.sqrt("area_mean")).otherwise(0.0)
    above_zero = lambda x: F.greatest(F.lit(0.0), F.lit(100.0) - x)
    return made.withColumns(
        {"uniformity_index": above_zero(F.col("cv_length")), "shape_consistency": above_zero(F.col("_cv_circularity")), "grain_density": density, "packing_ratio": density, "avg_inter_grain_spacing_px": spacing}
    ).drop("_cv_circularity", "_area", "_image")


def with_empty_runs(runs: DataFrame, measured: DataFrame) -> DataFrame:
    """All runs, those without objects with nulls and ``error``."""
    return runs.select("run_id").join(measured, "run_id", "left").withColumn("error", F.when(F.col("total_grains").isNull(), "No grains for quality analysis"))
