"""Pixels per millimetre: from settings, known objects, camera data or resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievestone.functions.expr import to_mm, to_mm2

#: Reference resolution, film and usual sensor width in mm, distance in mm, usual focal length.
BASE_PPM, BASE_PIXELS, FILM_MM, SENSOR_MM, DISTANCE_MM, FOCAL_MM = 40.0, 12_000_000.0, 36.0, 5.76, 150.0, 26.0
PPM_RANGE = (10.0, 200.0)
PX_COLUMNS = ("length", "width", "perimeter", "major_axis", "minor_axis", "hull_perimeter", "equivalent_diameter", "feret_max", "feret_min", "bbox_w", "bbox_h", "rot_rect_w", "rot_rect_h")


def ppm_by_resolution(height: Column, width: Column) -> Column:
    return F.lit(BASE_PPM) * F.sqrt(height * width / F.lit(BASE_PIXELS))


def ppm_by_camera(height: Column, width: Column, focal: Column, focal_35: Column) -> Column:
    """From focal lengths where there are any, within a range; by resolution otherwise."""
    has, has_35 = F.coalesce(focal > 0, F.lit(False)), F.coalesce(focal_35 > 0, F.lit(False))
    sensor = F.when(has & has_35, F.lit(FILM_MM) * focal / focal_35).otherwise(SENSOR_MM)
    view = F.when(has, sensor * F.lit(DISTANCE_MM) / focal).otherwise(FILM_MM * DISTANCE_MM / FOCAL_MM)
    clamped = F.greatest(F.lit(PPM_RANGE[0]), F.least(F.lit(PPM_RANGE[1]), width / view))
    return F.when(has | has_35, clamped).otherwise(ppm_by_resolution(height, width))


def effective_ppm(requested: Column, calibrated: Column, guessed: Column) -> Column:
    """A requested value first, else the stored calibration; exactly 0 takes the guess."""
    chosen = F.coalesce(requested, calibrated, F.lit(0.0))
    return F.when(chosen == 0, guessed).otherwise(chosen)


def is_calibrated(ppm: Column) -> Column:
    return F.coalesce(ppm > 0, F.lit(False))


def manual(settings: DataFrame) -> DataFrame:
    """Settings with a positive pixels_per_mm; others are refused."""
    return settings.where("pixels_per_mm > 0").withColumn("method", F.lit("manual"))


def known_object(objects: DataFrame, object_mm: float) -> DataFrame:
    """Per run, the long side of the largest object over its known length; (run_id, area_px, long_side_px)."""
    return objects.groupBy("run_id").agg(F.max_by("long_side_px", "area_px").alias("long_side_px")).select("run_id", F.lit("known_object").alias("method"), (F.col("long_side_px") / object_mm).alias("pixels_per_mm"))


def checkerboard(corners: DataFrame, square_mm: float = 25.0) -> DataFrame:
    """Distance of the first two corners of the first image over a square's side; (image, corner, x, y)."""
    first = corners.where("corner IN (0, 1)").groupBy("image").agg(*(F.max(F.when(F.col("corner") == k, F.col(c))).alias(f"{c}{k}") for k in (0, 1) for c in "xy"))
    side = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return first.orderBy("image").limit(1).select(F.lit("checkerboard").alias("method"), (side / square_mm).alias("pixels_per_mm"))


def with_mm(rows: DataFrame, ppm: Column | None = None) -> DataFrame:
    """Adds a millimetre column beside each pixel column that is there."""
    ppm = F.col("pixels_per_mm") if ppm is None else ppm
    made = {f"{c}_mm": to_mm(F.col(f"{c}_px"), ppm) for c in PX_COLUMNS if f"{c}_px" in rows.columns}
    made |= {f"{c}_mm2": to_mm2(F.col(f"{c}_px"), ppm) for c in ("area", "hull_area") if f"{c}_px" in rows.columns}
    return rows.withColumns(made) if made else rows
