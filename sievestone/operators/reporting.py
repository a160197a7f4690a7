"""Tables for reports and dashboards."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievestone.functions.expr import fixed

from . import order

FLAGS = ("broken", "whole", "long", "medium", "short")
CARRIED = ("aspect_ratio", "circularity", "solidity", "eccentricity", "orientation_angle")
#: Colours of the grades and categories as red, green, blue in hex.
GRADE_COLOURS = {"Premium": "#2E7D32", "Grade A": "#66BB6A", "Grade B": "#FFA726", "Grade C": "#FF7043", "Reject": "#EF5350"}

#: Colours of categories in annotated images as red, green, blue in hex.
CATEGORY_COLOURS = {
    "whole_grain": "#00FF00",
    "broken_grain": "#FF0000",
    "long_grain": "#0000FF",
    "medium_grain": "#FFA500",
    "short_grain": "#00FFFF",
    "oversized_grain": "#FF00FF",
    "undersized_grain": "#800080",
    "abnormal_grain": "#800000",
}


def grains(classified: DataFrame) -> DataFrame:
    """One row per object in the run's unit (columns keep their names in mm), with flags."""
    ppm = F.coalesce(F.col("pixels_per_mm"), F.lit(0.0))
    unit = lambda mm, px: F.when(ppm > 0, F.col(mm)).otherwise(F.col(px)).alias(mm)
    return classified.select(
        "run_id", "label", unit("area_mm2", "area_px"), unit("length_mm", "length_px"), unit("width_mm", "width_px"), *CARRIED, "primary_category",
        F.concat_ws(", ", "categories").alias("categories"), *(F.array_contains("categories", f"{f}_grain").alias(f"is_{f}") for f in FLAGS), F.when(ppm > 0, "mm").otherwise("px").alias("unit_suffix"),
    )


def histogram(rows: DataFrame, column: str, bins: int = 8) -> DataFrame:
    """Equal-width bins of each run, empty ones too: run_id, bin, bin_label, count; one bin if all are equal."""
    v = F.col(column).cast("double")
    there = rows.where(v.isNotNull() & ~F.isnan(v)).select("run_id", v.alias("v"))
    ends = there.groupBy("run_id").agg(F.min("v").alias("low"), F.max("v").alias("high")).withColumn("step", (F.col("high") - F.col("low")) / bins)
    place = F.when(F.col("step") > 0, F.least(F.floor(F.try_divide(F.col("v") - F.col("low"), F.col("step"))), F.lit(bins - 1))).otherwise(0).cast("int")
    counts = there.join(ends.hint("shuffle_hash"), "run_id").groupBy("run_id", place.alias("bin")).agg(F.count("*").alias("n"))
    spine = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.when(F.col("step") > 0, bins - 1).otherwise(0))))
    low, high = F.col("low") + F.col("bin") * F.col("step"), F.col("low") + (F.col("bin") + 1) * F.col("step")
    shown = F.when(F.col("step") > 0, F.concat(fixed(low), F.lit("-"), fixed(high))).otherwise(fixed(F.col("low")))
    return spine.join(counts, ["run_id", "bin"], "left").select("run_id", "bin", shown.alias("bin_label"), F.coalesce("n", F.lit(0)).alias("count"))


def scatter(rows: DataFrame, x: str = "length_mm", y: str = "width_mm") -> DataFrame:
    return rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select("run_id", F.col(x).alias("x"), F.col(y).alias("y"), F.col("primary_category").alias("category"))


def kpis(quality: DataFrame, graded: DataFrame, described: DataFrame, calibrated: DataFrame) -> DataFrame:
    """One row per run; means from millimetre statistics where the run is calibrated, else from pixels.

    calibrated: (run_id, calibrated).
    """
    names = {"length": ("length_mm", "length_px"), "width": ("width_mm", "width_px"), "area": ("area_mm2", "area_px")}
    pick = lambda metric, what: F.max(F.when(F.col("metric") == metric, F.col(what)))
    wide = described.where(F.col("metric").isin([m for both in names.values() for m in both])).groupBy("run_id").agg(
        *(pick(m, "mean").alias(f"mean_{m}") for both in names.values() for m in both), pick("length_mm", "cv").alias("cv_mm"), pick("length_px", "cv").alias("cv_px")
    )
    in_mm = F.coalesce(F.col("calibrated"), F.lit(False))
    joined = quality.withColumnRenamed("cv_length", "_cv").join(graded.select("run_id", "grade"), "run_id", "left").join(wide, "run_id", "left").join(calibrated.select("run_id", "calibrated"), "run_id", "left")
    means = [F.when(in_mm, F.col(f"mean_{mm}")).otherwise(F.col(f"mean_{px}")).alias(f"mean_{k}") for k, (mm, px) in names.items()]
    return joined.select("run_id", "total_grains", "broken_pct", "uniformity_index", F.coalesce("grade", F.lit("N/A")).alias("grade"), *means, F.when(in_mm, F.col("cv_mm")).otherwise(F.col("cv_px")).alias("cv_length"))


def alerts(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"broken_alert": F.col("broken_pct") > 10, "uniformity_alert": F.col("uniformity_index") < 70})


def quality_table(quality: DataFrame, graded: DataFrame) -> DataFrame:
    """Nine (metric, value) rows of text per run."""
    shown = lambda c, places=2, tail="": F.concat(fixed(F.coalesce(F.col(c), F.lit(0.0)), places), F.lit(tail))
    rows = [
        ("Total Grains", F.coalesce("total_grains", F.lit(0)).cast("string")), ("Broken Grains", shown("broken_pct", 2, " %")), ("Abnormal Grains", shown("abnormal_pct", 2, " %")),
        ("Uniformity Index", shown("uniformity_index", 2, " %")), ("CV of Length", shown("cv_length", 2, " %")), ("Avg Aspect Ratio", shown("average_aspect_ratio")),
        ("Shape Consistency", shown("shape_consistency", 2, " %")), ("Grain Density", shown("grain_density", 4)), ("Final Grade", F.coalesce("grade", F.lit("N/A"))),
    ]
    made = F.array(*(F.struct(F.lit(k).alias("row_no"), F.lit(m).alias("metric"), v.alias("value")) for k, (m, v) in enumerate(rows)))
    return quality.join(graded.select("run_id", "grade"), "run_id", "left").select("run_id", F.explode(made).alias("r")).select("run_id", "r.*")


def annotations(classified: DataFrame) -> DataFrame:
    """What is drawn on each object: its colour, its size as text, and where its label and size stand."""
    shown = lambda a, b, places, unit: F.concat(fixed(a, places), F.lit("x"), fixed(b, places), F.lit(unit))
    size = F.when(F.col("length_mm").isNotNull(), shown(F.col("length_mm"), F.col("width_mm"), 1, "mm")).otherwise(shown(F.col("length_px"), F.col("width_px"), 0, "px"))
    found = F.lit(CATEGORY_COLOURS["whole_grain"])
    for k, v in CATEGORY_COLOURS.items():
        found = F.when(F.col("primary_category") == k, v).otherwise(found)
    places = [c for x, c in (("centroid_x", F.col("centroid_x").cast("long").alias("x")), ("centroid_y", F.col("centroid_y").cast("long").alias("y"))) if x in classified.columns]
    return classified.select("run_id", "label", found.alias("colour"), size.alias("size_text"), *places)


def as_text(rows: DataFrame, *columns: str, first: Sequence[str] = ("length_mm", "width_mm", "area_mm2")) -> DataFrame:
    """Measurements with two places as text, a dash where there is none; ``first`` leads where it has values."""
    text = lambda c: F.coalesce(fixed(F.col(c)), F.lit("—")).alias(c)
    return rows.select("run_id", "label", *(text(c) for c in (*first, *columns) if c in rows.columns))


def total_files(reports: DataFrame, *lists: str) -> DataFrame:
    """How many files all reports list together; a missing list has none."""
    return reports.agg(F.coalesce(F.sum(sum((F.coalesce(F.size(c), F.lit(0)) for c in lists), F.lit(0))), F.lit(0)).alias("n_files"))


def rear_camera(devices: DataFrame) -> DataFrame:
    """The first video input whose label names the back or the rear: (position, kind, label)."""
    label = F.lower("label")
    there = devices.where((F.col("kind") == "videoinput") & (label.contains("back") | label.contains("rear")))
    return there.orderBy("position").limit(1)


def left_join_classes(measured: DataFrame, classes: DataFrame) -> DataFrame:
    return measured.join(classes, ["run_id", "label"], "left")


def zip_join(left: DataFrame, right: DataFrame, by: str = "label") -> DataFrame:
    """Pairs rows of a run by their place in the order of ``by``; the shorter side ends it."""
    placed = [order.ordinals(df, ["run_id"], by, "_at") for df in (left, right)]
    return placed[0].join(placed[1].drop(by), ["run_id", "_at"]).drop("_at")


def trend(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of each run with more than two points."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    made = rows.where(both).groupBy("run_id").agg(F.count("*").alias("n"), F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"))
    return made.where("n > 2")


def box_plot(long: DataFrame) -> DataFrame:
    """Quartiles, and whiskers at the last values within 1.5 quartile ranges; how many lie beyond."""
    there = long.where("value IS NOT NULL")
    q = order.quantiles(order.values(there, ["run_id", "metric"], "value"), ["run_id", "metric"], "value", (0.25, 0.5, 0.75))
    q = q.select("run_id", "metric", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    inside = F.col("value").between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    # the few rows of q are the side that is held: left alone, the planner broadcasts all values, whose rows have fewer bytes
    return there.join(q.hint("shuffle_hash"), ["run_id", "metric"]).groupBy("run_id", "metric", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"), F.max(F.when(inside, F.col("value"))).alias("whisker_high"), F.count_if(~inside).alias("n_beyond")
    )


def density(rows: DataFrame, column: str, points: int = 50, least: int = 6) -> DataFrame:
    """Gaussian kernel density of each run at equally spaced points, Scott's bandwidth.

    Values meet a fixed number of points, and sums are combined before the shuffle.
    """
    there = rows.where(F.col(column).isNotNull()).select("run_id", F.col(column).cast("double").alias("v"))
    ends = there.groupBy("run_id").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.stddev_samp("v").alias("sd")).where((F.col("n") >= least) & (F.col("sd") > 0))
    ends = ends.withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.struct(k.alias("k"), (F.col("low") + k * (F.col("high") - F.col("low")) / (points - 1)).alias("x"))))
    u = (F.col("p.x") - F.col("v")) / F.col("h")
    made = there.join(ends.hint("shuffle_hash"), "run_id").select("run_id", "v", "h", "n", at.alias("p")).groupBy("run_id", F.col("p.k").alias("point"), F.col("p.x").alias("x"), "h", "n").agg(F.sum(F.exp(-u * u / 2)).alias("s"))
    return made.select("run_id", "point", "x", (F.col("s") / (F.col("n") * F.col("h") * F.sqrt(F.lit(2) * F.pi()))).alias("density"))


def summaries(runs: DataFrame, quality: DataFrame, graded: DataFrame, annotated: DataFrame) -> DataFrame:
    """All runs, the newest first, with defaults where parts are missing, and whether an image is there."""
    images = annotated.select("run_id").distinct().withColumn("_image", F.lit(True))
    joined = runs.join(quality.select("run_id", "total_grains", "broken_pct", "uniformity_index"), "run_id", "left").join(graded.select("run_id", "grade"), "run_id", "left").join(images, "run_id", "left")
    return joined.select(
        "run_id", F.coalesce("total_grains", F.lit(0)).alias("num_grains"), F.coalesce("grade", F.lit("—")).alias("grade"), F.coalesce("broken_pct", F.lit(0.0)).alias("broken_pct"),
        F.coalesce("uniformity_index", F.lit(0.0)).alias("uniformity_index"), F.coalesce("_image", F.lit(False)).alias("has_annotated"),
    ).orderBy(F.desc("run_id"))


def latest(runs: DataFrame) -> DataFrame:
    """The run with the greatest id, by one aggregate."""
    return runs.agg(F.max_by(F.struct(*runs.columns), "run_id").alias("r")).where("r IS NOT NULL").select("r.*")


def first_source(*sources: DataFrame | Callable[[], DataFrame]) -> DataFrame:
    """The rows of the first source that has any; those after it are neither read nor, if they are functions, made.

    If none has rows, the last one.
    """
    for source in sources:
        rows = source() if callable(source) else source
        if not rows.isEmpty():
            break
    return rows


def flatten_lists(rows: DataFrame, lists: dict[str, int]) -> DataFrame:
    """A column for each place of list columns: name_0, name_1 and so on, in the list's place."""
    columns: list[Column] = []
    for c in rows.columns:
        columns += [F.get(c, F.lit(k)).alias(f"{c}_{k}") for k in range(lists[c])] if c in lists else [F.col(c)]
    return rows.select(*columns)


def search(rows: DataFrame, text: str) -> DataFrame:
    """Rows that contain the text anywhere, whatever the case."""
    return rows.where(F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in rows.columns))).contains(text.lower()))


def sliced(rows: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return rows.where(F.col(column).between(low, high))


def stamp(run_id: Column) -> Column:
    """The time in an id like run_20240131_235959."""
    return F.try_to_timestamp(F.regexp_extract(run_id, r"(\d{8}_\d{6})", 1), F.lit("yyyyMMdd_HHmmss"))


def run_of(file_name: Column, suffix: str = "_report.json") -> Column:
    return F.when(file_name.endswith(suffix), F.regexp_replace(F.element_at(F.split(file_name, "/"), -1), suffix.replace(".", r"\.") + "$", ""))


def readable_bytes(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(fixed(n / 1024, 1), F.lit(" KB"))).otherwise(F.concat(fixed(n / (1 << 20), 1), F.lit(" MB")))


def colour(grade: Column) -> Column:
    found = F.lit("#4CAF50")
    for k, v in GRADE_COLOURS.items():
        found = F.when(grade == k, v).otherwise(found)
    return found


def facts(classified: DataFrame) -> DataFrame:
    """Nineteen columns per object in millimetres (null without a calibration), and its run."""
    mm = lambda c: F.col(c) if c in classified.columns else F.lit(None).cast("double").alias(c)
    flags = ("whole", "broken", "long", "medium", "short", "oversized", "undersized", "abnormal")
    return classified.select(
        "run_id", "label", mm("area_mm2"), mm("length_mm"), mm("width_mm"), mm("perimeter_mm"), *CARRIED, "primary_category", *(F.array_contains("categories", f"{f}_grain").alias(f"is_{f}") for f in flags)
    )


def star_schema(classified: DataFrame, counts: DataFrame, quality: DataFrame, graded: DataFrame, runs: DataFrame) -> dict[str, DataFrame]:
    """Five tables: facts in millimetres with flags, categories, and one-row snapshots per run."""
    return {"GrainFacts": facts(classified), "CategoryDim": counts, "QualitySnapshot": quality, "GradingSnapshot": graded.select("run_id", "grade", "grade_key", "explanation"), "RunMetadata": runs}
