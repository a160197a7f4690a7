import pytest
from pyspark.sql import functions as F

from sievestone.operators import grading, quality, raster, reporting, statistics


def test_rear_camera_and_files(spark):
    rows = [(0, "audioinput", "Back microphone"), (1, "videoinput", "Front"), (2, "videoinput", "REAR wide"), (3, "videoinput", "back"), (4, "videoinput", None)]
    assert [r.position for r in reporting.rear_camera(spark.createDataFrame(rows, "position int, kind string, label string")).collect()] == [2]
    reports = spark.createDataFrame([(["a", "b"], ["c"]), (None, ["d"]), ([], None)], "csv array<string>, images array<string>")
    assert reporting.total_files(reports, "csv", "images").first().n_files == 4
    assert reporting.total_files(reports.limit(0), "csv", "images").first().n_files == 0


def test_annotations_in_pixels_and_unknown_category(spark):
    rows = spark.createDataFrame([(1, 7, "odd", None, None, 10.5, 3.4, 5.9, 6.1)], "run_id int, label int, primary_category string, length_mm double, width_mm double, length_px double, width_px double, centroid_x double, centroid_y double")
    r = reporting.annotations(rows).first()
    assert (r.colour, r.size_text, r.x, r.y) == ("#00FF00", "10x3px", 5, 6)


def test_facts_have_nineteen_columns(spark):
    rows = spark.createDataFrame([(1, 1, 2.0, 1.0, 1.0, 0.5, 0.5, 0.5, 0.5, 0.5, "whole_grain", ["whole_grain"])],
        "run_id int, label int, area_mm2 double, length_mm double, width_mm double, aspect_ratio double, circularity double, solidity double, eccentricity double, orientation_angle double, primary_category string, categories array<string>")
    r = reporting.facts(rows).first()
    assert len(r) == 20 and r.is_whole and not r.is_broken and r.perimeter_mm is None


def test_runs_without_objects(spark):
    runs = spark.createDataFrame([(1,), (2,)], "run_id int")
    described = statistics.describe(statistics.to_long(spark.createDataFrame([(1, 1, 5.0)], "run_id int, label int, length_px double"), ["length_px"]))
    assert {r.run_id: r.error for r in statistics.with_empty_runs(runs, described).collect()} == {1: None, 2: "No grains to analyze"}
    judged = quality.quality(spark.createDataFrame([(1, ["whole_grain"], 5.0, 2.0, 8.0)], "run_id int, categories array<string>, length_px double, width_px double, area_px double"))
    made = {r.run_id: r for r in grading.with_empty_runs(runs, grading.grade(judged, grading.rules(spark))).collect()}
    assert made[2].grade == "None (No grains detected)" and made[2].grade_key == "reject" and made[2].criteria_results == []
    assert made[1].grade == "Premium" and len(made[1].criteria_results) == 4


def test_views_come_back_on_an_oblong_image(spark):
    px = spark.range(6).selectExpr("1 AS run_id", "CAST(id DIV 3 AS INT) AS y", "CAST(id % 3 AS INT) AS x", "id AS v")
    size = px.groupBy("run_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    got = raster.undo_views(raster.test_time_views(px, size), size).collect()
    assert len(got) == 54 and all(r.v == r.y * 3 + r.x for r in got)


def test_first_strategy_with_objects(spark):
    kind = "run_id int, y int, x int, label int"
    none, some = spark.createDataFrame([(1, 0, 0, 0), (2, 0, 0, 3)], kind), spark.createDataFrame([(1, 0, 0, 1), (2, 0, 0, 1), (3, 0, 0, 0)], kind)
    got = {r.run_id: (r.method, r.label) for r in raster.first_with_objects({"model": None, "clusters": none, "classical": some}).collect()}
    assert got == {1: ("classical", 1), 2: ("clusters", 3), 3: ("classical", 0)}
    with pytest.raises(ValueError):
        raster.first_with_objects({"model": None})


def test_label_colours_span_the_hues(spark):
    rows = spark.createDataFrame([(1, 0, 0, k) for k in range(4)] + [(2, 0, 0, 9)], "run_id int, y int, x int, label int")
    got = {(r.run_id, r.label): (r.hue, r.r, r.g, r.b) for r in raster.label_colours(rows).collect()}
    assert got[1, 1] == got[2, 9] == (0, 255, 0, 0) and got[1, 2][0] == 89 and got[1, 3][0] == 179


def test_values_are_not_broadcast(spark):
    values = spark.range(1000).selectExpr("id % 3 AS run_id", "'m' AS metric", "id * 1.0D AS value")
    for made in (reporting.box_plot(values), reporting.density(values, "value", points=3)):
        assert "BuildLeft" not in made._jdf.queryExecution().executedPlan().toString()
