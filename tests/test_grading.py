import pytest
from pyspark.sql import functions as F

from sievestone.operators.calibration import checkerboard, effective_ppm, known_object, ppm_by_camera, with_mm
from sievestone.operators.classification import Thresholds, category_counts, classify
from sievestone.operators.grading import NOT_MET, checks, grade, rules
from sievestone.operators.quality import quality, with_empty_runs
from sievestone.operators import reporting
from sievestone.plans import catalogue


def classified(spark, rows, **more):
    df = spark.createDataFrame([("r", k, float(a), float(a) / 2, float(b)) for k, (a, b) in enumerate(rows)], "run_id string, label int, length_px double, width_px double, area_px double")
    for c, v in {"solidity": 0.9, "circularity": 0.8, "eccentricity": 0.5, **more}.items():
        df = df.withColumn(c, F.lit(v).cast("double"))
    return classify(df)


def test_labels(spark):
    got = [r.categories for r in classified(spark, [(100, 100), (74, 39), (75, 40), (115, 180), (130, 181)]).orderBy("label").collect()]
    assert got == [
        ["medium_grain", "whole_grain"], ["short_grain", "broken_grain", "undersized_grain"], ["short_grain", "whole_grain"], ["long_grain", "whole_grain"], ["long_grain", "whole_grain", "oversized_grain"],
    ]
    odd = classified(spark, [(1, 1)], solidity=0.84).first()
    assert odd.categories[-1] == "abnormal_grain" == odd.primary_category
    assert classified(spark, [(1, 1)], eccentricity=None).first().primary_category == "medium_grain"
    assert classified(spark, [(0, 0), (0, 0)]).first().categories == ["long_grain", "whole_grain"]
    assert {r.category: r["count"] for r in category_counts(classified(spark, [(100, 100), (10, 100)])).collect()}["whole_grain"] == 1
    assert classify(classified(spark, [(100, 100), (90, 100)]).drop("categories", "primary_category"), Thresholds(broken=0.99)).where(F.array_contains("categories", "broken_grain")).count() == 1


def graded(spark, **q):
    row = {"broken_pct": 0.0, "uniformity_index": 100.0, "abnormal_pct": 0.0, "cv_length": 0.0, "total_grains": 3, **q}
    df = spark.createDataFrame([("r", *row.values())], "run_id string, broken_pct double, uniformity_index double, abnormal_pct double, cv_length double, total_grains long")
    return grade(df, rules(spark)).first()


@pytest.mark.parametrize("q, key", [({}, "premium"), ({"broken_pct": 2.0}, "premium"), ({"broken_pct": 2.01}, "grade_a"), ({"cv_length": 20.0}, "grade_b"), ({"abnormal_pct": 8.0}, "grade_c"), ({"uniformity_index": 0.0}, "reject"), ({"broken_pct": None}, "reject")])
def test_grades(spark, q, key):
    r = graded(spark, **q)
    assert r.grade_key == key and len(r.criteria_results) == 4 and len(r.all_evaluations) == 5


def test_nothing_passed(spark):
    r = graded(spark, cv_length=100.1)
    assert (r.grade, r.explanation, r.criteria_results) == ("Reject", NOT_MET, [])


def test_explanation_and_overrides(spark):
    r = graded(spark, broken_pct=0.125)
    assert r.explanation.splitlines()[:2] == ["Sample classified as **Premium**.", "  • broken_pct: 0.12 <= 2.00 → PASS"]
    rows = {r.grade: r.max_broken_pct for r in rules(spark, {"premium": {"max_broken_pct": 0.1}, "unknown": {}}).collect()}
    assert rows["premium"] == 0.1 and len(rows) == 5


def test_specimens_reach_every_outcome(spark):
    made = catalogue.QUERIES["grade_final"](spark, "/root/testdata/sf0.01")
    got = {(r.grade, r.none_passed): r["count"] for r in made.groupBy("grade", "none_passed").count().collect()}
    assert got[("Premium", False)] and got[("Reject", True)] and sum(got.values()) == 42 and len(got) >= 5


def test_empty_runs(spark):
    q = with_empty_runs(spark.createDataFrame([("r",), ("none",)], "run_id string"), quality(classified(spark, [(1, 1)])))
    assert {r.run_id: r.error for r in q.collect()} == {"r": None, "none": "No grains for quality analysis"}
    assert checks(quality(classified(spark, [(1, 1)])), rules(spark)).count() == 5


def test_calibration(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = lambda x: F.lit(x).cast("double")
    assert one(ppm_by_camera(lit(3000), lit(4000), lit(None), lit(None))) == 40.0
    assert one(ppm_by_camera(lit(3000), lit(4000), lit(4.3), lit(26))) == pytest.approx(4000 / (36 * 4.3 / 26 * 150 / 4.3))
    assert one(ppm_by_camera(lit(3000), lit(400000), lit(4.3), lit(None))) == 200.0
    assert one(effective_ppm(lit(0), lit(5), lit(7))) == 7 and one(effective_ppm(lit(None), lit(5), lit(7))) == 5
    objects = spark.createDataFrame([("r", 5.0, 9.0), ("r", 8.0, 50.0)], "run_id string, area_px double, long_side_px double")
    assert known_object(objects, 25.0).first().pixels_per_mm == 2.0
    corners = spark.createDataFrame([("b", 0, 0.0, 0.0), ("b", 1, 9.0, 0.0), ("a", 0, 0.0, 0.0), ("a", 1, 30.0, 40.0)], "image string, corner int, x double, y double")
    assert checkerboard(corners, 25.0).first().pixels_per_mm == 2.0
    assert with_mm(spark.createDataFrame([(10.0, 100.0, 0.0)], "length_px double, area_px double, pixels_per_mm double")).first()[3:] == (None, None)


def test_histogram_and_helpers(spark):
    rows = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 8.0), ("b", 2.5), ("b", 2.5), ("c", None)], "run_id string, x double")
    got = {(r.run_id, r.bin): (r.bin_label, r["count"]) for r in reporting.histogram(rows, "x", 8).collect()}
    assert got["a", 0] == ("0.00-1.00", 1) and got["a", 1] == ("1.00-2.00", 1) and got["a", 7] == ("7.00-8.00", 1) and got["b", 0] == ("2.50", 2) and len(got) == 9
    r = spark.range(1).select(reporting.stamp(F.lit("run_20240131_235958")).alias("t"), reporting.stamp(F.lit("x")).alias("n"), reporting.run_of(F.lit("d/run_1_report.json")).alias("r"), reporting.readable_bytes(F.lit(2048)).alias("b")).first()
    assert (str(r.t), r.n, r.r, r.b) == ("2024-01-31 23:59:58", None, "run_1", "2.0 KB")
    empty, full = rows.where("false"), rows
    assert reporting.first_source(empty, full).count() == 6
