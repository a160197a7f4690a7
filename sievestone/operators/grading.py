"""Grades by rules: each run against each grade's limits, and the best grade all of whose limits hold."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievestone.functions.expr import fixed

#: Grades from best to worst, their names, and their limits.
GRADES = ("premium", "grade_a", "grade_b", "grade_c", "reject")
LABELS = {"premium": "Premium", "grade_a": "Grade A", "grade_b": "Grade B", "grade_c": "Grade C", "reject": "Reject"}
LIMITS = {
    "premium": {"max_broken_pct": 2.0, "min_uniformity": 90.0, "max_abnormal_pct": 1.0, "max_cv_length": 10.0},
    "grade_a": {"max_broken_pct": 5.0, "min_uniformity": 80.0, "max_abnormal_pct": 3.0, "max_cv_length": 15.0},
    "grade_b": {"max_broken_pct": 10.0, "min_uniformity": 70.0, "max_abnormal_pct": 5.0, "max_cv_length": 20.0},
    "grade_c": {"max_broken_pct": 15.0, "min_uniformity": 60.0, "max_abnormal_pct": 8.0, "max_cv_length": 25.0},
    "reject": {"max_broken_pct": 100.0, "min_uniformity": 0.0, "max_abnormal_pct": 100.0, "max_cv_length": 100.0},
}
#: Criterion name, quality column, limit, comparison, value where the quality column is null.
CRITERIA = (
    ("broken_pct", "broken_pct", "max_broken_pct", "<=", 100.0),
    ("uniformity_index", "uniformity_index", "min_uniformity", ">=", 0.0),
    ("abnormal_pct", "abnormal_pct", "max_abnormal_pct", "<=", 100.0),
    ("cv_length", "cv_length", "max_cv_length", "<=", 100.0),
)
#: Texts of runs that pass no grade and of runs without objects.
NOT_MET = "Sample does not meet minimum quality criteria."
NO_OBJECTS = "None (No grains detected)"


def rules(spark: SparkSession, overrides: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """One row per grade; unknown grades in ``overrides`` are ignored, known ones merged."""
    rows = [(k, g, LABELS[g], *({**LIMITS[g], **(overrides or {}).get(g, {})}[c[2]] for c in CRITERIA)) for k, g in enumerate(GRADES)]
    return spark.createDataFrame(rows, "grade_rank int, grade string, label string, max_broken_pct double, min_uniformity double, max_abnormal_pct double, max_cv_length double")


def checks(quality: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """One row per run and grade: the four checks and whether all passed.  The rules are five rows."""
    both = quality.crossJoin(F.broadcast(rule_rows))
    made = []
    for name, column, limit, sign, default in CRITERIA:
        value = F.coalesce(F.col(column), F.lit(default))
        made.append(F.struct(F.lit(name).alias("criterion"), value.alias("value"), F.col(limit).alias("threshold"), F.lit(sign).alias("operator"), (value <= F.col(limit) if sign == "<=" else value >= F.col(limit)).alias("passed")))
    both = both.withColumn("checks", F.array(*made))
    return both.select("run_id", "grade_rank", "grade", "label", "checks", F.forall("checks", lambda c: c["passed"]).alias("all_passed"))


def check_rows(evaluated: DataFrame) -> DataFrame:
    """One row per run, grade and criterion."""
    return evaluated.select("run_id", "grade_rank", "grade", F.explode("checks").alias("c")).select("run_id", "grade_rank", "grade", "c.*")


def grade(quality: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """One row per run: grade, grade_key, explanation, criteria_results and all_evaluations.

    A run that passes no grade is rejected without criteria.
    """
    evaluated = checks(quality, rule_rows).groupBy("run_id").agg(
        F.min(F.when(F.col("all_passed"), F.struct("grade_rank", "grade", "label", "checks"))).alias("best"),
        F.array_sort(F.collect_list(F.struct("grade_rank", "grade", "label", "all_passed", "checks"))).alias("all_evaluations"),
    )
    shown = lambda x: fixed(F.coalesce(x, F.lit(0.0)))
    lines = F.transform("best.checks", lambda c: F.concat(F.lit("  • "), c["criterion"], F.lit(": "), fixed(c["value"]), F.lit(" "), c["operator"], F.lit(" "), fixed(c["threshold"]), F.lit(" → "), F.when(c["passed"], "PASS").otherwise("FAIL")))
    text = F.concat_ws(
        "\n", F.concat(F.lit("Sample classified as **"), F.col("best.label"), F.lit("**.")), F.concat_ws("\n", lines), F.concat(F.lit("  • Total grains: "), F.col("total_grains").cast("string")),
        F.concat(F.lit("  • Broken: "), shown(F.col("broken_pct")), F.lit("%")), F.concat(F.lit("  • Uniformity: "), shown(F.col("uniformity_index")), F.lit("%")), F.concat(F.lit("  • Abnormal: "), shown(F.col("abnormal_pct")), F.lit("%")),
    )
    return quality.join(evaluated, "run_id").select(
        "run_id", F.coalesce("best.label", F.lit("Reject")).alias("grade"), F.coalesce("best.grade", F.lit("reject")).alias("grade_key"),
        F.when(F.col("best").isNull(), NOT_MET).otherwise(text).alias("explanation"),
        F.coalesce("best.checks", F.array().cast("array<struct<criterion:string,value:double,threshold:double,operator:string,passed:boolean>>")).alias("criteria_results"), "all_evaluations",
    )


def with_empty_runs(runs: DataFrame, graded: DataFrame) -> DataFrame:
    """All runs; one without objects is rejected by name, without criteria."""
    empty = F.array().cast(graded.schema["criteria_results"].dataType)
    return runs.select("run_id").join(graded, "run_id", "left").withColumns(
        {"grade": F.coalesce("grade", F.lit(NO_OBJECTS)), "grade_key": F.coalesce("grade_key", F.lit("reject")), "criteria_results": F.coalesce("criteria_results", empty)}
    )
