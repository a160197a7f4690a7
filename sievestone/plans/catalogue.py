"""Every query by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievestone.functions.expr import Z975, circular_mean, circular_std
from sievestone.operators import calibration, classification, geometry, grading, quality, raster, reporting, statistics
from sievestone.operators.links import new_folder
from sievestone.sources import specimens as s
from sievestone.streaming import parts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PPM = 250.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    return df.select(*((F.round(c, places) if c in columns else F.col(c)).alias(c) for c in df.columns))


def r4(*columns: str) -> str:
    return ", ".join(f"round({c}, 4) AS {c}" for c in columns)


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.to_long(s.lines(spark, sf_dir), list(s.LINE_METRICS))


def _classified(spark: SparkSession, sf_dir: str, ppm: float = 0.0) -> DataFrame:
    return classification.classify(s.parts(spark, sf_dir, ppm))


def _quality(spark: SparkSession, sf_dir: str, ppm: float = 0.0) -> DataFrame:
    return quality.quality(_classified(spark, sf_dir, ppm))


def _grade(spark: SparkSession, sf_dir: str, ppm: float = 0.0) -> DataFrame:
    return grading.grade(_quality(spark, sf_dir, ppm), grading.rules(spark))


# -- descriptive statistics

_BASIC = ("mean", "min", "max", "range", "variance", "std_dev", "cv")


@query(f"""WITH {s.LINES_SQL} SELECT run_id, metric, count, {r4(*_BASIC)} FROM (SELECT run_id, metric, count(value) AS count, avg(value) AS mean, min(value) AS min, max(value) AS max,
    max(value) - min(value) AS range, coalesce(var_samp(value), 0) AS variance, coalesce(stddev_samp(value), 0) AS std_dev,
    CASE WHEN avg(value) != 0 AND count(value) > 1 THEN stddev_samp(value) / avg(value) * 100 ELSE 0 END AS cv FROM long GROUP BY 1, 2)""")
def describe_basic(spark, sf_dir):
    return rounded(statistics.describe(_long(spark, sf_dir)).select("run_id", "metric", "count", *_BASIC), *_BASIC)


_QUANTILES = {"median": 0.5, "q1": 0.25, "q3": 0.75, "p5": 0.05, "p10": 0.1, "p90": 0.9, "p95": 0.95}


@query(f"""WITH {s.LINES_SQL} SELECT run_id, metric, {", ".join(f"round(quantile_cont(value, {p}), 4) AS {k}" for k, p in _QUANTILES.items())},
    round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) AS iqr FROM long GROUP BY 1, 2""")
def describe_percentiles(spark, sf_dir):
    return rounded(statistics.describe(_long(spark, sf_dir)).select("run_id", "metric", *_QUANTILES, "iqr"), *_QUANTILES, "iqr")


@query(f"""WITH {s.LINES_SQL} SELECT run_id, metric, value AS mode FROM (SELECT run_id, metric, value, row_number() OVER (PARTITION BY run_id, metric ORDER BY count(*) DESC, value) AS k
    FROM long WHERE value IS NOT NULL GROUP BY 1, 2, 3) WHERE k = 1""")
def describe_mode(spark, sf_dir):
    return statistics.describe(_long(spark, sf_dir)).select("run_id", "metric", "mode")


@query(f"""WITH {s.LINES_SQL} SELECT run_id, metric, round(skewness(value) * (count(value) - 2) / sqrt(count(value) * (count(value) - 1.0)), 4) AS skewness, round(kurtosis_pop(value), 4) AS kurtosis FROM long GROUP BY 1, 2""")
def describe_moments(spark, sf_dir):
    return rounded(statistics.describe(_long(spark, sf_dir)).select("run_id", "metric", "skewness", "kurtosis"), "skewness", "kurtosis")


_Z = Z975
_T = f"""({_Z} + {_Z**3 + _Z} / (4 * (n - 1)) + {5 * _Z**5 + 16 * _Z**3 + 3 * _Z} / (96.0 * (n - 1) ** 2) + {3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z} / (384.0 * (n - 1) ** 3)
    + {79 * _Z**9 + 776 * _Z**7 + 1482 * _Z**5 - 1920 * _Z**3 - 945 * _Z} / (92160.0 * (n - 1) ** 4))"""


@query(f"""WITH {s.LINES_SQL} SELECT run_id, metric, round(m - {_T} * sd / sqrt(n), 4) AS ci_95_lower, round(m + {_T} * sd / sqrt(n), 4) AS ci_95_upper
    FROM (SELECT run_id, metric, count(value)::DOUBLE AS n, avg(value) AS m, stddev_samp(value) AS sd FROM long GROUP BY 1, 2)""")
def describe_ci95(spark, sf_dir):
    return rounded(statistics.describe(_long(spark, sf_dir)).select("run_id", "metric", "ci_95_lower", "ci_95_upper"), "ci_95_lower", "ci_95_upper")


@query()
def shapiro_normality(spark, sf_dir):
    return rounded(statistics.normality(_long(spark, sf_dir)), "shapiro_stat", "shapiro_p", places=6)


def _text(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


_OUT = f"""WITH {s.parts_sql()}, there AS (SELECT run_id, label, length_px AS value, row_number() OVER (PARTITION BY run_id ORDER BY label) - 1 AS pos FROM spec),
    b AS (SELECT run_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, avg(value) AS m, stddev_pop(value) AS sd FROM there GROUP BY 1)"""


@query(f"""{_OUT} SELECT run_id, round(q1 - 1.5 * (q3 - q1), 4) AS iqr_lower, round(q3 + 1.5 * (q3 - q1), 4) AS iqr_upper,
    coalesce(string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)), '') AS iqr_outliers FROM there JOIN b USING (run_id) GROUP BY run_id, q1, q3""")
def outliers_iqr(spark, sf_dir):
    made = statistics.outliers(statistics.to_long(s.parts(spark, sf_dir), ["length_px"]))
    return rounded(made.select("run_id", "iqr_lower", "iqr_upper", _text("iqr_outliers")), "iqr_lower", "iqr_upper")


@query(f"""{_OUT} SELECT run_id, coalesce(string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (sd > 0 AND abs(value - m) / sd > 3), '') AS zscore_outliers FROM there JOIN b USING (run_id) GROUP BY run_id""")
def outliers_zscore(spark, sf_dir):
    return statistics.outliers(statistics.to_long(s.parts(spark, sf_dir), ["length_px"])).select("run_id", _text("zscore_outliers"))


@query("SELECT l_suppkey AS run_id, m1, m2, round_even(r, 4) AS r FROM (" + " UNION ALL ".join(
    f"SELECT l_suppkey, '{a}' AS m1, '{b}' AS m2, corr({x}, {y}) AS r FROM lineitem GROUP BY 1" for a, x in s.LINE_METRICS.items() for b, y in s.LINE_METRICS.items()) + ")")
def correlation_long(spark, sf_dir):
    return statistics.correlation(s.lines(spark, sf_dir), list(s.LINE_METRICS))


# -- calibration

@query(f"""WITH {s.parts_sql(PPM)} SELECT run_id, label, round(length_mm, 6) AS length_mm, round(width_mm, 6) AS width_mm, round(area_mm2, 6) AS area_mm2 FROM spec""")
def mm_conversion(spark, sf_dir):
    rows = s.parts(spark, sf_dir).select("run_id", "label", "length_px", "width_px", "area_px").withColumn("pixels_per_mm", F.lit(PPM))
    return rounded(calibration.with_mm(rows).select("run_id", "label", "length_mm", "width_mm", "area_mm2"), "length_mm", "width_mm", "area_mm2", places=6)


@query("""SELECT p_partkey, round(CASE WHEN req IS NOT NULL AND req != 0 THEN req WHEN req IS NULL AND cal IS NOT NULL AND cal != 0 THEN cal WHEN f IS NULL AND f35 IS NULL THEN 40.0 * sqrt(h * w / 12e6)
    ELSE greatest(10.0, least(200.0, w / CASE WHEN f IS NOT NULL THEN (CASE WHEN f35 IS NOT NULL THEN 36.0 * f / f35 ELSE 5.76 END) * 150.0 / f ELSE 36.0 * 150.0 / 26.0 END)) END, 6) AS pixels_per_mm
    FROM (SELECT p_partkey, (600 + p_size * 40)::DOUBLE AS h, (800 + p_size * 60)::DOUBLE AS w, CASE WHEN p_partkey % 3 > 0 THEN 2 + p_size / 10.0 END::DOUBLE AS f, CASE WHEN p_partkey % 4 > 1 THEN 20 + p_size END::DOUBLE AS f35,
    CASE WHEN p_partkey % 5 = 0 THEN p_size % 3 END::DOUBLE AS req, CASE WHEN p_partkey % 7 = 0 THEN p_size % 2 END::DOUBLE AS cal FROM part)""")
def ppm_estimate(spark, sf_dir):
    k, z = F.col("p_partkey"), F.col("p_size").cast("double")
    p = s.table(spark, sf_dir, "part").select(
        "p_partkey", (600 + z * 40).alias("h"), (800 + z * 60).alias("w"), F.when(k % 3 > 0, 2 + z / 10).alias("f"), F.when(k % 4 > 1, 20 + z).alias("f35"),
        F.when(k % 5 == 0, z % 3).alias("req"), F.when(k % 7 == 0, z % 2).alias("cal"),
    )
    guess = calibration.ppm_by_camera(F.col("h"), F.col("w"), F.col("f"), F.col("f35"))
    return p.select("p_partkey", F.round(calibration.effective_ppm(F.col("req"), F.col("cal"), guess), 6).alias("pixels_per_mm"))


# -- classification, quality, grading

_CLASS = "SELECT run_id, label, array_to_string(categories, ', ') AS categories, primary_category FROM cls"


def _classes(df: DataFrame) -> DataFrame:
    return df.select("run_id", "label", F.concat_ws(", ", "categories").alias("categories"), "primary_category")


@query(f"WITH {s.classes_sql(PPM)} {_CLASS}")
def classify_mm(spark, sf_dir):
    return _classes(_classified(spark, sf_dir, PPM))


@query(f"WITH {s.classes_sql()} {_CLASS}")
def classify_px(spark, sf_dir):
    return _classes(_classified(spark, sf_dir))


_COUNTS = f"WITH {s.classes_sql()} SELECT run_id, category, count(*) AS count FROM (SELECT run_id, unnest(categories) AS category FROM cls) GROUP BY 1, 2"


@query(_COUNTS)
def category_counts(spark, sf_dir):
    return classification.category_counts(_classified(spark, sf_dir))


@query(_COUNTS)
def category_dim(spark, sf_dir):
    held = classification.category_counts(_classified(spark, sf_dir)).groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "count"))).alias("counts"))
    return held.select("run_id", F.explode("counts").alias("category", "count"))


_CORE = ("broken_pct", "abnormal_pct", "length_mean", "length_std", "width_mean", "width_std", "area_mean", "area_std", "cv_length", "cv_area", "uniformity_index", "average_aspect_ratio", "shape_consistency")


@query(f"WITH {s.quality_sql()} SELECT run_id, total_grains, {r4(*_CORE)}, long_grain_count, medium_grain_count, short_grain_count FROM qual")
def quality_core(spark, sf_dir):
    return rounded(_quality(spark, sf_dir).select("run_id", "total_grains", *_CORE, *(f"{c}_count" for c in quality.SIZES)), *_CORE)


_IMG = s.IMAGE[0] * s.IMAGE[1]


@query(f"""WITH {s.quality_sql()} SELECT run_id, round(area_sum / {_IMG}, 4) AS grain_density, round(area_sum / {_IMG}, 4) AS packing_ratio,
    round(sqrt({_IMG}::DOUBLE / total_grains) - sqrt(area_mean), 4) AS avg_inter_grain_spacing_px FROM qual""")
def quality_density_spacing(spark, sf_dir):
    c = ("grain_density", "packing_ratio", "avg_inter_grain_spacing_px")
    return rounded(_quality(spark, sf_dir).select("run_id", *c), *c)


@query(f"""WITH {s.EVENTS_SQL} SELECT run_id, round(avg(orientation_angle), 4) AS orientation_mean, round(stddev_pop(orientation_angle), 4) AS orientation_std, round(degrees(atan2(sy, cy)), 4) AS circular_mean,
    round(CASE WHEN count(*) <= 1 THEN 0 WHEN sqrt(sy * sy + cy * cy) > 0 THEN degrees(sqrt(greatest(0, -2 * ln(least(1.0, sqrt(sy * sy + cy * cy)))))) END, 4) AS circular_std
    FROM ev JOIN (SELECT run_id AS r, avg(sin(radians(orientation_angle))) AS sy, avg(cos(radians(orientation_angle))) AS cy FROM ev GROUP BY 1) ON run_id = r GROUP BY run_id, sy, cy""")
def orientation_circular(spark, sf_dir):
    a = F.col("orientation_angle")
    made = s.events(spark, sf_dir).groupBy("run_id").agg(F.avg(a).alias("orientation_mean"), F.stddev_pop(a).alias("orientation_std"), circular_mean(a).alias("circular_mean"), circular_std(a).alias("circular_std"))
    return rounded(made, *made.columns[1:])


_RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(
    f"({k}, '{g}', '{grading.LABELS[g]}', " + ", ".join(f"{v}::DOUBLE" for v in grading.LIMITS[g].values()) + ")" for k, g in enumerate(grading.GRADES)
) + ") t(grade_rank, grade, label, mb, mu, ma, mc))"


@query(f"""WITH {s.quality_sql()}, {_RULES}, c AS (SELECT run_id, grade_rank, grade, unnest([{{'criterion': 'broken_pct', 'value': broken_pct, 'threshold': mb, 'operator': '<=', 'passed': broken_pct <= mb}},
    {{'criterion': 'uniformity_index', 'value': uniformity_index, 'threshold': mu, 'operator': '>=', 'passed': uniformity_index >= mu}}, {{'criterion': 'abnormal_pct', 'value': abnormal_pct, 'threshold': ma, 'operator': '<=', 'passed': abnormal_pct <= ma}},
    {{'criterion': 'cv_length', 'value': cv_length, 'threshold': mc, 'operator': '<=', 'passed': cv_length <= mc}}]) AS c FROM qual, rules)
    SELECT run_id, grade_rank, grade, c.criterion AS criterion, round(c.value, 4) AS value, c.threshold AS threshold, c.operator AS operator, c.passed AS passed FROM c""")
def grade_checks(spark, sf_dir):
    return rounded(grading.check_rows(grading.checks(_quality(spark, sf_dir), grading.rules(spark))), "value")


_GRADED = f"""{_RULES}, best AS (SELECT run_id AS r, min(grade_rank) AS k FROM qual, rules WHERE broken_pct <= mb AND uniformity_index >= mu AND abnormal_pct <= ma AND cv_length <= mc GROUP BY 1),
    graded AS (SELECT q.*, rules.* EXCLUDE (grade), coalesce(rules.label, 'Reject') AS grade, coalesce(rules.grade, 'reject') AS grade_key FROM qual q LEFT JOIN best ON run_id = r LEFT JOIN rules ON grade_rank = k)"""


_EXPLAINED = " || chr(10) || ".join(
    ["'Sample classified as **' || label || '**.'", *(f"printf('  • {c}: %.2f {sign} %.2f → PASS', {c}, {limit})" for c, limit, sign in (("broken_pct", "mb", "<="), ("uniformity_index", "mu", ">="), ("abnormal_pct", "ma", "<="), ("cv_length", "mc", "<="))),
     "'  • Total grains: ' || total_grains", *(f"printf('  • {name}: %.2f%%', {c})" for name, c in (("Broken", "broken_pct"), ("Uniformity", "uniformity_index"), ("Abnormal", "abnormal_pct")))]
)


@query(f"""WITH {s.quality_sql()}, {_GRADED} SELECT run_id, grade, grade_key, CASE WHEN label IS NULL THEN 0 ELSE 4 END AS n_criteria, label IS NULL AS none_passed,
    CASE WHEN label IS NULL THEN '{grading.NOT_MET}' ELSE {_EXPLAINED} END AS explanation FROM graded""")
def grade_final(spark, sf_dir):
    made = _grade(spark, sf_dir)
    return made.select("run_id", "grade", "grade_key", F.size("criteria_results").alias("n_criteria"), (F.col("explanation") == grading.NOT_MET).alias("none_passed"), "explanation")


@query(f"SELECT run_id, grade, grade_key, explanation FROM ({ORACLE_SQL['grade_final']})")
def grade_in_parts(spark, sf_dir):
    """Runs whose objects are spread over three batches of a stream."""
    rows = s.parts(spark, sf_dir)
    rows = rows.join(rows.groupBy("run_id").agg(F.count("*").alias("expected")), "run_id")
    folder, files = new_folder(spark, "parts"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(files, "label").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-files // 3)).parquet(f"{folder}/in")
    parts.grade_parts(stream, f"{folder}/store", f"{folder}/progress").awaitTermination()
    return parts.grades(spark, f"{folder}/store")


# -- reports and dashboards

_UNIT = "label, round(area_mm2, 8) AS area_mm2, round(length_mm, 6) AS length_mm, round(width_mm, 6) AS width_mm"
_FLAGS_SQL = ", ".join(f"list_contains(categories, '{f}_grain') AS is_{f}" for f in reporting.FLAGS)


@query(f"""WITH {s.classes_sql(PPM)} SELECT run_id, {_UNIT}, round(aspect_ratio, 6) AS aspect_ratio, circularity, round(solidity, 6) AS solidity, eccentricity, orientation_angle, primary_category,
    array_to_string(categories, ', ') AS categories, {_FLAGS_SQL}, 'mm' AS unit_suffix FROM cls""")
def dashboard_grains(spark, sf_dir):
    made = rounded(reporting.grains(_classified(spark, sf_dir, PPM)), "length_mm", "width_mm", "aspect_ratio", "solidity", places=6)
    return rounded(made, "area_mm2", places=8)


@query(f"WITH {s.classes_sql(PPM)} SELECT run_id, round(length_mm, 4) AS x, round(width_mm, 4) AS y, primary_category AS category FROM cls")
def scatter_points(spark, sf_dir):
    return rounded(reporting.scatter(reporting.grains(_classified(spark, sf_dir, PPM))), "x", "y")


def _hist_sql(with_cte: str, source: str, column: str, bins: int) -> str:
    return f"""WITH {with_cte}, ends AS (SELECT run_id, min({column}) AS lo, max({column}) AS hi, (max({column}) - min({column})) / {bins} AS step FROM {source} GROUP BY 1),
    n AS (SELECT run_id, CASE WHEN step > 0 THEN least(floor(({column} - lo) / step), {bins - 1}) ELSE 0 END::INT AS bin, count(*) AS n FROM {source} JOIN ends USING (run_id) GROUP BY 1, 2)
    SELECT e.run_id, e.bin::INT AS bin, CASE WHEN step > 0 THEN printf('%.2f', lo + e.bin * step) || '-' || printf('%.2f', lo + (e.bin + 1) * step) ELSE printf('%.2f', lo) END AS bin_label, coalesce(n, 0) AS count FROM (SELECT *, unnest(range(CASE WHEN step > 0 THEN {bins} ELSE 1 END)) AS bin FROM ends) e LEFT JOIN n ON e.run_id = n.run_id AND e.bin = n.bin"""


@query(_hist_sql(s.parts_sql(), "spec", "length_px", 8))
def histogram8(spark, sf_dir):
    return reporting.histogram(s.parts(spark, sf_dir), "length_px", 8)


@query(_hist_sql(s.EVENTS_SQL, "ev", "value", 30))
def hist30(spark, sf_dir):
    return reporting.histogram(s.events(spark, sf_dir), "value", 30)


@query(f"""WITH {s.quality_sql(PPM)}, {_GRADED} SELECT g.run_id, total_grains, round(broken_pct, 4) AS broken_pct, round(uniformity_index, 4) AS uniformity_index, grade,
    round(ml, 4) AS mean_length, round(mw, 4) AS mean_width, round(mar, 4) AS mean_area, round(cvl, 4) AS cv_length FROM graded g JOIN (SELECT run_id, avg(length_mm) AS ml, avg(width_mm) AS mw, avg(area_mm2) AS mar,
    stddev_samp(length_mm) / avg(length_mm) * 100 AS cvl FROM spec GROUP BY 1) m ON g.run_id = m.run_id""")
def kpi_row(spark, sf_dir):
    rows = s.parts(spark, sf_dir, PPM)
    described = statistics.describe(statistics.to_long(rows, ["length_mm", "width_mm", "area_mm2", "length_px", "width_px", "area_px"]))
    made = reporting.kpis(_quality(spark, sf_dir, PPM), _grade(spark, sf_dir, PPM), described, statistics.totals(rows))
    return rounded(made, "broken_pct", "uniformity_index", "mean_length", "mean_width", "mean_area", "cv_length")


@query(f"""WITH {s.quality_sql()}, {_GRADED}, r AS (SELECT run_id, total_grains AS num_grains, grade, round(broken_pct, 4) AS broken_pct, round(uniformity_index, 4) AS uniformity_index,
    run_id LIKE '%-k1%' AS has_annotated FROM graded) SELECT * FROM r WHERE run_id = (SELECT max(run_id) FROM r)""")
def run_summary_latest(spark, sf_dir):
    runs = s.parts(spark, sf_dir).select("run_id").distinct()
    made = reporting.summaries(runs, _quality(spark, sf_dir), _grade(spark, sf_dir), runs.where(F.col("run_id").contains("-k1")))
    return rounded(reporting.latest(made), "broken_pct", "uniformity_index")


@query(f"""WITH {s.classes_sql()} SELECT a.run_id, a.label, round(a.length_px, 4) AS length_px, b.primary_category FROM spec a LEFT JOIN (SELECT run_id, label, primary_category FROM cls WHERE label % 10 != 0) b
    ON a.run_id = b.run_id AND a.label = b.label""")
def measurements_left_join_class(spark, sf_dir):
    classes = _classified(spark, sf_dir).where("label % 10 != 0").select("run_id", "label", "primary_category")
    return rounded(reporting.left_join_classes(s.parts(spark, sf_dir).select("run_id", "label", "length_px"), classes), "length_px")


@query(f"""WITH {s.classes_sql()}, a AS (SELECT run_id, label, row_number() OVER (PARTITION BY run_id ORDER BY label) AS k FROM spec),
    b AS (SELECT run_id, primary_category, row_number() OVER (PARTITION BY run_id ORDER BY label) AS k FROM cls WHERE label % 10 != 0) SELECT a.run_id, a.label, b.primary_category FROM a JOIN b USING (run_id, k)""")
def zip_join(spark, sf_dir):
    classes = _classified(spark, sf_dir).where("label % 10 != 0").select("run_id", "label", "primary_category")
    return reporting.zip_join(s.parts(spark, sf_dir).select("run_id", "label"), classes)


@query(f"""WITH {s.parts_sql()} SELECT run_id, count(*) AS n, round(regr_slope(width_px, length_px), 6) AS slope, round(regr_intercept(width_px, length_px), 4) AS intercept FROM spec GROUP BY 1 HAVING count(*) > 2""")
def regression_trend(spark, sf_dir):
    return rounded(rounded(reporting.trend(s.parts(spark, sf_dir), "length_px", "width_px"), "slope", places=6), "intercept")


@query(f"""WITH {s.parts_sql()}, q AS (SELECT run_id, quantile_cont(length_px, 0.25) AS q1, quantile_cont(length_px, 0.5) AS median, quantile_cont(length_px, 0.75) AS q3 FROM spec GROUP BY 1),
    b AS (SELECT *, length_px BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM spec JOIN q USING (run_id))
    SELECT run_id, 'length_px' AS metric, {r4("q1", "median", "q3")}, round(min(length_px) FILTER (inside), 4) AS whisker_low, round(max(length_px) FILTER (inside), 4) AS whisker_high,
    count(*) FILTER (NOT inside) AS n_beyond FROM b GROUP BY run_id, q1, median, q3""")
def boxplot_summary(spark, sf_dir):
    made = reporting.box_plot(statistics.to_long(s.parts(spark, sf_dir), ["length_px"]))
    return rounded(made, "q1", "median", "q3", "whisker_low", "whisker_high")


@query(f"""WITH {s.parts_sql()}, e AS (SELECT run_id, count(*) AS n, min(length_px) AS lo, max(length_px) AS hi, stddev_samp(length_px) * count(*) ** -0.2 AS h FROM spec GROUP BY 1 HAVING count(*) >= 6 AND stddev_samp(length_px) > 0),
    p AS (SELECT *, lo + point * (hi - lo) / 19 AS x FROM (SELECT *, unnest(range(20)) AS point FROM e))
    SELECT p.run_id, point::INT AS point, round(x, 4) AS x, round(sum(exp(-(((x - length_px) / h) ** 2) / 2)) / (n * h * sqrt(2 * pi())), 8) AS density FROM p JOIN spec USING (run_id) GROUP BY p.run_id, point, x, n, h""")
def kde_grid(spark, sf_dir):
    return rounded(rounded(reporting.density(s.parts(spark, sf_dir), "length_px", points=20), "x"), "density", places=8)


@query(f"""WITH {s.quality_sql()}, {_GRADED}, f AS (SELECT run_id, unnest([{{'k': 0, 'm': 'Total Grains', 'v': total_grains::VARCHAR}}, {{'k': 1, 'm': 'Broken Grains', 'v': printf('%.2f %%', broken_pct)}},
    {{'k': 2, 'm': 'Abnormal Grains', 'v': printf('%.2f %%', abnormal_pct)}}, {{'k': 3, 'm': 'Uniformity Index', 'v': printf('%.2f %%', uniformity_index)}}, {{'k': 4, 'm': 'CV of Length', 'v': printf('%.2f %%', cv_length)}},
    {{'k': 5, 'm': 'Avg Aspect Ratio', 'v': printf('%.2f', average_aspect_ratio)}}, {{'k': 6, 'm': 'Shape Consistency', 'v': printf('%.2f %%', shape_consistency)}}, {{'k': 7, 'm': 'Grain Density', 'v': printf('%.4f', area_sum / {_IMG})}},
    {{'k': 8, 'm': 'Final Grade', 'v': grade}}]) AS r FROM graded) SELECT run_id, r.k AS row_no, r.m AS metric, r.v AS value FROM f""")
def quality_table_rows(spark, sf_dir):
    return reporting.quality_table(_quality(spark, sf_dir), _grade(spark, sf_dir))


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS e_0, round(embedding[2]::DOUBLE, 6) AS e_1, round(embedding[3]::DOUBLE, 6) AS e_2 FROM embeddings")
def flatten_list_columns(spark, sf_dir):
    rows = s.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return rounded(reporting.flatten_lists(rows, {"e": 3}), "e_0", "e_1", "e_2", places=6)


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_partkey::VARCHAR || ' ' || coalesce(p_name, '') || ' ' || coalesce(p_brand, '')), '#1')")
def text_search(spark, sf_dir):
    return reporting.search(s.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), "#1")


@query(f"WITH {s.parts_sql()} SELECT run_id, label, round(length_px, 4) AS length_px FROM spec WHERE length_px BETWEEN 1000 AND 1200")
def range_slicer(spark, sf_dir):
    return rounded(reporting.sliced(s.parts(spark, sf_dir).select("run_id", "label", "length_px"), "length_px", 1000, 1200), "length_px")


_COLOUR_SQL = "CASE primary_category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in reporting.CATEGORY_COLOURS.items()) + f" ELSE '{reporting.CATEGORY_COLOURS['whole_grain']}' END"


@query(f"WITH {s.classes_sql(PPM)} SELECT run_id, label, {_COLOUR_SQL} AS colour, printf('%.1fx%.1fmm', length_mm, width_mm) AS size_text FROM cls")
def annotation_text(spark, sf_dir):
    return reporting.annotations(_classified(spark, sf_dir, PPM)).select("run_id", "label", "colour", "size_text")


_ALL_FLAGS = ("whole", "broken", "long", "medium", "short", "oversized", "undersized", "abnormal")


@query(f"""WITH {s.classes_sql(PPM)} SELECT run_id, label, round(area_mm2, 8) AS area_mm2, round(length_mm, 6) AS length_mm, round(width_mm, 6) AS width_mm, round(aspect_ratio, 6) AS aspect_ratio, circularity, round(solidity, 6) AS solidity,
    eccentricity, orientation_angle, primary_category, {", ".join(f"list_contains(categories, '{f}_grain') AS is_{f}" for f in _ALL_FLAGS)} FROM cls""")
def grain_facts(spark, sf_dir):
    made = rounded(reporting.facts(_classified(spark, sf_dir, PPM)).drop("perimeter_mm"), "length_mm", "width_mm", "aspect_ratio", "solidity", places=6)
    return rounded(made, "area_mm2", places=8)


@query(f"WITH {s.parts_sql()} SELECT run_id, label, printf('%.2f', length_px) AS length_px, printf('%.2f', width_px) AS width_px, coalesce(CASE WHEN label % 10 != 0 THEN printf('%.2f', area_px) END, '—') AS area_px FROM spec")
def measurement_text(spark, sf_dir):
    rows = s.parts(spark, sf_dir).withColumn("area_px", F.when(F.col("label") % 10 != 0, F.col("area_px")))
    return reporting.as_text(rows, "length_px", "width_px", "area_px", first=())


@query(f"""WITH {s.EVENTS_SQL}, b AS (SELECT run_id, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, avg(value) AS mean, stddev_pop(value) AS sd FROM ev WHERE value IS NOT NULL GROUP BY 1)
    SELECT run_id, 'value' AS metric, count(*) FILTER (n >= 4 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)))::INT AS n_iqr, count(*) FILTER (n >= 4 AND sd > 0 AND abs(value - mean) / sd > 3)::INT AS n_zscore
    FROM ev JOIN b USING (run_id) WHERE value IS NOT NULL GROUP BY 1""")
def outlier_counts(spark, sf_dir):
    return statistics.outlier_counts(statistics.outliers(statistics.to_long(s.events(spark, sf_dir), ["value"])))


@query(f"""WITH {s.quality_sql()}, {_GRADED}, g AS (SELECT run_id, grade, grade_key, run_id AS found FROM graded WHERE run_id LIKE '%-k1%'), m AS (SELECT run_id, round(avg(length_px), 4) AS mean FROM spec WHERE run_id LIKE '%-k1%' GROUP BY 1)
    SELECT r.run_id, m.mean, CASE WHEN m.mean IS NULL THEN 'No grains to analyze' END AS error, coalesce(grade, '{grading.NO_OBJECTS}') AS grade, coalesce(grade_key, 'reject') AS grade_key
    FROM (SELECT DISTINCT run_id FROM spec) r LEFT JOIN g ON r.run_id = g.run_id LEFT JOIN m ON r.run_id = m.run_id""")
def empty_runs(spark, sf_dir):
    rows = s.parts(spark, sf_dir)
    runs, found = rows.select("run_id").distinct(), F.col("run_id").contains("-k1")
    described = statistics.describe(statistics.to_long(rows.where(found), ["length_px"])).select("run_id", "metric", "mean")
    graded = grading.with_empty_runs(runs, _grade(spark, sf_dir).where(found)).select("run_id", "grade", "grade_key")
    return rounded(statistics.with_empty_runs(runs, described).drop("metric"), "mean").join(graded, "run_id")


# -- shapes

_POLY = ("area_px", "perimeter_px", "centroid_x", "centroid_y", "equivalent_diameter_px", "circularity", "extent")


@query(f"""WITH {s.POLYGONS_SQL}, f AS (SELECT run_id, label, sum(x * y2 - x2 * y) / 2 AS a, sum((x + x2) * (x * y2 - x2 * y)) / 6 AS mx, sum((y + y2) * (x * y2 - x2 * y)) / 6 AS my, sum(sqrt((x2 - x) ** 2 + (y2 - y) ** 2)) AS p,
    min(x)::BIGINT AS bbox_x, min(y)::BIGINT AS bbox_y, (max(x) - min(x) + 1)::BIGINT AS bbox_w_px, (max(y) - min(y) + 1)::BIGINT AS bbox_h_px FROM edge GROUP BY 1, 2)
    SELECT run_id, label, round(abs(a), 4) AS area_px, round(p, 4) AS perimeter_px, bbox_x, bbox_y, bbox_w_px, bbox_h_px, round(CASE WHEN a = 0 THEN 0 ELSE mx / a END, 4) AS centroid_x, round(CASE WHEN a = 0 THEN 0 ELSE my / a END, 4) AS centroid_y,
    round(sqrt(4 * abs(a) / pi()), 4) AS equivalent_diameter_px, round(CASE WHEN p = 0 THEN 0 ELSE 4 * pi() * abs(a) / (p * p) END, 4) AS circularity, round(abs(a) / (bbox_w_px * bbox_h_px), 4) AS extent FROM f""")
def polygon_features(spark, sf_dir):
    return rounded(geometry.polygon_features(s.polygons(spark, sf_dir)), *_POLY)


_HU = [f"hu_moments_{k}" for k in range(7)]


@query(f"""WITH {s.POLYGONS_SQL}, c AS (SELECT *, x * y2 - x2 * y AS w FROM edge), m AS (SELECT run_id, label, sum(w) / 2 AS m00, sum(w * (x + x2)) / 6 AS m10, sum(w * (y + y2)) / 6 AS m01, sum(w * (x * x + x * x2 + x2 * x2)) / 12 AS m20,
    sum(w * (x * (2 * y + y2) + x2 * (y + 2 * y2))) / 24 AS m11, sum(w * (y * y + y * y2 + y2 * y2)) / 12 AS m02 FROM c GROUP BY 1, 2),
    n AS (SELECT run_id, label, (m20 - m10 * m10 / m00) / m00 ** 2 AS n20, (m02 - m01 * m01 / m00) / m00 ** 2 AS n02, (m11 - m10 * m01 / m00) / m00 ** 2 AS n11 FROM (SELECT run_id, label, abs(m00) AS m00, sign(m00) * m10 AS m10,
    sign(m00) * m01 AS m01, sign(m00) * m20 AS m20, sign(m00) * m11 AS m11, sign(m00) * m02 AS m02 FROM m WHERE m00 != 0))
    SELECT run_id, label, round(sign(h1) * ln(1 + abs(h1)), 6) AS hu_moments_0, round(sign(h2) * ln(1 + abs(h2)), 6) AS hu_moments_1 FROM (SELECT run_id, label, n20 + n02 AS h1, (n20 - n02) ** 2 + 4 * n11 ** 2 AS h2 FROM n)""")
def hu_moments(spark, sf_dir):
    made = geometry.hu_moments(s.polygons(spark, sf_dir)).select("run_id", "label", "hu_moments_0", "hu_moments_1")
    return rounded(made, "hu_moments_0", "hu_moments_1", places=6)


_HU_FORMS = (
    "n20 + n02", "(n20 - n02) ** 2 + 4 * n11 ** 2", "r * r + s * s", "p * p + q * q", "r * p * (p * p - 3 * q * q) + s * q * (3 * p * p - q * q)",
    "(n20 - n02) * (p * p - q * q) + 4 * n11 * p * q", "s * p * (p * p - 3 * q * q) - r * q * (3 * p * p - q * q)",
)


# moments of the polygon moved to its centroid, unlike the operator's
@query(f"""WITH {s.POLYGONS_SQL}, c AS (SELECT run_id, label, sum(x * y2 - x2 * y) / 2 AS a, sum((x + x2) * (x * y2 - x2 * y)) / 6 AS mx, sum((y + y2) * (x * y2 - x2 * y)) / 6 AS my FROM edge GROUP BY 1, 2),
    u AS (SELECT run_id, label, sign(a) AS sg, abs(a) AS a, x - mx / a AS x, y - my / a AS y, x2 - mx / a AS x2, y2 - my / a AS y2 FROM edge JOIN c USING (run_id, label) WHERE a != 0), w AS (SELECT *, sg * (x * y2 - x2 * y) AS w FROM u),
    n AS (SELECT run_id, label, sum(w * (x * x + x * x2 + x2 * x2)) / 12 / a ** 2 AS n20, sum(w * (y * y + y * y2 + y2 * y2)) / 12 / a ** 2 AS n02, sum(w * (x * (2 * y + y2) + x2 * (y + 2 * y2))) / 24 / a ** 2 AS n11,
    sum(w * (x ** 3 + x * x * x2 + x * x2 * x2 + x2 ** 3)) / 20 / a ** 2.5 AS n30, sum(w * (y ** 3 + y * y * y2 + y * y2 * y2 + y2 ** 3)) / 20 / a ** 2.5 AS n03,
    sum(w * (x * x * (3 * y + y2) + 2 * x * x2 * (y + y2) + x2 * x2 * (y + 3 * y2))) / 60 / a ** 2.5 AS n21, sum(w * (y * y * (3 * x + x2) + 2 * y * y2 * (x + x2) + y2 * y2 * (x + 3 * x2))) / 60 / a ** 2.5 AS n12 FROM w GROUP BY run_id, label, a),
    h AS (SELECT run_id, label, {", ".join(f"{form} AS h{k}" for k, form in enumerate(_HU_FORMS))} FROM (SELECT *, n30 + n12 AS p, n21 + n03 AS q, n30 - 3 * n12 AS r, 3 * n21 - n03 AS s FROM n))
    SELECT run_id, label, {", ".join(f"round(sign(h{k}) * ln(1 + abs(h{k})), 9) + 0.0::DOUBLE AS hu_moments_{k}" for k in range(7))} FROM h""")
def hu_moments_all(spark, sf_dir):
    made = rounded(geometry.hu_moments(s.polygons(spark, sf_dir)), *_HU, places=9)
    return made.select("run_id", "label", *((F.col(c) + F.lit(0.0)).alias(c) for c in _HU))


@query(f"""WITH {s.RASTER_SQL}, o AS (SELECT run_id, v // 25 AS label, y, x FROM px WHERE v >= 25), c AS (SELECT run_id, label, avg(x) AS cx, avg(y) AS cy FROM o GROUP BY 1, 2),
    r AS (SELECT run_id, label, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS r FROM o JOIN c USING (run_id, label)), m AS (SELECT run_id, label, CASE WHEN max(r) > 0 THEN max(r) ELSE 1 END AS rm FROM r GROUP BY 1, 2)
    SELECT run_id, label, {", ".join(f"round(avg((r / rm) ** {n}), 6) AS zernike_moments_{n}" for n in range(5))} FROM r JOIN m USING (run_id, label) GROUP BY 1, 2""")
def radial_moments(spark, sf_dir):
    px = s.raster(spark, sf_dir).where("v >= 25").select("run_id", F.floor(F.col("v") / 25).alias("label"), "y", "x")
    return rounded(geometry.radial_moments(px), *(f"zernike_moments_{n}" for n in range(5)), places=6)


_TWO = [(i, j) for i in range(5) for j in range(5 - i)]
_m = lambda *p: "s" + "".join(str(k) for k in map(sum, zip(*p)))
_QUAD, _LINE = ((2, 0), (1, 1), (0, 2)), ((1, 0), (0, 1), (0, 0))
# about the centre the linear terms only meet each other: t = -(s3 inverse)(s2 transposed), row by row
_T = [[f"-(s02 * {_m(q, (1, 0))} - s11 * {_m(q, (0, 1))}) / (s20 * s02 - s11 * s11)" for q in _QUAD], [f"-(s20 * {_m(q, (0, 1))} - s11 * {_m(q, (1, 0))}) / (s20 * s02 - s11 * s11)" for q in _QUAD], [f"-{_m(q, (0, 0))} / s00" for q in _QUAD]]
_A = [[f"{_m(p, q)} + " + " + ".join(f"{_m(p, r)} * t{k}{j}" for k, r in enumerate(_LINE)) for j, q in enumerate(_QUAD)] for p in _QUAD]
_cross = lambda i, j: [f"(m{i}1 * m{j}2 - m{i}2 * m{j}1)", f"(m{i}2 * m{j}0 - m{i}0 * m{j}2)", f"(m{i}0 * m{j}1 - m{i}1 * m{j}0)"]
# the cubic of a matrix of three rows has one positive root, the greatest; the vector stands on two rows of the matrix less the root
_ELLIPSE_SQL = f"""mid AS (SELECT run_id, label, avg(x) AS cx, avg(y) AS cy, greatest(max(x) - avg(x), avg(x) - min(x), max(y) - avg(y), avg(y) - min(y)) AS scale FROM poly GROUP BY 1, 2),
    sums AS (SELECT run_id, label, scale, {", ".join(f"sum(u ** {i} * v ** {j}) AS s{i}{j}" for i, j in _TWO)} FROM (SELECT run_id, label, scale, (x - cx) / scale AS u, (y - cy) / scale AS v FROM poly JOIN mid USING (run_id, label)) GROUP BY 1, 2, 3),
    t AS (SELECT *, {", ".join(f"{_T[k][j]} AS t{k}{j}" for k in range(3) for j in range(3))} FROM sums WHERE s00 >= 5 AND (s20 * s02 - s11 * s11) / (s00 * s00) > 1e-12),
    m AS (SELECT *, {", ".join(f"({_A[2][j]}) / 2 AS m0{j}, -({_A[1][j]}) AS m1{j}, ({_A[0][j]}) / 2 AS m2{j}" for j in range(3))} FROM t),
    tr AS (SELECT *, (m00 + m11 + m22) / 3 AS c FROM m), q AS (SELECT *, ((m00 - c) ** 2 + (m11 - c) ** 2 + (m22 - c) ** 2 + 2 * (m01 * m10 + m02 * m20 + m12 * m21)) / 6 AS p2 FROM tr),
    w AS (SELECT * REPLACE (m00 - root AS m00, m11 - root AS m11, m22 - root AS m22) FROM (SELECT *, c + 2 * sqrt(p2) * cos(acos(greatest(-1, least(1, ((m00 - c) * ((m11 - c) * (m22 - c) - m12 * m21) - m01 * (m10 * (m22 - c) - m12 * m20) + m02 * (m10 * m21 - (m11 - c) * m20)) / (2 * p2 * sqrt(p2))))) / 3) AS root FROM q)),
    v AS (SELECT *, CASE WHEN n01 >= n02 AND n01 >= n12 THEN v01 WHEN n02 >= n12 THEN v02 ELSE v12 END AS e FROM (SELECT *, {", ".join(f"[{', '.join(_cross(i, j))}] AS v{i}{j}, {' + '.join(f'{c} ** 2' for c in _cross(i, j))} AS n{i}{j}" for i, j in ((0, 1), (0, 2), (1, 2)))} FROM w)),
    conic AS (SELECT run_id, label, scale, a, b, c, (b * e - 2 * c * d) / (4 * a * c - b * b) AS x0, (b * d - 2 * a * e) / (4 * a * c - b * b) AS y0, f FROM (SELECT run_id, label, scale, e[1] AS a, e[2] AS b, e[3] AS c, {", ".join(f"t{k}0 * e[1] + t{k}1 * e[2] + t{k}2 * e[3] AS {n}" for k, n in ((0, "d"), (1, "g"), (2, "f")))} FROM v) z(run_id, label, scale, a, b, c, d, e, f)),
    axes AS (SELECT run_id, label, scale, a, b, c, a * x0 * x0 + b * x0 * y0 + c * y0 * y0 - f AS level, (a + c + sqrt((a - c) ** 2 + b * b)) / 2 AS v1, (a + c - sqrt((a - c) ** 2 + b * b)) / 2 AS v2 FROM conic WHERE 4 * a * c > b * b),
    ellipse AS (SELECT run_id, label, 2 * scale * sqrt(greatest(level / v1, level / v2)) AS long, 2 * scale * sqrt(least(level / v1, level / v2)) AS short, degrees(atan2(b, a - c)) / 2 + CASE WHEN level > 0 THEN 90 ELSE 0 END AS turn FROM axes WHERE level / v1 > 0)"""


# a side of the hull has no point to its right and none on its line beyond its ends
@query(f"""WITH {s.POLYGONS_SQL}, pt AS (SELECT DISTINCT run_id, label, x, y FROM poly), {_ELLIPSE_SQL},
    side AS (SELECT a.run_id, a.label, a.x, a.y, b.x AS x2, b.y AS y2 FROM pt a JOIN pt b ON a.run_id = b.run_id AND a.label = b.label AND (a.x != b.x OR a.y != b.y) JOIN pt p ON a.run_id = p.run_id AND a.label = p.label GROUP BY ALL
        HAVING min((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x)) >= 0 AND bool_and((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x) > 0 OR (b.x - a.x) * (p.x - a.x) + (b.y - a.y) * (p.y - a.y) BETWEEN 0 AND (b.x - a.x) ** 2 + (b.y - a.y) ** 2)),
    hull AS (SELECT run_id, label, sum(x * y2 - x2 * y)::DOUBLE / 2 AS area, sum(sqrt((x2 - x) ** 2 + (y2 - y) ** 2)) AS around FROM side GROUP BY 1, 2),
    turned AS (SELECT run_id, label, x, y, x2, y2, round(degrees(atan2(y2 - y, x2 - x)), 9) AS turn, sqrt((x2 - x) ** 2 + (y2 - y) ** 2) AS len FROM side),
    wide AS (SELECT e.run_id, e.label, turn, floor(turn / 90) + 1 AS quarters, (max((x2 - e.x) * p.x + (y2 - e.y) * p.y) - min((x2 - e.x) * p.x + (y2 - e.y) * p.y)) / any_value(len) AS w, (max((x2 - e.x) * p.y - (y2 - e.y) * p.x) - min((x2 - e.x) * p.y - (y2 - e.y) * p.x)) / any_value(len) AS h
        FROM turned e JOIN pt p ON e.run_id = p.run_id AND e.label = p.label GROUP BY e.run_id, e.label, e.x, e.y, x2, y2, turn),
    rect AS (SELECT run_id, label, CASE WHEN quarters % 2 = 0 THEN w ELSE h END AS w, CASE WHEN quarters % 2 = 0 THEN h ELSE w END AS h, turn - 90 * quarters AS angle FROM wide QUALIFY row_number() OVER (PARTITION BY run_id, label ORDER BY round(w * h, 6), round(turn - 90 * quarters, 6), turn) = 1),
    far AS (SELECT a.run_id, a.label, max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS widest, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS nearest FROM poly a JOIN poly b ON a.run_id = b.run_id AND a.label = b.label AND a.seq < b.seq GROUP BY 1, 2)
    SELECT run_id, label, round(area, 4) AS hull_area_px, round(around, 4) AS hull_perimeter_px, round(w, 4) AS rot_rect_w_px, round(h, 4) AS rot_rect_h_px, round(angle, 4) AS rot_rect_angle, round(coalesce(sqrt(greatest(0, 1 - (short / long) ** 2)), 0), 4) AS eccentricity,
    round((coalesce(turn + 90, angle) + 360) % 180, 4) AS orientation_angle, round(coalesce(long, widest), 4) AS feret_max_px, round(coalesce(short, nearest), 4) AS feret_min_px FROM hull JOIN rect USING (run_id, label) JOIN far USING (run_id, label) LEFT JOIN ellipse USING (run_id, label)""")
def hull_rect_ellipse(spark, sf_dir):
    return rounded(geometry.whole_shapes(s.polygons(spark, sf_dir)), *geometry.SHAPE)


# -- rasters

@query(f"""WITH {s.RASTER_SQL}, h AS (SELECT run_id, v, count(*) AS n FROM px GROUP BY 1, 2), c AS (SELECT run_id, v, sum(n) OVER w AS n0, sum(n * v) OVER w AS s0, sum(n) OVER (PARTITION BY run_id) AS nt, sum(n * v) OVER (PARTITION BY run_id) AS st
    FROM h WINDOW w AS (PARTITION BY run_id ORDER BY v)), b AS (SELECT run_id, v, round(CASE WHEN nt > n0 THEN n0::DOUBLE * (nt - n0) * (s0::DOUBLE / n0 - (st - s0)::DOUBLE / (nt - n0)) ** 2 ELSE 0 END, 4) AS b FROM c)
    SELECT run_id, v AS level FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY b DESC, v) AS k FROM b) WHERE k = 1""")
def otsu_threshold(spark, sf_dir):
    return raster.otsu_level(s.raster(spark, sf_dir))


@query(f"""WITH {s.RASTER_SQL}, m AS (SELECT run_id, avg(v) FILTER (y < 10 OR y >= 54 OR x < 10 OR x >= 54) AS b, avg(v) FILTER (NOT (y < 10 OR y >= 54 OR x < 10 OR x >= 54)) AS c, avg(v) AS o,
    sum(v * ((y < 15 OR y >= 49)::INT + (x < 15 OR x >= 49)::INT)) / sum((y < 15 OR y >= 49)::INT + (x < 15 OR x >= 49)::INT)::DOUBLE AS wb FROM px GROUP BY 1)
    SELECT run_id, round(b, 4) AS border_mean, round(c, 4) AS center_mean, round(o, 4) AS overall_mean, round(wb, 4) AS wide_border_mean,
    CASE WHEN b < 80 AND o < 120 THEN 'bright_on_dark' WHEN b > 150 THEN 'dark_on_bright' WHEN b < c - 20 THEN 'bright_on_dark' ELSE 'auto' END AS polarity, wb < 50 AND o < 100 AS black_background FROM m""")
def border_polarity(spark, sf_dir):
    return rounded(raster.border(s.raster(spark, sf_dir)), "border_mean", "center_mean", "overall_mean", "wide_border_mean")


@query(f"""WITH RECURSIVE {s.RASTER_SQL}, p AS (SELECT run_id, y, x, y * 64 + x AS id FROM px WHERE v > 170), reach AS (SELECT run_id, y, x, id FROM p UNION SELECT q.run_id, q.y, q.x, r.id FROM reach r JOIN p q
    ON q.run_id = r.run_id AND abs(q.y - r.y) <= 1 AND abs(q.x - r.x) <= 1), l AS (SELECT run_id, y, x, min(id) AS root FROM reach GROUP BY 1, 2, 3), a AS (SELECT run_id, root, count(*) AS area FROM l GROUP BY 1, 2)
    SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY root) AS label, area FROM a WHERE area BETWEEN 3 AND 500""")
def connected_components_area(spark, sf_dir):
    binary = s.raster(spark, sf_dir).withColumn("v", F.when(F.col("v") > 170, 255).otherwise(0).cast("long"))
    return raster.areas(raster.filter_area(raster.components(binary), 3, 500)).withColumn("label", F.col("label").cast("long"))


@query(f"WITH {s.RASTER_SQL} SELECT run_id, y, x, v FROM px")
def tile_and_stitch_max(spark, sf_dir):
    px = s.raster(spark, sf_dir)
    size = px.groupBy("run_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    return raster.stitch_max(raster.cut_tiles(px, raster.tile_origins(size, 24, 6), 24))


def _raster_size(px: DataFrame) -> DataFrame:
    return px.groupBy("run_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


@query(f"WITH {s.RASTER_SQL} SELECT run_id, unnest(range(9))::INT AS view, y, x, v FROM px")
def views_and_back(spark, sf_dir):
    px = s.raster(spark, sf_dir)
    made = raster.undo_views(raster.test_time_views(px, _raster_size(px)), _raster_size(px))
    return made.select("run_id", "view", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "v")


@query(f"""WITH {s.RASTER_SQL}, o AS (SELECT * FROM (VALUES (0), (18), (36), (40)) t(o)), t AS (SELECT px.*, a.o AS ty, b.o AS tx, exp(-((y - a.o - 12) ** 2 + (x - b.o - 12) ** 2) / 32.0) AS wt FROM px, o a, o b
    WHERE y BETWEEN a.o AND a.o + 23 AND x BETWEEN b.o AND b.o + 23) SELECT run_id, y, x, round(sum((v + ty + tx) * wt) / sum(wt), 4) AS v FROM t GROUP BY 1, 2, 3""")
def tile_and_stitch_weighted(spark, sf_dir):
    px = s.raster(spark, sf_dir)
    tiles = raster.cut_tiles(px, raster.tile_origins(_raster_size(px), 24, 6), 24).withColumn("v", F.col("v") + F.col("ty") + F.col("tx"))
    return rounded(raster.stitch_weighted(tiles, raster.tile_weight(24)), "v")


@query(f"""WITH {s.RASTER_SQL}, l AS (SELECT DISTINCT run_id, v // 25 AS label FROM px WHERE v >= 25), h AS (SELECT run_id, label, floor(CASE WHEN k > 0 AND k = n - 1 THEN 179 WHEN n > 1 THEN k * (179.0::DOUBLE / (n - 1)) ELSE 0 END)::BIGINT AS hue
    FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY label) - 1 AS k, count(*) OVER (PARTITION BY run_id) AS n FROM l))
    SELECT run_id, label, hue, {", ".join(f"round(255 * greatest(0, least(1, abs(fmod(hue / 30.0::DOUBLE + {k}, 6) - 3) - 1)))::INT AS {c}" for c, k in (("r", 0), ("g", 4), ("b", 2)))} FROM h""")
def label_colours(spark, sf_dir):
    return raster.label_colours(s.raster(spark, sf_dir).select("run_id", F.floor(F.col("v") / 25).alias("label")))


@query(f"""WITH {s.RASTER_SQL}, d AS (SELECT a.run_id, a.y, a.x, CASE WHEN any_value(a.v) <= 100 THEN 0 ELSE coalesce(sqrt(min((a.y - b.y) ** 2 + (a.x - b.x) ** 2)), 64 * 64 + 1) END::DOUBLE AS d FROM px a LEFT JOIN px b ON a.run_id = b.run_id AND b.v <= 100 GROUP BY 1, 2, 3)
    SELECT run_id, y, x, round(d, 6) AS d, CASE WHEN m > 0 THEN floor(d / m * 255) ELSE 0 END::BIGINT AS view FROM (SELECT *, max(d) OVER (PARTITION BY run_id) AS m FROM d)""")
def distance_view(spark, sf_dir):
    binary = s.raster(spark, sf_dir).withColumn("v", F.when(F.col("v") > 100, 255).otherwise(0).cast("long"))
    return rounded(raster.distances(binary), "d", places=6)


@query(f"""WITH {s.RASTER_SQL}, m AS (SELECT run_id, CASE WHEN run_id < 2 AND max(v) > 170 THEN 'bright' ELSE 'all' END AS method FROM px GROUP BY 1)
    SELECT run_id, method, count(*) AS n FROM px JOIN m USING (run_id) WHERE v > CASE method WHEN 'bright' THEN 170 ELSE 100 END GROUP BY 1, 2""")
def strategy_cascade(spark, sf_dir):
    px = s.raster(spark, sf_dir)
    made = lambda test: px.withColumn("label", F.when(test, 1).otherwise(0))
    found = raster.first_with_objects({"model": None, "bright": made((F.col("run_id") < 2) & (F.col("v") > 170)), "all": made(F.col("v") > 100)})
    return found.where("label > 0").groupBy("run_id", "method").agg(F.count("*").alias("n"))
