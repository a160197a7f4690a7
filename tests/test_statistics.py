import numpy as np
import pytest

from sievestone.functions.expr import t_quantile, t_series, t_upper
from sievestone.operators.statistics import METRICS, correlation, describe, normality, outliers, shapiro_wilk, to_long

#: Lengths of the objects of four runs (20, 3, 4 and 1 of them), with the published statistics of each,
#: its positions beyond the quartile fences, and those beyond three deviations.
PUBLISHED = {20: ([50.31130599975586, 47.0, 79.52531433105469, 59.396968841552734, 67.88226318359375, 67.0, 65.49305725097656, 56.56854248046875, 64.34671783447266, 62.22539520263672, 60.86463928222656,
       113.03622436523438, 60.81118392944336, 45.0, 29.0, 35.7770881652832, 62.75187683105469, 93.61780548095703, 43.826927185058594, 20.0],
      {'count': 20.0,
       'mean': 59.22176551818848,
       'median': 60.83791160583496,
       'mode': 20.0,
       'min': 20.0,
       'max': 113.03622436523438,
       'range': 93.03622436523438,
       'variance': 441.87255156431024,
       'std_dev': 21.02076477115688,
       'cv': 35.494998481092026,
       'q1': 46.5,
       'q3': 65.86979293823242,
       'iqr': 19.369792938232422,
       'p5': 28.55,
       'p10': 35.09937934875489,
       'p90': 80.93456344604495,
       'p95': 94.58872642517092,
       'skewness': 0.561514106172664,
       'kurtosis': 0.8580256027727873,
       'ci_95_lower': 49.38374477132273,
       'ci_95_upper': 69.05978626505421,
       'shapiro_stat': 0.9475529645873786,
       'shapiro_p': 0.3314672811572107},
      [11], []),
 3: ([17.3648624420166, 10.0, 14.758047103881836],
     {'count': 3.0,
      'mean': 14.040969848632812,
      'median': 14.758047103881836,
      'mode': 10.0,
      'min': 10.0,
      'max': 17.3648624420166,
      'range': 7.364862442016602,
      'variance': 13.94594953995329,
      'std_dev': 3.7344276053972836,
      'cv': 26.596649986830574,
      'q1': 12.379023551940918,
      'q3': 16.06145477294922,
      'iqr': 3.682431221008301,
      'p5': 10.475804710388184,
      'p10': 10.951609420776368,
      'p90': 16.843499374389648,
      'p95': 17.104180908203126,
      'skewness': -0.33975299481743704,
      'kurtosis': 0.0,
      'ci_95_lower': 4.764137402263939,
      'ci_95_upper': 23.317802295001684,
      'shapiro_stat': 0.9723468207459255,
      'shapiro_p': 0.680922539935065},
     [], []),
 4: ([93.70742797851562, 39.04742431640625, 44.97199630737305, 74.21589660644531],
     {'count': 4.0,
      'mean': 62.98568630218506,
      'median': 59.59394645690918,
      'mode': 39.04742431640625,
      'min': 39.04742431640625,
      'max': 93.70742797851562,
      'range': 54.660003662109375,
      'variance': 655.8254830780243,
      'std_dev': 25.609089852589925,
      'cv': 40.658586666382824,
      'q1': 43.49085330963135,
      'q3': 79.08877944946289,
      'iqr': 35.59792613983154,
      'p5': 39.93611011505127,
      'p10': 40.82479591369629,
      'p90': 87.85996856689454,
      'p95': 90.78369827270507,
      'skewness': 0.24863977889285743,
      'kurtosis': -1.6149360021460817,
      'ci_95_lower': 22.23590961065841,
      'ci_95_upper': 103.7354629937117,
      'shapiro_stat': 0.9150408614729745,
      'shapiro_p': 0.5095128272367699},
     [], []),
 1: ([164.6378936767578],
     {'count': 1.0,
      'mean': 164.6378936767578,
      'median': 164.6378936767578,
      'mode': 164.6378936767578,
      'min': 164.6378936767578,
      'max': 164.6378936767578,
      'range': 0.0,
      'variance': 0.0,
      'std_dev': 0.0,
      'cv': 0.0,
      'q1': 164.6378936767578,
      'q3': 164.6378936767578,
      'iqr': 0.0,
      'p5': 164.6378936767578,
      'p10': 164.6378936767578,
      'p90': 164.6378936767578,
      'p95': 164.6378936767578,
      'skewness': 0.0,
      'kurtosis': 0.0,
      'ci_95_lower': 164.6378936767578,
      'ci_95_upper': 164.6378936767578,
      'shapiro_stat': None,
      'shapiro_p': None},
     [], [])}


def test_published_results(spark):
    rows = [(n, k, x) for n, (values, *_) in PUBLISHED.items() for k, x in enumerate(values)]
    long = to_long(spark.createDataFrame(rows, "run_id int, label int, length_px double"), METRICS).cache()
    got = {r.run_id: r.asDict() for r in describe(long).collect()}
    for r in normality(long).collect():
        got[r.run_id] |= r.asDict()
    far = {r.run_id: r for r in outliers(long).collect()}
    for n, (_, want, beyond_fences, beyond_three) in PUBLISHED.items():
        for name, x in want.items():
            assert got[n][name] == (None if x is None else pytest.approx(x, rel=1e-6, abs=1e-8)), (n, name)
        assert [far[n].iqr_outliers, far[n].zscore_outliers] == [beyond_fences, beyond_three]


def test_small_groups_and_bad_values(spark):
    rows = [("a", 1, 5.0), ("b", 1, 1.0), ("b", 2, 1.0), ("b", 3, 1.0), ("c", 1, None), ("d", 1, float("nan")), ("d", 2, 2.0), ("e", 1, -1.0), ("e", 2, 1.0)]
    long = to_long(spark.createDataFrame(rows, "run_id string, label int, x double"), ["x", "missing"])
    got = {r.run_id: r for r in describe(long).collect()}
    assert set(got) == {"a", "b", "d", "e"}
    assert (got["a"].variance, got["a"].cv, got["a"].ci_95_lower, got["a"].skewness) == (0.0, 0.0, 5.0, 0.0)
    assert got["b"].skewness is None and got["b"].std_dev == 0 and got["e"].cv == 0
    assert got["d"]["count"] == 1
    assert {r.run_id: r.shapiro_stat for r in normality(long).collect()} == {"a": None, "b": None, "d": None, "e": None}
    assert all(r.iqr_lower is None and r.iqr_outliers == [] for r in outliers(long).collect())


def test_t_quantiles(spark):
    assert [t_upper(k) for k in (1, 2, 5, 30)] == pytest.approx([12.706204736, 4.302652730, 2.570581836, 2.042272456], abs=1e-8)
    rows = spark.range(1, 500).selectExpr("cast(id as long) as n")
    got = rows.select("n", t_quantile(rows.n).alias("a"), t_series(rows.n.cast("double")).alias("b")).collect()
    assert all(abs(r.a - t_upper(r.n)) < 1e-8 for r in got) and all(abs(r.a - r.b) < 1e-8 for r in got if r.n > 100)


def test_correlation(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 2))
    rows = [("a", float(p), float(p + q) if k % 5 else None, 3.0) for k, (p, q) in enumerate(x)]
    got = {(r.m1, r.m2): r.r for r in correlation(spark.createDataFrame(rows, "run_id string, u double, v double, w double"), ["u", "v", "w", "z"]).collect()}
    here = np.array([r[1:3] for r in rows if r[2] is not None], float)
    assert got["u", "v"] == got["v", "u"] == pytest.approx(np.corrcoef(here.T)[0, 1], abs=6e-5)
    assert got["u", "u"] == 1.0 and got["u", "w"] is None and len(got) == 9


def test_shapiro_of_a_normal_sample():
    w, p = shapiro_wilk(np.random.default_rng(3).normal(size=200))
    assert w > 0.98 and p > 0.05
    w, p = shapiro_wilk(np.random.default_rng(3).exponential(size=200))
    assert p < 1e-6
