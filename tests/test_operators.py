"""Rolling operators against pandas on the edge-case panel."""

import numpy as np
import pandas as pd
import pytest
from lodestrata.dsl.tree import FormulaError
from lodestrata.functions import registry
from lodestrata.functions.registry import Context
from lodestrata.operators.processors import infinite_to_mean
from lodestrata.plans.compiler import evaluate

RNG = np.random.default_rng(5)
DENSE = np.round(RNG.normal(10, 2, 60), 2)
SERIES = {
    "dense": DENSE,
    "leading": np.where(np.arange(60) < 5, np.nan, DENSE),
    "interior": np.where(np.isin(np.arange(60), [3, 17, 18]), np.nan, DENSE),
    "constant": np.ones(60),
    "ties": np.array([1.0, 2, 2, 3] * 5),
    "zeros": np.array([0.0, -1, 2, 0] * 4),
    "one": np.array([4.0]),
    "two": np.array([4.0, 5.0]),
    "missing": np.full(6, np.nan),
    "gap": np.where(np.isin(np.arange(800), [0, 60, 61, 790]), np.resize(DENSE, 800), np.nan),
}


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(k, i, (pd.Timestamp("2024-01-01") + pd.Timedelta(days=i)).to_pydatetime(), None if np.isnan(v) else float(v), float(i % 7)) for k, s in SERIES.items() for i, v in enumerate(s)]
    return spark.createDataFrame(rows, "instrument string, cal_idx int, datetime timestamp, x double, y double").cache()


def mad(v):
    v = v[~np.isnan(v)]
    return np.mean(np.abs(v - v.mean())) if len(v) else np.nan


def slope(v):
    t = np.arange(len(v))[~np.isnan(v)]
    v = v[~np.isnan(v)]
    return np.polyfit(t, v, 1)[0] if len(v) > 1 else np.nan


def wma(v):
    w = np.arange(1, len(v) + 1)
    return np.nanmean(w / w.sum() * v) if (~np.isnan(v)).any() else np.nan


def rank(v):
    ok = v[~np.isnan(v)]
    return np.nan if np.isnan(v[-1]) else ((ok < v[-1]).sum() + ((ok == v[-1]).sum() + 1) / 2) / len(ok)


CASES = {
    "Ref($x, 2)": lambda s: s.shift(2),
    "Ref($x, -2)": lambda s: s.shift(-2),
    "Delta($x, 3)": lambda s: s - s.shift(3),
    "Mean($x, 5)": lambda s: s.rolling(5, min_periods=1).mean(),
    "Mean($x, 0)": lambda s: s.expanding(1).mean(),
    "Sum($x, 5)": lambda s: s.rolling(5, min_periods=1).sum(),
    "Std($x, 5)": lambda s: s.rolling(5, min_periods=1).std(),
    "Var($x, 5)": lambda s: s.rolling(5, min_periods=1).var(),
    "Max($x, 5)": lambda s: s.rolling(5, min_periods=1).max(),
    "Min($x, 5)": lambda s: s.rolling(5, min_periods=1).min(),
    "Med($x, 5)": lambda s: s.rolling(5, min_periods=1).median(),
    "Quantile($x, 5, 0.8)": lambda s: s.rolling(5, min_periods=1).quantile(0.8),
    "Count($x, 5)": lambda s: s.rolling(5, min_periods=1).count(),
    "Mad($x, 5)": lambda s: s.rolling(5, min_periods=1).apply(mad, raw=True),
    "Rank($x, 5)": lambda s: s.rolling(5, min_periods=1).apply(rank, raw=True),
    "Slope($x, 5)": lambda s: s.rolling(5, min_periods=1).apply(slope, raw=True),
    "WMA($x, 5)": lambda s: s.rolling(5, min_periods=1).apply(wma, raw=True),
    "EMA($x, 5)": lambda s: s.ewm(span=5, min_periods=1).mean(),
    "EMA($x, 0.3)": lambda s: s.ewm(alpha=0.3, min_periods=1).mean(),
    "FFillNan($x)": lambda s: s.ffill(),
    "BFillNan($x)": lambda s: s.bfill(),
    "Abs($x) + Sign($x)": lambda s: s.abs() + np.sign(s),
}


@pytest.mark.parametrize("formula", CASES)
def test_like_pandas(panel, formula):
    got = evaluate(panel, {"v": formula}).toPandas().sort_values(["instrument", "cal_idx"])
    for name, values in SERIES.items():
        want = CASES[formula](pd.Series(values)).to_numpy(float)
        if formula.startswith("EMA"):
            want = np.where(np.cumsum(~np.isnan(values)) > 0, want, np.nan)
        np.testing.assert_allclose(got[got.instrument == name].v.to_numpy(float), want, rtol=1e-9, atol=1e-9, err_msg=name)


def test_skew_and_kurt_are_bias_corrected_and_null_on_constants(panel):
    got = evaluate(panel, {"s": "Skew($x, 20)", "k": "Kurt($x, 20)"}).toPandas().sort_values(["instrument", "cal_idx"])
    s = pd.Series(DENSE)
    d = got[got.instrument == "dense"]
    np.testing.assert_allclose(d.s.to_numpy(float), s.rolling(20, min_periods=3).skew(), rtol=1e-8)
    np.testing.assert_allclose(d.k.to_numpy(float), s.rolling(20, min_periods=4).kurt(), rtol=1e-8)
    assert got[got.instrument == "constant"][["s", "k"]].isna().all().all()


def test_constant_windows_have_no_fit(panel):
    got = evaluate(panel, {"r": "Rsquare($x, 5)", "c": "Corr($x, $y, 5)"}).filter("instrument = 'constant'").toPandas()
    assert got[["r", "c"]].isna().all().all()


def test_the_first_missing_value_is_the_extreme(panel):
    got = evaluate(panel, {"a": "IdxMax($x, 5)", "b": "IdxMin($x, 5)"}).filter("instrument = 'interior'").orderBy("cal_idx").toPandas()
    assert got.a[4] == got.b[4] == 4 and got.a[19] == 3
    assert got.a[12] == int(np.argmax(DENSE[8:13])) + 1


def test_division_and_logarithm_of_nothing(panel):
    strict = evaluate(panel, {"d": "1 / $x", "l": "Log($x)"}).filter("instrument = 'zeros'").orderBy("cal_idx").toPandas()
    assert np.isnan(strict.d[0]) and np.isnan(strict.l[0]) and np.isnan(strict.l[1])
    ieee = evaluate(panel, {"d": "1 / $x", "l": "Log($x)"}, Context(ieee=True)).filter("instrument = 'zeros'").orderBy("cal_idx").toPandas()
    assert ieee.d[0] == np.inf and ieee.l[0] == -np.inf


def test_strict_windows_need_all_rows(panel):
    got = evaluate(panel, {"m": "Mean($x, 5)", "r": "Rank($x, 4)", "med": "Med($x, 4)"}, Context(strict=True)).toPandas().sort_values(["instrument", "cal_idx"])
    s = pd.Series(SERIES["interior"])
    np.testing.assert_allclose(got[got.instrument == "interior"].m.to_numpy(float), s.rolling(5).mean())
    t = got[got.instrument == "ties"].reset_index(drop=True)
    assert t.med[3] == 2.0 and t.r[3] == 2 / 8  # the largest of four: (1 at least as large + 0 larger + 1) / 8


def test_shared_subtrees_are_one_window(panel):
    plan = evaluate(panel, {"a": "Mean($x, 5) + 1", "b": "Mean($x, 5) * 2"})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("avg(") == 1


def test_a_batch_has_one_exchange(panel):
    df = evaluate(panel, {f"f{n}": f"Mean($x, {n}) / Ref($x, {n})" for n in (5, 10, 20)})
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1


def test_ranges_read_what_windows_need(panel):
    part = evaluate(panel, {"v": "Mean($x, 5)"}, start=20, end=30).filter("instrument = 'dense'").orderBy("cal_idx").toPandas()
    whole = pd.Series(DENSE).rolling(5, min_periods=1).mean()[20:31].to_numpy()
    np.testing.assert_allclose(part.v, whole)


def test_own_operators_and_unknown_ones(panel):
    registry.register("Twice", lambda c, x: x * 2)
    assert evaluate(panel, {"v": "Twice($y)"}, keep=("y",)).filter("v != y * 2").count() == 0
    for bad in ("Nothing($x)", "$nothing", "Mean($x)"):
        with pytest.raises(FormulaError):
            evaluate(panel, {"v": bad})


def test_array_kernels_agree_with_sql_windows(panel):
    formulas = {f"f{i}": f.replace("$x, 0)", "$x, 4)") for i, f in enumerate(CASES) if "FillNan" not in f}
    formulas |= {"skew": "Skew($x, 9)", "kurt": "Kurt($x, 9)", "corr": "Corr($x, $y, 6)", "cov": "Cov($x, $y, 6)", "resi": "Resi($x, 7)", "rsq": "Rsquare($x, 7)", "imax": "IdxMax($x, 5)", "imin": "IdxMin($x, 5)", "nested": "EMA(Delta(Mad($x, 5), 2), 8)", "cmp": "Mean($x > Ref($x, 1), 5) / ($y + 1)", "zero": "1 / $x + Log($x)", "first": "Ref($x, 0)"}
    a, b = (evaluate(panel, formulas, engine=e).toPandas().sort_values(["instrument", "cal_idx"]) for e in ("array", "sql"))
    for name in formulas:
        np.testing.assert_allclose(a[name].to_numpy(float), b[name].to_numpy(float), rtol=1e-8, atol=1e-9, err_msg=formulas[name])


def test_means_are_carried_through_gaps_of_any_length(panel):
    got = evaluate(panel, {"e": "EMA($x, 2)", "c": "CSRank(EMA($x, 2))", "w": "Mean($x, 0.9)"}).filter("instrument = 'gap'").orderBy("cal_idx").toPandas()
    want = pd.Series(SERIES["gap"])
    np.testing.assert_allclose(got.e, want.ewm(span=2, min_periods=1).mean())
    np.testing.assert_allclose(got.w, want.ewm(alpha=0.9, min_periods=1).mean())
    assert got.e[789] == got.e[62] and got.c.notna().all()


def test_scans_share_the_exchange_of_windows(panel):
    formulas = {"a": "CSRank($x) + EMA($x, 5) + Mean($x, 3)", "b": "Rank(Mean($y, 4), 6)", "c": "EMA(CSRank(Mean($x, 3)), 4)"}
    mixed = evaluate(panel, formulas)
    assert evaluate(panel, {k: formulas[k] for k in "ab"})._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(instrument") == 1
    a, b = (df.toPandas().sort_values(["instrument", "cal_idx"]) for df in (mixed, evaluate(panel, formulas, engine="sql")))
    for name in formulas:
        np.testing.assert_allclose(a[name].to_numpy(float), b[name].to_numpy(float), rtol=1e-9, err_msg=name)


def test_auto_takes_arrays_for_wide_batches_only(panel):
    plan = lambda f: evaluate(panel, f)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan({"a": "Mean($x, 20)"})
    assert "MapInArrow" in plan({f"a{n}": f"Mean($x, {n})" for n in range(50, 54)})
    assert "MapInArrow" in plan({"a": "Rank($x, 5)"})
    assert "MapInArrow" not in plan({f"a{n}": f"CSRank(Mean($x, {n}))" for n in range(50, 54)})


def test_infinite_values_become_the_mean_of_the_others(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, "a", inf), (1, "b", 2.0), (1, "c", 4.0), (1, "d", -inf), (1, "e", None), (1, "f", nan), (2, "a", -inf), (2, "b", 7.0), (3, "a", inf), (4, "a", 5.0)]
    df = spark.createDataFrame([(f"2024-01-0{d}", i, x) for d, i, x in rows], "datetime string, instrument string, x double")
    got = {(int(r.datetime[-1]), r.instrument): r.x for r in infinite_to_mean(["x"])(df).collect()}
    assert np.isnan(got.pop((1, "f")))
    assert got == {(1, "a"): 3.0, (1, "b"): 2.0, (1, "c"): 4.0, (1, "d"): 3.0, (1, "e"): None, (2, "a"): 7.0, (2, "b"): 7.0, (3, "a"): None, (4, "a"): 5.0}
