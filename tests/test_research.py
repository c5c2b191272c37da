"""Stored series, search, risk models and the smaller research steps."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from lodestrata.dsl import search
from lodestrata.dsl.tree import parse, size, to_text
from lodestrata.functions.registry import SYMBOLIC
from lodestrata.operators import research as R
from lodestrata.operators import risk_models as K
from lodestrata.operators.metrics import hashed_noise
from lodestrata.plans.compiler import evaluate
from lodestrata.sources import panel as S
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(4)
    rows = [(f"i{k}", t, datetime(2024, 1, 1) + timedelta(days=t), *map(float, np.round(rng.uniform(5, 15, 6), 3))) for k in range(4) for t in range(40)]
    return spark.createDataFrame(rows, "instrument string, cal_idx int, datetime timestamp, open double, high double, low double, close double, volume double, vwap double")


@pytest.mark.parametrize("formula", ["Mean($close, 5)", "Ref($close, -3) / $close - 1", "EMA($close, 4)"])
def test_updated_series_equal_new_ones(spark, panel, tmp_path, formula):
    store = R.SeriesStore(spark, str(tmp_path))
    old = store.write(panel.filter("cal_idx <= 25"), formula, 25)
    got = store.update(panel, formula, old, 39, 1)
    want = evaluate(panel, {"value": formula})
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count()


def test_equal_formulas_share_a_table(spark, tmp_path):
    store = R.SeriesStore(spark, str(tmp_path))
    assert store.path("$close/Ref($close, 1)") == store.path("Div($close,Ref($close,1))") != store.path("$close")


def test_offspring_are_formulas(panel):
    rng = np.random.default_rng(1)
    pool = [search.grow(rng) for _ in range(20)]
    for _ in range(3):
        pool = search.next_generation(pool, rng.normal(size=20), rng)
        assert all(parse(to_text(n)) == n and size(n) <= 60 for n in pool)
    assert evaluate(panel, {f"f{i}": to_text(n) for i, n in enumerate(pool[:8])}).count() == 160
    n = parse("Mean(Add($close, $open), 5)")
    assert all(size(search.hoist_mutation(n, rng)) <= size(n) for _ in range(20))


def test_closed_functions(spark):
    assert R.closed(SYMBOLIC["pdiv"], 2, spark) and R.closed(SYMBOLIC["plog"], 1, spark)
    assert not R.closed(lambda x: F.ln(F.when(x > 0, x)), 1, spark)


def test_covariances_are_positive_and_keep_variances():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5))
    cov = np.cov(x.T)
    for m in (K.poet(cov, 200, 1, 0.5, "soft"), K.poet(cov, 200, 1, 0.5, "scad"), K.poet(cov, 200, 0, 0.1, "hard"), K.structured(cov, 2)):
        np.testing.assert_allclose(np.diag(m), np.diag(cov))
        np.testing.assert_allclose(m, m.T)
    np.testing.assert_allclose(K.structured(cov, 5), cov, atol=1e-9)


def test_index_weights_stay_in_bounds():
    bench = np.full(4, 0.25)
    w = K.enhanced_index(np.array([1.0, 0, 0, -1]), np.eye(4) * 0.01, bench, 1.0, 0.1)
    np.testing.assert_allclose(w, [0.35, 0.25, 0.25, 0.15], atol=1e-4)
    w = K.enhanced_index(np.array([1.0, 0, 0, -1]), np.eye(4) * 0.01, bench, 1.0, 0.1, now=bench, turnover=0.1)
    assert abs(np.abs(w - bench).sum() - 0.1) < 1e-9


def test_soft_topk_sells_slowly():
    assert K.soft_topk({}, {"a": 1.0, "b": 0.0}, 1, 0.1) == {"a": 1.0}
    out = K.soft_topk({"a": 0.5, "b": 0.5}, {"a": 0.0, "b": 1.0, "c": 2.0}, 2, 0.2)
    assert out == pytest.approx({"a": 0.3, "b": 0.5, "c": 0.2})
    out = K.soft_topk({"a": 0.5, "b": 0.5}, {"a": 0.0, "b": 1.0, "c": 2.0}, 2, 0.2, "average_fill")
    assert out == pytest.approx({"a": 0.3, "b": 0.6, "c": 0.1})


def test_orders_sell_first_and_round():
    orders = K.target_orders({"b": 0.5}, {"a": 130.0}, {"a": 10.0, "b": 1.0}, 1000.0)
    assert orders == [("a", -130.0), ("b", 1100.0)]


def test_as_of_and_known_values(spark):
    pit = spark.createDataFrame([("a", 1, datetime(2024, 1, 1), 1.0), ("a", 2, datetime(2024, 2, 1), 2.0), ("a", 1, datetime(2024, 2, 15), 9.0), ("a", 2, datetime(2024, 3, 1), 3.0)], "instrument string, period int, announced timestamp, value double")
    at = spark.createDataFrame([("a", datetime(2023, 12, 1)), ("a", datetime(2024, 1, 1)), ("a", datetime(2024, 2, 20)), ("a", datetime(2024, 3, 2)), ("b", datetime(2024, 3, 2))], "instrument string, datetime timestamp")
    got = {(r.instrument, r.datetime.date().isoformat()): (r.period, r.value) for r in S.known_at(pit, at).collect()}
    assert got == {("a", "2023-12-01"): (None, None), ("a", "2024-01-01"): (1, 1.0), ("a", "2024-02-20"): (2, 2.0), ("a", "2024-03-02"): (2, 3.0), ("b", "2024-03-02"): (None, None)}
    one = {r.datetime.date().isoformat(): r.value for r in S.known_period(pit, at.filter("instrument = 'a'"), 1).collect()}
    assert one["2024-02-20"] == 9.0


def test_readers(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_text("symbol,date,close,junk\nA,2024-01-01,1.5,x\nA,2024-01-01,1.5,x\nB,2024-01-02,2.5,y\n")
    got = S.read_bars_csv(spark, str(tmp_path / "csv"), {"symbol": "string", "date": "date", "close": "double", "junk": "string"}, exclude={"junk"})
    assert got.columns == ["symbol", "date", "close"] and got.count() == 2
    (tmp_path / "t.json").write_text('{"run_id": "r", "formula": "$close", "raw_fitness": 0.5}\n')
    assert S.read_trajectory(spark, str(tmp_path / "t.json")).first().raw_fitness == 0.5
    (tmp_path / "r.csv").write_text("name\nx\n")
    with pytest.raises(ValueError):
        S.read_result(spark, str(tmp_path / "r.csv"))
    assert S.parse_frequency("5min") == (5, "minute") and S.parse_frequency("week") == (1, "week")


def test_gaps_are_filled_between_first_and_last(spark):
    cal = spark.createDataFrame([(i, datetime(2024, 1, 1) + timedelta(days=i)) for i in range(9)], "cal_idx int, datetime timestamp")
    rows = spark.createDataFrame([("a", 2, 1.0), ("a", 5, 2.0), ("b", 7, 3.0)], "instrument string, cal_idx int, close double")
    got = [(r.instrument, r.cal_idx, r.close) for r in S.densify(rows, cal).orderBy("instrument", "cal_idx").collect()]
    assert got == [("a", 2, 1.0), ("a", 3, None), ("a", 4, None), ("a", 5, 2.0), ("b", 7, 3.0)]
    assert S.densify(rows.filter("false"), cal).count() == 0


@pytest.mark.parametrize("mode", R.PFS_MODES)
def test_fidelity_is_the_mean_over_draws_of_both_kinds_of_noise(panel, mode):
    formula, sigma = "$close / Ref($close, 1) - $open", 0.3
    got = R.perturbation_fidelity(panel, formula, sigma, mode, draws=2, seed=5).first()
    noise = [hashed_noise(k, sigma, 3, F.lit(f"{mode}|{c}|{k}_{d}|5")).alias(f"{c or 'score'}|{k}|{d}") for k in ("gaussian", "student_t") for d in range(2) for c in ([""] if mode == "legacy" else ["close", "open"])]
    df = panel.select("instrument", "cal_idx", "datetime", "close", "open", *noise).toPandas().sort_values(["instrument", "cal_idx"])
    score = lambda close, open_: close / close.groupby(df.instrument).shift(1) - open_
    clear, want = score(df.close, df.open), {"gaussian": [], "student_t": []}
    for kind, each in want.items():
        for d in range(2):
            eps = lambda c: df[f"{c}|{kind}|{d}"]  # noqa: B023, E731
            if mode == "legacy":
                noisy = clear * (1 + eps("score"))
            elif mode == "paper":
                noisy = score(df.close + eps("close"), df.open + eps("open"))
            else:
                noisy = score(df.close * (1 + eps("close")), df.open * (1 + eps("open")))
            both = df.assign(a=clear, b=noisy).dropna(subset=["a", "b"])
            each.append(both.groupby("datetime")[["a", "b"]].apply(lambda g: (g if mode == "legacy" else g.rank()).corr().iloc[0, 1]).mean())
    assert got.gaussian == pytest.approx(np.mean(want["gaussian"])) and got.student_t == pytest.approx(np.mean(want["student_t"]))
    assert got.gaussian_sd == pytest.approx(np.std(want["gaussian"])) and got.student_t_sd == pytest.approx(np.std(want["student_t"]))
    assert got.least == min(got.gaussian, got.student_t) and got.gaussian_sd > 0
    assert R.perturbation_fidelity(panel, formula, 0.0, mode).first().least == pytest.approx(1)


def test_both_kinds_of_noise_have_one_deviation(spark):
    df = spark.range(200_000).select(F.col("id").alias("datetime"), F.lit("a").alias("instrument"))
    row = df.agg(*[F.stddev_samp(hashed_noise(k, 0.2, 9, F.lit("x"))) for k in ("gaussian", "student_t")]).first()
    assert row[0] == pytest.approx(0.2, rel=0.02) and row[1] == pytest.approx(0.2, rel=0.02)
