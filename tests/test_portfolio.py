"""Hand-calculated portfolios and invariants of the measures."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from lodestrata.operators import exchange as X
from lodestrata.operators import metrics as M
from lodestrata.operators import portfolio as B
from lodestrata.operators import processors as P
from lodestrata.operators import programs as G
from pyspark.sql import functions as F


def grid(spark, scores, labels):
    rows = [(datetime(2024, 1, t + 1), f"i{k:02d}", float(s) if s is not None else None, float(y) if y is not None else None) for t, (a, b) in enumerate(zip(scores, labels)) for k, (s, y) in enumerate(zip(a, b))]
    return spark.createDataFrame(rows, "datetime timestamp, instrument string, score double, label double")


def test_hand_calculated_long_short(spark):
    signals = [[4, 3, 2, 1], [1, 2, 3, 4]] * 2 + [[4, 3, 2, 1]]
    frame = grid(spark, signals, [[0.02, 0, 0, -0.04]] * 5)
    daily = B.daily_returns(B.long_short_weights(frame, 0.25), frame.select("datetime", "instrument", F.col("label").alias("ret")), 0.0005 * 2 / 2).orderBy("datetime").toPandas()
    np.testing.assert_allclose(daily.gross, [0.03, -0.03, 0.03, -0.03, 0.03], atol=1e-12)
    np.testing.assert_allclose(daily.turnover_l1, [1, 2, 2, 2, 2], atol=1e-12)
    np.testing.assert_allclose(daily.cost, [0.00025, 0.0005, 0.0005, 0.0005, 0.0005], atol=1e-12)


def test_missing_returns_earn_nothing(spark):
    frame = grid(spark, [[4, 3, 2, 1]], [[None, 0.1, 0.1, -0.04]])
    daily = B.daily_returns(B.long_short_weights(frame, 0.25), frame.select("datetime", "instrument", F.col("label").alias("ret")), 0.0).toPandas()
    assert daily.gross[0] == pytest.approx(0.02)


def test_drawdown(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, i + 1), x) for i, x in enumerate([0.1, -0.2, 0.05])], "datetime timestamp, net double")
    assert B.wealth(rows).agg(F.min("drawdown")).first()[0] == pytest.approx(-0.2)


def test_perfect_inverse_and_constant_scores(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=(5, 20))
    assert all(r.ic == pytest.approx(1) for r in M.daily_ic(grid(spark, y, y)).collect())
    assert all(r.ic == pytest.approx(-1) for r in M.daily_rank_ic(grid(spark, -y, y)).collect())
    assert all(r.ic is None for r in M.daily_ic(grid(spark, np.ones_like(y), y)).collect())


def test_equal_ranks_are_stable(spark):
    y = np.tile(np.arange(10.0), (4, 1))
    assert all(r.rre == pytest.approx(1, abs=1e-9) for r in M.rank_stability(grid(spark, y, y)).collect())


def test_diversity_of_equal_and_orthogonal_factors():
    assert M.diversity_entropy(np.ones((3, 3))) == pytest.approx(0, abs=1e-6)
    assert M.diversity_entropy(np.eye(3)) == pytest.approx(1)


def test_processors_fit_once(spark):
    df = spark.createDataFrame([(datetime(2024, 1, i + 1), "a", float(i)) for i in range(10)], "datetime timestamp, instrument string, x double")
    out = P.fit(df, ["x"], "zscore", "2024-01-01", "2024-01-05")(df).orderBy("datetime").toPandas()
    np.testing.assert_allclose(out.x, (np.arange(10) - 2) / np.std(range(5)))


def test_hall_of_fame_drops_the_less_fit_of_the_closest_pair():
    corr = np.array([[1, 0.9, 0.1], [0.9, 1, 0.2], [0.1, 0.2, 1]])
    assert G.hall_of_fame(np.array([1.0, 2.0, 0.5]), corr, 2) == [1, 2]
    assert G.greedy_uncorrelated(np.array([1.0, 2.0, 0.5]), corr, 0.5, 3) == [1, 2]


def test_optimisers():
    cov = np.diag([1.0, 4.0])
    np.testing.assert_allclose(B.inverse_volatility(cov), [2 / 3, 1 / 3])
    np.testing.assert_allclose(B.minimum_variance(cov), [0.8, 0.2], atol=1e-4)
    w = B.risk_parity(np.array([[1.0, 0.3], [0.3, 2.0]]))
    rc = w * (np.array([[1.0, 0.3], [0.3, 2.0]]) @ w)
    assert rc[0] == pytest.approx(rc[1])


def test_order_rules():
    assert X.lots(np.array([250.0]), np.array([1.0]), 100)[0] == 200 and X.lots(np.array([250.0]), np.array([np.nan]), 100)[0] == 250
    terms = X.Exchange()
    assert X.fees(np.array([1000.0]), np.nan, 0.001, terms)[0] == 5 and X.fees(np.array([0.0]), np.nan, 0.001, terms)[0] == 0
    for cash in (1000.0, 1e6):
        n = X.affordable(np.array([cash]), 10, 0.001, 5)
        assert n * 10 + X.fees(n * 10, np.nan, 0.001, terms) == pytest.approx(cash)


def test_rotation_by_hand():
    score, held = np.array([5.0, 4, 3, 2, 1, np.nan]), np.array([False, True, False, True, True, False])
    out, into = X.rotation(score, held, 3, 1)
    assert out.tolist() == [False, False, False, False, True, False] and into.tolist() == [True, False, False, False, False, False]
    # better names are not let go for worse ones
    out, into = X.rotation(np.array([5.0, 4, 3, 2]), np.array([True, True, False, False]), 2, 1)
    assert not out.any() and not into.any()
    # a held name without a score ranks last; free places are filled
    out, into = X.rotation(np.array([np.nan, 1.0, 2.0, 0.5]), np.array([True, False, False, False]), 2, 1)
    assert out[0] and into.tolist() == [False, True, True, False]


def test_total_loss_ends_the_wealth(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, i + 1), x, 0.0, 0.0, 0.0) for i, x in enumerate([0.1, -1.0, 0.5])], "datetime timestamp, net double, turnover_l1 double, turnover_oneway double, cost double")
    assert [r.compounded for r in B.wealth(rows).orderBy("datetime").collect()] == [pytest.approx(1.1), 0.0, 0.0]
    p = B.performance(rows).first()
    assert p.net_return == -1.0 and p.cagr == -1.0 and p.mdd == 1.0


def test_suspended_limited_and_young_names_stay(spark):
    def days(limit, hold):
        rows = []
        for t in range(3):
            for i, (name, score) in enumerate([("a", [3, 1, 1][t]), ("b", [2, 2, 2][t]), ("c", [1, 3, 3][t])]):
                rows.append(("x", datetime(2024, 1, t + 1), name, float(score), 10.0, 1.0, 1e9, 1e9, limit and t == 1 and name == "a"))
        df = spark.createDataFrame(rows, "account string, datetime timestamp, instrument string, score double, price double, factor double, amount double, volume double, limit_sell boolean")
        return X.simulate_topk(df, 1, 1, hold=hold).orderBy("datetime").toPandas()

    free, barred, young = days(False, 1), days(True, 1), days(False, 2)
    assert free.turnover[1] > 1 and free.refused.tolist() == [0, 0, 0]
    assert barred.refused[1] == 1 and barred.n_held[1] >= 1 and young.refused[1] == 1 and young.refused[2] == 0


def test_volume_caps_a_day(spark):
    rows = [("x", datetime(2024, 1, 1), "a", 1.0, 10.0, 1.0, 1e9, 3000.0)]
    df = spark.createDataFrame(rows, "account string, datetime timestamp, instrument string, score double, price double, factor double, amount double, volume double")
    out = X.simulate_topk(df, 1, 1, terms=X.Exchange(volume_share=0.1)).first()
    assert out.turnover == pytest.approx(300 * 10 / 1e6)
    assert X.simulate_topk(df.filter("false"), 1, 1).count() == 0


def test_schedules_sum_to_the_order(spark):
    orders = spark.createDataFrame([(1, 1050.0, 0.02)], "order_id int, amount double, sigma double")
    for s in (B.twap_schedule(orders, 4), B.almgren_chriss_schedule(orders, 4)):
        assert s.agg(F.sum("part")).first()[0] == pytest.approx(1050)


def test_rolling_regression_recovers_a_line(spark):
    rng = np.random.default_rng(2)
    rows = [(datetime(2024, 1, t + 1), f"i{k}", float(a), float(2 * a + 1)) for t in range(6) for k, a in enumerate(rng.normal(size=8))]
    frame = spark.createDataFrame(rows, "datetime timestamp, instrument string, a double, label double")
    out = G.rolling_regression(frame, ["a"], "label", 3).join(frame, ["datetime", "instrument"]).toPandas()
    assert len(out) == 40 and np.allclose(out.score, out.label)


def test_simulated_account_never_overspends(spark):
    rng = np.random.default_rng(3)
    rows = [("x", datetime(2024, 1, t + 1), f"i{k}", float(rng.normal()), float(10 + rng.random()), 1.0, 1e6) for t in range(8) for k in range(12)]
    out = X.simulate_topk(spark.createDataFrame(rows, "account string, datetime timestamp, instrument string, score double, price double, factor double, amount double"), 5, 2).orderBy("datetime").toPandas()
    assert (out.cash >= 0).all() and (out.n_held <= 5).all() and len(out) == 8
    assert isinstance(out, pd.DataFrame)


def test_shrinkage_towards_a_single_factor():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5))
    x -= x.mean(axis=0)
    cov, mean = x.T @ x / 60, x.mean(axis=1)
    goal = np.outer(x.T @ mean / 60, x.T @ mean / 60) / (mean @ mean / 60)
    np.fill_diagonal(goal, np.diag(cov))
    tr2, p, mu = np.sum(cov * cov), 5, np.trace(cov) / 5
    rho = min(1.0, ((1 - 2 / p) * tr2 + (p * mu) ** 2) / ((60 + 1 - 2 / p) * (tr2 - (p * mu) ** 2 / p)))
    np.testing.assert_allclose(B.shrunk_covariance(cov, 60, "single_factor"), (1 - rho) * cov + rho * goal)
    with pytest.raises(ValueError):
        B.shrunk_covariance(cov, 60, "constant")
