"""Portfolios from scores: weights, turnover, costs, performance and attribution."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.metrics import YEAR, finite


def execution_returns(panel: DataFrame, mode: str = "next_open_oo", days: int = 1) -> DataFrame:
    """Return of a signal of day t under an execution rule; lead over the dense calendar."""
    w = Window.partitionBy("instrument").orderBy("cal_idx")
    after = lambda c, n: F.lead(c, n).over(w)
    buy, sell = {
        "same_close": (F.col("close"), after("close", days)),
        "next_open_oo": (after("open", 1), after("open", 1 + days)),
        "next_open_oc": (after("open", 1), after("close", days)),
        "delayed_close_cc": (after("close", 1), after("close", 1 + days)),
    }[mode]
    return panel.withColumn("ret", sell / F.when(buy != 0, buy) - 1)


def long_short_weights(scores: DataFrame, share: float = 0.2, topk: int | None = None) -> DataFrame:
    """(datetime, instrument, weight): +-0.5 / k on the top and the bottom of a day.

    By quantile cuts with linear interpolation, names on both sides dropping out; with ``topk`` by count, at most
    half of the names. Days with fewer than two names have no weights.
    """
    day = Window.partitionBy("datetime")
    rows = scores.select("datetime", "instrument", finite("score").alias("score")).dropna(subset=["score"])
    n = F.count(F.lit(1)).over(day)
    if topk is None:
        cut = rows.select("*", n.alias("n"), F.percentile("score", 1 - share).over(day).alias("hi"), F.percentile("score", share).over(day).alias("lo"))
        top, low = (F.col("score") >= F.col("hi")), (F.col("score") <= F.col("lo"))
    else:
        cut = rows.select("*", n.alias("n"), F.row_number().over(day.orderBy(F.desc("score"), F.desc("instrument"))).alias("hi"), F.row_number().over(day.orderBy("score", "instrument")).alias("lo"))
        k = F.least(F.lit(topk), F.floor(F.col("n") / 2))
        top, low = F.col("hi") <= k, F.col("lo") <= k
    side = F.when(top & ~low, 1).when(low & ~top, -1)
    picked = cut.filter("n >= 2").withColumn("side", side).filter("side is not null")
    each = F.count(F.lit(1)).over(Window.partitionBy("datetime", "side"))
    sides = F.max("side").over(day) - F.min("side").over(day)
    return picked.select("datetime", "instrument", (0.5 * F.col("side") / each).alias("weight"), sides.alias("__sides")).filter("__sides = 2").drop("__sides")


def daily_returns(weights: DataFrame, returns: DataFrame, cost_rate: float = 0.0015, by: str = "oneway", rebalance: int = 1) -> DataFrame:
    """(datetime, gross, turnover_l1, turnover_oneway, cost, net) over the dates of ``returns(datetime, instrument, ret)``.

    Weights hold for ``rebalance`` dates; the first day's weights are a turnover of their own; a held name without
    return earns nothing. Days without positions count with zeros.
    """
    days = returns.select("datetime").distinct().withColumn("d", F.row_number().over(Window.orderBy("datetime")) - 1)
    held = weights.join(days, "datetime").filter(F.col("d") % rebalance == 0).drop("datetime")
    held = held.withColumn("d", F.explode(F.sequence("d", F.col("d") + rebalance - 1)))
    before = held.select("instrument", (F.col("d") + 1).alias("d"), F.col("weight").alias("past"))
    moves = held.join(before, ["instrument", "d"], "full").join(days, "d")
    moves = moves.join(returns.select("datetime", "instrument", finite("ret").alias("ret")), ["datetime", "instrument"], "left")
    w, p = F.coalesce("weight", F.lit(0.0)), F.coalesce("past", F.lit(0.0))
    daily = moves.groupBy("datetime").agg(F.sum(w * F.coalesce("ret", F.lit(0.0))).alias("gross"), F.sum(F.abs(w - p)).alias("turnover_l1"))
    out = days.select("datetime").join(daily, "datetime", "left").na.fill(0.0).withColumn("turnover_oneway", F.col("turnover_l1") / 2)
    cost = F.col("turnover_l1" if by == "l1" else "turnover_oneway") * cost_rate
    return out.withColumn("cost", cost).withColumn("net", F.col("gross") - cost)


def long_short_pnl(scores: DataFrame, returns: DataFrame, share: float = 0.2, cost_rate: float = 0.0015) -> DataFrame:
    """(datetime, gross, turnover, cost, net) of a quantile long/short test: mean return above the upper cut less that below the lower.

    ``turnover`` is the mean over both sides of the share of a side's names that were not in it on the date before (1
    where there was none). Days on which either side is empty are left out.
    """
    day = Window.partitionBy("datetime")
    rows = scores.select("datetime", "instrument", finite("score").alias("score")).dropna(subset=["score"]).join(returns.select("datetime", "instrument", finite("ret").alias("ret")), ["datetime", "instrument"]).dropna(subset=["ret"])
    cut = rows.select("*", F.percentile("score", 1 - share).over(day).alias("hi"), F.percentile("score", share).over(day).alias("lo"))
    sides = cut.select("datetime", "instrument", "ret", F.explode(F.filter(F.array(F.when(F.col("score") >= F.col("hi"), 1), F.when(F.col("score") <= F.col("lo"), -1)), lambda x: x.isNotNull())).alias("side"))
    days = sides.groupBy("datetime").agg(F.count_distinct("side").alias("n")).filter("n = 2").select("datetime", F.row_number().over(Window.orderBy("datetime")).alias("d"))
    sides = sides.join(days, "datetime")
    before = sides.select((F.col("d") + 1).alias("d"), "instrument", "side", F.lit(1).alias("stayed"))
    each = sides.join(before, ["d", "instrument", "side"], "left").groupBy("datetime", "side").agg(F.avg("ret").alias("mean"), F.avg(F.when(F.col("stayed").isNull(), 1.0).otherwise(0.0)).alias("fresh"))
    out = each.groupBy("datetime").agg(F.sum(F.col("mean") * F.col("side")).alias("gross"), F.avg("fresh").alias("turnover"))
    cost = F.col("turnover") * cost_rate
    return out.withColumn("cost", cost).withColumn("net", F.col("gross") - cost)


def wealth(daily: DataFrame, value: str = "net") -> DataFrame:
    """Cumulative return, compounded and summed, and the drawdown of each."""
    w = Window.orderBy("datetime").rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    x = F.coalesce(value, F.lit(0.0))
    # from a return of -1 or less on nothing is left
    grown = F.exp(F.sum(F.when(x > -1, F.log1p(x))).over(w))
    out = daily.withColumn("compounded", F.when(F.min(x).over(w) <= -1, 0.0).otherwise(grown)).withColumn("summed", F.sum(x).over(w))
    return out.withColumn("drawdown", F.col("compounded") / F.max("compounded").over(w) - 1).withColumn("drawdown_summed", F.col("summed") - F.max("summed").over(w))


def performance(daily: DataFrame) -> DataFrame:
    """One row: yearly return, growth, Sharpe ratio, deepest drawdown, turnover and cost."""
    d = wealth(daily)
    sd = F.stddev_samp("net")
    growth = F.when(F.min("net") <= -1, 0.0).otherwise(F.exp(F.sum(F.when(F.col("net") > -1, F.log1p("net")))))
    return d.agg(
        (F.avg("net") * YEAR).alias("annual"),
        (F.pow(growth, F.lit(float(YEAR)) / F.count("net")) - 1).alias("cagr"),
        (F.avg("net") / F.when(sd > 0, sd) * math.sqrt(YEAR)).alias("sharpe"),
        (-F.min("drawdown")).alias("mdd"),
        F.avg("turnover_l1").alias("mean_turnover_l1"),
        F.avg("turnover_oneway").alias("mean_turnover_oneway"),
        F.sum("cost").alias("total_cost"),
        (growth - 1).alias("net_return"),
        F.count("net").alias("n_days"),
    )


def risk(daily: DataFrame, value: str = "net", year: int = 238) -> DataFrame:
    """Mean, deviation, yearly return, information ratio and deepest fall of the summed series."""
    d = wealth(daily, value)
    sd = F.stddev_samp(value)
    return d.agg(F.avg(value).alias("mean"), sd.alias("std"), (F.avg(value) * year).alias("annualized_return"), (F.avg(value) / F.when(sd > 0, sd) * math.sqrt(year)).alias("information_ratio"), F.min("drawdown_summed").alias("max_drawdown"))


def monthly_risk(daily: DataFrame, value: str = "net", least: int = 3) -> DataFrame:
    sd = F.stddev_samp(value)
    return daily.groupBy(F.year("datetime").alias("year"), F.month("datetime").alias("month")).agg(F.avg(value).alias("mean"), sd.alias("std"), F.count(value).alias("n")).filter(F.col("n") >= least)


def against_benchmark(daily: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Beta, alpha, and the excess return's yearly mean and ratio; benchmark(datetime, bench)."""
    d = daily.join(benchmark, "datetime").dropna(subset=["net", "bench"]).withColumn("excess", F.col("net") - F.col("bench"))
    var, sd = F.var_pop("bench"), F.stddev_samp("excess")
    beta = F.covar_pop("net", "bench") / F.when(var > 0, var)
    return d.agg(beta.alias("beta"), ((F.avg("net") - beta * F.avg("bench")) * YEAR).alias("alpha"), (F.avg("excess") * YEAR).alias("excess_annual"), (F.avg("excess") / F.when(sd > 0, sd) * math.sqrt(YEAR)).alias("information_ratio"))


def holdings_changes(weights: DataFrame) -> DataFrame:
    """(datetime, entries, exits): names that are new and names that left, against the date before."""
    days = weights.select("datetime").distinct().withColumn("d", F.row_number().over(Window.orderBy("datetime")))
    held = weights.select("datetime", "instrument").join(days, "datetime").select("d", "instrument")
    before = held.select((F.col("d") + 1).alias("d"), "instrument")
    came, left = held.join(before, ["d", "instrument"], "left_anti"), before.join(held, ["d", "instrument"], "left_anti")
    counts = came.groupBy("d").agg(F.count("*").alias("entries")).join(left.groupBy("d").agg(F.count("*").alias("exits")), "d", "full")
    return days.join(counts, "d", "left").select("datetime", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("exits", F.lit(0)).alias("exits"))


def brinson(port: DataFrame, bench: DataFrame, groups: DataFrame, returns: DataFrame) -> DataFrame:
    """Per day: allocation, selection, interaction and total of a portfolio against a benchmark.

    port and bench (datetime, instrument, weight), groups (instrument, grp), returns (datetime, instrument, ret).
    """
    both = port.select("datetime", "instrument", F.col("weight").alias("wp")).join(bench.select("datetime", "instrument", F.col("weight").alias("wb")), ["datetime", "instrument"], "full")
    rows = both.join(returns, ["datetime", "instrument"], "left").join(groups, "instrument", "left").na.fill(0.0, ["wp", "wb", "ret"])
    g = rows.groupBy("datetime", F.coalesce("grp", F.lit("")).alias("grp")).agg(F.sum("wp").alias("wp"), F.sum("wb").alias("wb"), F.sum(F.col("wp") * F.col("ret")).alias("cp"), F.sum(F.col("wb") * F.col("ret")).alias("cb"))
    rp, rb = F.coalesce(F.col("cp") / F.when(F.col("wp") != 0, F.col("wp")), F.lit(0.0)), F.coalesce(F.col("cb") / F.when(F.col("wb") != 0, F.col("wb")), F.lit(0.0))
    dw = F.col("wp") - F.col("wb")
    return g.groupBy("datetime").agg(F.sum(dw * rb).alias("allocation"), F.sum(F.col("wb") * (rp - rb)).alias("selection"), F.sum(dw * (rp - rb)).alias("interaction"), F.sum(F.col("cp") - F.col("cb")).alias("total"))


def combine_signals(frame: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Sum of weight * daily z-score over the signals that are there; NULL where none is."""
    day = Window.partitionBy("datetime")
    parts, seen = [], []
    for c, w in weights.items():
        x = finite(c)
        sd = F.stddev_pop(x).over(day)
        parts.append(F.coalesce(w * (x - F.avg(x).over(day)) / F.when(sd < 1e-8, 1.0).otherwise(sd), F.lit(0.0)))
        seen.append(x.isNotNull())
    return frame.withColumn("score", F.when(sum(s.cast("int") for s in seen) > 0, sum(parts)))


def twap_schedule(orders: DataFrame, steps: int, unit: float = 100.0) -> DataFrame:
    """Equal parts in whole lots over the steps, what is left in the last; orders(order_id, amount)."""
    each = orders.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    upto = lambda s: F.floor(F.col("amount") * (s + 1) / steps / unit + 1e-9) * unit
    done = F.when(F.col("step") == 0, 0.0).otherwise(upto(F.col("step") - 1))
    return each.withColumn("part", F.when(F.col("step") == steps - 1, F.col("amount") - done).otherwise(upto(F.col("step")) - done))


def almgren_chriss_schedule(orders: DataFrame, steps: int, risk: float = 1e-6, impact: float = 2.5e-6) -> DataFrame:
    """Share of each step under a trade-off of risk and impact; orders(order_id, amount, sigma)."""
    each = orders.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    k = F.acosh(F.lit(risk / impact) * F.col("sigma") * F.col("sigma") / 2 + 1)
    left = lambda t: F.sinh(k * t)
    share = F.when(k > 0, (left(steps - F.col("step")) - left(steps - F.col("step") - 1)) / F.when(left(F.lit(steps)) > 0, left(F.lit(steps)))).otherwise(1 / steps)
    return each.withColumn("part", F.col("amount") * share)


def trade_indicators(fills: DataFrame) -> DataFrame:
    """Per day: fulfilled share, price advantage against the base price, and the share of good deals.

    fills(datetime, direction (1 buy, 0 sell), wanted, done, price, base).
    """
    gain = (1 - 2 * F.col("direction")) * (F.col("price") / F.when(F.col("base") > 1e-8, F.col("base")) - 1)
    return fills.withColumn("gain", gain).groupBy("datetime").agg((F.sum("done") / F.when(F.sum("wanted") > 0, F.sum("wanted"))).alias("fulfil_rate"), (F.sum(F.col("gain") * F.col("done")) / F.when(F.sum("done") > 0, F.sum("done"))).alias("price_advantage"), F.avg(F.when(F.col("gain").isNotNull(), (F.col("gain") > 0).cast("double"))).alias("positive_rate"))


# Weights from moments: small matrices on the driver.


def inverse_volatility(cov: np.ndarray) -> np.ndarray:
    w = 1 / np.sqrt(np.diag(cov))
    return w / w.sum()


def minimum_variance(cov: np.ndarray, mean: np.ndarray | None = None, aversion: float = 1.0, rounds: int = 2000) -> np.ndarray:
    """Long-only weights of least variance, or with ``mean`` of the best trade-off, by projected gradients."""
    n = len(cov)
    w, step = np.full(n, 1 / n), 1 / (2 * np.linalg.norm(cov, 2) * aversion + 1e-12)
    for _ in range(rounds):
        w = _to_simplex(w - step * (2 * aversion * cov @ w - (mean if mean is not None else 0)))
    return w


def risk_parity(cov: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Weights whose contributions to variance are equal, coordinate by coordinate."""
    n = len(cov)
    x = 1 / np.sqrt(np.diag(cov))
    for _ in range(rounds):
        for i in range(n):
            b = cov[i] @ x - cov[i, i] * x[i]
            x[i] = (-b + np.sqrt(b * b + 4 * cov[i, i] / n)) / (2 * cov[i, i])
    return x / x.sum()


def _to_simplex(v: np.ndarray) -> np.ndarray:
    u = np.sort(v)[::-1]
    css = np.cumsum(u) - 1
    k = np.flatnonzero(u - css / np.arange(1, len(v) + 1) > 0)[-1]
    return np.maximum(v - css[k] / (k + 1), 0)


def shrunk_covariance(cov: np.ndarray, n_rows: int, target: str = "const_var") -> np.ndarray:
    """Covariance drawn towards a simple target by the oracle-approximating intensity.

    Targets: const_var, const_corr, and single_factor, the mean of all names, whose covariances follow from ``cov``.
    """
    p = len(cov)
    mu = np.trace(cov) / p
    if target == "const_var":
        goal = mu * np.eye(p)
    elif target == "single_factor":
        to_mean = cov.mean(axis=1)
        goal = np.outer(to_mean, to_mean) / max(cov.mean(), 1e-300)
        np.fill_diagonal(goal, np.diag(cov))
    elif target != "const_corr":
        raise ValueError(f"unknown target {target!r}")
    else:
        sd = np.sqrt(np.diag(cov))
        corr = cov / np.outer(sd, sd)
        mean = (corr.sum() - p) / (p * (p - 1))
        goal = mean * np.outer(sd, sd)
        np.fill_diagonal(goal, np.diag(cov))
    tr2 = np.sum(cov * cov)
    rho = min(1.0, ((1 - 2 / p) * tr2 + (p * mu) ** 2) / ((n_rows + 1 - 2 / p) * max(tr2 - (p * mu) ** 2 / p, 1e-300)))
    return (1 - rho) * cov + rho * goal
