"""Accounts at an exchange: limits, suspension, volume caps, lots and fees.

What depends on the order alone (``deal``) is a plan over orders and quotes. What depends on the account's own past
(cash, holdings, holding times) is folded day by day, one account a task, each day as arrays over its names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Exchange:
    """Fees as shares of a deal's value and its other terms."""

    open_cost: float = 0.0005
    close_cost: float = 0.0015
    min_cost: float = 5.0
    impact: float = 0.0  # times the square of the deal's share in the day's turnover
    unit: float = 100.0  # shares of a lot, before adjustment
    volume_share: float | None = None  # of the day's volume that all orders of a name may take
    both_limits: bool = True  # at either limit neither buying nor selling


def lots(amount, factor, unit: float):
    """Whole lots of unadjusted shares; any amount where there is no factor."""
    with np.errstate(all="ignore"):
        whole = np.floor((amount * factor + 0.1) / unit) * unit / factor if unit > 0 else amount
    return np.where(np.isfinite(factor) & (unit > 0), whole, amount)


def fees(worth, turnover, ratio: float, terms: Exchange):
    """Fee of deals; without a known turnover the impact counts whole."""
    with np.errstate(all="ignore"):
        part = np.where(np.isfinite(turnover) & (turnover > 0), (worth / turnover) ** 2, 1.0)
    return np.where(worth > 1e-5, np.maximum(worth * (ratio + terms.impact * part), terms.min_cost), 0.0)


def affordable(cash, price, ratio: float, least: float):
    """Shares that cash buys, fees included: the fee is a share of the value, or ``least`` for small deals."""
    by_share = cash / (1 + ratio)
    value = np.where(by_share * ratio >= least, by_share, cash - least)
    with np.errstate(all="ignore"):
        return np.maximum(value, 0.0) / price


def rotation(score: np.ndarray, held: np.ndarray, topk: int, drop: int) -> tuple[np.ndarray, np.ndarray]:
    """Which held names leave and which others come in, of one day's names with their scores (NaN: none).

    The pool is what is held and the best others that there could be room for. The ``drop`` lowest of the pool leave
    if they are held; the best others fill the places, up to ``topk``.
    """
    place = np.lexsort((np.arange(len(score)), -np.nan_to_num(score, nan=-np.inf)))
    own, scored = held[place], ~np.isnan(score[place])
    free = topk - int(own.sum())
    outside = np.cumsum(~own & scored)
    pool = own | (~own & scored & (outside <= free + drop))
    below = pool[::-1].cumsum()[::-1] - pool  # members of the pool that rank lower
    leaving = own & (below < drop)
    coming = ~own & pool & (outside <= free + int(leaving.sum()))
    out, into = np.zeros(len(score), bool), np.zeros(len(score), bool)
    out[place], into[place] = leaving, coming
    return out, into


_DAY = "account string, datetime timestamp, cash double, value double, ret double, cost double, turnover double, n_held int, refused int"


def _account(topk: int, drop: int, risk: float, start: float, hold: int, terms: Exchange) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["datetime", "instrument"], kind="stable").drop_duplicates(["datetime", "instrument"], keep="last")
        code, names = pd.factorize(rows.instrument, sort=True)
        day, days = pd.factorize(rows.datetime, sort=True)
        grid = {}
        for c in ("score", "price", "factor", "amount", "volume", "limit_buy", "limit_sell"):
            grid[c] = np.full((len(days), len(names)), np.nan)
            grid[c][day, code] = rows[c].to_numpy(float)
        shares, age, known = np.zeros(len(names)), np.zeros(len(names), int), np.full(len(names), np.nan)
        cash, before, out = start, start, []
        for t, when in enumerate(days):
            score, price, factor, turnover, volume = (grid[c][t] for c in ("score", "price", "factor", "amount", "volume"))
            quoted = np.isfinite(price) & (price > 0)
            known = np.where(quoted, price, known)
            up, low = (np.nan_to_num(grid[c][t]) > 0 for c in ("limit_buy", "limit_sell"))
            if terms.both_limits:
                up = low = up | low
            out_, in_ = rotation(score, shares > 0, topk, drop)
            sold = out_ & quoted & ~low & (age >= hold)
            room = np.where(np.isfinite(volume), volume, 0.0) * terms.volume_share if terms.volume_share is not None else np.full(len(names), np.inf)
            away = np.where(sold, np.minimum(shares, room), 0.0)
            away = np.where(away < shares, lots(away, factor, terms.unit), away)
            got = np.where(sold, away * price, 0.0)
            paid = fees(got, turnover, terms.close_cost, terms)
            cash += float(got.sum() - paid.sum())
            shares = np.where(sold, shares - away, shares)

            best = np.flatnonzero(in_)[np.argsort(-score[in_], kind="stable")]
            budget = cash * risk / max(1, len(best))
            best = best[quoted[best] & ~up[best]]
            most = np.minimum(np.minimum(budget / price[best], affordable(cash, price[best], terms.open_cost, terms.min_cost)), room[best])
            plan = lots(most, factor[best], terms.unit) * price[best]
            fee = fees(plan, turnover[best], terms.open_cost, terms)
            within = (np.cumsum(plan + fee) <= cash + 1e-9) & (plan > 0)
            cash -= float((plan + fee)[within].sum())
            shares[best[within]] += plan[within] / price[best[within]]
            age = np.where(shares > 0, age + 1, 0)

            value = cash + float(np.nansum(shares * known))
            cost, traded = float(paid.sum() + fee[within].sum()), float(got.sum() + plan[within].sum())
            refused = int((out_ & ~sold).sum() + in_.sum() - within.sum())
            out.append((rows.account.iloc[0], when, cash, value, (value - before + cost) / before, cost / before, traded / before, int((shares > 0).sum()), refused))
            before = value
        return pd.DataFrame(out, columns=["account", "datetime", "cash", "value", "ret", "cost", "turnover", "n_held", "refused"])

    return run


def simulate_topk(frame: DataFrame, topk: int = 10, drop: int = 2, risk_degree: float = 0.95, start_cash: float = 1e6, hold: int = 1, terms: Exchange = Exchange()) -> DataFrame:
    """Accounts that hold the best ``topk`` names and let at most ``drop`` of them go a day.

    frame(account, datetime, instrument, score, price, factor, amount[, volume, limit_buy, limit_sell]). A name without
    price is suspended; at a limit it isn't traded (``Exchange.both_limits``: in neither direction); held names stay
    ``hold`` days at least; ``Exchange.volume_share`` caps a day's trade. ``refused`` counts orders that were not
    dealt. Cash, lots and fees make a day depend on the one before, so an account is folded in one task; accounts run
    in parallel. An empty frame gives no rows; rows with a NULL account or datetime are left out.
    """
    extra = {c: F.col(c).cast("double") if c in frame.columns else F.lit(None).cast("double") for c in ("volume", "limit_buy", "limit_sell")}
    rows = frame.filter("account is not null and datetime is not null and instrument is not null")
    rows = rows.select(F.col("account").cast("string").alias("account"), "datetime", "instrument", *[F.col(c).cast("double") for c in ("score", "price", "factor", "amount")], *[x.alias(c) for c, x in extra.items()])
    return rows.groupBy("account").applyInPandas(_account(topk, drop, risk_degree, start_cash, hold, terms), _DAY)


def deal(orders: DataFrame, quotes: DataFrame, terms: Exchange = Exchange()) -> DataFrame:
    """Orders against the quotes of their day: ``done`` shares, ``worth`` and ``fee`` next to the orders' columns.

    orders(order_id, instrument, datetime, direction (1 buy, 0 sell), wanted), quotes(instrument, datetime, price, factor,
    amount, volume, limit_buy, limit_sell), one row a key. Nothing is done without a price or at a limit. All orders of
    a name and day share ``volume_share`` of its volume, first come first served by order_id; then whole lots are cut.
    """
    joined = orders.join(quotes.select("instrument", "datetime", "price", "factor", "amount", "volume", "limit_buy", "limit_sell"), ["instrument", "datetime"], "left")
    up, low = F.coalesce("limit_buy", F.lit(False)), F.coalesce("limit_sell", F.lit(False))
    barred = (up | low) if terms.both_limits else F.when(F.col("direction") == 1, up).otherwise(low)
    open_ = (F.col("price") > 0) & ~barred
    wanted = F.when(F.coalesce(open_, F.lit(False)), F.greatest(F.coalesce("wanted", F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    joined = joined.withColumn("__open", wanted)
    amount: Column = F.col("__open")
    if terms.volume_share is not None:
        # the orders of one name and day: as many as were placed there
        w = Window.partitionBy("instrument", "datetime").orderBy("order_id").rowsBetween(Window.unboundedPreceding, -1)
        room = F.coalesce("volume", F.lit(0.0)) * terms.volume_share - F.coalesce(F.sum("__open").over(w), F.lit(0.0))
        amount = F.greatest(F.lit(0.0), F.least(amount, room))
    if terms.unit > 0:
        amount = F.when(F.col("factor") > 0, F.floor((amount * F.col("factor") + 0.1) / terms.unit) * terms.unit / F.col("factor")).otherwise(amount)
    worth = F.col("done") * F.coalesce("price", F.lit(0.0))
    ratio = F.when(F.col("direction") == 1, terms.open_cost).otherwise(terms.close_cost)
    part = F.when(F.col("amount") > 0, F.pow(F.col("worth") / F.col("amount"), 2)).otherwise(1.0)
    fee = F.when(F.col("worth") > 1e-5, F.greatest(F.col("worth") * (ratio + terms.impact * part), F.lit(terms.min_cost))).otherwise(0.0)
    return joined.withColumn("done", amount).withColumn("worth", worth).withColumn("fee", fee).drop("__open")


def tradable(panel: DataFrame, limit: float | None = 0.095) -> DataFrame:
    """``limit_buy`` and ``limit_sell``: no trade without a price, no buying at the upper and no selling at the lower limit."""
    gone = F.col("close").isNull()
    up, down = (F.coalesce(F.col("change") >= limit, F.lit(False)), F.coalesce(F.col("change") <= -limit, F.lit(False))) if limit is not None else (F.lit(False), F.lit(False))
    return panel.withColumn("limit_buy", gone | up).withColumn("limit_sell", gone | down)


def long_short_tradable(scores: DataFrame, quotes: DataFrame, topk: int = 50) -> DataFrame:
    """(datetime, long, short, long_short): mean returns of a day's best and worst ``topk`` names that can be traded.

    scores(datetime, instrument, score), quotes(datetime, instrument, price, limit_buy, limit_sell, ret) of the day of the
    trade. The names are chosen before their quotes are looked at: one at a limit or suspended drops out, another
    without a return earns nothing. ``long`` and ``short`` are measured against all names that are not suspended,
    ``long_short`` is the sum of both sides. A side without names is NULL. Ties go to the smaller instrument.
    """
    day = Window.partitionBy("datetime")
    rows = scores.dropna(subset=["score"]).filter(~F.isnan("score")).select("datetime", "instrument", F.row_number().over(day.orderBy(F.desc("score"), "instrument")).alias("__hi"), F.row_number().over(day.orderBy("score", F.desc("instrument"))).alias("__lo"))
    rows = rows.join(quotes.select("datetime", "instrument", "price", "limit_buy", "limit_sell", "ret"), ["datetime", "instrument"], "left")
    quoted = F.col("price") > 0
    free = quoted & ~F.coalesce(F.col("limit_buy") | F.col("limit_sell"), F.lit(False))
    gain = F.coalesce("ret", F.lit(0.0))
    side = lambda c, sign: F.avg(F.when((F.col(c) <= topk) & free, sign * gain))
    daily = rows.groupBy("datetime").agg(side("__hi", 1.0).alias("__l"), side("__lo", -1.0).alias("__s"), F.avg(F.when(quoted, gain)).alias("__all"))
    return daily.select("datetime", (F.col("__l") - F.col("__all")).alias("long"), (F.col("__s") + F.col("__all")).alias("short"), (F.col("__l") + F.col("__s")).alias("long_short"))
