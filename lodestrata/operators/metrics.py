"""Measures of factors and of return series, as aggregations and windows.

Frames of factors are (datetime, instrument, score, label). Infinite values count as missing. Correlations never
divide by zero: they are NULL where a side is constant or fewer than two pairs are whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.registry import both, md5_normal, percent_rank, zscore

YEAR = 252


def finite(c: str | Column) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of whole pairs as an aggregate."""
    a, b = both(x, y, x), both(x, y, y)
    product = F.stddev_samp(a) * F.stddev_samp(b)
    return F.when(F.count(a) >= 2, F.covar_samp(a, b) / F.when(product > 0, product))


def clean(df: DataFrame) -> DataFrame:
    return df.select("datetime", "instrument", finite("score").alias("score"), finite("label").alias("label"))


def daily_ic(df: DataFrame) -> DataFrame:
    """(datetime, ic, n): correlation of score and label over the instruments of a day."""
    return clean(df).groupBy("datetime").agg(correlation(F.col("score"), F.col("label")).alias("ic"), F.count(both(F.col("score"), F.col("label"), F.col("score"))).alias("n"))


def ranked_pairs(df: DataFrame) -> DataFrame:
    """Average ranks within the day, over rows that have both score and label."""
    pairs = clean(df).dropna(subset=["score", "label"])
    rank = lambda c: F.rank().over(Window.partitionBy("datetime").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("datetime", c)) - 1) / 2
    return pairs.select("datetime", "instrument", rank("score").alias("score"), rank("label").alias("label"))


def daily_rank_ic(df: DataFrame) -> DataFrame:
    return daily_ic(ranked_pairs(df))


def ic_summary(ic: DataFrame, value: str = "ic") -> DataFrame:
    """Mean, information ratio, its yearly figure and the number of days."""
    sd = F.stddev_samp(value)
    ratio = F.avg(value) / F.when(sd > 0, sd)
    return ic.agg(F.avg(value).alias("mean"), ratio.alias("icir"), (ratio * float(np.sqrt(YEAR))).alias("icir_ann"), F.count(value).alias("n_obs"))


def ic_tstat(ic: DataFrame, value: str = "ic") -> DataFrame:
    sd = F.stddev_samp(value)
    return ic.agg((F.abs(F.avg(value)) / F.when(sd > 0, sd / F.sqrt(F.count(value)))).alias("tstat"))


def ic_or_zero(ic: DataFrame) -> DataFrame:
    """Mean of the days' correlations; 0 if more than half of them are missing."""
    return ic.agg(F.when(F.avg(F.col("ic").isNull().cast("double")) > 0.5, 0.0).otherwise(F.coalesce(F.avg("ic"), F.lit(0.0))).alias("ic"))


def many_ics(df: DataFrame, scores: list[str], labels: list[str]) -> DataFrame:
    """(datetime, score, label, ic) of all pairs of columns in one aggregation."""
    cells = {f"{s}|{y}": correlation(finite(s), finite(y)) for s in scores for y in labels}
    wide = df.groupBy("datetime").agg(*[c.alias(f"c{i}") for i, c in enumerate(cells.values())])
    entries = [F.struct(F.lit(k.split("|")[0]).alias("score"), F.lit(k.split("|")[1]).alias("label"), F.col(f"c{i}").alias("ic")) for i, k in enumerate(cells)]
    return wide.select("datetime", F.explode(F.array(*entries)).alias("e")).select("datetime", "e.*")


def _sides(df: DataFrame, share: float) -> DataFrame:
    """Place from the top and the bottom of a day, and how many floor(share * n) are."""
    day = Window.partitionBy("datetime")
    rows = clean(df).dropna(subset=["score"])
    return rows.select("*", F.row_number().over(day.orderBy(F.desc("score"), "instrument")).alias("hi"), F.row_number().over(day.orderBy("score", "instrument")).alias("lo"), F.floor(F.count(F.lit(1)).over(day) * share).alias("k"))


def long_short(df: DataFrame, share: float = 0.2) -> DataFrame:
    """Per day: return of top less bottom by two, average return, and how often either side was right."""
    s = _sides(df, share)
    top, low = F.col("hi") <= F.col("k"), F.col("lo") <= F.col("k")
    return s.groupBy("datetime").agg(
        ((F.avg(F.when(top, F.col("label"))) - F.avg(F.when(low, F.col("label")))) / 2).alias("long_short"),
        F.avg("label").alias("average"),
        F.avg(F.when(top & F.col("label").isNotNull(), (F.col("label") > 0).cast("double"))).alias("long_precision"),
        F.avg(F.when(low & F.col("label").isNotNull(), (F.col("label") < 0).cast("double"))).alias("short_precision"),
    )


def group_returns(df: DataFrame, groups: int = 5) -> DataFrame:
    """(datetime, grp, ret): mean label of n // groups rows each by falling score; what remains is dropped."""
    day = Window.partitionBy("datetime")
    rows = clean(df).dropna(subset=["score"])
    place, each = F.row_number().over(day.orderBy(F.desc("score"), "instrument")), F.floor(F.count(F.lit(1)).over(day) / groups)
    grouped = rows.select("datetime", "label", place.alias("p"), each.alias("m")).filter("m > 0").withColumn("grp", (F.floor((F.col("p") - 1) / F.col("m")) + 1).cast("int"))
    return grouped.filter(F.col("grp") <= groups).groupBy("datetime", "grp").agg(F.avg("label").alias("ret"))


def lagged_days(df: DataFrame, value: str, lag: int = 1) -> DataFrame:
    """``value`` of the same instrument ``lag`` dates of the table earlier, whether or not it had rows between."""
    days = df.select("datetime").distinct().withColumn("__d", F.row_number().over(Window.orderBy("datetime")))
    dated = df.join(days, "datetime")
    past = dated.select("instrument", (F.col("__d") + lag).alias("__d"), F.col(value).alias("past"))
    return dated.join(past, ["instrument", "__d"], "left").drop("__d")


def autocorrelation(df: DataFrame, lag: int = 1, ranks: bool = False) -> DataFrame:
    rows = clean(df)
    if ranks:
        rows = rows.withColumn("score", percent_rank(F.col("score"), "datetime"))
    return lagged_days(rows, "score", lag).groupBy("datetime").agg(correlation(F.col("score"), F.col("past")).alias("autocorr"))


def topk_turnover(df: DataFrame, share: float = 0.2) -> DataFrame:
    """Share of a day's top that wasn't in the top of the date before."""
    top = _sides(df, share).filter("hi <= k").select("datetime", "instrument", F.lit(1).alias("score"))
    return lagged_days(top, "score").groupBy("datetime").agg((1 - F.count("past") / F.count(F.lit(1))).alias("turnover"))


def rank_stability(df: DataFrame, eps: float = 1e-8) -> DataFrame:
    """(datetime, kl, score): divergence of the day's rank shares from the date before, over names in both; 1 / (1 + kl)."""
    day = Window.partitionBy("datetime")
    rows = clean(df).dropna(subset=["score"])
    rank = F.rank().over(day.orderBy("score")) + (F.count(F.lit(1)).over(Window.partitionBy("datetime", "score")) - 1) / 2
    shares = rows.select("datetime", "instrument", rank.alias("r")).withColumn("score", F.col("r") / F.sum("r").over(day)).drop("r")
    both_days = lagged_days(shares, "score").filter("past is not null")
    kl = both_days.groupBy("datetime").agg(F.sum(F.col("score") * F.ln((F.col("score") + eps) / (F.col("past") + eps))).alias("kl"))
    return kl.withColumn("rre", 1 / (1 + F.col("kl")))


def rank_stability_common(df: DataFrame, least: int = 2) -> DataFrame:
    """As ``rank_stability``, ranks being taken anew among the names that both days have."""
    pairs = lagged_days(clean(df).dropna(subset=["score"]).select("datetime", "instrument", "score"), "score").filter("past is not null")
    day = Window.partitionBy("datetime")
    rank = lambda c: F.rank().over(day.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("datetime", c)) - 1) / 2
    r = pairs.select("datetime", rank("score").alias("a"), rank("past").alias("b")).withColumn("n", F.count(F.lit(1)).over(day)).filter(F.col("n") >= least)
    p = r.select("datetime", (F.col("a") / F.sum("a").over(day)).alias("p"), (F.col("b") / F.sum("b").over(day)).alias("q"))
    return p.groupBy("datetime").agg(F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))).alias("kl"), F.count(F.lit(1)).alias("n_common")).withColumn("rre", 1 / (1 + F.col("kl")))


def hashed_normal(*parts: Column, at: int = 0) -> Column:
    """A normal number that a hash of the row and of ``parts`` fixes; ``at``, an even number, tells numbers of one key apart."""
    u = lambda k: (F.pmod(F.xxhash64("datetime", "instrument", *parts, F.lit(k)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    return F.sqrt(-2 * F.ln(u(at))) * F.cos(2 * np.pi * u(at + 1))


def hashed_noise(kind: str, scale: float, dof: int, *parts: Column) -> Column:
    """gaussian, or student_t of ``dof`` degrees brought to the same deviation."""
    z = hashed_normal(*parts)
    if kind == "gaussian":
        return scale * z
    if kind != "student_t":
        raise ValueError(f"unknown noise {kind!r}")
    chi = sum((F.pow(hashed_normal(*parts, at=2 * k), F.lit(2.0)) for k in range(1, dof + 1)), F.lit(0.0))
    return scale * float(np.sqrt((dof - 2) / dof)) * z / F.sqrt(chi / dof)


def noise_stability(df: DataFrame, scale: float = 0.1, seed: int = 7) -> DataFrame:
    """(datetime, pfs): correlation of scores with themselves times 1 + noise, which a hash of the row fixes."""
    return clean(df).withColumn("noisy", F.col("score") * (1 + scale * md5_normal("instrument", F.unix_micros(F.col("datetime").cast("timestamp")), F.lit(seed)))).groupBy("datetime").agg(correlation(F.col("score"), F.col("noisy")).alias("pfs"))


def covariance(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Sample covariance of columns in one aggregation; a columns-by-columns matrix is what reaches the driver."""
    n = len(columns)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    row = df.agg(*[F.covar_samp(finite(columns[i]), finite(columns[j])).alias(f"c{k}") for k, (i, j) in enumerate(pairs)]).first()
    out = np.zeros((n, n))
    for k, (i, j) in enumerate(pairs):
        out[i, j] = out[j, i] = row[k] if row[k] is not None else 0.0
    return out


def diversity_entropy(cov: np.ndarray) -> float:
    """Entropy of the eigenvalues' shares by its maximum: 1 for unrelated factors of equal size, 0 for one direction."""
    values = np.clip(np.linalg.eigvalsh(cov), 0, None)
    if len(values) < 2 or values.sum() <= 0:
        return 0.0
    p = values / values.sum()
    p = p[p > 0]
    return float(-(p * np.log(p)).sum() / np.log(len(values)))


def validity(df: DataFrame) -> DataFrame:
    """One row on how far a signal is usable: covered days and cells, constant days, NaN and infinite cells."""
    x = F.col("score")
    good = finite(x)
    per_day = df.groupBy("datetime").agg(F.count(F.lit(1)).alias("uni"), F.count(good).alias("n"), F.min(good).alias("lo"), F.max(good).alias("hi"), F.sum((x.isNull() | F.isnan(x)).cast("long")).alias("nan"), F.sum(F.coalesce(F.abs(x) == float("inf"), F.lit(False)).cast("long")).alias("inf"))
    cover = F.col("n") / F.col("uni")
    two, still = F.col("n") >= 2, (F.col("n") >= 2) & (F.col("hi") == F.col("lo"))
    return per_day.agg(
        F.count(F.lit(1)).alias("n_total_days"),
        F.count(F.when(F.col("n") >= 1, 1)).alias("n_valid_days"),
        F.avg(cover).alias("mean_coverage"),
        F.percentile(cover, 0.5).alias("median_coverage"),
        F.percentile(cover, 0.1).alias("p10_coverage"),
        (F.count(F.when(still, 1)) / F.greatest(F.count(F.when(two, 1)), F.lit(1))).alias("const_day_ratio"),
        F.count(F.when(two & (F.col("hi") != F.col("lo")), 1)).alias("n_correlatable_days"),
        (F.sum("nan") / F.sum("uni")).alias("nan_cell_ratio"),
        (F.sum("inf") / F.sum("uni")).alias("inf_cell_ratio"),
    )


def validity_gate(stats: DataFrame, coverage: float = 0.5, days: float = 0.5, constant: float = 0.5) -> DataFrame:
    """``passed`` and the first reason against it."""
    reason = (
        F.when(F.col("n_valid_days") == 0, "no_valid_day")
        .when(F.col("n_valid_days") / F.col("n_total_days") < days, "few_valid_days")
        .when(F.col("mean_coverage") < coverage, "low_coverage")
        .when(F.col("const_day_ratio") > constant, "constant")
    )
    return stats.withColumn("reason", reason).withColumn("passed", reason.isNull())


def descriptors(df: DataFrame) -> DataFrame:
    """Per day: effective names by names, and half the change of weights z / sum |z| since the date before."""
    day = Window.partitionBy("datetime")
    z = clean(df).select("datetime", "instrument", F.col("score").isNotNull().cast("int").alias("valid"), zscore(F.col("score"), day).alias("z"))
    w = z.withColumn("s", F.sum(F.abs("z")).over(day)).withColumn("score", F.col("z") / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0))
    out = lagged_days(w, "score")
    breadth = (1 / F.when(F.sum(F.col("score") * F.col("score")) > 0, F.sum(F.col("score") * F.col("score")))) / F.when(F.sum("valid") > 0, F.sum("valid"))
    return out.groupBy("datetime").agg(breadth.alias("breadth"), (F.sum(F.abs(F.col("score") - F.coalesce("past", F.lit(0.0)))) / 2).alias("turnover"))


def regime_ic(df: DataFrame, regimes: DataFrame) -> DataFrame:
    """(regime, ic, n): mean daily IC in each regime; regimes(datetime, regime)."""
    return daily_ic(df).join(regimes, "datetime").groupBy("regime").agg(F.avg("ic").alias("ic"), F.count("ic").alias("n"))


def contrast(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return (a - b) / (F.abs(a) + F.abs(b) + eps)


def monthly(ic: DataFrame, value: str = "ic") -> DataFrame:
    return ic.groupBy(F.year("datetime").alias("year"), F.month("datetime").alias("month")).agg(F.avg(value).alias(value))


def feature_health(df: DataFrame, column: str) -> DataFrame:
    """Per day: distinct values, missing and infinite counts, mean and deviation."""
    x, good = F.col(column), finite(column)
    return df.groupBy("datetime").agg(F.countDistinct(good).alias("n_values"), F.count(F.when(x.isNull() | F.isnan(x), 1)).alias("n_missing"), F.count(F.when(F.abs(x) == float("inf"), 1)).alias("n_inf"), F.avg(good).alias("mean"), F.stddev_samp(good).alias("std"))


# Symbolic regression: weighted fits of a prediction to a target.


def weighted_pearson(x: Column, y: Column, w: Column) -> Column:
    total = F.sum(w)
    mx, my = F.sum(w * x) / total, F.sum(w * y) / total
    cov, vx, vy = F.sum(w * x * y) / total - mx * my, F.sum(w * x * x) / total - mx * mx, F.sum(w * y * y) / total - my * my
    return F.abs(cov / F.when((vx > 0) & (vy > 0), F.sqrt(vx * vy)))


def fit_errors(x: Column, y: Column, w: Column) -> dict[str, Column]:
    """Weighted absolute, squared and root squared error, and log loss of a logistic score."""
    p = F.least(F.greatest(1 / (1 + F.exp(-x)), F.lit(1e-15)), F.lit(1 - 1e-15))
    mse = F.sum(w * (x - y) * (x - y)) / F.sum(w)
    return {"mae": F.sum(w * F.abs(x - y)) / F.sum(w), "mse": mse, "rmse": F.sqrt(mse), "log_loss": -F.sum(w * F.when(y > 0, F.ln(p)).otherwise(F.ln(1 - p))) / F.sum(w)}
