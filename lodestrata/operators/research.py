"""Further measures and data steps of factor research."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.dsl.tree import extent, fields, parse, to_text
from lodestrata.functions.registry import hashed_uniform, percent_rank, zscore
from lodestrata.operators.metrics import correlation, finite, hashed_noise, lagged_days
from lodestrata.plans.compiler import evaluate


# Signals.

PFS_MODES = ("legacy", "paper", "relative")


def market_volatility(frame: DataFrame) -> float:
    """Deviation over days of the mean ``score`` (a return) of the day's names."""
    days = frame.groupBy("datetime").agg(F.avg(finite("score")).alias("r"))
    return days.agg(F.stddev_samp("r")).first()[0] or 0.0


def perturbation_fidelity(panel: DataFrame, formula: str, sigma: float, mode: str = "paper", draws: int = 3, seed: int = 0, dof: int = 3) -> DataFrame:
    """One row (mode, gaussian, student_t, least, gaussian_sd, student_t_sd): how far a factor stays itself under noise.

    legacy: scores times 1 + noise, Pearson; paper: noise added to each field, and relative: each field times 1 + noise,
    of which the formula is computed anew, Spearman. Each kind of noise is drawn ``draws`` times; a draw counts by the
    mean of its daily correlations, a kind by the mean of its draws, and the deviation over draws stands beside it.
    Noise is fixed by hashes of row, field, kind, draw, seed and mode, so that all formulas meet the same one.
    """
    if mode not in PFS_MODES:
        raise ValueError(f"unknown mode {mode!r}")
    copies = {f"{kind}_{d}": kind for kind in ("gaussian", "student_t") for d in range(draws)}
    noise = lambda name, of: hashed_noise(copies[name], sigma, dof, F.lit(f"{mode}|{of}|{name}|{seed}"))
    if mode == "legacy":
        rows = evaluate(panel, {"score": formula})
        rows = rows.withColumns({name: F.col("score") * (1 + noise(name, "")) for name in copies})
    else:
        text = to_text(parse(formula))
        names = sorted(fields(parse(formula)))
        noisy = {f"{c}__{name}": F.col(c) + noise(name, c) if mode == "paper" else F.col(c) * (1 + noise(name, c)) for c in names for name in copies}
        versions = {name: re.sub(r"\$(\w+)", rf"$\1__{name}", text) for name in copies}
        rows = evaluate(panel.withColumns(noisy), {"score": text, **versions})
    pairs = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("draw"), finite(name).alias("noisy")) for name, kind in copies.items()]))
    rows = rows.select("datetime", finite("score").alias("score"), pairs.alias("p")).select("datetime", "score", "p.*").dropna(subset=["score", "noisy"])
    by = ("kind", "draw", "datetime")
    if mode != "legacy":
        rank = lambda c: F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2
        rows = rows.select(*by, rank("score").alias("score"), rank("noisy").alias("noisy"))
    daily = rows.groupBy(*by).agg(correlation(F.col("score"), F.col("noisy")).alias("r"))
    each = daily.groupBy("kind", "draw").agg(F.avg("r").alias("r"))
    of = lambda kind: F.when(F.col("kind") == kind, F.col("r"))
    out = each.agg(*[f(of(kind)).alias(kind + end) for f, end in ((F.avg, ""), (F.stddev_pop, "_sd")) for kind in ("gaussian", "student_t")])
    least = F.when(F.col("gaussian").isNotNull() & F.col("student_t").isNotNull(), F.least("gaussian", "student_t"))
    return out.select(F.lit(mode).alias("mode"), "gaussian", "student_t", least.alias("least"), "gaussian_sd", "student_t_sd")



def average_ensemble(frames: list[DataFrame]) -> DataFrame:
    """Mean of the frames' daily z-scores (sample deviation); rows that a frame lacks don't count for it."""
    day = Window.partitionBy("datetime", "__f")
    rows = None
    for k, f in enumerate(frames):
        part = f.select("datetime", "instrument", finite("score").alias("score"), F.lit(k).alias("__f"))
        rows = part if rows is None else rows.unionByName(part)
    sd = F.stddev_samp("score").over(day)
    z = rows.withColumn("score", (F.col("score") - F.avg("score").over(day)) / F.when(sd > 0, sd))
    return z.groupBy("datetime", "instrument").agg(F.avg("score").alias("score"))


def rolling_ensemble(frames: list[DataFrame]) -> DataFrame:
    """Predictions of successive tasks as one frame; the later task wins where two have a key."""
    rows = None
    for k, f in enumerate(frames):
        part = f.withColumn("__f", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    rest = [c for c in frames[0].columns if c not in ("datetime", "instrument")]
    last = rows.groupBy("datetime", "instrument").agg(F.max_by(F.struct(*rest), "__f").alias("r"))
    return last.select("datetime", "instrument", "r.*")


def split_predictions(pred: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """The first ``number`` dates and the rest."""
    days = pred.select("datetime").distinct().withColumn("__n", F.row_number().over(Window.orderBy("datetime")))
    dated = pred.join(days, "datetime")
    return dated.filter(F.col("__n") <= number).drop("__n"), dated.filter(F.col("__n") > number).drop("__n")


def permuted(df: DataFrame, seed: int = 7) -> DataFrame:
    """Scores dealt anew among the instruments of a day: the null of a cross-sectional signal."""
    by = lambda *o: F.row_number().over(Window.partitionBy("datetime").orderBy(*o))
    names = df.select("datetime", "instrument", "label", by("instrument").alias("__k"))
    values = df.select("datetime", "score", by(hashed_uniform("instrument", F.unix_micros(F.col("datetime").cast("timestamp")), F.lit(seed)), "instrument").alias("__k"))
    return names.join(values, ["datetime", "__k"]).drop("__k")


# Liquidity and regimes.


def illiquidity(panel: DataFrame, length: int = 20, least: int = 10) -> DataFrame:
    """Mean of |return| / amount over the last rows; NULL with fewer than ``least`` values; and its daily percentile."""
    w = Window.partitionBy("instrument").orderBy("cal_idx").rowsBetween(-(length - 1), 0)
    x = F.abs("change") / F.when(F.col("amount") > 0, F.col("amount"))
    rows = panel.withColumn("__x", x * 1e9)
    rows = rows.withColumn("illiquidity", F.when(F.count("__x").over(w) >= least, F.avg("__x").over(w))).drop("__x")
    return rows.withColumn("illiquidity_pct", percent_rank(F.col("illiquidity"), "datetime"))


def volatility_regimes(benchmark: DataFrame, length: int = 20, train_end: str | None = None, low: float = 0.3, high: float = 0.7) -> DataFrame:
    """(datetime, vol, regime): rolling deviation of the benchmark, cut at quantiles of the training days."""
    w = Window.orderBy("datetime").rowsBetween(-(length - 1), 0)  # one row a day
    vol = benchmark.withColumn("vol", F.when(F.count("bench").over(w) == length, F.stddev_samp("bench").over(w)))
    train = vol if train_end is None else vol.filter(F.col("datetime") <= F.to_timestamp(F.lit(train_end)))
    a, b = train.agg(F.percentile("vol", low), F.percentile("vol", high)).first()
    regime = F.when(F.col("vol") <= F.lit(a), "low").when(F.col("vol") >= F.lit(b), "high").when(F.col("vol").isNotNull(), "middle")
    return vol.select("datetime", "vol", regime.alias("regime"))


def horizon(ics: DataFrame) -> DataFrame:
    """Horizon of a signal: mean of horizons weighted by |IC|; ics(horizon, ic)."""
    total = F.sum(F.abs("ic"))
    return ics.agg((F.sum(F.col("horizon") * F.abs("ic")) / F.when(total > 1e-12, total)).alias("horizon"))


def footprint(df: DataFrame, characteristic: str) -> DataFrame:
    """Per day: the characteristic's mean percentile weighted by |z|, and top less bottom fifth by score."""
    day = Window.partitionBy("datetime")
    rows = df.select("datetime", "instrument", finite("score").alias("score"), percent_rank(finite(characteristic), "datetime").alias("pct"))
    z = rows.withColumn("w", F.abs(zscore(F.col("score"), day))).withColumn("p", percent_rank(F.col("score"), "datetime"))
    total = F.sum("w")
    return z.groupBy("datetime").agg((F.sum(F.col("w") * F.col("pct")) / F.when(total > 0, total)).alias("footprint"), (F.avg(F.when(F.col("p") > 0.8, F.col("pct"))) - F.avg(F.when(F.col("p") <= 0.2, F.col("pct")))).alias("tilt"), F.abs(correlation(F.col("p"), F.col("pct"))).alias("rank_corr"))


def common_turnover(df: DataFrame) -> DataFrame:
    """Half the change of |z|-normalised weights among the names that two successive dates share."""
    day = Window.partitionBy("datetime")
    z = df.select("datetime", "instrument", finite("score").alias("score")).dropna().withColumn("score", zscore(F.col("score"), day))
    pairs = lagged_days(z, "score").filter("past is not null")
    a, b = F.sum(F.abs("score")).over(day), F.sum(F.abs("past")).over(day)
    moved = pairs.select("datetime", F.abs(F.col("score") / F.when(a > 0, a) - F.col("past") / F.when(b > 0, b)).alias("d"))
    return moved.groupBy("datetime").agg((F.sum("d") / 2).alias("turnover"))


# Positions and pools.


def benchmark_weights(rows: DataFrame, index: str) -> DataFrame:
    """(datetime, instrument, weight) of an index from constituent rows (code, date, index, weight in per cent)."""
    return rows.filter(F.col("index") == index).groupBy(F.col("date").cast("timestamp").alias("datetime"), F.col("code").alias("instrument")).agg((F.sum("weight") / 100).alias("weight"))


def position_status(held: DataFrame) -> DataFrame:
    """1 for names new on a date, 0 for held ones, -1 (dated on the day they are gone) for names that left."""
    days = held.select("datetime").distinct().withColumn("__d", F.row_number().over(Window.orderBy("datetime")))
    now = held.select("datetime", "instrument").join(days, "datetime").select("__d", "instrument", F.lit(1).alias("now"))
    then = now.select((F.col("__d") + 1).alias("__d"), "instrument", F.lit(1).alias("then"))
    both = now.join(then, ["__d", "instrument"], "full").join(days, "__d")
    return both.select("datetime", "instrument", (F.coalesce("now", F.lit(0)) - F.coalesce("then", F.lit(0))).alias("status"))


def profile(results: DataFrame, group: str, value: str) -> DataFrame:
    """Median, quartile range, worst and number of a value over a grid of configurations."""
    q = lambda p: F.percentile(value, p)
    return results.groupBy(group).agg(q(0.5).alias("median"), (q(0.75) - q(0.25)).alias("iqr"), F.min(value).alias("worst"), F.count(value).alias("n"))


def nearest_on_grid(binned: DataFrame, x: str, y: str) -> DataFrame:
    """Least distance of each occupied cell to another occupied one.

    Cells, not points, are compared: at most bins * bins of them, in an array that each row of cells scans.
    """
    cells = binned.groupBy("gx", "gy").agg(F.count("*").alias("n"))
    cells = cells.withColumn("all", F.collect_list(F.struct("gx", "gy")).over(Window.partitionBy(F.lit(1))))  # bounded by the grid
    distance = lambda c: F.sqrt(F.pow(c["gx"] - F.col("gx"), F.lit(2.0)) + F.pow(c["gy"] - F.col("gy"), F.lit(2.0)))
    others = F.filter("all", lambda c: (c["gx"] != F.col("gx")) | (c["gy"] != F.col("gy")))
    return cells.select("gx", "gy", "n", F.array_min(F.transform(others, distance)).alias("nearest"))


def execution_trend(bars: DataFrame, span: int = 3) -> DataFrame:
    """Which of two adjacent bars an order should favour: the sign of the fast mean's move, read on even steps."""
    moved = evaluate(bars, {"trend": f"Sign(EMA($close, {span}) - Ref(EMA($close, {span}), 1))"})
    even = F.pmod(F.col("cal_idx"), F.lit(2)) == 0
    w = Window.partitionBy("instrument").orderBy("cal_idx").rowsBetween(Window.unboundedPreceding, 0)
    return moved.withColumn("trend", F.last(F.when(even, F.col("trend")), True).over(w))


def indicator_means(rows: DataFrame, value: str, method: str = "mean", amount: str = "amount", price: str = "price") -> DataFrame:
    """Mean of an indicator, plain or weighted by traded amount or by traded value."""
    w = {"mean": F.lit(1.0), "amount": F.abs(amount), "value": F.abs(F.col(amount) * F.col(price))}[method]
    total = F.sum(F.when(F.col(value).isNotNull(), w))
    return rows.agg((F.sum(F.col(value) * w) / F.when(total > 0, total)).alias(value))


# Stored series.


class SeriesStore:
    """Evaluated formulas kept as tables under a folder, one per canonical formula, and updated at the tail.

    An update computes the days after the stored end and as many before it as the formula looks ahead, and replaces
    those; formulas that look back without bound are computed from the whole panel but stored the same way.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, formula: str, version: str = "") -> str:
        return f"{self.folder}/{hashlib.sha256(to_text(parse(formula)).encode()).hexdigest()[:24]}{version}"

    def write(self, panel: DataFrame, formula: str, upto: int, version: int = 0) -> DataFrame:
        path = self.path(formula, f"/v{version}")
        evaluate(panel, {"value": formula}, end=upto).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def update(self, panel: DataFrame, formula: str, old: DataFrame, upto: int, version: int) -> DataFrame:
        ahead = extent(parse(formula))[1]
        end = old.agg(F.max("cal_idx")).first()[0]
        first = -(1 << 30) if end is None else int(end - ahead) + 1
        tail = evaluate(panel, {"value": formula}, start=first, end=upto)
        path = self.path(formula, f"/v{version}")
        old.filter(F.col("cal_idx") < first).unionByName(tail).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def closed(build, arity: int, spark: SparkSession) -> bool:
    """Whether a row-wise function is defined for zeros and negative numbers, as symbolic regression needs."""
    values = [-1.0, 0.0, 1.0]
    rows = [(a, b, c) for a in values for b in values for c in values]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    out: Column = build(*[F.col(x) for x in "abc"[:arity]])
    return df.select(out.cast("double").alias("v")).filter(F.col("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf"))).limit(1).count() == 0
