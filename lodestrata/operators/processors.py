"""Processors of datasets: filling, filtering and normalising columns, fitted on a range or within a day."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.registry import percent_rank

Processor = Callable[[DataFrame], DataFrame]


def _day():
    return Window.partitionBy("datetime")


#: Makes the median absolute deviation comparable with a standard deviation.
MAD_SCALE = 1.4826


def _each(df: DataFrame, columns: list[str], f: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({c: f(F.col(c)) for c in columns})


def drop_missing(columns: list[str]) -> Processor:
    return lambda df: df.na.drop(subset=columns)


def fill(columns: list[str], value: float = 0.0) -> Processor:
    return lambda df: df.na.fill(value, columns)


def keep_columns(pattern: str, keys: tuple[str, ...] = ("instrument", "datetime")) -> Processor:
    return lambda df: df.select(*[c for c in df.columns if c in keys or re.search(pattern, c)])


def drop_columns(columns: list[str]) -> Processor:
    return lambda df: df.drop(*columns)


def squash(columns: list[str]) -> Processor:
    """tanh(x - 1)."""
    return lambda df: _each(df, columns, lambda x: F.tanh(x - 1))


def infinite_to_mean(columns: list[str]) -> Processor:
    """Infinite values become the day's mean of the others, missing ones aside; NULL where a day has no others."""
    wild = lambda x: F.abs(x) == float("inf")
    return lambda df: _each(df, columns, lambda x: F.when(wild(x), F.avg(F.when(~wild(x) & ~F.isnan(x), x)).over(_day())).otherwise(x))


def day_zscore(columns: list[str]) -> Processor:
    """By the sample deviation of the day; NULL where nothing varies."""

    def f(x: Column) -> Column:
        sd = F.stddev_samp(x).over(_day())
        return (x - F.avg(x).over(_day())) / F.when(sd > 0, sd)

    return lambda df: _each(df, columns, f)


def day_robust(columns: list[str], clip: float = 3.0) -> Processor:
    """Median and scaled absolute deviation of the day, cut at +-clip; two passes over the day, without a self-join."""

    def run(df: DataFrame) -> DataFrame:
        mid = df.withColumns({f"__m_{c}": F.percentile(c, 0.5).over(_day()) for c in columns})
        out = mid
        for c in columns:
            spread = F.percentile(F.abs(F.col(c) - F.col(f"__m_{c}")), 0.5).over(_day()) * MAD_SCALE
            out = out.withColumn(c, (F.col(c) - F.col(f"__m_{c}")) / F.when(spread > 0, spread))
        # greatest and least skip NULL
        return out.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), F.col(c)))) for c in columns}).drop(*[f"__m_{c}" for c in columns])

    return run


def day_rank(columns: list[str]) -> Processor:
    """Percentage rank of the day, centred and scaled to about one deviation."""
    return lambda df: _each(df, columns, lambda x: (percent_rank(x, "datetime") - 0.5) * 3.46)


def day_fill(columns: list[str]) -> Processor:
    return lambda df: _each(df, columns, lambda x: F.coalesce(x, F.avg(x).over(_day())))


@dataclass(frozen=True)
class Fitted:
    """Shift and scale of each column, learned once on a range of time: one row, applied as literals."""

    shift: dict[str, float]
    scale: dict[str, float]
    clip: float | None = None

    def __call__(self, df: DataFrame) -> DataFrame:
        def f(c: str) -> Column:
            x = (F.col(c) - self.shift[c]) / self.scale[c]
            return x if self.clip is None else F.when(x.isNotNull(), F.greatest(F.lit(-self.clip), F.least(F.lit(self.clip), x)))

        return df.withColumns({c: f(c) for c in self.shift})


def fit(df: DataFrame, columns: list[str], kind: str = "zscore", start: str | None = None, end: str | None = None) -> Fitted:
    """minmax, zscore (population deviation) or robust (median, scaled deviation, cut at +-3); a column without spread stays as it is."""
    part = df
    if start is not None:
        part = part.filter(F.col("datetime") >= F.to_timestamp(F.lit(start)))
    if end is not None:
        part = part.filter(F.col("datetime") <= F.to_timestamp(F.lit(end)))
    if kind == "robust":
        mids = part.agg(*[F.percentile(c, 0.5).alias(c) for c in columns]).first()
        row = part.agg(*[(F.percentile(F.abs(F.col(c) - F.lit(mids[c])), 0.5) * MAD_SCALE).alias(c) for c in columns]).first()
        a, b = {c: mids[c] for c in columns}, {c: row[c] for c in columns}
    else:
        low, high = ((F.min, F.max), (F.avg, F.stddev_pop))[kind == "zscore"]
        row = part.agg(*[low(c).alias(f"a_{c}") for c in columns], *[high(c).alias(f"b_{c}") for c in columns]).first()
        a = {c: row[f"a_{c}"] for c in columns}
        b = {c: row[f"b_{c}"] - (a[c] if kind == "minmax" else 0) if a[c] is not None else None for c in columns}
    spread = [c for c in columns if b[c]]
    return Fitted({c: float(a[c]) for c in spread}, {c: float(b[c]) for c in spread}, 3.0 if kind == "robust" else None)


def by_family(rules: dict[str, Callable[[Column], Column]]) -> Processor:
    """Transforms of columns by the first pattern that their name meets."""

    def run(df: DataFrame) -> DataFrame:
        found = {c: next((f for p, f in rules.items() if re.search(p, c)), None) for c in df.columns}
        return df.withColumns({c: f(F.col(c)) for c, f in found.items() if f})

    return run


#: Transforms that make heavy-tailed families even.
FAMILIES: dict[str, Callable[[Column], Column]] = {
    r"^(VOLUME|VMA|VSTD|WVMA)": lambda x: F.ln(F.when(x > -1, x + 1)),
    r"^(STD|RESI)": lambda x: F.signum(x) * F.sqrt(F.abs(x)),
    r"^(KLEN|RSQR)": lambda x: F.pow(F.when(x >= 0, x), F.lit(0.25)),
}


def pipeline(*steps: Processor) -> Processor:
    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = df.transform(s)
        return df

    return run


def infer_and_learn(df: DataFrame, shared: list[Processor], infer: list[Processor], learn: list[Processor], append: bool = True) -> tuple[DataFrame, DataFrame]:
    """Frames for inference and for learning; learning starts from the inferred frame if ``append``, else beside it."""
    base = df.transform(pipeline(*shared))
    inferred = base.transform(pipeline(*infer))
    return inferred, (inferred if append else base).transform(pipeline(*learn))


def segments(df: DataFrame, spans: dict[str, tuple[str, str]]) -> dict[str, DataFrame]:
    return {k: df.filter(F.col("datetime").between(F.to_timestamp(F.lit(a)), F.to_timestamp(F.lit(b)))) for k, (a, b) in spans.items()}


def look_back(df: DataFrame, columns: list[str], length: int, fill_forward: bool = True) -> DataFrame:
    """``window``: the last ``length`` rows of an instrument as an array of structs, oldest first, padded with NULLs.

    With ``fill_forward`` gaps take the value before them, and leading ones the value after.
    """
    w = Window.partitionBy("instrument").orderBy("cal_idx")
    row = F.struct(*[F.col(c).cast("double").alias(c) for c in columns])
    held = F.collect_list(row).over(w.rowsBetween(-(length - 1), 0))
    blank = F.struct(*[F.lit(None).cast("double").alias(c) for c in columns])
    out = df.withColumn("window", F.concat(F.array_repeat(blank, length - F.size(held)), held))
    if not fill_forward:
        return out
    return out.withColumn("window", F.transform("window", lambda e, i: F.struct(*[_near(F.col("window"), e, i, c).alias(c) for c in columns])))


def _near(whole: Column, e: Column, i: Column, c: str) -> Column:
    values = F.transform(whole, lambda x: x[c])
    before = F.filter(F.slice(values, 1, i + 1), lambda v: v.isNotNull())
    after = F.filter(values, lambda v: v.isNotNull())
    return F.coalesce(e[c], F.try_element_at(before, F.lit(-1)), F.try_element_at(after, F.lit(1)))


def rolling_segments(calendar: DataFrame, train: int, valid: int, test: int, step: int, expanding: bool = False) -> DataFrame:
    """(task, train_start, train_end, valid_start, valid_end, test_start, test_end): bounds of successive tasks."""
    ends = calendar.agg(F.min("cal_idx").alias("a"), F.max("cal_idx").alias("b"))
    task = ends.select("a", "b", F.explode(F.sequence(F.lit(0), F.floor((F.col("b") - F.col("a") + 1 - train - valid - test) / step).cast("int"))).alias("task"))
    at = F.col("a") + F.col("task") * step
    bounds = {"train_start": F.col("a") if expanding else at, "train_end": at + train - 1, "valid_start": at + train, "valid_end": at + train + valid - 1, "test_start": at + train + valid, "test_end": F.least(at + train + valid + test - 1, F.col("b"))}
    return task.select("task", *[c.cast("int").alias(k) for k, c in bounds.items()])


def without_tail(df: DataFrame, label: str, k: int) -> DataFrame:
    """The label of the last k dates becomes NULL."""
    days = df.select("datetime").distinct().withColumn("__n", F.row_number().over(Window.orderBy(F.desc("datetime"))))
    return df.join(days, "datetime").withColumn(label, F.when(F.col("__n") > k, F.col(label))).drop("__n")


def noisy(df: DataFrame, columns: list[str], scale: float, seed: int = 7, freedom: int | None = None) -> DataFrame:
    """Columns times 1 + noise: normal, or Student's t of integer freedom scaled to the same variance; fixed by row and seed."""

    def normal(c: str, k: int) -> Column:
        u = lambda j: (F.pmod(F.xxhash64("instrument", "datetime", F.lit(c), F.lit(seed), F.lit(k), F.lit(j)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
        return F.sqrt(-2 * F.ln(u(0))) * F.cos(2 * np.pi * u(1))

    def noise(c: str) -> Column:
        if freedom is None:
            return normal(c, 0)
        chi = sum(normal(c, k) * normal(c, k) for k in range(1, freedom + 1))
        t = normal(c, 0) / F.sqrt(chi / freedom)
        return t / float(np.sqrt(freedom / (freedom - 2))) if freedom > 2 else t

    return df.withColumns({c: F.col(c) * (1 + scale * noise(c)) for c in columns})


# Sets of rows other than those of the panel.


def select_rows(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet the condition, with new dense places: later windows see only them."""
    w = Window.partitionBy("instrument").orderBy("cal_idx")
    kept = df.filter(condition)
    return kept.withColumn("__p", F.row_number().over(w) - 1).drop("cal_idx").withColumnRenamed("__p", "cal_idx")


def cut_ends(df: DataFrame, left: int, right: int) -> DataFrame:
    """Series without their first ``left`` and last ``-right`` rows."""
    w = Window.partitionBy("instrument")
    place, n = F.row_number().over(w.orderBy("cal_idx")), F.count(F.lit(1)).over(w)
    return df.withColumns({"__p": place, "__n": n}).filter((F.col("__p") > left) & (F.col("__p") <= F.col("__n") + right)).drop("__p", "__n")


def resample(df: DataFrame, every: str, how: dict[str, str], key: str = "instrument") -> DataFrame:
    """Buckets of time: how gives first, last, sum, mean, max, min or count for each column; NULLs are skipped."""
    pick = {
        "first": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("datetime"))),
        "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("datetime"))),
        "sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "count": F.count,
    }
    bucket = F.date_trunc(every, "datetime") if every in ("day", "week", "month", "hour") else F.window("datetime", every)["start"]
    return df.groupBy(key, bucket.alias("bucket")).agg(*[pick[h](c).alias(c) for c, h in how.items()])
