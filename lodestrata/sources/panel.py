"""Reading of market tables: panels, calendars, universes, announcements and logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = ("open", "high", "low", "close", "volume", "amount", "vwap", "factor", "change")


def newest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """One row per key: the last in order of ``by``. A struct maximum, so that tasks combine before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("__r"))
    return picked.select(*keys, "__r.*").select(*rows.columns)


def densify(rows: DataFrame, calendar: DataFrame, entity: str = "instrument", order: str = "cal_idx", time: str = "datetime") -> DataFrame:
    """A row for each calendar place of an entity from its first to its last, so that windows count calendar rows.

    Each row brings the empty places up to the next one: a lead over the series instead of joins with a grid. The
    exchange by entity is the one that windows over series need anyway. One row per (entity, place) is expected.
    """
    after = F.lead(order).over(Window.partitionBy(entity).orderBy(order))
    fields = [c for c in rows.columns if c not in (entity, order, time)]
    spread = rows.withColumn("__to", F.coalesce(after - 1, F.col(order))).select(entity, F.col(order).alias("__at"), F.explode(F.sequence(order, "__to")).alias(order), *fields)
    own = F.col(order) == F.col("__at")
    filled = spread.select(entity, order, *[F.when(own, F.col(c)).alias(c) for c in fields])
    return filled.join(calendar.select(order, time), order)


def market_panel(spark: SparkSession, sf: str, table: str = "bars_day", wanted: set[str] | None = None) -> DataFrame:
    """Dense daily panel of the valid bars: newest delivery of each key, NaN as NULL, adjusted close added.

    ``wanted`` fields alone are read: the choice of the newest row would keep the optimizer from dropping others.
    """
    needed = [c for c in PRICES if wanted is None or c in wanted or c in ("close", "factor") and "adjclose" in wanted]
    bars = spark.read.parquet(f"{sf}/{table}.parquet").select("instrument", "cal_idx", "datetime", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in needed], "ingested_at", "row_id")
    valid = newest(bars.filter("instrument is not null and cal_idx is not null"), ["instrument", "cal_idx"], ["ingested_at", "row_id"]).drop("ingested_at", "row_id")
    panel = densify(valid, spark.read.parquet(f"{sf}/trade_calendar.parquet"))
    return panel.withColumn("adjclose", F.col("close") * F.col("factor")) if {"close", "factor"} <= set(needed) else panel


def with_industry(panel: DataFrame, relation: DataFrame) -> DataFrame:
    """``industry`` of each instrument; one row per instrument, so that rows stay as many."""
    return panel.join(relation.groupBy("instrument").agg(F.min("industry").alias("industry")), "instrument", "left")


# Calendars.


def calendar_slice(calendar: DataFrame, start: str, end: str) -> DataFrame:
    """Trading days from the first at or after start to the last at or before end."""
    return calendar.filter(F.col("datetime").between(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))))


def calendar_shift(calendar: DataFrame, shift: int) -> DataFrame:
    """(datetime, shifted): the day ``shift`` places on, clipped to the calendar's ends."""
    a, b = calendar.agg(F.min("cal_idx"), F.max("cal_idx")).first()
    moved = calendar.select("datetime", F.least(F.greatest(F.col("cal_idx") + shift, F.lit(a)), F.lit(b)).alias("cal_idx"))
    return moved.join(calendar.select("cal_idx", F.col("datetime").alias("shifted")), "cal_idx").select("datetime", "shifted")


def calendar_resample(calendar: DataFrame, unit: str, every: int = 1) -> DataFrame:
    """First trading day of every n-th week or month, or every n-th trading day."""
    if unit == "day":
        return calendar.filter((F.col("cal_idx") - calendar.agg(F.min("cal_idx")).first()[0]) % every == 0).select("datetime")
    first = calendar.groupBy(F.date_trunc(unit, "datetime").alias("__p")).agg(F.min("datetime").alias("datetime"))
    return first.withColumn("__n", F.row_number().over(Window.orderBy("__p"))).filter((F.col("__n") - 1) % every == 0).select("datetime")


# Universes.


def clipped_spans(universe: DataFrame, market: str, start: str, end: str) -> DataFrame:
    """Validity spans of a market cut to [start, end]; an open end reaches to ``end``."""
    a, b = F.greatest("start_dt", F.to_timestamp(F.lit(start))), F.least(F.coalesce("end_dt", F.to_timestamp(F.lit(end))), F.to_timestamp(F.lit(end)))
    return universe.filter(F.col("market") == market).select("instrument", a.alias("start_dt"), b.alias("end_dt")).filter("start_dt <= end_dt")


def in_universe(panel: DataFrame, universe: DataFrame, market: str) -> DataFrame:
    """Rows of the panel within a span of the market; apply it after windows, which may look back before the entry."""
    spans = universe.filter(F.col("market") == market).groupBy("instrument").agg(F.collect_set(F.struct("start_dt", "end_dt")).alias("__spans"))
    inside = F.exists("__spans", lambda s: (F.col("datetime") >= s["start_dt"]) & (s["end_dt"].isNull() | (F.col("datetime") <= s["end_dt"])))
    return panel.join(spans, "instrument").filter(inside).drop("__spans")


def spans_of(rows: DataFrame, flag: Column, entity: str = "instrument", order: str = "cal_idx", time: str = "datetime") -> DataFrame:
    """Spans of consecutive places at which ``flag`` holds."""
    kept = rows.filter(flag).select(entity, order, time)
    island = F.col(order) - F.row_number().over(Window.partitionBy(entity).orderBy(order))
    return kept.withColumn("__i", island).groupBy(entity, "__i").agg(F.min(time).alias("start_dt"), F.max(time).alias("end_dt")).drop("__i")


def named(panel: DataFrame, pattern: str) -> DataFrame:
    """Instruments whose name begins with the pattern."""
    return panel.filter(F.col("instrument").rlike(f"^(?:{pattern})"))


def covering(panel: DataFrame, start: str, end: str) -> DataFrame:
    """Instruments with rows from start or before to end or after."""
    whole = panel.groupBy("instrument").agg(F.min("datetime").alias("__a"), F.max("datetime").alias("__b")).filter((F.col("__a") <= F.to_timestamp(F.lit(start))) & (F.col("__b") >= F.to_timestamp(F.lit(end))))
    return panel.join(whole.select("instrument"), "instrument", "left_semi")


# Announcements that are revised.


def known_at(pit: DataFrame, moments: DataFrame, key: str = "instrument", when: str = "datetime") -> DataFrame:
    """For each (key, moment): the newest period announced by then, and its value as announced last by then.

    pit(key, period, announced, value); moments(key, when). Announcements and moments of a key are merged into one
    order and the latest announcement is carried forward, which joins no pairs.
    """
    lead = Window.partitionBy(key).orderBy("__t", "__side", "period").rowsBetween(Window.unboundedPreceding, 0)
    a = pit.select(key, F.col("announced").cast("timestamp").alias("__t"), F.lit(0).alias("__side"), "period", "value")
    b = moments.select(key, F.col(when).cast("timestamp").alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(pit.schema["period"].dataType).alias("period"), F.lit(None).cast(pit.schema["value"].dataType).alias("value"))
    merged = a.unionByName(b).withColumn("__top", F.max("period").over(lead))
    # revisions of older periods don't replace the newest one
    merged = merged.withColumn("__v", F.when((F.col("__side") == 0) & (F.col("period") == F.col("__top")), F.struct("value")))
    merged = merged.withColumn("__v", F.last("__v", True).over(lead))
    return merged.filter("__side = 1").select(key, F.col("__t").alias(when), F.col("__top").alias("period"), F.col("__v.value").alias("value"))


def known_period(pit: DataFrame, moments: DataFrame, period: int, key: str = "instrument", when: str = "datetime") -> DataFrame:
    """One period's value as of each moment."""
    return known_at(pit.filter(F.col("period") == period), moments, key, when)


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Backward as-of join: the last non-NULL ``value`` of ``right`` at or before each row of ``left``."""
    w = Window.partitionBy(key).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    rest = [c for c in left.columns if c not in (key, time)]
    a = right.select(key, time, F.lit(0).alias("__side"), F.col(value).alias("__v"), F.lit(None).cast(left.select(F.struct(*rest or [key])).schema[0].dataType).alias("__r"))
    b = left.select(key, time, F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.struct(*rest or [key]).alias("__r"))
    out = a.unionByName(b).withColumn("__v", F.last("__v", True).over(w)).filter("__side = 1")
    return out.select(key, time, *[F.col(f"__r.{c}").alias(c) for c in rest], F.col("__v").alias(value))


# Files.

_PERIOD = re.compile(r"^(\d*)\s*(month|mon|week|w|day|d|minute|min)$")


def parse_frequency(text: str) -> tuple[int, str]:
    """``5min`` to (5, minute), ``week`` to (1, week)."""
    if not (m := _PERIOD.match(text.strip().lower())):
        raise ValueError(f"unknown frequency {text!r}")
    unit = {"mon": "month", "w": "week", "d": "day", "min": "minute"}.get(m[2], m[2])
    return int(m[1] or 1), unit


def read_bars_csv(spark: SparkSession, path: str, columns: dict[str, str], include: set[str] | None = None, exclude: set[str] = frozenset()) -> DataFrame:
    """CSV folder of bars with an explicit schema (name to type), less unwanted fields, one row per (symbol, date)."""
    schema = T.StructType([T.StructField(c, T._parse_datatype_string(t)) for c, t in columns.items()])
    rows = spark.read.csv(path, header=True, schema=schema)
    keep = [c for c in columns if c in ("symbol", "date") or ((include is None or c in include) and c not in exclude)]
    return rows.select(*keep).dropDuplicates(["symbol", "date"])


def with_vwap(rows: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Adjustment factor carried forward to each bar, and vwap = amount / volume."""
    out = as_of(rows, adjustments, "symbol", "date", "factor")
    return out.withColumn("vwap", F.when(F.col("volume") != 0, F.col("amount") / F.when(F.col("volume") != 0, F.col("volume"))))


TRAJECTORY = "run_id string, method string, seed int, generation int, idx_in_population int, formula string, raw_fitness double, signed_train_ic double, operation string, parent_idx int, donor_idx int, program_length int, program_depth int, memo_hit boolean"


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of evaluated candidates."""
    return spark.read.schema(TRAJECTORY).json(path)


def read_result(spark: SparkSession, path: str, required: tuple[str, ...] = ("formula",)) -> DataFrame:
    """A miner's result as CSV or Parquet; ValueError if a required column is missing."""
    df = spark.read.csv(path, header=True) if path.endswith(".csv") else spark.read.parquet(path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns {missing}")
    return df


def append_series(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("instrument", "cal_idx")) -> DataFrame:
    """Write of a series over another: new rows win where both have a key."""
    ranked = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)))
    return newest(ranked, list(keys), ["__v"]).drop("__v")


def replace_range(old: DataFrame, new: DataFrame, time: str = "datetime", keys: tuple[str, ...] = ("instrument", "datetime")) -> DataFrame:
    """Old rows outside the new rows' range of time, and the new rows."""
    a, b = new.agg(F.min(time), F.max(time)).first()
    kept = old if a is None else old.filter(~F.col(time).between(F.lit(a), F.lit(b)))
    return kept.unionByName(new)


def combine(frames: list[DataFrame], keys: list[str], how: str = "outer") -> DataFrame:
    """Frames side by side on their keys."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, keys, how)
    return out


def unadjusted(panel: DataFrame) -> DataFrame:
    """Prices times factor, volume by factor in millions."""
    out = panel.select("*", *[]).withColumns({c: F.col(c) * F.col("factor") for c in ("open", "high", "low", "close", "vwap")})
    return out.withColumn("volume", F.when(F.col("factor") != 0, F.col("volume") / F.when(F.col("factor") != 0, F.col("factor")) / 1e6))
