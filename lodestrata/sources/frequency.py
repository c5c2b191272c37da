"""Bars of any frequency from the stored ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources.panel import newest, parse_frequency


def _bars(rows: DataFrame, keys: list[str], bucket) -> DataFrame:
    """First, highest, lowest and last price and the sum of volumes of each bucket; NULLs are skipped."""
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("datetime"))
    return rows.groupBy(*keys, bucket.alias("bucket")).agg(F.min_by("open", at("open")).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at("close")).alias("close"), F.sum("volume").alias("volume"))


def read_at(spark: SparkSession, sf: str, frequency: str) -> DataFrame:
    """Bars such as ``5min``, ``day``, ``week`` or ``2month``; days come from daily bars, minutes from minute bars.

    Buckets of minutes never reach over the pause at noon if they divide an hour and a half; of several weeks or
    months every n-th calendar week or month begins a bucket.
    """
    n, unit = parse_frequency(frequency)
    if unit == "minute":
        raw = spark.read.parquet(f"{sf}/bars_1min.parquet").select("instrument", "feed", "datetime", "open", "high", "low", "close", "volume", "ingested_at", "bar_id")
        rows = newest(raw, ["instrument", "feed", "datetime"], ["ingested_at", "bar_id"])
        return _bars(rows, ["instrument", "feed"], F.window("datetime", f"{n} minutes")["start"])
    raw = spark.read.parquet(f"{sf}/bars_day.parquet").select("instrument", "datetime", "cal_idx", "open", "high", "low", "close", "volume", "ingested_at", "row_id")
    rows = newest(raw, ["instrument", "datetime"], ["ingested_at", "row_id"])
    if unit == "day":
        first = F.date_sub("datetime", F.pmod(F.unix_date(F.to_date("datetime")), F.lit(n)))
        return _bars(rows, ["instrument"], (F.date_trunc("day", "datetime") if n == 1 else first.cast("timestamp")))
    start = F.date_trunc(unit, "datetime")
    if n > 1:
        months = F.year(start) * 12 + F.month(start) - 1
        start = F.date_trunc("month", F.add_months(start, -F.pmod(months, F.lit(n)))) if unit == "month" else F.date_sub(start, 7 * F.pmod(F.floor(F.unix_date(F.to_date(start)) / 7), F.lit(n)).cast("int")).cast("timestamp")
    return _bars(rows, ["instrument"], start.cast("timestamp"))
