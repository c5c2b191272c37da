"""Order flow: files of orders, clipping to times of day, and fills against a bar's volume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDERS = "datetime timestamp, instrument string, amount double, direction int"


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    """CSV folder of orders; direction 1 buys, 0 sells."""
    return spark.read.csv(path, header=True, schema=ORDERS)


def within_times(rows: DataFrame, start: str, end: str, ts: str = "datetime") -> DataFrame:
    """Rows whose time of day lies in [start, end], given as HH:mm."""
    return rows.filter(F.date_format(ts, "HH:mm").between(start, end))


def within_steps(rows: DataFrame, first: int, last: int, order: str = "cal_idx") -> DataFrame:
    """Rows of the places first to last of each instrument and day, counted from 0."""
    place = F.row_number().over(Window.partitionBy("instrument", F.to_date("datetime")).orderBy(order)) - 1
    return rows.withColumn("__p", place).filter(F.col("__p").between(first, last)).drop("__p")


def fills(orders: DataFrame, bars: DataFrame, share: float = 0.1) -> DataFrame:
    """Orders against their bar: at most ``share`` of its volume, all orders of a bar together, first come first served.

    orders (order_id, instrument, datetime, amount), bars (instrument, datetime, price, volume); adds ``filled``.
    """
    w = Window.partitionBy("instrument", "datetime").orderBy("order_id").rowsBetween(Window.unboundedPreceding, -1)
    joined = orders.join(bars.select("instrument", "datetime", "price", "volume"), ["instrument", "datetime"], "left")
    room = F.coalesce(F.col("volume"), F.lit(0.0)) * share - F.coalesce(F.sum("amount").over(w), F.lit(0.0))
    return joined.withColumn("filled", F.when(F.col("price").isNotNull(), F.greatest(F.lit(0.0), F.least("amount", room))).otherwise(0.0))


def base_prices(bars: DataFrame) -> DataFrame:
    """Time- and volume-weighted price of each instrument and day, from prices above zero."""
    ok = F.col("price") > 1e-8
    value, size = F.sum(F.when(ok, F.col("price") * F.col("volume"))), F.sum(F.when(ok, F.col("volume")))
    return bars.groupBy("instrument", F.to_date("datetime").alias("day")).agg(F.avg(F.when(ok, F.col("price"))).alias("twap"), (value / F.when(size > 0, size)).alias("vwap"))


def account_rates(days: DataFrame) -> DataFrame:
    """Return, cost and turnover rates of each account by yesterday's value: (value gain + cost) / value before."""
    w = Window.partitionBy("account").orderBy("datetime")
    before = F.lag("value").over(w)
    base = F.when(before != 0, before)
    return days.withColumns({"ret": (F.col("value") - before + F.col("cost")) / base, "cost_rate": F.col("cost") / base, "turnover_rate": F.col("traded") / base})
