"""Queries p1_ and p3_: the general operators on the market tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.rolling_state import RollingState
from lodestrata.operators.spikes import flag_implausible
from lodestrata.plans.engine_queries import _r, same_rounding


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return flag_implausible(_table(spark, sf, "bars_1min"))


def p3_trailing(spark: SparkSession, sf: str) -> DataFrame:
    """The state of the rows that came within a day, corrected by those that came later; to 6 places."""
    bars = _table(spark, sf, "bars_day").select(F.col("instrument").alias("entity"), F.to_date("datetime").alias("day"), F.col("ingested_at").alias("at"), F.col("row_id").alias("tie"), "close", "volume", "datetime")
    late = F.coalesce(F.col("at") > F.col("datetime") + F.expr("INTERVAL 1 DAY"), F.lit(True))
    state = RollingState.build(bars.filter(~late), ("close", "volume")).advance(bars.filter(late))
    out = state.trailing().withColumnRenamed("entity", "instrument")
    return out.select("instrument", "day", *[_r(c) for c in out.columns[2:]])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p3_trailing": p3_trailing}

_TRAILING = ",\n  ".join(f"round(sum({f}) OVER w{p}, 6) AS {f}_sum_{p}, round(sum({f}) OVER w{p} / nullif(count({f}) OVER w{p}, 0), 6) AS {f}_mean_{p}" for f in ("close", "volume") for p in (7, 30))
_P3 = f"""
WITH valid AS (
  SELECT instrument, CAST(datetime AS DATE) AS day, CASE WHEN NOT isnan(close) THEN close END AS close, CASE WHEN NOT isnan(volume) THEN volume END AS volume
  FROM bars_day WHERE instrument IS NOT NULL AND datetime IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY instrument, CAST(datetime AS DATE) ORDER BY ingested_at DESC NULLS LAST, row_id DESC NULLS LAST) = 1),
days AS (
  SELECT instrument, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM valid GROUP BY instrument)
SELECT instrument, day,
  {_TRAILING}
FROM days LEFT JOIN valid USING (instrument, day)
WINDOW w7 AS (PARTITION BY instrument ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW),
       w30 AS (PARTITION BY instrument ORDER BY day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)"""
ORACLE: dict[str, str] = {"p3_trailing": same_rounding(_P3)}
