"""Streams of bars: tumbling, sliding and session windows, deduplication, and rolling state per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _stats(value: str):
    return F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most")


def tumbling(df: DataFrame, key: str, every: str, value: str = "value", delay: str = "10 minutes") -> DataFrame:
    """Works on streams and on tables; on a stream, rows later than ``delay`` are dropped."""
    return sliding(df, key, every, every, value, delay)


def sliding(df: DataFrame, key: str, length: str, step: str, value: str = "value", delay: str = "10 minutes") -> DataFrame:
    rows = df.withWatermark("ts", delay) if df.isStreaming else df
    return rows.groupBy(F.window("ts", length, step).alias("w"), key).agg(*_stats(value)).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total", "least", "most")


def sessions(df: DataFrame, key: str, gap: str, value: str = "value", delay: str = "10 minutes") -> DataFrame:
    rows = df.withWatermark("ts", delay) if df.isStreaming else df
    return rows.groupBy(F.session_window("ts", gap).alias("w"), key).agg(*_stats(value)).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total", "least", "most")


def deduplicated(df: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """One row per key; a stream forgets keys after ``delay``."""
    return df.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def rolling_mean(stream: DataFrame, key: str, length: int, value: str = "value", delay: str = "10 minutes") -> DataFrame:
    """(key, ts, value, mean): mean of a key's last ``length`` values in order of ts.

    The state is the last length - 1 values and the rows that the watermark hasn't passed; rows are put out once
    no earlier one can come, so that late arrivals within ``delay`` count in their place. A timeout wakes a key when
    the watermark has passed its waiting rows.
    """

    def step(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, waiting = state.get if state.exists else ([], [])
        tail, waiting = list(tail), [tuple(x) for x in waiting]
        for pdf in pdfs:
            waiting += [(t.value // 1000, v, i) for t, v, i in zip(pd.to_datetime(pdf.ts), pdf.value.astype(float), pdf.rid)]
        mark = state.getCurrentWatermarkMs() * 1000
        ready = sorted((x for x in waiting if x[0] <= mark), key=lambda x: (x[0], x[2]))
        waiting = [x for x in waiting if x[0] > mark]
        out = []
        for t, v, _ in ready:
            held = [x for x in (*tail, v)][-length:]
            out.append((k[0], pd.Timestamp(t * 1000), v, sum(held) / len(held)))
            tail = held[-(length - 1) :] if length > 1 else []
        state.update((tail, [list(x) for x in waiting]))
        if waiting:
            state.setTimeoutTimestamp(max(min(x[0] for x in waiting) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=[key, "ts", "value", "mean"])

    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(F.col(key), F.col("ts"), F.col(value).cast("double").alias("value"), F.xxhash64(*stream.columns).alias("rid")).withWatermark("ts", delay)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts timestamp, value double, mean double", "tail array<double>, waiting array<struct<t:bigint,v:double,i:bigint>>", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Take what there is, write it to files and stop; the checkpoint makes a second run go on from there."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def daily_routine(stream: DataFrame, checkpoint: str, publish) -> None:
    """For each new batch of days call ``publish(frame, batch_id)``, once and in order."""
    stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
