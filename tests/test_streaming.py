"""Streams give what the same functions give on tables."""

from datetime import datetime, timedelta

import pytest
from lodestrata.streaming import windows as W

T0 = datetime(2024, 1, 1)


@pytest.fixture()
def source(spark, tmp_path):
    rows = [(i, T0 + timedelta(minutes=7 * i), f"k{i % 3}", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "rid bigint, ts timestamp, k string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def drained(stream, spark, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.sql(f"SELECT * FROM {name}")


@pytest.mark.parametrize("f", [lambda d: W.tumbling(d, "k", "1 hour"), lambda d: W.sliding(d, "k", "1 hour", "30 minutes"), lambda d: W.sessions(d, "k", "25 minutes")], ids=["tumbling", "sliding", "session"])
def test_windows(spark, source, f):
    table, stream = source
    got = drained(f(stream), spark, "w" + str(id(f)), "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, f(table).collect()))


def test_rolling_state_counts_late_rows_in_place(spark, source):
    table, stream = source
    got = drained(W.rolling_mean(stream, "k", 3), spark, "rolled", "append").orderBy("k", "ts").collect()
    want = {}
    for r in table.orderBy("ts").collect():
        want.setdefault(r.k, []).append(r.value)
    assert len(got) > 40
    seen = {}
    for r in got:
        n = seen[r.k] = seen.get(r.k, 0) + 1
        assert r.mean == pytest.approx(sum(want[r.k][max(0, n - 3) : n]) / min(3, n))


def test_run_once_goes_on_where_it_stopped(spark, source, tmp_path):
    _, stream = source
    for _ in range(2):
        W.run_once(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60
