"""Orders, fills and bars of other frequencies."""

from datetime import datetime, timedelta

import os
import pytest
from lodestrata.operators import orders as O
from lodestrata.sources.frequency import read_at

SF = "/root/testdata/sf0.001"


def test_fills_share_a_bar(spark):
    t = datetime(2024, 1, 1, 10)
    bars = spark.createDataFrame([("a", t, 10.0, 1000.0), ("b", t, None, 1000.0)], "instrument string, datetime timestamp, price double, volume double")
    orders = spark.createDataFrame([(1, "a", t, 60.0), (2, "a", t, 60.0), (3, "a", t, 60.0), (4, "b", t, 5.0), (5, "c", t, 5.0)], "order_id int, instrument string, datetime timestamp, amount double")
    assert [r.filled for r in O.fills(orders, bars, 0.1).orderBy("order_id").collect()] == [60.0, 40.0, 0.0, 0.0, 0.0]


def test_times_and_steps(spark):
    rows = spark.createDataFrame([("a", datetime(2024, 1, 1, 9, 30) + timedelta(minutes=i), i) for i in range(10)], "instrument string, datetime timestamp, cal_idx int")
    assert O.within_times(rows, "09:32", "09:34").count() == 3
    assert [r.cal_idx for r in O.within_steps(rows, 2, 4).orderBy("cal_idx").collect()] == [2, 3, 4]


def test_base_prices_and_rates(spark):
    t = datetime(2024, 1, 1)
    p = O.base_prices(spark.createDataFrame([("a", t, 10.0, 1.0), ("a", t, 20.0, 3.0), ("a", t, 0.0, 9.0)], "instrument string, datetime timestamp, price double, volume double")).first()
    assert (p.twap, p.vwap) == (15.0, 17.5)
    days = spark.createDataFrame([("x", t, 100.0, 1.0, 10.0), ("x", t + timedelta(days=1), 110.0, 2.0, 20.0)], "account string, datetime timestamp, value double, cost double, traded double")
    last = O.account_rates(days).orderBy("datetime").collect()[1]
    assert (last.ret, last.cost_rate, last.turnover_rate) == pytest.approx((0.12, 0.02, 0.2))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_frequencies(spark):
    day, week, month, two = (read_at(spark, SF, f) for f in ("day", "week", "month", "2month"))
    assert day.count() > week.count() > month.count() >= two.count()
    five, thirty = read_at(spark, SF, "5min"), read_at(spark, SF, "30min")
    assert five.count() > thirty.count()
    assert five.agg({"volume": "sum"}).first()[0] == pytest.approx(thirty.agg({"volume": "sum"}).first()[0])
