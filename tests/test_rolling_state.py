"""Rolling state against pandas, corrected in any order."""

from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from lodestrata.operators.rolling_state import RollingState
from pyspark.sql import functions as F

SCHEMA = "entity string, day date, at timestamp, tie bigint, v double"


def make(seed: int, n: int = 300) -> list[tuple]:
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = None if rng.random() < 0.1 else float("nan") if rng.random() < 0.05 else round(float(rng.normal(0, 1e6)), 4)
        rows.append((f"e{rng.integers(4)}", date(2024, 1, 1 + int(rng.integers(28))) if rng.random() < 0.7 else date(2024, int(3 + rng.integers(2)), int(1 + rng.integers(28))), datetime(2024, 6, 1, int(rng.integers(24))), i, v))
    return rows


def brute(rows: list[tuple]) -> dict:
    last: dict = {}
    for e, d, at, tie, v in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[2] or datetime(1900, 1, 1), r[3] if r[3] is not None else -1)):
        last[(e, d)] = None if v is None or v != v else v
    out = {}
    for e in {k[0] for k in last}:
        days = [k[1] for k in last if k[0] == e]
        for d in pd.date_range(min(days), max(days)):
            for w in (7, 30):
                held = [last.get((e, (d - pd.Timedelta(days=i)).date())) for i in range(w)]
                held = [x for x in held if x is not None]
                out[(e, d.date(), w)] = (round(sum(held), 4), round(sum(held) / len(held), 4)) if held else (None, None)
    return out


def values(state: RollingState) -> dict:
    return {(r.entity, r.day, w): tuple(None if x is None else round(x, 4) for x in (r[f"v_sum_{w}"], r[f"v_mean_{w}"])) for r in state.trailing().collect() for w in (7, 30)}


def same(a: dict, b: dict) -> None:
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 2e-4), k


def test_built_at_once(spark):
    rows = make(1)
    same(values(RollingState.build(spark.createDataFrame(rows, SCHEMA), ("v",))), brute(rows))


def test_corrections_give_what_a_new_state_would(spark):
    rows = make(2)
    state = RollingState.build(spark.createDataFrame(rows[:150], SCHEMA), ("v",))
    for part in (rows[150:220], rows[220:]):
        state = state.advance(spark.createDataFrame(part, SCHEMA))
    same(values(state), brute(rows))
    assert state.version == 3
    versions = {r.version for r in state.totals.select("version").distinct().collect()}
    assert 3 in versions


def test_untouched_days_keep_their_version(spark):
    rows = [("a", date(2024, 1, d), datetime(2024, 2, 1), d, 1.0) for d in range(1, 31)]
    state = RollingState.build(spark.createDataFrame(rows, SCHEMA), ("v",), (7,)).advance(spark.createDataFrame([("a", date(2024, 1, 10), datetime(2024, 3, 1), 99, 5.0)], SCHEMA))
    assert [r.day.day for r in state.totals.filter("version = 2").orderBy("day").collect()] == list(range(10, 17))


def test_day_by_day_in_new_sessions_like_at_once(spark, tmp_path):
    rows = [r for r in make(5, 60) if r[1].day % 4 == 0]
    RollingState.create(spark, str(tmp_path), ("v",), part_days=7)
    days = sorted({r[1] for r in rows})
    for d in days[::3] + days[1::3] + days[2::3]:  # out of order: two thirds come late
        state = RollingState.load(spark.newSession(), str(tmp_path))
        state.advance(state.spark.createDataFrame([r for r in rows if r[1] == d], SCHEMA))
    state = RollingState.load(spark, str(tmp_path))
    assert state.version == len(days)
    same(values(state), brute(rows))
    # older versions are still there
    first = RollingState.load(spark, str(tmp_path), 1)
    same(values(first), brute([r for r in rows if r[1] == days[0]]))


def test_a_delivery_reads_and_writes_the_parts_in_reach(spark, tmp_path):
    rows = [("a", date(2023, 1, 1) + pd.Timedelta(days=i).to_pytimedelta(), datetime(2024, 6, 1), i, 1.0) for i in range(400)]
    state = RollingState.create(spark, str(tmp_path), ("v",), part_days=10).advance(spark.createDataFrame(rows, SCHEMA))
    read = []

    class Watched(RollingState):
        def _read(self, table, parts=None):
            read.append((table, parts))
            return super()._read(table, parts)

    watched = Watched(**{k: getattr(state, k) for k in RollingState.__dataclass_fields__})
    new = watched.advance(spark.createDataFrame([("a", date(2024, 2, 5), datetime(2024, 6, 2), 1, 7.0)], SCHEMA))
    assert all(parts is not None and len(parts) <= 5 for _, parts in read) and len(read) >= 2
    assert sum(v == 2 for v in new.total_parts.values()) <= 2 and sum(v == 2 for v in new.amount_parts.values()) == 1
    assert new.trailing().filter("day = '2024-02-05'").first().v_sum_7 == 6 + 7.0


def test_small_large_and_infinite_amounts(spark):
    inf = float("inf")
    rows = [("tiny", date(2024, 1, 1), None, 1, 4e-7), ("tiny", date(2024, 1, 2), None, 1, 4e-7), ("wild", date(2024, 1, 1), None, 1, inf), ("wild", date(2024, 1, 9), None, 1, 2.0), ("both", date(2024, 1, 1), None, 1, inf), ("both", date(2024, 1, 2), None, 1, -inf)]
    got = {(r.entity, r.day.day): r.v_sum_7 for r in RollingState.build(spark.createDataFrame(rows, SCHEMA), ("v",)).trailing().collect()}
    assert got[("tiny", 2)] == 8e-7 and got[("wild", 7)] == inf and got[("wild", 8)] is None and got[("wild", 9)] == 2.0 and np.isnan(got[("both", 2)])
    for x in (3e-14, 1e30):
        with pytest.raises(Exception, match="does not fit"):
            RollingState.build(spark.createDataFrame([("a", date(2024, 1, 1), None, 1, x)], SCHEMA), ("v",))
    assert RollingState.build(spark.createDataFrame([("a", date(2024, 1, 1), None, 1, 3e-14)], SCHEMA), ("v",), scale=20).trailing().first().v_sum_7 == 3e-14


def test_edges(spark):
    assert RollingState.build(spark.createDataFrame([], SCHEMA), ("v",)).trailing().count() == 0
    rows = [(None, date(2024, 1, 1), None, 1, 1.0), ("a", None, None, 1, 1.0), ("a", date(2024, 1, 1), None, None, 2.0), ("a", date(2024, 1, 1), None, None, 2.0), ("b", date(2024, 1, 1), None, 1, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("first", F.lit(1)).withColumn("version", F.lit("x"))
    got = {r.entity: r.v_sum_7 for r in RollingState.build(df, ("v",)).trailing().collect()}
    assert got == {"a": 2.0, "b": None}
    late = RollingState.build(spark.createDataFrame([], SCHEMA), ("v",)).advance(df)
    assert {r.entity: r.v_sum_30 for r in late.trailing().collect()} == got
