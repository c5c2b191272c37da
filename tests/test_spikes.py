"""Planted readings in two sources, and the edges of the input."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from lodestrata.operators.spikes import SpikeRules, flag_implausible, forward_backward

SCHEMA = "bar_id bigint, instrument string, feed string, datetime timestamp, close double, volume double, ingested_at timestamp"


def times(day: int) -> list[datetime]:
    start = datetime(2024, 3, 4 + day)
    return [start + timedelta(minutes=570 + i if i < 120 else 660 + i) for i in range(240)]


def bars(days: int = 3, seed: int = 1, price: float = 50.0, sigma: float = 0.001) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    out = []
    for d in range(days):
        close = price * np.exp(np.cumsum(rng.normal(0, sigma, 240)))
        out.append(pd.DataFrame({"datetime": times(d), "close": np.round(close, 6), "volume": np.round(rng.lognormal(8, 0.4, 240), 2)}))
    df = pd.concat(out, ignore_index=True)
    df["bar_id"] = np.arange(len(df)) + 1000 * seed
    return df.assign(instrument="A", feed=f"f{seed}", ingested_at=df.datetime + pd.Timedelta(minutes=1))


def found(spark, df: pd.DataFrame, rules: SpikeRules = SpikeRules()) -> set[tuple[int, str]]:
    rows = spark.createDataFrame([tuple(None if x is pd.NaT or (isinstance(x, float) and np.isnan(x)) else x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in r) for r in df[["bar_id", "instrument", "feed", "datetime", "close", "volume", "ingested_at"]].astype(object).itertuples(index=False)], SCHEMA)
    return {(r.bar_id, r.field) for r in flag_implausible(rows, rules).collect()}


def test_planted_readings_are_found_and_nothing_else(spark):
    df, other = bars(seed=1), bars(seed=2, price=3.0, sigma=0.0001)
    want = set()

    def plant(at, field, value):
        df.loc[at, field] = value
        want.update((int(b), field) for b in df.loc[at, "bar_id"].to_numpy())

    plant([10], "close", -1.0)
    plant([20], "close", 0.0)
    plant([30, 31, 32], "close", df.close[29] * 1.03)
    plant([60], "close", df.close[59] * 0.01)
    plant([300], "volume", -5.0)
    plant([310], "volume", df.volume.max() * 2.5)
    plant(list(range(330, 345)), "close", df.close[330])
    plant(list(range(500, 512)), "volume", 777.0)
    # no cases: a lasting move, a short run, a pause, a zero run
    df.loc[100:239, "close"] *= 1.05
    df.loc[400:410, "volume"] = 555.0
    df.loc[420:440, "close"], df.loc[420:440, "volume"] = np.nan, 0.0
    copy = df[df.bar_id == df.bar_id[30]].assign(bar_id=9_999, ingested_at=lambda x: x.ingested_at + pd.Timedelta(days=2))
    want.add((9_999, "close"))
    assert found(spark, pd.concat([df, other, copy])) == want


def test_runs_go_over_lunch_and_need_twelve(spark):
    df = bars(seed=1)
    df.loc[114:125, "close"] = df.close[114]
    df.loc[600:610, "close"] = df.close[600]
    assert found(spark, df) == {(int(b), "close") for b in df.bar_id[114:126]}


def test_nulls_in_any_column(spark):
    df = bars(seed=1).astype({"instrument": object, "feed": object})
    df.loc[5, "datetime"] = pd.NaT
    df.loc[5, "close"] = -3.0
    df.loc[6, "instrument"] = None
    df.loc[7, "feed"] = None
    df.loc[8, ["close", "volume"]] = np.nan
    df.loc[9, "ingested_at"] = pd.NaT
    assert found(spark, df) == {(int(df.bar_id[5]), "close")}


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA + ", src string, day int, slot int, field string, value double, hist string, sigma double")
    assert flag_implausible(empty).count() == 0


def test_a_hot_bar_is_flagged_in_all_its_copies(spark):
    df = bars(days=1)
    df.loc[50, "close"] = 5000.0
    copies = pd.concat([df.iloc[[50]]] * 300).assign(bar_id=range(50_000, 50_300))
    assert found(spark, pd.concat([df, copies])) == {(b, "close") for b in [int(df.bar_id[50]), *range(50_000, 50_300)]}


@pytest.mark.parametrize("days, bars_kept, spikes", [(1, 213, 5), (3, 720, 72), (3, 720, 300)])
def test_sources_with_many_volume_spikes(spark, days, bars_kept, spikes):
    df, rng = bars(days=days, seed=4).iloc[:bars_kept].reset_index(drop=True), np.random.default_rng(5)
    top = df.volume.max()
    at = rng.choice(bars_kept, spikes, replace=False)
    at = at[df.volume[at] < top]
    df.loc[at, "volume"] = np.round(top * rng.uniform(2.05, 9, len(at)), 2)
    assert found(spark, pd.concat([df, bars(seed=2)])) == {(int(b), "volume") for b in df.bar_id.to_numpy()[at]}


def spikes_by_brute_force(df: pd.DataFrame) -> set[tuple[int, str]]:
    """Rule (b) bar by bar, for a source whose moves are usual ones or of more than six deviations."""
    log, day = np.log(df.close.to_numpy()), df.datetime.dt.date.to_numpy()
    move = np.diff(log)[day[1:] == day[:-1]]
    least = 10 * np.sqrt(np.mean(move[np.abs(move) < 6 * 1.4826 * np.median(np.abs(move))] ** 2))
    hit = set()
    for i in range(1, len(log)):
        for k in range(1, 6):
            if i + k < len(log) and day[i - 1] == day[i + k]:
                a, b, seg = log[i - 1], log[i + k], log[i : i + k]
                if seg.min() - max(a, b) > least or min(a, b) - seg.max() > least:
                    hit.update(range(i, i + k))
    return {(int(b), "close") for b in df.bar_id.to_numpy()[list(hit)]}


def test_usual_moves_of_thin_sources_count_zero_moves(spark):
    df, rng = bars(days=4, seed=6), np.random.default_rng(7)
    idle = rng.random(len(df)) < 0.5
    idle[::240] = False
    df.loc[idle, "volume"] = 0.0
    log = pd.Series(np.log(df.close)).where(~idle).ffill().to_numpy().copy()
    sigma = np.sqrt(np.mean(np.diff(log.reshape(4, 240)) ** 2))
    at = np.array([i for i in range(20, len(df) - 20, 60) if 10 < i % 240 < 225])
    size = np.resize([9.0, 11.0, 12.0, 13.0], len(at))
    log[at] = np.fmax(log[at - 1], log[at + 1]) + size * sigma
    df["close"] = np.exp(log)
    assert found(spark, df) == {(int(b), "close") for b in df.bar_id.to_numpy()[at[size > 10]]}


def test_every_spike_beyond_ten_moves_is_found(spark):
    df = bars(days=12, seed=3)
    log = np.log(df.close.to_numpy())
    sigma, sizes, planted = np.diff(log.reshape(12, 240)).std(), [9.8, 10.1, 10.3, 10.5, 10.8, 11.0, 11.3, 11.6, 12.0], {}
    for n, at in enumerate(i for i in range(20, len(df) - 20, 24) if 10 < i % 240 < 225):
        k, size = 1 + n % 5, sizes[n // 5 % len(sizes)]
        ends = log[at - 1], log[at + k]
        seg = log[at : at + k]
        log[at : at + k] += max(ends) + size * sigma - seg.min() if n % 2 else min(ends) - size * sigma - seg.max()
        planted.update({i: size for i in range(at, at + k)})
    df["close"] = np.exp(log)
    want = spikes_by_brute_force(df)
    assert want == {(int(df.bar_id[i]), "close") for i, size in planted.items() if size > 10}
    assert found(spark, df) == want


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    ll, stay, start = rng.normal(size=(1, 4, 3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(3))
    want = np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        p = start[path[0]] * np.prod([stay[a, b] for a, b in zip(path, path[1:])]) * np.exp(sum(ll[0, t, s] for t, s in enumerate(path)))
        for t, s in enumerate(path):
            want[t, s] += p
    np.testing.assert_allclose(forward_backward(ll, stay, start)[0], want / want.sum(1, keepdims=True), rtol=1e-9)


def test_each_rule_is_a_parameter(spark):
    df = bars(seed=1)
    df.loc[30, "close"] *= 1.015
    df.loc[300, "volume"] = df.volume.max() * 2.5
    df.loc[500:507, "volume"] = 777.0
    case = lambda *rows: {(int(df.bar_id[i]), f) for i, f in rows}
    assert found(spark, df) == case((30, "close"), (300, "volume"))
    assert found(spark, df, SpikeRules(spike_moves=30.0)) == case((300, "volume"))
    assert found(spark, df, SpikeRules(amount_factor=3.0)) == case((30, "close"))
    assert found(spark, df, SpikeRules(stuck_bars=8)) == case((30, "close"), (300, "volume"), *((i, "volume") for i in range(500, 508)))
    df.loc[100:102, "close"] *= 1.05
    assert found(spark, df, SpikeRules(spike_bars=2)) == case((30, "close"), (300, "volume"))


def test_ordinary_amounts_of_thin_sources_may_leave_gaps(spark):
    df, rng = bars(days=2, seed=8), np.random.default_rng(9)
    volume = np.exp(8 + 0.8 * np.clip(rng.normal(size=480), -3, 2.4))
    top = volume.max()
    volume[70] = top * 2.2  # 3.4 deviations from the level: large, but the source may well do that
    volume[200] = top * 9
    df["volume"] = volume
    assert found(spark, df) == {(int(df.bar_id[200]), "volume")}
