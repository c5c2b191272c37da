"""Implausible readings in measured series: a hidden Markov model per source.

Every (source, session) is one chain; its states are normal, spike, stuck and out of range. What a source's
normal behaviour is (usual move, largest ordinary amount, share of unchanged readings) comes from histograms that
are merged over all its sessions, so that no task ever holds a whole source. Forward-backward probabilities pick
the chains' suspicious stretches; hard bounds and the exact rules decide what is flagged. Spikes of the close are
looked for in every bar, whatever their probability: no posterior is sure to be looser than their rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.storage import materialize, skew_join

NORMAL, SPIKE, STUCK, OUT = range(4)


@dataclass(frozen=True)
class SpikeRules:
    """Parameters of the rules and of the model."""

    spike_moves: float = 10.0  # usual moves by which a spike leaves both neighbours
    spike_bars: int = 5  # longest spike
    amount_factor: float = 2.0  # times the largest ordinary amount
    stuck_bars: int = 12  # shortest run of one exact value
    suspicion: float = 0.05  # posterior from which a run is examined
    certainty: float = 0.5  # posterior from which an amount beyond the factor is a spike
    window: int = 7  # bars to either side in the local level
    slots: int = 240  # minutes of a session


RETURN_BINS = 8  # per octave
AMOUNT_BINS = 4


def session_minute(ts: Column) -> Column:
    """Minute 0..239 of a session 09:30-11:29, 13:00-14:59; -1 outside it or for NULL."""
    m = F.hour(ts) * 60 + F.minute(ts)
    inside = F.when(m.between(570, 689), m - 570).when(m.between(780, 899), m - 660)
    return F.coalesce(inside, F.lit(-1)).cast("int")


def _matrix(table: pa.Table, slots: int) -> tuple[np.ndarray, ...]:
    """Rows ordered by (src, day, slot, newest first) to starts of sessions and matrices [session, slot]."""
    src, day = table["src"].combine_chunks(), table["day"].to_numpy()
    codes = src.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    change = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (day[1:] != day[:-1])])
    row = np.repeat(np.arange(len(change)), np.diff(np.r_[change, len(day)]))
    slot = table["slot"].to_numpy()
    # one reading a slot: rows come oldest first, so that the newest is written last
    out = []
    for name in ("close", "volume"):
        m = np.full((len(change), slots), np.nan)
        m[row, slot] = table[name].to_numpy(zero_copy_only=False)
        out.append(m)
    seen = np.zeros((len(change), slots), bool)
    seen[row, slot] = True
    return change, *out, seen


def _last_valid(m: np.ndarray) -> np.ndarray:
    """Value of the latest earlier non-NaN cell in each row."""
    at = np.where(np.isnan(m), -1, np.arange(m.shape[1]))
    at = np.maximum.accumulate(at, axis=1)
    at = np.concatenate([np.full((len(m), 1), -1), at[:, :-1]], axis=1)
    return np.where(at < 0, np.nan, np.take_along_axis(m, np.maximum(at, 0), 1))


def _sparse_bins(rows: np.ndarray, bins: np.ndarray, values: np.ndarray, n: int, kind: int) -> list[list[dict]]:
    """Per row a list of (kind, bin, cnt, sumsq, lo, hi)."""
    out: list[list[dict]] = [[] for _ in range(n)]
    if len(rows):
        key = rows.astype(np.int64) * 100_000 + (bins + 50_000)
        order = np.lexsort((values, key))
        key, values = key[order], values[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        cnt, ss = np.diff(np.r_[start, len(key)]), np.add.reduceat(values * values, start)
        end = np.r_[start[1:], len(key)] - 1
        for k, c, s, lo, hi in zip(key[start].tolist(), cnt.tolist(), ss.tolist(), values[start].tolist(), values[end].tolist()):
            out[k // 100_000].append({"kind": kind, "bin": k % 100_000 - 50_000, "cnt": c, "ss": s, "lo": lo, "hi": hi})
    return out


_HIST = pa.list_(pa.struct([("kind", pa.int32()), ("bin", pa.int32()), ("cnt", pa.int64()), ("ss", pa.float64()), ("lo", pa.float64()), ("hi", pa.float64())]))
_SESSION = "src string, day int, seen binary, close binary, volume binary, hist array<struct<kind:int,bin:int,cnt:bigint,ss:double,lo:double,hi:double>>"


def _sessions(rules: SpikeRules):
    def chunk(table: pa.Table) -> pa.RecordBatch:
        change, close, volume, seen = _matrix(table, rules.slots)
        n = len(change)
        with np.errstate(all="ignore"):
            log = np.log(np.where(close > 0, close, np.nan))
            move = np.abs(log - _last_valid(log))
            r, c = np.nonzero(move > 0)
            hist = _sparse_bins(r, np.floor(RETURN_BINS * np.log2(move[r, c])).astype(int), move[r, c], n, 0)
            r, c = np.nonzero(volume > 0)
            more = _sparse_bins(r, np.floor(AMOUNT_BINS * np.log2(volume[r, c])).astype(int), volume[r, c], n, 1)
            steady = (move == 0) & (volume > 0)
            same = np.zeros_like(steady)
            same[:, 1:] = (volume[:, 1:] == volume[:, :-1]) & (volume[:, 1:] > 0)
            traded = (volume > 0).sum(1)
            still = (move == 0).sum(1)
        for k, (h, x, a, b, t, z) in enumerate(zip(hist, more, steady.sum(1).tolist(), same.sum(1).tolist(), traded.tolist(), still.tolist())):
            h.extend(x)
            h.append({"kind": 2, "bin": 0, "cnt": t, "ss": 0.0, "lo": 0.0, "hi": 0.0})
            h.append({"kind": 2, "bin": 1, "cnt": a, "ss": 0.0, "lo": 0.0, "hi": 0.0})
            h.append({"kind": 2, "bin": 2, "cnt": b, "ss": 0.0, "lo": 0.0, "hi": 0.0})
            h.append({"kind": 2, "bin": 3, "cnt": z, "ss": 0.0, "lo": 0.0, "hi": 0.0})
        pack = lambda m, kind: pa.array([x.tobytes() for x in m.astype(kind)], pa.binary())
        return pa.RecordBatch.from_arrays(
            [table["src"].combine_chunks().take(pa.array(change)), table["day"].combine_chunks().take(pa.array(change)), pa.array([x.tobytes() for x in np.packbits(seen, axis=1)], pa.binary()), pack(close, "f8"), pack(volume, "f8"), pa.array(hist, _HIST)],
            names=["src", "day", "seen", "close", "volume", "hist"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if b.num_rows == 0:
                continue
            kept.append(b)
            rows += b.num_rows
            if rows >= 60_000:
                t = pa.Table.from_batches(kept)
                src, day = t["src"].to_numpy(), t["day"].to_numpy()
                tail = np.flatnonzero((src != src[-1]) | (day != day[-1]))
                cut = int(tail[-1]) + 1 if len(tail) else 0
                if cut:
                    yield chunk(t.slice(0, cut).combine_chunks())
                kept = t.slice(cut).combine_chunks().to_batches()
                rows = t.num_rows - cut
        if rows:
            yield chunk(pa.Table.from_batches(kept).combine_chunks())

    return run


_PARAMS = ("sigma", "cap", "level", "spread", "raised", "steady", "same")


def _params(rules: SpikeRules):
    """From a source's merged histograms its usual move, its largest ordinary amount and its shares of unchanged readings.

    The largest ordinary amount lies below the lowest gap of amount_factor in the upper half of the source's positive
    amounts: what lies above is spikes, however many up to half. More than that are the source's normal behaviour.
    The usual move is the deviation of all log returns, those of zero included; outliers are told by the non-zero ones,
    as the median of all is zero where prices are mostly carried on.
    A gap may also lie between two ordinary amounts of a thin source. So level and spread of the logarithms of the
    amounts below it are kept, and the share of those above it, as which the model expects a spike: an amount beyond
    the gap is a spike only if the chain finds it likelier than an ordinary one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            srcs, out = b.column("src").to_pylist(), []
            for h in b.column("h").to_pylist():
                n = {x["bin"]: x["cnt"] for x in h if x["kind"] == 2}
                moves = sorted((x["bin"], x["cnt"], x["ss"]) for x in h if x["kind"] == 0)
                sigma = 0.0
                if moves:
                    half, total = sum(c for _, c, _ in moves) / 2, 0
                    for mid, c, _ in moves:
                        total += c
                        if total >= half:
                            break
                    cut = mid + RETURN_BINS * np.log2(6 * 1.4826)
                    near = [(c, s) for k, c, s in moves if k <= cut]
                    sigma = float(np.sqrt(sum(s for _, s in near) / (sum(c for c, _ in near) + n.get(3, 0))))
                sizes = sorted(((x["bin"], x["cnt"], x["lo"], x["hi"]) for x in h if x["kind"] == 1), reverse=True)
                cap, above = (sizes[0][3] if sizes else float("inf")), 0
                most = max(3, sum(x[1] for x in sizes) / 2)
                for upper, lower in zip(sizes, sizes[1:]):
                    above += upper[1]
                    if above > most:
                        break
                    if upper[2] > rules.amount_factor * lower[3]:
                        cap = lower[3]
                ordinary = [(x[1], (x[0] + 0.5) * np.log(2) / AMOUNT_BINS) for x in sizes if x[3] <= cap]
                some = max(1, sum(c for c, _ in ordinary))
                level = sum(c * v for c, v in ordinary) / some
                spread = float(np.sqrt(sum(c * (v - level) ** 2 for c, v in ordinary) / some))
                raised = sum(x[1] for x in sizes if x[3] > cap)
                traded = max(1, n.get(0, 0))
                out.append((sigma, cap, level, spread, (raised + 1) / (raised + some + 1000), n.get(1, 0) / traded, n.get(2, 0) / traded))
            cols = list(zip(*out)) or [[]] * len(_PARAMS)
            yield pa.RecordBatch.from_arrays([pa.array(srcs, pa.string()), b.column("sessions"), *(pa.array(c, pa.float64()) for c in cols)], names=["src", "sessions", *_PARAMS])

    return run


def forward_backward(loglik: np.ndarray, stay: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Posterior [chain, time, state] of a hidden Markov model; loglik [chain, time, state], stay [from, to] or [chain, from, to]."""
    lik = np.exp(loglik - loglik.max(axis=2, keepdims=True)) + 1e-300
    n, t, k = lik.shape
    alpha, beta = np.empty((t, n, k)), np.empty((t, n, k))
    lik = np.ascontiguousarray(lik.transpose(1, 0, 2))
    a = start * lik[0]
    alpha[0] = a / a.sum(1, keepdims=True)
    step = (lambda x, m: x @ m) if stay.ndim == 2 else (lambda x, m: (x[:, None, :] @ m)[:, 0])
    for i in range(1, t):
        a = step(alpha[i - 1], stay) * lik[i]
        alpha[i] = a / a.sum(1, keepdims=True)
    beta[-1] = 1.0
    back = np.swapaxes(stay, -1, -2).copy()
    for i in range(t - 2, -1, -1):
        b = step(beta[i + 1] * lik[i + 1], back)
        beta[i] = b / b.sum(1, keepdims=True)
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    return post.transpose(1, 0, 2)


#: Transitions between normal, spike, stuck and out of range; the first row's spikes are as frequent as in the source.
_STAY = np.array([[0.9968, 0.001, 0.002, 0.0002], [0.4, 0.59, 0.005, 0.005], [0.05, 0.005, 0.94, 0.005], [0.6, 0.05, 0.05, 0.3]])
_START = np.array([0.99, 0.004, 0.004, 0.002])


def _transitions(raised: np.ndarray) -> np.ndarray:
    """Transitions [source, from, to] for sources with a share of raised readings."""
    stay = np.repeat(_STAY[None], len(raised), 0)
    stay[:, 0, SPIKE] = np.clip(raised, 1e-4, 0.3)
    stay[:, 0, NORMAL] = 1 - stay[:, 0, SPIKE] - _STAY[0, STUCK] - _STAY[0, OUT]
    return stay


def _local_level(log: np.ndarray, w: int) -> np.ndarray:
    """Median of the known values within w bars to either side."""
    padded = np.pad(log, ((0, 0), (w, w)), constant_values=np.nan)
    view = np.sort(np.lib.stride_tricks.sliding_window_view(padded, 2 * w + 1, axis=1), axis=2)
    n = (~np.isnan(view)).sum(2)
    return np.take_along_axis(view, np.maximum(n - 1, 0)[:, :, None] // 2, 2)[:, :, 0]


def _runs(equal: np.ndarray) -> np.ndarray:
    """Length of the run of one value that each cell belongs to; equal: the cell repeats the one before."""
    n, t = equal.shape
    starts = ~equal
    starts[:, 0] = True
    ident = np.cumsum(starts.ravel())
    return np.bincount(ident)[ident].reshape(n, t)


def _spikes(log: np.ndarray, sigma: np.ndarray, rules: SpikeRules) -> np.ndarray:
    """Exact rule: at most spike_bars known bars that lie to one side of the known bars before and after."""
    n, t = log.shape
    known = ~np.isnan(log)
    order = np.argsort(~known, axis=1, kind="stable")
    x = np.take_along_axis(log, order, 1)
    hit, least = np.zeros((n, t), bool), rules.spike_moves * sigma[:, None]
    for k in range(1, rules.spike_bars + 1):
        if t < k + 2:
            break
        seg = np.lib.stride_tricks.sliding_window_view(x[:, 1:-1], k, axis=1)
        before, after = x[:, : t - k - 1], x[:, k + 1 :]
        up, down = seg.min(2) - np.fmax(before, after), np.fmin(before, after) - seg.max(2)
        found = (np.maximum(up, down) > least) & ~np.isnan(before) & ~np.isnan(after)
        for j in range(k):
            hit[:, 1 + j : 1 + j + found.shape[1]] |= found
    out = np.zeros((n, t), bool)
    np.put_along_axis(out, order, hit, 1)
    return out & known


def _likelihoods(deviation: np.ndarray, equal: np.ndarray, known: np.ndarray, bad: np.ndarray, p_equal: np.ndarray, scale: float) -> np.ndarray:
    """Log emissions; deviation in usual units (0 where unknown), equal: repeats the reading before while something trades."""
    p = np.clip(p_equal, 1e-3, 0.2)[:, None]
    ll = np.empty((*deviation.shape, 4))
    z = np.minimum(np.abs(deviation) / scale, 40)
    ll[..., NORMAL] = -0.5 * z * z + np.where(equal, np.log(p), np.log1p(-p))
    ll[..., SPIKE] = -4.5 - np.where(equal, 1.0, 0.0)  # a spike may repeat its value
    ll[..., STUCK] = np.where(equal, -0.02, -6.0) - 0.5 * np.minimum(z, 6) ** 2
    ll[..., OUT] = -60.0
    ll[~known] = 0.0
    ll[bad] = (-60.0, -60.0, -60.0, 0.0)
    return ll


def _flags(rules: SpikeRules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            unpack = lambda name: np.frombuffer(b"".join(b.column(name).to_pylist()), "f8").reshape(n, rules.slots)
            close, volume = unpack("close"), unpack("volume")
            sigma, cap, level, spread, raised, steady, same = (b.column(x).to_numpy(zero_copy_only=False) for x in _PARAMS)
            sigma, spread = np.maximum(sigma, 1e-9), np.maximum(spread, 0.1)
            trades = np.nan_to_num(volume) > 0
            with np.errstate(all="ignore"):
                log = np.log(np.where(close > 0, close, np.nan))
                dev = np.nan_to_num((log - _local_level(log, rules.window)) / sigma[:, None], posinf=0, neginf=0)
                eq_c, eq_v = np.zeros(close.shape, bool), np.zeros(close.shape, bool)
                eq_c[:, 1:] = (close[:, 1:] == close[:, :-1]) & trades[:, 1:] & trades[:, :-1] & (close[:, 1:] != 0)
                eq_v[:, 1:] = (volume[:, 1:] == volume[:, :-1]) & trades[:, 1:]
                excess = np.where(trades, (np.log(np.maximum(volume, 1e-300)) - level[:, None]) / spread[:, None], 0.0)
            post_c = forward_backward(_likelihoods(dev, eq_c, ~np.isnan(close), close <= 0, steady, 2.6), _STAY, _START)
            post_v = forward_backward(_likelihoods(np.maximum(excess, 0), eq_v, ~np.isnan(volume), volume < 0, same, 1.0), _transitions(raised), _START)
            spike_c = _spikes(log, sigma, rules)
            spike_v = (post_v[..., SPIKE] > rules.certainty) & (volume > rules.amount_factor * cap[:, None])
            out = {"close": spike_c, "volume": spike_v}
            for field, equal, post in (("close", eq_c, post_c), ("volume", eq_v, post_v)):
                starts = ~equal
                starts[:, 0] = True
                ident = np.cumsum(starts.ravel())
                suspect = np.bincount(ident, weights=(post[..., STUCK] > rules.suspicion).ravel())[ident].reshape(equal.shape) > 0
                out[field] = out[field] | ((_runs(equal) >= rules.stuck_bars) & suspect)
            srcs, days = b.column("src"), b.column("day")
            parts = []
            for field, values in (("close", close), ("volume", volume)):
                r, c = np.nonzero(out[field])
                take = pa.array(r)
                parts.append(pa.table([srcs.take(take), days.take(take), pa.array(c.astype("i4")), pa.array([field] * len(r), pa.string()), pa.array(values[r, c])], names=["src", "day", "slot", "field", "value"]))
            yield from pa.concat_tables(parts).combine_chunks().to_batches()

    return run


def flag_implausible(bars: DataFrame, rules: SpikeRules = SpikeRules()) -> DataFrame:
    """Rows (bar_id, field) of the implausible ``close`` and ``volume`` readings of minute bars.

    A source is one (instrument, feed), NULLs being values of their own. Readings that are NULL or NaN are never
    flagged. Of several rows with one (source, datetime) the chain uses the newest by ``ingested_at`` (ties: the
    larger close, then volume); every row that holds the flagged value of its bar is flagged under its own bar_id.
    Rows outside the session or without datetime meet the hard bounds only. An empty table gives no rows; other
    columns are ignored.
    """
    clean = lambda c: F.when(F.isnan(c), None).otherwise(F.col(c).cast("double"))
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))
    rows = bars.select("bar_id", F.concat(part("instrument"), F.lit("\u0001"), part("feed")).alias("src"), F.unix_date(F.to_date("datetime")).alias("day"), session_minute(F.col("datetime")).alias("slot"), clean("close").alias("close"), clean("volume").alias("volume"), F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("at"))
    inside = rows.filter("slot >= 0 and day is not null")
    distinct = inside.groupBy("src", "day", "slot", "close", "volume").agg(F.coalesce(F.max("at"), F.lit(0)).alias("at"))
    ordered = distinct.repartition("src", "day").sortWithinPartitions("src", "day", "slot", "at", "close", "volume")
    sessions = materialize(ordered.select("src", "day", "slot", "close", "volume").mapInArrow(_sessions(rules), _SESSION), "sessions")
    merged = sessions.select("src", F.explode("hist").alias("h")).groupBy("src", "h.kind", "h.bin").agg(F.sum("h.cnt").alias("cnt"), F.sum("h.ss").alias("ss"), F.min("h.lo").alias("lo"), F.max("h.hi").alias("hi"), F.count("*").alias("sessions"))
    params = merged.groupBy("src").agg(F.collect_list(F.struct("kind", "bin", "cnt", "ss", "lo", "hi")).alias("h"), F.max("sessions").alias("sessions"))
    params = materialize(params.mapInArrow(_params(rules), "src string, sessions bigint, " + ", ".join(f"{c} double" for c in _PARAMS)), "sources")
    flagged = skew_join(sessions.drop("hist"), params, ["src"], "sessions", sessions.count()).mapInArrow(_flags(rules), "src string, day int, slot int, field string, value double")
    flagged = materialize(flagged, "flagged")
    value = F.when(F.col("field") == "close", F.col("close")).otherwise(F.col("volume"))
    by_model = inside.drop("at").join(flagged, ["src", "day", "slot"]).filter(value == F.col("value")).select("bar_id", "field", F.when(F.col("field") == "close", F.col("value") > 0).otherwise(F.col("value") >= 0).alias("ok")).filter("ok").drop("ok")
    bounds = rows.select("bar_id", F.explode(F.filter(F.array(F.when(F.col("close") <= 0, F.lit("close")), F.when(F.col("volume") < 0, F.lit("volume"))), lambda x: x.isNotNull())).alias("field"))
    return by_model.unionByName(bounds)
