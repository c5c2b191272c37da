"""Windows over series as array kernels, for large batches of formulas.

Sliding frames of the SQL engine aggregate every frame anew, row by row; with a hundred windows that is most of the
time. Here a task takes whole series as Arrow batches and evaluates all formulas on arrays, equal subtrees once.
Results are those of ``functions.registry`` in its core dialect; tests hold one against the other. Missing values
are NaN inside and NULL outside.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from lodestrata.dsl.tree import Node, window_of

#: Cells of a window matrix at once.
CELLS = 2_000_000
#: Windows whose frames the SQL engine would have to collect row by row: always evaluated here.
SCANNED = frozenset(["EMA", "WMA", "Rank", "Mad", "IdxMax", "IdxMin"])
#: Rows that a task gathers before it evaluates; a series is never cut.
ROWS = 100_000
STILL = 2e-5


class Frame:
    """Columns of some whole series, one after another."""

    def __init__(self, columns: dict[str, np.ndarray], start: np.ndarray, place: np.ndarray):
        self.columns, self.place = columns, place
        n = len(place)
        self.n, self.first = n, start
        self.pos = np.arange(n) - start
        ends = np.r_[np.flatnonzero(np.diff(start)) + 1, n] if n else np.empty(0, int)
        self.left = (np.repeat(ends, np.diff(np.r_[0, ends])) - 1 - np.arange(n)) if n else np.empty(0, int)
        self.memo: dict[Node, np.ndarray] = {}

    def eval(self, node: Node) -> np.ndarray | float | str:
        if node.kind in ("number", "text"):
            return node.value
        if node.kind == "field":
            return self.columns[node.name]
        if node not in self.memo:
            args = [self.eval(a) for a in node.args]
            with np.errstate(all="ignore"):
                if node.name in ELEMENTWISE:
                    out = ELEMENTWISE[node.name](*args)
                else:
                    out = WINDOWS[node.name](self, *args)
            self.memo[node] = np.asarray(out)
        return self.memo[node]

    def full(self, x) -> np.ndarray:
        return np.broadcast_to(np.asarray(x, float), (self.n,))

    def shift(self, x: np.ndarray, k: int) -> np.ndarray:
        x, i = self.full(x), np.arange(self.n)
        ok = self.pos >= k if k >= 0 else self.left >= -k
        return np.where(ok, x[np.clip(i - k, 0, max(0, self.n - 1))], np.nan) if self.n else x

    def windows(self, n: int, *xs: np.ndarray) -> Iterator[tuple[slice, list[np.ndarray], np.ndarray]]:
        """(rows, window matrices, lengths): cells before a series' start are NaN."""
        padded = [np.concatenate([np.full(n - 1, np.nan), self.full(x)]) for x in xs]
        views = [np.lib.stride_tricks.sliding_window_view(p, n) for p in padded]
        step = max(1, CELLS // n)
        for s in range(0, self.n, step):
            rows = slice(s, min(self.n, s + step))
            length = np.minimum(self.pos[rows] + 1, n)
            outside = np.arange(n) < (n - length)[:, None]
            yield rows, [np.where(outside, np.nan, v[rows]) for v in views], length

    def over(self, n: float, f: Callable, *xs: np.ndarray) -> np.ndarray:
        out = np.full(self.n, np.nan)
        for rows, mats, length in self.windows(int(n), *xs):
            out[rows] = f(*mats, length)
        return out


def _moments(v: np.ndarray):
    ok = ~np.isnan(v)
    n = ok.sum(1)
    mean = np.where(ok, v, 0).sum(1) / n
    d = np.where(ok, v - mean[:, None], 0.0)
    return ok, n, mean, d


def _std(v, length):
    _, n, _, d = _moments(v)
    return np.sqrt(np.where(n > 1, (d * d).sum(1) / (n - 1), np.nan))


def _skew(v, length):
    _, n, _, d = _moments(v)
    m2, m3 = (d * d).sum(1) / n, (d * d * d).sum(1) / n
    return np.where((n >= 3) & (np.nanmax(v, 1, initial=-np.inf) > np.nanmin(v, 1, initial=np.inf)), m3 / m2**1.5 * np.sqrt(n * (n - 1.0)) / (n - 2), np.nan)


def _kurt(v, length):
    _, n, _, d = _moments(v)
    m2, m4 = (d * d).sum(1) / n, (d**4).sum(1) / n
    return np.where((n >= 4) & (np.nanmax(v, 1, initial=-np.inf) > np.nanmin(v, 1, initial=np.inf)), (n - 1.0) / ((n - 2.0) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6), np.nan)


def _extreme(sign: float):
    def f(v, length):
        out = np.where(np.isnan(v), -np.inf, sign * v).max(1)
        return np.where(np.isnan(v).all(1), np.nan, sign * out)

    return f


def _index(sign: float):
    def f(v, length):
        outside = np.arange(v.shape[1]) < (v.shape[1] - length)[:, None]
        filled = np.where(outside, -np.inf, np.where(np.isnan(v), np.inf, sign * v))
        return np.where(np.isnan(v).all(1), np.nan, filled.argmax(1) - (v.shape[1] - length) + 1.0)

    return f


def _quantile(q: float):
    def f(v, length):
        n = (~np.isnan(v)).sum(1)
        s, at = np.sort(v, axis=1), np.maximum(n - 1, 0) * q
        lo = np.floor(at).astype(int)
        a = np.take_along_axis(s, lo[:, None], 1)[:, 0]
        b = np.take_along_axis(s, np.minimum(lo + 1, np.maximum(n - 1, 0))[:, None], 1)[:, 0]
        return a + (b - a) * (at - lo)

    return f


def _mad(v, length):
    _, n, _, d = _moments(v)
    return np.abs(d).sum(1) / n


def _rank(v, length):
    last, n = v[:, -1:], (~np.isnan(v)).sum(1)
    return np.where(np.isnan(last[:, 0]), np.nan, ((v < last).sum(1) + ((v == last).sum(1) + 1) / 2) / n)


def _line(v):
    ok, n, mean, d = _moments(v)
    t = np.arange(v.shape[1], dtype=float)
    tm = np.where(ok, t, 0).sum(1) / n
    dt = np.where(ok, t - tm[:, None], 0.0)
    return n, mean, d, dt, (d * dt).sum(1), (dt * dt).sum(1), tm


def _slope(v, length):
    n, _, _, _, sxy, sxx, _ = _line(v)
    return np.where(n >= 2, sxy / sxx, np.nan)


def _resi(v, length):
    n, mean, _, _, sxy, sxx, tm = _line(v)
    return np.where(n >= 2, v[:, -1] - (mean + sxy / sxx * (v.shape[1] - 1 - tm)), np.nan)


def _rsquare(v, length):
    n, _, d, _, sxy, sxx, _ = _line(v)
    syy = (d * d).sum(1)
    return np.where((n >= 2) & (np.sqrt(syy / (n - 1)) > STILL), sxy * sxy / (sxx * syy), np.nan)


def _wma(v, length):
    outside = v.shape[1] - length
    weight = np.maximum(np.arange(v.shape[1]) - outside[:, None] + 1, 0)
    n = (~np.isnan(v)).sum(1)
    return np.where(n > 0, np.nansum(v * weight, 1) / (length * (length + 1) / 2) / n, np.nan)


def _pairs(a, b):
    ok = ~np.isnan(a) & ~np.isnan(b)
    n = ok.sum(1)
    da = np.where(ok, a - (np.where(ok, a, 0).sum(1) / n)[:, None], 0.0)
    db = np.where(ok, b - (np.where(ok, b, 0).sum(1) / n)[:, None], 0.0)
    return n, da, db


def _cov(a, b, length):
    n, da, db = _pairs(a, b)
    return np.where(n >= 2, (da * db).sum(1) / (n - 1), np.nan)


def _corr(a, b, length):
    n, da, db = _pairs(a, b)
    sa, sb = (da * da).sum(1), (db * db).sum(1)
    moves = (_std(a, length) > STILL) & (_std(b, length) > STILL) & (sa * sb > 0)
    return np.where((n >= 2) & moves, (da * db).sum(1) / np.sqrt(sa * sb), np.nan)


def _sum(v, length):
    n = (~np.isnan(v)).sum(1)
    return np.where(n > 0, np.nansum(v, 1), np.nan)


def _count(v, length):
    return (~np.isnan(v)).sum(1).astype(float)


def _ema(frame: Frame, x: np.ndarray, n: float) -> np.ndarray:
    """Exponentially weighted mean of the whole past, gaps decaying too: a step per place of the longest series."""
    alpha = n if n < 1 else 2 / (n + 1)
    x, out = frame.full(x), np.full(frame.n, np.nan)
    begins = np.flatnonzero(frame.pos == 0)
    sizes = np.diff(np.r_[begins, frame.n])
    order = np.argsort(-sizes)
    begins, sizes = begins[order], sizes[order]
    mean, weight = np.full(len(begins), np.nan), np.zeros(len(begins))
    for t in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -t, "left"))
        v = x[begins[:live] + t]
        ok = ~np.isnan(v)
        mean, weight = mean[:live], weight[:live] * (1 - alpha)
        # a weight may fade to nothing in a long gap; the mean is carried on all the same
        moved = (np.where(weight > 0, mean, 0) * weight + np.where(ok, v, 0)) / (weight + 1)
        mean, weight = np.where(ok, moved, mean), weight + ok
        out[begins[:live] + t] = mean
    return out


WINDOWS: dict[str, Callable] = {
    "Ref": lambda f, x, n: f.full(x)[f.first] if n == 0 else f.shift(x, int(n)),
    "Delta": lambda f, x, n: f.full(x) - (f.full(x)[f.first] if n == 0 else f.shift(x, int(n))),
    "Mean": lambda f, x, n: f.over(n, lambda v, length: _moments(v)[2], x),
    "Sum": lambda f, x, n: f.over(n, _sum, x),
    "Count": lambda f, x, n: f.over(n, _count, x),
    "Std": lambda f, x, n: f.over(n, _std, x),
    "Var": lambda f, x, n: f.over(n, lambda v, length: _std(v, length) ** 2, x),
    "Skew": lambda f, x, n: f.over(n, _skew, x),
    "Kurt": lambda f, x, n: f.over(n, _kurt, x),
    "Max": lambda f, x, n: f.over(n, _extreme(1.0), x),
    "Min": lambda f, x, n: f.over(n, _extreme(-1.0), x),
    "IdxMax": lambda f, x, n: f.over(n, _index(1.0), x),
    "IdxMin": lambda f, x, n: f.over(n, _index(-1.0), x),
    "Quantile": lambda f, x, n, q: f.over(n, _quantile(q), x),
    "Med": lambda f, x, n: f.over(n, _quantile(0.5), x),
    "Mad": lambda f, x, n: f.over(n, _mad, x),
    "Rank": lambda f, x, n: f.over(n, _rank, x),
    "Slope": lambda f, x, n: f.over(n, _slope, x),
    "Resi": lambda f, x, n: f.over(n, _resi, x),
    "Rsquare": lambda f, x, n: f.over(n, _rsquare, x),
    "WMA": lambda f, x, n: f.over(n, _wma, x),
    "EMA": _ema,
    "Corr": lambda f, x, y, n: f.over(n, _corr, x, y),
    "Cov": lambda f, x, y, n: f.over(n, _cov, x, y),
}


ELEMENTWISE: dict[str, Callable] = {
    "Add": np.add, "Sub": np.subtract, "Mul": np.multiply, "Abs": np.abs, "Sign": np.sign,
    "Div": lambda a, b: np.where(np.asarray(b) != 0, np.divide(a, np.where(np.asarray(b) != 0, b, np.nan)), np.nan),
    "Log": lambda x: np.log(np.where(np.asarray(x) > 0, x, np.nan)),
    "Power": lambda a, b: np.power(np.asarray(a, float), b),
    "Greater": np.maximum, "Less": np.minimum,
    "Gt": lambda a, b: np.greater(a, b) * 1.0, "Ge": lambda a, b: np.greater_equal(a, b) * 1.0,
    "Lt": lambda a, b: np.less(a, b) * 1.0, "Le": lambda a, b: np.less_equal(a, b) * 1.0,
    "Eq": lambda a, b: np.equal(a, b) * 1.0, "Ne": lambda a, b: np.not_equal(a, b) * 1.0,
}


def fixed(x: Node) -> bool:
    """Whether a window has a fixed number of rows, or any weight if it is an EMA."""
    n = window_of(x)
    if x.name not in WINDOWS or n is None:
        return False
    return n > 0 if x.name == "EMA" else x.name in ("Ref", "Delta") or n >= 1 and n == int(n)


def supported(tree: Node) -> bool:
    """Series operators only, with windows of a fixed number of rows."""
    for x in tree.walk():
        if x.kind == "call":
            if x.name not in ELEMENTWISE and not fixed(x):
                return False
        elif x.kind not in ("field", "number"):
            return False
    return True


def runner(trees: dict[str, Node], keys: list[str], entity: str, order: str, fields: list[str]):
    """mapInArrow function over batches sorted by (entity, order)."""

    def one(table: pa.Table) -> pa.RecordBatch:
        name = table[entity].combine_chunks()
        code = name.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        at = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        start = np.repeat(at, np.diff(np.r_[at, len(code)]))
        columns = {f: table[f].to_numpy(zero_copy_only=False).astype(float) for f in fields}
        frame = Frame(columns, start, table[order].to_numpy(zero_copy_only=False))
        values = [frame.full(frame.eval(t)) for t in trees.values()]
        return pa.RecordBatch.from_arrays([*(table[k].combine_chunks() for k in keys), *(pa.array(v, pa.float64(), mask=np.isnan(v)) for v in values)], names=[*keys, *trees])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            kept.append(b)
            rows += b.num_rows
            if rows >= ROWS:
                t = pa.Table.from_batches(kept)
                same = t[entity].to_numpy() == t[entity][-1].as_py()
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                if cut:
                    yield from _slices(one(t.slice(0, cut)))
                kept, rows = t.slice(cut).to_batches(), t.num_rows - cut
        if rows:
            yield from _slices(one(pa.Table.from_batches(kept)))

    def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // max(1, b.num_columns))
        for s in range(0, b.num_rows, step):
            yield b.slice(s, step)

    return run


def cost(trees: dict[str, Node]) -> float:
    """Cells of all windows a row, equal ones counted once."""
    seen = {x for t in trees.values() for x in t.walk() if x.kind == "call" and x.name in WINDOWS}
    return sum(1 if x.name in ("Ref", "Delta") else 30 if x.name == "EMA" else math.ceil(x.args[2 if x.name in ("Corr", "Cov") else 1].value) for x in seen)
