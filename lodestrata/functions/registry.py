"""Operators of the factor language as builders of columns.

A builder gets the compiled arguments and a context and returns a Column. NULL is the only missing value; builders
never let NaN through. ``core`` windows are partial at the start of a series and skip NULLs; ``strict`` windows
give NULL unless all their rows are there and filled.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

Builder = Callable[..., Column]


@dataclass(frozen=True)
class Context:
    entity: str = "instrument"
    order: str = "cal_idx"
    time: str = "datetime"
    group: str = "industry"
    strict: bool = False
    ieee: bool = False  # division by zero and log of zero give infinity
    seed: int = 7

    def series(self) -> WindowSpec:
        return Window.partitionBy(self.entity).orderBy(self.order)

    def rows(self, n: float) -> WindowSpec:
        """The last n rows; n = 0: all so far."""
        return self.series().rowsBetween(Window.unboundedPreceding if n == 0 else -(int(n) - 1), 0)

    def day(self) -> WindowSpec:
        return Window.partitionBy(self.time)


SCALAR: dict[str, Builder] = {}
WINDOWED: dict[str, Builder] = {}


def scalar(name: str):
    return lambda f: SCALAR.setdefault(name, f)


def windowed(name: str):
    return lambda f: WINDOWED.setdefault(name, f)


def register(name: str, builder: Builder, uses_window: bool = False) -> None:
    """Add an operator or replace one; ``builder(context, *args)``."""
    SCALAR.pop(name, None)
    WINDOWED.pop(name, None)
    (WINDOWED if uses_window else SCALAR)[name] = builder


def known(x: Column) -> Column:
    """NaN to NULL."""
    return F.when(~F.isnan(x), x)


def both(a: Column, b: Column, x: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), x)



# Arithmetic and comparison.
SCALAR |= {
    "Abs": lambda c, x: F.abs(x),
    "Sign": lambda c, x: F.signum(x),
    "Add": lambda c, a, b: a + b,
    "Sub": lambda c, a, b: a - b,
    "Mul": lambda c, a, b: a * b,
    "Not": lambda c, x: ~x,
    "And": lambda c, a, b: F.coalesce(a, F.lit(False)) & F.coalesce(b, F.lit(False)),
    "Or": lambda c, a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)),
    "Gt": lambda c, a, b: F.coalesce(a > b, F.lit(False)),
    "Ge": lambda c, a, b: F.coalesce(a >= b, F.lit(False)),
    "Lt": lambda c, a, b: F.coalesce(a < b, F.lit(False)),
    "Le": lambda c, a, b: F.coalesce(a <= b, F.lit(False)),
    "Eq": lambda c, a, b: F.coalesce(a == b, F.lit(False)),
    "Ne": lambda c, a, b: F.coalesce(a != b, F.lit(True)),
    "Greater": lambda c, a, b: both(a, b, F.greatest(a, b)),
    "Less": lambda c, a, b: both(a, b, F.least(a, b)),
    "Power": lambda c, a, b: known(F.pow(a, b)),
    "IsNull": lambda c, x: x.isNull() | F.isnan(x),
    "IsInf": lambda c, x: F.coalesce(F.abs(x) == float("inf"), F.lit(False)),
    "Date": lambda c, x: F.to_date(F.col(c.time)),
    "SLog1p": lambda c, x: F.signum(x) * F.log1p(F.abs(x)),
    "Inv": lambda c, x: SCALAR["Div"](c, F.lit(1.0), x),
}


@scalar("Log")
def _log(c: Context, x: Column) -> Column:
    found = F.when(x > 0, F.ln(x))
    return found.when(x == 0, F.lit(float("-inf"))) if c.ieee else found


@scalar("Div")
def _div(c: Context, a: Column, b: Column) -> Column:
    found = F.when(b != 0, a / F.when(b != 0, b))
    return found.when((b == 0) & (a != 0), F.signum(a) * F.lit(float("inf"))) if c.ieee else found


@scalar("If")
def _if(c: Context, test: Column, a: Column, b: Column) -> Column:
    """A missing test counts as true."""
    return F.when(F.coalesce(test.cast("boolean"), F.lit(True)), a).otherwise(b)


def _full(c: Context, n: float, x: Column, w: WindowSpec, found: Column) -> Column:
    return F.when(F.count(x).over(w) == int(n), found) if c.strict else found


def _aggregate(make: Callable[[Column], Column], least: int = 1) -> Builder:
    def build(c: Context, x: Column, n: float) -> Column:
        w = c.rows(n)
        found = make(x).over(w)
        if least > 1:
            found = F.when(F.count(x).over(w) >= least, found)
        return _full(c, n, x, w, found)

    return build


WINDOWED |= {
    "Sum": _aggregate(F.sum),
    "Max": _aggregate(F.max),
    "Min": _aggregate(F.min),
    "Std": _aggregate(F.stddev_samp, 2),
    "Var": _aggregate(F.var_samp, 2),
    "Count": lambda c, x, n: F.count(x).over(c.rows(n)).cast("double"),
    "Quantile": lambda c, x, n, q: _full(c, n, x, c.rows(n), F.percentile(x, q).over(c.rows(n))),
}


@windowed("Ref")
def _ref(c: Context, x: Column, n: float) -> Column:
    """n rows back, or ahead if negative; 0 is the first value of the series."""
    if n == 0:
        return F.first(x).over(c.series().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.lag(x, int(n)).over(c.series())


@windowed("Delta")
def _delta(c: Context, x: Column, n: float) -> Column:
    return x - _ref(c, x, n)


@windowed("Mean")
def _mean(c: Context, x: Column, n: float) -> Column:
    if 0 < n < 1:
        return _ema(c, x, n)
    return _full(c, n, x, c.rows(n), F.avg(x).over(c.rows(n)))


def _varied(x: Column, w: WindowSpec) -> Column:
    return F.max(x).over(w) > F.min(x).over(w)


@windowed("Skew")
def _skew(c: Context, x: Column, n: float) -> Column:
    """Bias-corrected; the population figure if strict. NULL where nothing varies."""
    w = c.rows(n)
    k = F.count(x).over(w).cast("double")
    if c.strict:
        return F.when((k == int(n)) & _varied(x, w), F.skewness(x).over(w))
    return F.when((k >= 3) & _varied(x, w), F.skewness(x).over(w) * F.sqrt(k * (k - 1)) / F.when(k > 2, k - 2))


@windowed("Kurt")
def _kurt(c: Context, x: Column, n: float) -> Column:
    """Excess, bias-corrected; from the sample variance if strict."""
    w = c.rows(n)
    k, raw = F.count(x).over(w).cast("double"), F.kurtosis(x).over(w)
    if c.strict:
        return F.when((k == int(n)) & _varied(x, w), (raw + 3) * F.pow((k - 1) / k, F.lit(2.0)) - 3)
    return F.when((k >= 4) & _varied(x, w), (k - 1) / F.when(k > 3, (k - 2) * (k - 3)) * ((k + 1) * raw + 6))


@windowed("Med")
def _med(c: Context, x: Column, n: float) -> Column:
    """Median; the lower one of an even number if strict."""
    w = c.rows(n)
    if c.strict:
        return F.when(F.count(x).over(w) == int(n), F.element_at(F.array_sort(F.collect_list(x).over(w)), (int(n) + 1) // 2))
    return F.percentile(x, 0.5).over(w)


def _listed(c: Context, x: Column, n: float) -> Column:
    """Values of the window, oldest first, with NULLs kept as structs."""
    return F.collect_list(F.struct(x.alias("v"))).over(c.rows(n))


@windowed("IdxMax")
def _idxmax(c: Context, x: Column, n: float) -> Column:
    """Place of the largest value, 1 = oldest; a missing value counts as larger than any, the first of equals wins."""
    w = c.rows(n)
    filled = F.coalesce(x, F.lit(float("nan")))
    return _full(c, n, x, w, F.when(F.count(x).over(w) > 0, F.array_position(F.collect_list(filled).over(w), F.max(filled).over(w)).cast("double")))


@windowed("IdxMin")
def _idxmin(c: Context, x: Column, n: float) -> Column:
    w = c.rows(n)
    filled = F.coalesce(-x, F.lit(float("nan")))
    return _full(c, n, x, w, F.when(F.count(x).over(w) > 0, F.array_position(F.collect_list(filled).over(w), F.max(filled).over(w)).cast("double")))


@windowed("Mad")
def _mad(c: Context, x: Column, n: float) -> Column:
    """Mean absolute deviation from the mean."""
    w = c.rows(n)
    mean, k = F.avg(x).over(w), F.count(x).over(w)
    total = F.aggregate(F.collect_list(x).over(w), F.lit(0.0), lambda s, v: s + F.abs(v - mean))
    return _full(c, n, x, w, F.when(k > 0, total / F.when(k > 0, k)))


@windowed("Rank")
def _rank(c: Context, x: Column, n: float) -> Column:
    """Share of the last value's rank in its window, ties averaged; counted from the top if strict."""
    w = c.rows(n)
    held, k = F.collect_list(x).over(w), F.count(x).over(w)
    count = lambda test: F.aggregate(held, F.lit(0.0), lambda s, v: s + F.when(test(v), 1.0).otherwise(0.0))
    if c.strict:
        return F.when(k == int(n), (count(lambda v: v >= x) + count(lambda v: v > x) + 1) / (2 * int(n)))
    return F.when(x.isNotNull(), (count(lambda v: v < x) + (count(lambda v: v == x) + 1) / 2) / F.when(k > 0, k))


@windowed("Slope")
def _slope(c: Context, x: Column, n: float) -> Column:
    w = c.rows(n)
    return F.when(F.count(x).over(w) >= 2, F.regr_slope(x, F.col(c.order).cast("double")).over(w))


@windowed("Resi")
def _resi(c: Context, x: Column, n: float) -> Column:
    """Last value less the fitted line's; on centred places, which keeps digits."""
    w = c.rows(n)
    t = F.col(c.order).cast("double")
    mean = F.avg(F.when(x.isNotNull(), t)).over(w)
    return F.when(F.count(x).over(w) >= 2, x - (F.avg(x).over(w) + F.regr_slope(x, t).over(w) * (t - mean)))


#: Standard deviation up to which a window counts as constant.
STILL = 2e-5


@windowed("Rsquare")
def _rsquare(c: Context, x: Column, n: float) -> Column:
    w = c.rows(n)
    moves = F.stddev_samp(x).over(w) > (STILL if n != 0 else 0.0)
    return F.when(moves & (F.count(x).over(w) >= 2), F.regr_r2(x, F.col(c.order).cast("double")).over(w))


@windowed("WMA")
def _wma(c: Context, x: Column, n: float) -> Column:
    """Weights 1..n normalised, the sum divided once more by the number of values; strict: weights 0..n-1, a plain weighted mean."""
    w = c.rows(n)
    held = _listed(c, x, n)
    k = F.size(held).cast("double")
    weighted = F.aggregate(F.transform(held, lambda v, i: F.coalesce(v["v"], F.lit(0.0)) * (i if c.strict else i + 1)), F.lit(0.0), lambda s, v: s + v)
    if c.strict:
        return F.when(F.count(x).over(w) == int(n), weighted / (int(n) * (int(n) - 1) / 2))
    values = F.count(x).over(w)
    return F.when(values > 0, weighted / (k * (k + 1) / 2) / F.when(values > 0, values))


@windowed("EMA")
def _ema(c: Context, x: Column, n: float) -> Column:
    """Span n, or alpha if n < 1; strict: weights over n rows only."""
    if c.strict:
        w, a = c.rows(n), 1 - 2 / (1 + int(n))
        weights = [a ** (int(n) - i) for i in range(int(n))]
        held = F.collect_list(x).over(w)
        total = F.aggregate(F.zip_with(held, F.array(*map(F.lit, weights)), lambda v, k: v * k), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
        return F.when(F.count(x).over(w) == int(n), total / sum(weights))
    raise ValueError("EMA needs a span or a weight and is a scan of its series")


@windowed("Cov")
def _cov(c: Context, x: Column, y: Column, n: float) -> Column:
    w = c.rows(n)
    pairs = F.count(both(x, y, x)).over(w)
    found = F.covar_samp(x, y).over(w)
    return F.when(pairs == int(n) if c.strict else pairs >= 2, found)


@windowed("Corr")
def _corr(c: Context, x: Column, y: Column, n: float) -> Column:
    """Of the pairs that are whole; NULL where either side hardly moves. Strict: a sum of squares under 1e-6 counts as 1."""
    w = c.rows(n)
    a, b = both(x, y, x), both(x, y, y)
    k, cov = F.count(a).over(w), F.covar_samp(x, y).over(w)
    sa, sb = F.stddev_samp(a).over(w), F.stddev_samp(b).over(w)
    if c.strict:
        m = int(n) - 1
        tiny = (sa * sa * m < 1e-6) | (sb * sb * m < 1e-6)
        return F.when(k == int(n), F.when(tiny, cov * m).otherwise(cov / F.when(~tiny, sa * sb)))
    moves = (F.stddev_samp(x).over(w) > STILL) & (F.stddev_samp(y).over(w) > STILL) & (sa * sb > 0)
    return F.when((k >= 2) & moves, cov / F.when(sa * sb > 0, sa * sb))


# More windows of the strict dialect.
WINDOWED |= {
    "IR": lambda c, x, n: WINDOWED["Mean"](c, x, n) / F.when(WINDOWED["Std"](c, x, n) > 0, WINDOWED["Std"](c, x, n)),
    "MinMaxDiff": lambda c, x, n: WINDOWED["Max"](c, x, n) - WINDOWED["Min"](c, x, n),
    "MaxDiff": lambda c, x, n: x - WINDOWED["Max"](c, x, n),
    "MinDiff": lambda c, x, n: x - WINDOWED["Min"](c, x, n),
    "RefDiv": lambda c, x, n: _div(c, x, _ref(c, x, n)),
    "PctChange": lambda c, x, n: _div(c, x, _ref(c, x, n)) - 1,
    "FFillNan": lambda c, x: F.last(x, True).over(c.rows(0)),
    "BFillNan": lambda c, x: F.first(x, True).over(c.series().rowsBetween(0, Window.unboundedFollowing)),
    "DayLast": lambda c, x: F.last(x, True).over(Window.partitionBy(c.entity, F.to_date(c.time)).orderBy(c.order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    "Product": lambda c, x, n: F.product(x).over(c.rows(n)),
}


@windowed("DayCumsum")
def _day_cumsum(c: Context, x: Column, start: str = "9:30", end: str = "14:59") -> Column:
    """Running sum of a day's minutes from start to end; 0 outside them."""
    minute = F.hour(c.time) * 60 + F.minute(c.time)
    lo, hi = (int(h) * 60 + int(m) for h, m in (s.split(":") for s in (start, end)))
    w = Window.partitionBy(c.entity, F.to_date(c.time)).orderBy(c.order).rowsBetween(Window.unboundedPreceding, 0)
    return F.when(minute.between(lo, hi), F.coalesce(F.sum(F.when(minute.between(lo, hi), x)).over(w), F.lit(0.0))).otherwise(0.0)


@windowed("Rolling")
def _rolling(c: Context, x: Column, n: float, name: str) -> Column:
    return WINDOWED[{"mean": "Mean", "sum": "Sum", "std": "Std", "var": "Var", "skew": "Skew", "kurt": "Kurt", "max": "Max", "min": "Min", "median": "Med", "count": "Count"}[name]](c, x, n)


def hashed_uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) that the parts alone fix, whatever the partitions: 52 bits of their MD5 sum."""
    text = F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def md5_normal(*parts: Column | str) -> Column:
    """A standard normal number that the parts alone fix."""
    u, v = hashed_uniform(*parts, F.lit("u")), hashed_uniform(*parts, F.lit("v"))
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)


def percent_rank(x: Column, *by: str) -> Column:
    """Average rank among the values that are there, as a share of them."""
    w = Window.partitionBy(*by, x.isNull())
    rank = F.rank().over(w.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / 2
    return F.when(x.isNotNull(), rank / F.count(F.lit(1)).over(w))


# Operators over the instruments of one moment.
WINDOWED |= {
    "CSZScore": lambda c, x: zscore(x, c.day()),
    "CSDemean": lambda c, x: x - F.avg(x).over(c.day()),
    "CSScale": lambda c, x: x / F.when(F.sum(F.abs(x)).over(c.day()) > 0, F.sum(F.abs(x)).over(c.day())),
    "CSPctRank": lambda c, x: percent_rank(x, c.time),
    "CSFillna": lambda c, x: F.coalesce(x, F.avg(x).over(c.day())),
    # the value of another instrument at the same moment, without a join
    "ChangeInstrument": lambda c, name, x: F.max(F.when(F.col(c.entity) == name, x)).over(c.day()),
    "Mask": lambda c, x, name: F.max(F.when(F.col(c.entity) == name, x)).over(c.day()),
    "RelationDemean": lambda c, x: F.when(F.col(c.group).isNotNull(), x - F.avg(x).over(Window.partitionBy(c.time, c.group))).otherwise(F.when(x.isNotNull(), 0.0)),
    "RelationRank": lambda c, x: F.when(F.col(c.group).isNotNull(), percent_rank(x, c.time, c.group)).otherwise(hashed_uniform(c.entity, c.order, F.lit(c.seed))),
}


@windowed("CSRank")
def _csrank(c: Context, x: Column) -> Column:
    """Place from 0 as a share of the values, equal ones by instrument."""
    w = Window.partitionBy(c.time, x.isNull())
    return F.when(x.isNotNull(), (F.row_number().over(w.orderBy(x, c.entity)) - 1) / F.count(F.lit(1)).over(w))


def zscore(x: Column, w: WindowSpec, least: float = 1e-8) -> Column:
    """By the population's deviation, which counts as 1 below ``least``; missing values become 0."""
    sd = F.stddev_pop(x).over(w)
    return F.coalesce((x - F.avg(x).over(w)) / F.when(sd < least, 1.0).otherwise(sd), F.lit(0.0))


#: Thresholds of protected arithmetic.
NEAR_ZERO, LARGE_EXPONENT = 0.001, 100.0
_safe = lambda x, y, otherwise: F.when(F.abs(x) > NEAR_ZERO, y).otherwise(otherwise)

#: Row-wise functions of symbolic regression; ``p`` marks those that are defined everywhere.
SYMBOLIC: dict[str, Callable[..., Column]] = {
    "padd": lambda a, b: a + b,
    "psub": lambda a, b: a - b,
    "pmul": lambda a, b: a * b,
    "pdiv": lambda a, b: _safe(b, a / F.when(F.abs(b) > NEAR_ZERO, b), 1.0),
    "psqrt": lambda x: F.sqrt(F.abs(x)),
    "plog": lambda x: _safe(x, F.ln(F.when(F.abs(x) > NEAR_ZERO, F.abs(x))), 0.0),
    "pneg": lambda x: -x,
    "pinv": lambda x: _safe(x, 1 / F.when(F.abs(x) > NEAR_ZERO, x), 0.0),
    "pabs": lambda x: F.abs(x),
    "pmax": lambda a, b: both(a, b, F.greatest(a, b)),
    "pmin": lambda a, b: both(a, b, F.least(a, b)),
    "psin": lambda x: F.sin(x),
    "pcos": lambda x: F.cos(x),
    "ptan": lambda x: F.tan(x),
    "psig": lambda x: 1 / (1 + F.exp(-x)),
    "pexp": lambda x: F.when(x < LARGE_EXPONENT, F.exp(F.least(x, F.lit(LARGE_EXPONENT)))).otherwise(0.0),
    "n2": lambda x: x * x,
    "n3": lambda x: x * x * x,
    "n4": lambda x: x * x * x * x,
    "tanh": lambda x: F.tanh(x),
    "expneg": lambda x: F.exp(-x),
    "logabs": lambda x: F.when(x != 0, F.ln(F.abs(x))),
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)),
    "harmonic": lambda x: F.when(x > 0, F.ln(x) + 0.577215664901532860606512 + 1 / (2 * F.when(x > 0, x))),
}
for _name, _f in SYMBOLIC.items():
    SCALAR[_name] = (lambda f: lambda c, *args: f(*args))(_f)
SCALAR["StateChecker"] = lambda c, x, t, a, b: F.when(x < t, a).otherwise(b)
