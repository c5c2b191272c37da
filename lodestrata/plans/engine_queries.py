"""Named queries over the engine's operators, each with an independent SQL equivalent where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.dsl.tree import fields, parse
from lodestrata.functions import catalogs
from lodestrata.functions.registry import Context
from lodestrata.operators import metrics as M
from lodestrata.operators import exchange as X
from lodestrata.operators import portfolio as B
from lodestrata.plans.compiler import evaluate
from lodestrata.plans.formula_sql import formulas_sql
from lodestrata.sources import panel as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_FIELDS = ", ".join(f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}" for c in S.PRICES)
PANEL_SQL = f"""
WITH valid AS (
  SELECT instrument, cal_idx, {_FIELDS}
  FROM bars_day WHERE instrument IS NOT NULL AND cal_idx IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY instrument, cal_idx ORDER BY ingested_at DESC, row_id DESC) = 1),
span AS (SELECT instrument, min(cal_idx) AS a, max(cal_idx) AS b FROM valid GROUP BY 1),
panel AS (
  SELECT s.instrument, c.cal_idx, c.datetime, {", ".join(S.PRICES)}, close * factor AS adjclose
  FROM span s JOIN trade_calendar c ON c.cal_idx BETWEEN s.a AND s.b
  LEFT JOIN valid v ON v.instrument = s.instrument AND v.cal_idx = c.cal_idx)"""


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return S.market_panel(spark, sf)


def market(spark: SparkSession, sf: str, formulas: dict[str, str], context: Context = Context(), **how) -> DataFrame:
    """Formulas over the market panel, of which only their fields are read."""
    wanted = set().union(*(fields(parse(t)) for t in formulas.values()))
    return evaluate(S.market_panel(spark, sf, wanted=wanted), formulas, context, **how)


def _r(c: str) -> Column:
    """To 6 places; short of a half, so that means of prices, which often end in one, round alike in any engine."""
    return (F.floor(F.col(c) * 1e6 + 0.4999) / 1e6).alias(c)


def same_rounding(sql: str) -> str:
    """``round(x, 6)`` of the SQL as ``_r`` does it."""
    while (start := sql.find("round(")) >= 0:
        level, end = 0, start + 5
        while True:
            level += {"(": 1, ")": -1}.get(sql[end], 0)
            if level == 0:
                break
            end += 1
        inner = sql[start + 6 : end]
        if not inner.endswith(", 6"):
            raise ValueError(f"round to 6 places: {inner}")
        sql = f"{sql[:start]}floor(({inner[:-3]}) * 1e6 + 0.4999) / 1e6{sql[end + 1:]}"
    return sql


def windows(sql: str, partition: str = "instrument", order: str = "cal_idx") -> str:
    """WINDOW clause of the names wN (last N rows, 0: all so far) that the text uses."""
    used = sorted({int(n) for n in re.findall(r"\bw(\d+)\b", sql)})
    frame = lambda n: "UNBOUNDED PRECEDING" if n == 0 else f"{n - 1} PRECEDING"
    parts = [f"w{n} AS (PARTITION BY {partition} ORDER BY {order} ROWS BETWEEN {frame(n)} AND CURRENT ROW)" for n in used]
    if re.search(r"\bw\b(?!\d)", sql):
        parts.append(f"w AS (PARTITION BY {partition} ORDER BY {order})")
    return "WINDOW " + ", ".join(parts) if parts else ""


def formula_query(name: str, formula: str, sql: str, before: dict[str, str] | None = None, context: Context = Context()) -> None:
    """A query of one formula; ``before``: columns that an inner SELECT gives."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return market(spark, sf, {"value": formula}, context).select("instrument", "cal_idx", _r("value"))

    QUERIES[name] = run
    source = "panel"
    if before:
        inner = ", ".join(f"{e} AS {k}" for k, e in before.items())
        source = f"(SELECT *, {inner} FROM panel {windows(inner)})"
    ORACLE[name] = same_rounding(f"{PANEL_SQL}\nSELECT instrument, cal_idx, round({sql}, 6) + 0.0 AS value FROM {source} t {windows(sql)}")


_C = "close"
#: Operator queries: name, formula, SQL.
for _name, _formula, _sql in [
    ("el_abs", "Abs($change)", "abs(change)"),
    ("el_sign", "Sign($change)", "sign(change)"),
    ("el_log", "Log($volume)", "CASE WHEN volume > 0 THEN ln(volume) END"),
    ("el_power", "Power(Abs($change), 2)", "pow(abs(change), 2)"),
    ("el_add_sub_mul", "($close + $open) * ($high - $low)", "(close + open) * (high - low)"),
    ("el_div", "$close / ($volume - $volume)", "close / nullif(volume - volume, 0)"),
    ("el_greater", "Greater($open, $close)", "CASE WHEN open IS NOT NULL AND close IS NOT NULL THEN greatest(open, close) END"),
    ("el_less", "Less($open, $close)", "CASE WHEN open IS NOT NULL AND close IS NOT NULL THEN least(open, close) END"),
    ("el_compare", "($close > $open) + ($close >= $open) * 2 + ($close != $open) * 4", "CASE WHEN close > open THEN 1.0 ELSE 0 END + CASE WHEN close >= open THEN 2.0 ELSE 0 END + CASE WHEN close <> open OR close IS NULL OR open IS NULL THEN 4.0 ELSE 0 END"),
    ("el_if", "If($close > $open, $high, $low)", "CASE WHEN coalesce(close > open, false) THEN high ELSE low END"),
    ("el_logic", "($close > $open) & ~($volume > 0) | ($change < 0)", "CASE WHEN (coalesce(close > open, false) AND NOT coalesce(volume > 0, false)) OR coalesce(change < 0, false) THEN 1.0 ELSE 0.0 END"),
    ("el_slog1p", "SLog1p($change)", "sign(change) * ln(1 + abs(change))"),
    ("el_isnull", "IsNull($close)", "CASE WHEN close IS NULL THEN 1.0 ELSE 0.0 END"),
    ("ts_ref", "Ref($close, 5)", "lag(close, 5) OVER w"),
    ("ts_ref_future", "Ref($close, -2)", "lead(close, 2) OVER w"),
    ("ts_ref_zero", "Ref($close, 0)", "first_value(close) OVER w0"),
    ("ts_delta", "Delta($close, 5)", "close - lag(close, 5) OVER w"),
    ("ts_mean", "Mean($close, 10)", "avg(close) OVER w10"),
    ("ts_mean_expanding", "Mean($close, 0)", "avg(close) OVER w0"),
    ("ts_sum", "Sum($close, 12)", "sum(close) OVER w12"),
    ("ts_std", "Std($change, 12)", "stddev_samp(change) OVER w12"),
    ("ts_var", "Var($change, 5)", "var_samp(change) OVER w5"),
    ("ts_max", "Max($high, 20)", "max(high) OVER w20"),
    ("ts_min", "Min($low, 20)", "min(low) OVER w20"),
    ("ts_count", "Count($close, 10)", "count(close) OVER w10"),
    ("ts_quantile", "Quantile($close, 10, 0.8)", "quantile_cont(close, 0.8) OVER w10"),
    ("ts_med", "Med($close, 12)", "median(close) OVER w12"),
    ("ts_skew", "Skew($change, 20)", "CASE WHEN count(change) OVER w20 >= 3 AND max(change) OVER w20 > min(change) OVER w20 THEN skewness(change) OVER w20 END"),
    ("ts_kurt", "Kurt($change, 20)", "CASE WHEN count(change) OVER w20 >= 4 AND max(change) OVER w20 > min(change) OVER w20 THEN kurtosis(change) OVER w20 END"),
    ("ts_slope", "Slope($close, 12)", "CASE WHEN count(close) OVER w12 >= 2 THEN regr_slope(close, cal_idx) OVER w12 END"),
    ("ts_resi", "Resi($close, 12)", "CASE WHEN count(close) OVER w12 >= 2 THEN close - (avg(close) OVER w12 + regr_slope(close, cal_idx) OVER w12 * (cal_idx - avg(CASE WHEN close IS NOT NULL THEN cal_idx END) OVER w12)) END"),
    ("ts_rsquare", "Rsquare($close, 12)", "CASE WHEN count(close) OVER w12 >= 2 AND stddev_samp(close) OVER w12 > 2e-5 THEN regr_r2(close, cal_idx) OVER w12 END"),
    ("ts_corr", "Corr($close, $volume, 10)", "CASE WHEN stddev_samp(close) OVER w10 > 2e-5 AND stddev_samp(volume) OVER w10 > 2e-5 THEN covar_samp(close, volume) OVER w10 / nullif(stddev_samp(CASE WHEN volume IS NOT NULL THEN close END) OVER w10 * stddev_samp(CASE WHEN close IS NOT NULL THEN volume END) OVER w10, 0) END"),
    ("ts_cov", "Cov($change, $close, 10)", "covar_samp(change, close) OVER w10"),
    ("ts_mad", "Mad($close, 10)", "list_avg(list_transform(list_filter(list(close) OVER w10, lambda v: v IS NOT NULL), lambda v: abs(v - list_avg(list_filter(list(close) OVER w10, lambda u: u IS NOT NULL)))))"),
    ("ts_rank", "Rank($close, 10)", "CASE WHEN close IS NOT NULL THEN (len(list_filter(list(close) OVER w10, lambda v: v < close)) + (len(list_filter(list(close) OVER w10, lambda v: v = close)) + 1) / 2.0) / count(close) OVER w10 END"),
    ("ts_idxmax", "IdxMax($high, 10)", "CASE WHEN count(high) OVER w10 > 0 THEN CASE WHEN count(high) OVER w10 < count(*) OVER w10 THEN list_position(list_transform(list(high) OVER w10, lambda v: v IS NULL), true) ELSE list_position(list(high) OVER w10, max(high) OVER w10) END END"),
    ("ts_idxmin", "IdxMin($low, 10)", "CASE WHEN count(low) OVER w10 > 0 THEN CASE WHEN count(low) OVER w10 < count(*) OVER w10 THEN list_position(list_transform(list(low) OVER w10, lambda v: v IS NULL), true) ELSE list_position(list(low) OVER w10, min(low) OVER w10) END END"),
    ("ts_wma", "WMA($close, 12)", "CASE WHEN count(close) OVER w12 > 0 THEN list_sum(list_transform(list(close) OVER w12, lambda v, i: coalesce(v, 0) * i)) / (count(*) OVER w12 * (count(*) OVER w12 + 1) / 2.0) / count(close) OVER w12 END"),
    ("ts_ema", "EMA($close, 5)", "list_reduce(list_prepend({'n': 0.0::DOUBLE, 'd': 0.0::DOUBLE}, list_transform(list(close) OVER w0, lambda v: {'n': coalesce(v, 0.0), 'd': CASE WHEN v IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END})), lambda s, e: {'n': s.n * (1 - 2.0 / 6) + e.n, 'd': s.d * (1 - 2.0 / 6) + e.d}).n / nullif(list_reduce(list_prepend({'n': 0.0::DOUBLE, 'd': 0.0::DOUBLE}, list_transform(list(close) OVER w0, lambda v: {'n': coalesce(v, 0.0), 'd': CASE WHEN v IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END})), lambda s, e: {'n': s.n * (1 - 2.0 / 6) + e.n, 'd': s.d * (1 - 2.0 / 6) + e.d}).d, 0)"),
    ("ts_ffill", "FFillNan($close)", "last_value(close IGNORE NULLS) OVER w0"),
    ("ts_bfill", "BFillNan($close)", "first_value(close IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY cal_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"),
]:
    formula_query(_name, _formula, _sql)

_full = lambda n, e, c=_C: f"CASE WHEN count({c}) OVER w{n} = {n} THEN {e} END"
_LIST = "list(close) OVER w10"
for _name, _formula, _sql in [
    ("strict_mean", "Mean($close, 10)", _full(10, "avg(close) OVER w10")),
    ("strict_std", "Std($close, 10)", _full(10, "stddev_samp(close) OVER w10")),
    ("strict_skew", "Skew($change, 10)", f"CASE WHEN count(change) OVER w10 = 10 AND max(change) OVER w10 > min(change) OVER w10 THEN skewness(change) OVER w10 * 8 / sqrt(90.0) END"),
    ("strict_kurt", "Kurt($change, 10)", "CASE WHEN count(change) OVER w10 = 10 AND max(change) OVER w10 > min(change) OVER w10 THEN (kurtosis_pop(change) OVER w10 + 3) * 0.81 - 3 END"),
    ("strict_med", "Med($close, 10)", _full(10, "list_extract(list_sort(list(close) OVER w10), 5)")),
    ("strict_mad", "Mad($close, 10)", _full(10, f"list_avg(list_transform({_LIST}, lambda v: abs(v - list_avg({_LIST}))))")),
    ("strict_rank", "Rank($close, 10)", _full(10, f"(len(list_filter({_LIST}, lambda v: v >= close)) + len(list_filter({_LIST}, lambda v: v > close)) + 1) / 20.0")),
    ("strict_wma", "WMA($close, 10)", _full(10, f"list_sum(list_transform({_LIST}, lambda v, i: v * (i - 1))) / 45.0")),
    ("strict_ema", "EMA($close, 10)", _full(10, f"list_sum(list_transform({_LIST}, lambda v, i: v * pow(1 - 2.0 / 11, 11 - i))) / list_sum(list_transform({_LIST}, lambda v, i: pow(1 - 2.0 / 11, 11 - i)))")),
    ("strict_corr", "Corr($close, $open, 10)", "CASE WHEN count(CASE WHEN open IS NOT NULL THEN close END) OVER w10 = 10 THEN CASE WHEN var_samp(close) OVER w10 * 9 < 1e-6 OR var_samp(open) OVER w10 * 9 < 1e-6 THEN covar_samp(close, open) OVER w10 * 9 ELSE covar_samp(close, open) OVER w10 / (stddev_samp(close) OVER w10 * stddev_samp(open) OVER w10) END END"),
    ("strict_cov", "Cov($close, $change, 10)", "CASE WHEN count(CASE WHEN change IS NOT NULL THEN close END) OVER w10 = 10 THEN covar_samp(close, change) OVER w10 END"),
    ("strict_ir", "IR($close, 10)", _full(10, "avg(close) OVER w10 / nullif(stddev_samp(close) OVER w10, 0)")),
    ("strict_minmaxdiff", "MinMaxDiff($close, 10)", _full(10, "max(close) OVER w10 - min(close) OVER w10")),
    ("strict_maxdiff", "MaxDiff($close, 10)", _full(10, "close - max(close) OVER w10")),
    ("strict_pctchange", "PctChange($close, 5)", "close / nullif(lag(close, 5) OVER w, 0) - 1"),
]:
    formula_query(_name, _formula, _sql, context=Context(strict=True))

formula_query("nest_mean_gt", "Mean($close > Ref($close, 1), 10)", "avg(CASE WHEN up THEN 1.0 ELSE 0.0 END) OVER w10", {"up": "coalesce(close > lag(close, 1) OVER w, false)"})
formula_query("nest_std_div", "Sub(Std(Div($high, $low), 12), Mean($close, 5))", "stddev_samp(q) OVER w12 - avg(close) OVER w5", {"q": "high / nullif(low, 0)"})
formula_query("nest_slope_log", "Mean(Slope(Log($volume), 12), 5)", "avg(s) OVER w5", {"s": "CASE WHEN count(CASE WHEN volume > 0 THEN volume END) OVER w12 >= 2 THEN regr_slope(CASE WHEN volume > 0 THEN ln(volume) END, cal_idx) OVER w12 END"})
formula_query("nest_volume_weighted", "Std(Abs($close/Ref($close,1)-1)*$volume,10)/(Mean(Abs($close/Ref($close,1)-1)*$volume,10)+1e-12)", "CASE WHEN count(x) OVER w10 >= 2 THEN stddev_samp(x) OVER w10 END / nullif(avg(x) OVER w10 + 1e-12, 0)", {"x": "abs(close / nullif(lag(close) OVER w, 0) - 1) * volume"})
_SYM = {
    "pdiv": ("pdiv($change, $close - $open)", "CASE WHEN abs(close - open) > 0.001 THEN change / (close - open) ELSE 1.0 END"),
    "psqrt": ("psqrt($change)", "sqrt(abs(change))"),
    "plog": ("plog($change)", "CASE WHEN abs(change) > 0.001 THEN ln(abs(change)) ELSE 0.0 END"),
    "pinv": ("pinv($change)", "CASE WHEN abs(change) > 0.001 THEN 1 / change ELSE 0.0 END"),
    "psig": ("psig($change)", "1 / (1 + exp(-change))"),
    "ptrig": ("psin($change) + pcos($change) + ptan($change)", "sin(change) + cos(change) + tan(change)"),
    "polynomial": ("n2($change) + n3($change) + n4($change)", "change * change + change * change * change + change * change * change * change"),
    "decision": ("StateChecker($change, 0, $high, $low)", "CASE WHEN change < 0 THEN high ELSE low END"),
}
for _name, (_formula, _sql) in _SYM.items():
    formula_query("sym_" + _name, _formula, _sql)

formula_query("cs_rank", "CSRank($close)", "CASE WHEN close IS NOT NULL THEN (row_number() OVER (PARTITION BY datetime, close IS NULL ORDER BY close, instrument) - 1) / (count(close) OVER (PARTITION BY datetime))::DOUBLE END")
formula_query("cs_pct_rank", "CSPctRank($volume)", "CASE WHEN volume IS NOT NULL THEN (rank() OVER (PARTITION BY datetime, volume IS NULL ORDER BY volume) + (count(*) OVER (PARTITION BY datetime, volume) - 1) / 2.0) / count(volume) OVER (PARTITION BY datetime) END")
formula_query("cs_zscore", "CSZScore($change)", "coalesce((change - avg(change) OVER (PARTITION BY datetime)) / CASE WHEN stddev_pop(change) OVER (PARTITION BY datetime) < 1e-8 THEN 1.0 ELSE stddev_pop(change) OVER (PARTITION BY datetime) END, 0.0)")
formula_query("cs_demean", "CSDemean($close)", "close - avg(close) OVER (PARTITION BY datetime)")
formula_query("cs_fillna", "CSFillna($close)", "coalesce(close, avg(close) OVER (PARTITION BY datetime))")


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = same_rounding(sql)
        return f

    return keep


_REL = "(SELECT p.*, r.industry FROM panel p LEFT JOIN (SELECT instrument, min(industry) AS industry FROM relation GROUP BY 1) r USING (instrument))"


@query("relation_rank", f"{PANEL_SQL}\nSELECT instrument, cal_idx, round(CASE WHEN close IS NOT NULL THEN (rank() OVER (PARTITION BY datetime, industry, close IS NULL ORDER BY close) + (count(*) OVER (PARTITION BY datetime, industry, close) - 1) / 2.0) / count(close) OVER (PARTITION BY datetime, industry) END, 6) AS value FROM {_REL} t WHERE industry IS NOT NULL")
def relation_rank(spark: SparkSession, sf: str) -> DataFrame:
    p = S.with_industry(panel(spark, sf), spark.read.parquet(f"{sf}/relation.parquet"))
    return evaluate(p, {"value": "RelationRank($close)"}, keep=("industry",)).filter("industry is not null").select("instrument", "cal_idx", _r("value"))


#: ``registry.hashed_uniform`` in SQL, of a text.
_HASHED = "((('0x' || substr(md5({text}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


@query("relation_rank_unmapped", f"{PANEL_SQL}\nSELECT instrument, cal_idx, round({_HASHED.format(text="concat_ws('|', instrument, cal_idx, 7)")}, 6) AS value FROM {_REL} t WHERE industry IS NULL")
def relation_rank_unmapped(spark: SparkSession, sf: str) -> DataFrame:
    """Names without an industry get a rank by lot, the same in every run."""
    p = S.with_industry(panel(spark, sf), spark.read.parquet(f"{sf}/relation.parquet"))
    return evaluate(p, {"value": "RelationRank($close)"}, keep=("industry",)).filter("industry is null").select("instrument", "cal_idx", _r("value"))


def _ema_sql(x: str, alpha: str) -> str:
    """Of all known values so far, by their distance, which a list keeps."""
    known = f"list({{'v': {x}, 't': cal_idx}}) FILTER ({x} IS NOT NULL) OVER w0"
    latest = f"max(CASE WHEN {x} IS NOT NULL THEN cal_idx END) OVER w0"
    part = lambda v: f"list_sum(list_transform({known}, lambda e: {v} * pow(1 - {alpha}, ({latest} - e.t)::DOUBLE)))"
    return f"{part('e.v')} / {part('1.0')}"


@query("ts_ema_gap", f"{PANEL_SQL}, gaps AS (SELECT instrument, cal_idx, CASE WHEN cal_idx % 97 = 5 THEN close END AS x FROM panel), v AS (SELECT instrument, cal_idx, {_ema_sql('x', '2.0 / 3')} AS narrow, {_ema_sql('x', '2.0 / 31')} AS wide FROM gaps WINDOW w0 AS (PARTITION BY instrument ORDER BY cal_idx))\nSELECT instrument, cal_idx, round(narrow, 6) + 0.0 AS narrow, round(wide, 6) + 0.0 AS wide FROM v")
def ts_ema_gap(spark: SparkSession, sf: str) -> DataFrame:
    """A value every 97 days, carried on through the gaps."""
    p = panel(spark, sf).withColumn("gap", F.col("cal_idx") % 97)
    sparse = "Div($close, Eq($gap, 5))"
    return _rounded(evaluate(p, {"narrow": f"EMA({sparse}, 2)", "wide": f"EMA({sparse}, 30)"}).select("instrument", "cal_idx", "narrow", "wide"))


@query("relation_demean", f"{PANEL_SQL}\nSELECT instrument, cal_idx, round(CASE WHEN industry IS NULL THEN CASE WHEN close IS NOT NULL THEN 0.0 END ELSE close - avg(close) OVER (PARTITION BY datetime, industry) END, 6) + 0.0 AS value FROM {_REL} t")
def relation_demean(spark: SparkSession, sf: str) -> DataFrame:
    p = S.with_industry(panel(spark, sf), spark.read.parquet(f"{sf}/relation.parquet"))
    return evaluate(p, {"value": "RelationDemean($close)"}).select("instrument", "cal_idx", _r("value"))


@query("change_instrument", f"{PANEL_SQL}\nSELECT instrument, cal_idx, round(close / nullif((SELECT q.close FROM panel q WHERE q.cal_idx = p.cal_idx AND q.instrument = (SELECT min(instrument) FROM bars_day)), 0), 6) + 0.0 AS value FROM panel p")
def change_instrument(spark: SparkSession, sf: str) -> DataFrame:
    first = spark.read.parquet(f"{sf}/bars_day.parquet").agg(F.min("instrument")).first()[0]
    return market(spark, sf, {"value": f"$close / ChangeInstrument('{first}', $close)"}).select("instrument", "cal_idx", _r("value"))


@query("calendar_densify", f"{PANEL_SQL}\nSELECT instrument, cal_idx, datetime, close FROM panel")
def calendar_densify(spark: SparkSession, sf: str) -> DataFrame:
    return panel(spark, sf).select("instrument", "cal_idx", "datetime", "close")


@query("calendar_resample_week", "SELECT min(datetime) AS datetime FROM trade_calendar GROUP BY date_trunc('week', datetime)")
def calendar_week(spark: SparkSession, sf: str) -> DataFrame:
    return S.calendar_resample(spark.read.parquet(f"{sf}/trade_calendar.parquet"), "week")


@query("calendar_resample_month", "SELECT min(datetime) AS datetime FROM trade_calendar GROUP BY date_trunc('month', datetime)")
def calendar_month(spark: SparkSession, sf: str) -> DataFrame:
    return S.calendar_resample(spark.read.parquet(f"{sf}/trade_calendar.parquet"), "month")


@query("calendar_shift", "SELECT c.datetime, d.datetime AS shifted FROM trade_calendar c JOIN trade_calendar d ON d.cal_idx = least(c.cal_idx + 5, (SELECT max(cal_idx) FROM trade_calendar))")
def calendar_shift(spark: SparkSession, sf: str) -> DataFrame:
    return S.calendar_shift(spark.read.parquet(f"{sf}/trade_calendar.parquet"), 5)


_CLIP = "SELECT instrument, greatest(start_dt, TIMESTAMP '2024-03-01') AS start_dt, least(coalesce(end_dt, TIMESTAMP '2024-12-31'), TIMESTAMP '2024-12-31') AS end_dt FROM universe WHERE market = 'x800'"


@query("universe_spans", f"SELECT * FROM ({_CLIP}) WHERE start_dt <= end_dt")
def universe_spans(spark: SparkSession, sf: str) -> DataFrame:
    return S.clipped_spans(spark.read.parquet(f"{sf}/universe.parquet"), "x800", "2024-03-01", "2024-12-31")


@query("span_semijoin", f"{PANEL_SQL}\nSELECT instrument, cal_idx, close FROM panel p WHERE EXISTS (SELECT 1 FROM universe u WHERE u.market = 'x800' AND u.instrument = p.instrument AND p.datetime >= u.start_dt AND (u.end_dt IS NULL OR p.datetime <= u.end_dt))")
def span_semijoin(spark: SparkSession, sf: str) -> DataFrame:
    return S.in_universe(panel(spark, sf), spark.read.parquet(f"{sf}/universe.parquet"), "x800").select("instrument", "cal_idx", "close")


@query("islands", f"{PANEL_SQL}, k AS (SELECT instrument, cal_idx, datetime, cal_idx - row_number() OVER (PARTITION BY instrument ORDER BY cal_idx) AS i FROM panel WHERE volume > 0)\nSELECT instrument, min(datetime) AS start_dt, max(datetime) AS end_dt FROM k GROUP BY instrument, i")
def islands(spark: SparkSession, sf: str) -> DataFrame:
    return S.spans_of(panel(spark, sf), F.col("volume") > 0)


@query("filter_name", f"{PANEL_SQL}\nSELECT instrument, cal_idx, close FROM panel WHERE regexp_matches(instrument, '^(?:XA|XB0)')")
def filter_name(spark: SparkSession, sf: str) -> DataFrame:
    return S.named(panel(spark, sf), "XA|XB0").select("instrument", "cal_idx", "close")


@query("filter_expression", f"{PANEL_SQL}\nSELECT instrument, cal_idx FROM (SELECT *, avg(close) OVER w20 AS m FROM panel WINDOW w20 AS (PARTITION BY instrument ORDER BY cal_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE close > m")
def filter_expression(spark: SparkSession, sf: str) -> DataFrame:
    return market(spark, sf, {"keep": "$close > Mean($close, 20)"}).filter("keep = 1").select("instrument", "cal_idx")


@query("range_pushdown", f"{PANEL_SQL}\nSELECT instrument, cal_idx, round(value, 6) + 0.0 AS value FROM (SELECT instrument, cal_idx, avg(close) OVER (PARTITION BY instrument ORDER BY cal_idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS value FROM panel) WHERE cal_idx BETWEEN 100 AND 200")
def range_pushdown(spark: SparkSession, sf: str) -> DataFrame:
    return market(spark, sf, {"value": "Mean($close, 10)"}, start=100, end=200).select("instrument", "cal_idx", _r("value"))


# Announcements: orders stand for them, a quarter for the period, and prices are what is announced.
_PIT = "SELECT o_custkey AS instrument, (year(o_orderdate) * 100 + quarter(o_orderdate))::INT AS period, o_orderdate AS announced, max(o_totalprice) AS value FROM orders GROUP BY 1, 2, 3"


def announcements(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.groupBy(F.col("o_custkey").alias("instrument"), (F.year("o_orderdate") * 100 + F.quarter("o_orderdate")).alias("period"), F.col("o_orderdate").alias("announced")).agg(F.max("o_totalprice").alias("value"))


@query("pit_asof", f"WITH pit AS ({_PIT}), m AS (SELECT DISTINCT instrument, date_trunc('month', announced) + INTERVAL 1 MONTH AS datetime FROM pit)\nSELECT m.instrument, CAST(m.datetime AS TIMESTAMP) AS datetime, p.period, p.value FROM m LEFT JOIN LATERAL (SELECT period, value FROM pit WHERE pit.instrument = m.instrument AND pit.announced <= m.datetime ORDER BY period DESC, announced DESC LIMIT 1) p ON true")
def pit_asof(spark: SparkSession, sf: str) -> DataFrame:
    pit = announcements(spark, sf)
    moments = pit.select("instrument", F.add_months(F.date_trunc("month", "announced"), 1).cast("timestamp").alias("datetime")).distinct()
    return S.known_at(pit, moments)


@query("asof_backward", f"{PANEL_SQL}, last AS (SELECT instrument, datetime, last_value(close IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY cal_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close FROM panel)\nSELECT instrument, datetime, close FROM last")
def asof_backward(spark: SparkSession, sf: str) -> DataFrame:
    p = panel(spark, sf)
    return S.as_of(p.select("instrument", "datetime"), p.select("instrument", "datetime", "close").filter("close is not null"), "instrument", "datetime", "close").select("instrument", "datetime", "close")


@query("union_dedup", "SELECT instrument, cal_idx, close FROM bars_day QUALIFY row_number() OVER (PARTITION BY instrument, cal_idx ORDER BY ingested_at DESC, row_id DESC) = 1")
def union_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/bars_day.parquet").select("instrument", "cal_idx", "close", "ingested_at", "row_id")
    return S.newest(rows, ["instrument", "cal_idx"], ["ingested_at", "row_id"]).select("instrument", "cal_idx", "close")


# Factors and their measures: momentum against the next day's return.
SCORE, LABEL = "$close / Ref($close, 5) - 1", "Ref($close, -1) / $close - 1"
FRAME_SQL = f"""{PANEL_SQL},
frame AS (
  SELECT datetime, instrument, cal_idx, close / nullif(lag(close, 5) OVER w, 0) - 1 AS score, lead(close, 1) OVER w / nullif(close, 0) - 1 AS label
  FROM panel WINDOW w AS (PARTITION BY instrument ORDER BY cal_idx))"""
_CORR = "CASE WHEN count(CASE WHEN {y} IS NOT NULL THEN {x} END) >= 2 THEN covar_samp({x}, {y}) / nullif(stddev_samp(CASE WHEN {y} IS NOT NULL THEN {x} END) * stddev_samp(CASE WHEN {x} IS NOT NULL THEN {y} END), 0) END"
_IC_SQL = f"{FRAME_SQL}, ic AS (SELECT datetime, {_CORR.format(x='score', y='label')} AS ic FROM frame GROUP BY datetime)"
_PAIRS_SQL = f"""{FRAME_SQL}, pairs AS (
  SELECT datetime, instrument, rank() OVER (PARTITION BY datetime ORDER BY score) + (count(*) OVER (PARTITION BY datetime, score) - 1) / 2.0 AS score,
         rank() OVER (PARTITION BY datetime ORDER BY label) + (count(*) OVER (PARTITION BY datetime, label) - 1) / 2.0 AS label
  FROM frame WHERE score IS NOT NULL AND label IS NOT NULL)"""


def frame(spark: SparkSession, sf: str) -> DataFrame:
    return market(spark, sf, {"score": SCORE, "label": LABEL})


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[_r(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("ic_daily", f"{_IC_SQL}\nSELECT datetime, round(ic, 6) + 0.0 AS ic FROM ic")
def ic_daily(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(M.daily_ic(frame(spark, sf)).drop("n"))


@query("rank_ic_daily", f"{_PAIRS_SQL}\nSELECT datetime, round({_CORR.format(x='score', y='label')}, 6) + 0.0 AS ic FROM pairs GROUP BY datetime")
def rank_ic_daily(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(M.daily_rank_ic(frame(spark, sf)).drop("n"))


@query("icir", f"{_IC_SQL}\nSELECT round(avg(ic), 6) + 0.0 AS mean, round(avg(ic) / stddev_samp(ic), 6) + 0.0 AS icir, round(avg(ic) / stddev_samp(ic) * sqrt(252), 6) + 0.0 AS icir_ann, count(ic) AS n_obs FROM ic")
def icir(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(M.ic_summary(M.daily_ic(frame(spark, sf))))


@query("ic_tstat", f"{_IC_SQL}\nSELECT round(abs(avg(ic)) / (stddev_samp(ic) / sqrt(count(ic))), 6) AS tstat FROM ic")
def ic_tstat(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(M.ic_tstat(M.daily_ic(frame(spark, sf))))


@query("ic_mean", f"{_IC_SQL}\nSELECT round(CASE WHEN avg(CASE WHEN ic IS NULL THEN 1.0 ELSE 0.0 END) > 0.5 THEN 0.0 ELSE avg(ic) END, 6) + 0.0 AS ic FROM ic")
def ic_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(M.ic_or_zero(M.daily_ic(frame(spark, sf))))


@query("monthly_ic", f"{_IC_SQL}\nSELECT year(datetime)::INT AS year, month(datetime)::INT AS month, round(avg(ic), 6) + 0.0 AS ic FROM ic GROUP BY 1, 2")
def monthly_ic(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(M.monthly(M.daily_ic(frame(spark, sf))))


_SIDES = f"{FRAME_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY datetime ORDER BY score DESC, instrument) AS hi, row_number() OVER (PARTITION BY datetime ORDER BY score, instrument) AS lo, floor(count(*) OVER (PARTITION BY datetime) * 0.2) AS k FROM frame WHERE score IS NOT NULL)"


@query("long_short_return", f"{_SIDES}\nSELECT datetime, round((avg(CASE WHEN hi <= k THEN label END) - avg(CASE WHEN lo <= k THEN label END)) / 2, 6) + 0.0 AS long_short, round(avg(label), 6) + 0.0 AS average, round(avg(CASE WHEN hi <= k AND label IS NOT NULL THEN (label > 0)::INT END), 6) AS long_precision, round(avg(CASE WHEN lo <= k AND label IS NOT NULL THEN (label < 0)::INT END), 6) AS short_precision FROM s GROUP BY datetime")
def long_short_return(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(M.long_short(frame(spark, sf)))


@query("group_return", f"{FRAME_SQL}, g AS (SELECT datetime, label, row_number() OVER (PARTITION BY datetime ORDER BY score DESC, instrument) AS p, count(*) OVER (PARTITION BY datetime) // 5 AS m FROM frame WHERE score IS NOT NULL)\nSELECT datetime, ((p - 1) // m + 1)::INT AS grp, round(avg(label), 6) + 0.0 AS ret FROM g WHERE m > 0 AND (p - 1) // m < 5 GROUP BY 1, 2")
def group_return(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(M.group_returns(frame(spark, sf)))


_LAG = "(SELECT a.*, b.{v} AS past FROM {t} a JOIN (SELECT datetime, row_number() OVER (ORDER BY datetime) AS d FROM (SELECT DISTINCT datetime FROM {t})) x USING (datetime) LEFT JOIN (SELECT instrument, {v}, d FROM {t} JOIN (SELECT datetime, row_number() OVER (ORDER BY datetime) AS d FROM (SELECT DISTINCT datetime FROM {t})) y USING (datetime)) b ON b.instrument = a.instrument AND b.d = x.d - 1)"


@query("pred_autocorr", f"{FRAME_SQL}\nSELECT datetime, round({_CORR.format(x='score', y='past')}, 6) + 0.0 AS autocorr FROM {_LAG.format(v='score', t='frame')} t GROUP BY datetime")
def pred_autocorr(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(M.autocorrelation(frame(spark, sf)))


@query("topk_turnover", f"{_SIDES}, top AS (SELECT datetime, instrument, 1 AS score FROM s WHERE hi <= k)\nSELECT datetime, round(1 - count(past) / count(*)::DOUBLE, 6) AS turnover FROM {_LAG.format(v='score', t='top')} t GROUP BY datetime")
def topk_turnover(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(M.topk_turnover(frame(spark, sf)))


@query("rre", f"{FRAME_SQL}, r AS (SELECT datetime, instrument, rank() OVER (PARTITION BY datetime ORDER BY score) + (count(*) OVER (PARTITION BY datetime, score) - 1) / 2.0 AS r FROM frame WHERE score IS NOT NULL), p AS (SELECT datetime, instrument, r / sum(r) OVER (PARTITION BY datetime) AS score FROM r)\nSELECT datetime, round(sum(score * ln((score + 1e-8) / (past + 1e-8))), 6) + 0.0 AS kl, round(1 / (1 + sum(score * ln((score + 1e-8) / (past + 1e-8)))), 6) AS rre FROM {_LAG.format(v='score', t='p')} t WHERE past IS NOT NULL GROUP BY datetime")
def rre(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(M.rank_stability(frame(spark, sf)))


@query("rre_common", f"{FRAME_SQL}, f AS (SELECT datetime, instrument, score FROM frame WHERE score IS NOT NULL), j AS (SELECT * FROM {_LAG.format(v='score', t='f')} t WHERE past IS NOT NULL), r AS (SELECT datetime, rank() OVER (PARTITION BY datetime ORDER BY score) + (count(*) OVER (PARTITION BY datetime, score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY datetime ORDER BY past) + (count(*) OVER (PARTITION BY datetime, past) - 1) / 2.0 AS b, count(*) OVER (PARTITION BY datetime) AS n FROM j), q AS (SELECT datetime, a / sum(a) OVER (PARTITION BY datetime) AS p, b / sum(b) OVER (PARTITION BY datetime) AS q FROM r WHERE n >= 2)\nSELECT datetime, round(sum(p * ln(p / q)), 6) + 0.0 AS kl, count(*) AS n_common, round(1 / (1 + sum(p * ln(p / q))), 6) AS rre FROM q GROUP BY datetime")
def rre_common(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(M.rank_stability_common(frame(spark, sf)))


_NOISE_KEY = "concat_ws('|', instrument, epoch_us(datetime), 7, '{}')"
_NOISE = f"sqrt(-2 * ln({_HASHED.format(text=_NOISE_KEY.format('u'))})) * cos(2 * pi() * {_HASHED.format(text=_NOISE_KEY.format('v'))})"


@query("pfs_noise", f"{FRAME_SQL}, n AS (SELECT datetime, score AS x, score * (1 + 0.1 * {_NOISE}) AS y FROM frame)\nSELECT datetime, round({_CORR.format(x='x', y='y')}, 6) + 0.0 AS pfs FROM n GROUP BY datetime")
def pfs_noise(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(M.noise_stability(frame(spark, sf)))


@query("validity_stats", f"{FRAME_SQL}, d AS (SELECT datetime, count(*) AS uni, count(score) AS n, min(score) AS lo, max(score) AS hi FROM frame GROUP BY datetime)\nSELECT count(*) AS n_total_days, count(CASE WHEN n >= 1 THEN 1 END) AS n_valid_days, round(avg(n / uni::DOUBLE), 6) AS mean_coverage, round(median(n / uni::DOUBLE), 6) AS median_coverage, round(quantile_cont(n / uni::DOUBLE, 0.1), 6) AS p10_coverage, round(count(CASE WHEN n >= 2 AND hi = lo THEN 1 END) / greatest(count(CASE WHEN n >= 2 THEN 1 END), 1)::DOUBLE, 6) AS const_day_ratio, count(CASE WHEN n >= 2 AND hi <> lo THEN 1 END) AS n_correlatable_days, round(sum(uni - n) / sum(uni)::DOUBLE, 6) AS nan_cell_ratio, 0.0::DOUBLE AS inf_cell_ratio FROM d")
def validity_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(M.validity(frame(spark, sf)))


@query("descriptors", f"{FRAME_SQL}, z AS (SELECT datetime, instrument, (score IS NOT NULL)::INT AS valid, coalesce((score - avg(score) OVER (PARTITION BY datetime)) / CASE WHEN stddev_pop(score) OVER (PARTITION BY datetime) < 1e-8 THEN 1.0 ELSE stddev_pop(score) OVER (PARTITION BY datetime) END, 0.0) AS z FROM frame), w AS (SELECT datetime, instrument, valid, z / CASE WHEN sum(abs(z)) OVER (PARTITION BY datetime) > 0 THEN sum(abs(z)) OVER (PARTITION BY datetime) ELSE 1.0 END AS score FROM z)\nSELECT datetime, round(1 / nullif(sum(score * score), 0) / nullif(sum(valid), 0), 6) AS breadth, round(sum(abs(score - coalesce(past, 0.0))) / 2, 6) AS turnover FROM {_LAG.format(v='score', t='w')} t GROUP BY datetime")
def descriptors(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(M.descriptors(frame(spark, sf)))


_REGIMES = f"{_IC_SQL}, mkt AS (SELECT datetime, avg(label) AS m FROM frame GROUP BY datetime), reg AS (SELECT datetime, CASE WHEN m >= 0 THEN 'up' ELSE 'down' END AS regime FROM mkt WHERE m IS NOT NULL)"


@query("regime_ic", f"{_REGIMES}\nSELECT regime, round(avg(ic), 6) + 0.0 AS ic, count(ic) AS n FROM ic JOIN reg USING (datetime) GROUP BY regime")
def regime_ic(spark: SparkSession, sf: str) -> DataFrame:
    f = frame(spark, sf)
    market = f.groupBy("datetime").agg(F.avg("label").alias("m")).filter("m is not null")
    return _rounded(M.regime_ic(f, market.select("datetime", F.when(F.col("m") >= 0, "up").otherwise("down").alias("regime"))))


@query("feature_health", f"{FRAME_SQL}\nSELECT datetime, count(DISTINCT score) AS n_values, count(*) - count(score) AS n_missing, 0::BIGINT AS n_inf, round(avg(score), 6) + 0.0 AS mean, round(stddev_samp(score), 6) AS std FROM frame GROUP BY datetime")
def feature_health(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(M.feature_health(frame(spark, sf), "score"))


@query("multi_ic", f"{PANEL_SQL}, f AS (SELECT datetime, close / nullif(lag(close, 5) OVER w, 0) - 1 AS mom, change AS chg, lead(close, 1) OVER w / nullif(close, 0) - 1 AS y1, lead(close, 5) OVER w / nullif(close, 0) - 1 AS y5 FROM panel WINDOW w AS (PARTITION BY instrument ORDER BY cal_idx))\n" + " UNION ALL ".join(f"SELECT datetime, '{x}' AS score, '{y}' AS label, round({_CORR.format(x=x, y=y)}, 6) + 0.0 AS ic FROM f GROUP BY datetime" for x in ("mom", "chg") for y in ("y1", "y5")))
def multi_ic(spark: SparkSession, sf: str) -> DataFrame:
    f = market(spark, sf, {"mom": SCORE, "chg": "$change", "y1": LABEL, "y5": "Ref($close, -5) / $close - 1"})
    return _rounded(M.many_ics(f, ["mom", "chg"], ["y1", "y5"]))


# Portfolios.
_WEIGHTS_SQL = f"""{FRAME_SQL},
q AS (SELECT datetime, instrument, score, count(*) OVER d AS n, quantile_cont(score, 0.8) OVER d AS hi, quantile_cont(score, 0.2) OVER d AS lo FROM frame WHERE score IS NOT NULL WINDOW d AS (PARTITION BY datetime)),
side AS (SELECT datetime, instrument, CASE WHEN score >= hi AND NOT score <= lo THEN 1 WHEN score <= lo AND NOT score >= hi THEN -1 END AS side FROM q WHERE n >= 2),
weights AS (SELECT datetime, instrument, 0.5 * side / count(*) OVER (PARTITION BY datetime, side) AS weight FROM side WHERE side IS NOT NULL QUALIFY max(side) OVER (PARTITION BY datetime) - min(side) OVER (PARTITION BY datetime) = 2)"""
_DAILY_SQL = f"""{_WEIGHTS_SQL},
days AS (SELECT datetime, row_number() OVER (ORDER BY datetime) AS d FROM (SELECT DISTINCT datetime FROM frame)),
h AS (SELECT w.instrument, w.weight, d.d FROM weights w JOIN days d USING (datetime)),
moves AS (SELECT coalesce(a.instrument, b.instrument) AS instrument, coalesce(a.d, b.d + 1) AS d, coalesce(a.weight, 0.0) AS w, coalesce(b.weight, 0.0) AS p FROM h a FULL JOIN h b ON a.instrument = b.instrument AND a.d = b.d + 1),
agg AS (SELECT days.datetime, sum(m.w * coalesce(f.label, 0.0)) AS gross, sum(abs(m.w - m.p)) AS l1 FROM moves m JOIN days USING (d) LEFT JOIN frame f ON f.datetime = days.datetime AND f.instrument = m.instrument GROUP BY 1),
daily AS (SELECT days.datetime, coalesce(gross, 0.0) AS gross, coalesce(l1, 0.0) AS turnover_l1, coalesce(l1, 0.0) / 2 AS turnover_oneway, coalesce(l1, 0.0) / 2 * 0.0015 AS cost, coalesce(gross, 0.0) - coalesce(l1, 0.0) / 2 * 0.0015 AS net FROM days LEFT JOIN agg USING (datetime))"""


def daily(spark: SparkSession, sf: str) -> DataFrame:
    f = frame(spark, sf)
    return B.daily_returns(B.long_short_weights(f), f.select("datetime", "instrument", F.col("label").alias("ret")))


@query("ls_weights", f"{_WEIGHTS_SQL}\nSELECT datetime, instrument, round(weight, 6) AS weight FROM weights")
def ls_weights(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(B.long_short_weights(frame(spark, sf)))


@query("topk_weights", f"{FRAME_SQL}, q AS (SELECT datetime, instrument, count(*) OVER (PARTITION BY datetime) AS n, row_number() OVER (PARTITION BY datetime ORDER BY score DESC, instrument DESC) AS hi, row_number() OVER (PARTITION BY datetime ORDER BY score, instrument) AS lo FROM frame WHERE score IS NOT NULL)\nSELECT datetime, instrument, round(CASE WHEN hi <= least(5, n // 2) THEN 0.5 ELSE -0.5 END / least(5, n // 2), 6) AS weight FROM q WHERE n >= 2 AND (hi <= least(5, n // 2) OR lo <= least(5, n // 2))")
def topk_weights(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(B.long_short_weights(frame(spark, sf), topk=5))


@query("ls_backtest", f"{_DAILY_SQL}\nSELECT datetime, round(gross, 6) + 0.0 AS gross, round(turnover_l1, 6) AS turnover_l1, round(turnover_oneway, 6) AS turnover_oneway, round(cost, 6) AS cost, round(net, 6) + 0.0 AS net FROM daily")
def ls_backtest(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(daily(spark, sf))


_WEALTH_SQL = f"{_DAILY_SQL}, c AS (SELECT *, exp(sum(ln(1 + net)) OVER w) AS compounded, sum(net) OVER w AS summed FROM daily WINDOW w AS (ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), wealth AS (SELECT *, compounded / max(compounded) OVER w - 1 AS drawdown, summed - max(summed) OVER w AS drawdown_summed FROM c WINDOW w AS (ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"


@query("drawdown", f"{_WEALTH_SQL}\nSELECT datetime, round(compounded, 6) AS compounded, round(drawdown, 6) + 0.0 AS drawdown, round(drawdown_summed, 6) + 0.0 AS drawdown_summed FROM wealth")
def drawdown(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(B.wealth(daily(spark, sf)).select("datetime", "compounded", "drawdown", "drawdown_summed"))


@query("perf_metrics", f"{_WEALTH_SQL}\nSELECT round(avg(net) * 252, 6) AS annual, round(pow(exp(sum(ln(1 + net))), 252.0 / count(net)) - 1, 6) AS cagr, round(avg(net) / stddev_samp(net) * sqrt(252), 6) AS sharpe, round(-min(drawdown), 6) AS mdd, round(avg(turnover_l1), 6) AS mean_turnover_l1, round(avg(turnover_oneway), 6) AS mean_turnover_oneway, round(sum(cost), 6) AS total_cost, round(exp(sum(ln(1 + net))) - 1, 6) AS net_return, count(net) AS n_days FROM wealth")
def perf_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(B.performance(daily(spark, sf)))


@query("risk_analysis", f"{_WEALTH_SQL}\nSELECT round(avg(net), 6) + 0.0 AS mean, round(stddev_samp(net), 6) AS std, round(avg(net) * 238, 6) AS annualized_return, round(avg(net) / stddev_samp(net) * sqrt(238), 6) AS information_ratio, round(min(drawdown_summed), 6) + 0.0 AS max_drawdown FROM wealth")
def risk_analysis(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(B.risk(daily(spark, sf)))


@query("monthly_risk", f"{_DAILY_SQL}\nSELECT year(datetime)::INT AS year, month(datetime)::INT AS month, round(avg(net), 6) + 0.0 AS mean, round(stddev_samp(net), 6) AS std, count(net) AS n FROM daily GROUP BY 1, 2 HAVING count(net) >= 3")
def monthly_risk(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(B.monthly_risk(daily(spark, sf)))


@query("benchmark_relative", f"{_DAILY_SQL}, x AS (SELECT net, bench FROM daily JOIN (SELECT datetime, avg(label) AS bench FROM frame GROUP BY 1) USING (datetime) WHERE bench IS NOT NULL)\nSELECT round(covar_pop(net, bench) / var_pop(bench), 6) AS beta, round((avg(net) - covar_pop(net, bench) / var_pop(bench) * avg(bench)) * 252, 6) AS alpha, round(avg(net - bench) * 252, 6) AS excess_annual, round(avg(net - bench) / stddev_samp(net - bench) * sqrt(252), 6) AS information_ratio FROM x")
def benchmark_relative(spark: SparkSession, sf: str) -> DataFrame:
    bench = frame(spark, sf).groupBy("datetime").agg(F.avg("label").alias("bench"))
    return _rounded(B.against_benchmark(daily(spark, sf), bench))


@query("holdings_changes", f"{_WEIGHTS_SQL}, days AS (SELECT datetime, row_number() OVER (ORDER BY datetime) AS d FROM (SELECT DISTINCT datetime FROM weights)), h AS (SELECT d, instrument FROM weights JOIN days USING (datetime))\nSELECT datetime, (SELECT count(*) FROM h a WHERE a.d = days.d AND NOT EXISTS (SELECT 1 FROM h b WHERE b.d = a.d - 1 AND b.instrument = a.instrument)) AS entries, (SELECT count(*) FROM h b WHERE b.d = days.d - 1 AND NOT EXISTS (SELECT 1 FROM h a WHERE a.d = b.d + 1 AND a.instrument = b.instrument)) AS exits FROM days")
def holdings_changes(spark: SparkSession, sf: str) -> DataFrame:
    return B.holdings_changes(B.long_short_weights(frame(spark, sf)))


@query("brinson", f"{_WEIGHTS_SQL}, bench AS (SELECT datetime, instrument, 1.0 / count(*) OVER (PARTITION BY datetime) AS weight FROM frame WHERE label IS NOT NULL), ind AS (SELECT instrument, min(industry) AS grp FROM relation GROUP BY 1), b2 AS (SELECT coalesce(p.datetime, b.datetime) AS datetime, coalesce(p.instrument, b.instrument) AS instrument, coalesce(p.weight, 0.0) AS wp, coalesce(b.weight, 0.0) AS wb FROM weights p FULL JOIN bench b ON p.datetime = b.datetime AND p.instrument = b.instrument), g AS (SELECT b2.datetime, coalesce(grp, '') AS grp, sum(wp) AS wp, sum(wb) AS wb, sum(wp * coalesce(label, 0.0)) AS cp, sum(wb * coalesce(label, 0.0)) AS cb FROM b2 LEFT JOIN frame f ON f.datetime = b2.datetime AND f.instrument = b2.instrument LEFT JOIN ind ON ind.instrument = b2.instrument GROUP BY 1, 2), x AS (SELECT *, coalesce(cp / nullif(wp, 0), 0.0) AS rp, coalesce(cb / nullif(wb, 0), 0.0) AS rb FROM g)\nSELECT datetime, round(sum((wp - wb) * rb), 6) + 0.0 AS allocation, round(sum(wb * (rp - rb)), 6) + 0.0 AS selection, round(sum((wp - wb) * (rp - rb)), 6) + 0.0 AS interaction, round(sum(cp - cb), 6) + 0.0 AS total FROM x GROUP BY datetime")
def brinson(spark: SparkSession, sf: str) -> DataFrame:
    f = frame(spark, sf)
    day = B.Window.partitionBy("datetime")
    bench = f.filter("label is not null").select("datetime", "instrument", (1 / F.count(F.lit(1)).over(day)).alias("weight"))
    groups = spark.read.parquet(f"{sf}/relation.parquet").groupBy("instrument").agg(F.min("industry").alias("grp"))
    out = B.brinson(B.long_short_weights(f), bench, groups, f.select("datetime", "instrument", F.col("label").alias("ret")))
    return _rounded(out)


@query("execution_returns", f"{PANEL_SQL}\nSELECT instrument, cal_idx, round(lead(open, 2) OVER w / nullif(lead(open, 1) OVER w, 0) - 1, 6) + 0.0 AS ret FROM panel WINDOW w AS (PARTITION BY instrument ORDER BY cal_idx)")
def execution_returns(spark: SparkSession, sf: str) -> DataFrame:
    return B.execution_returns(panel(spark, sf)).select("instrument", "cal_idx", _r("ret"))


@query("limit_masks", f"{PANEL_SQL}\nSELECT instrument, cal_idx, close IS NULL OR coalesce(change >= 0.02, false) AS limit_buy, close IS NULL OR coalesce(change <= -0.02, false) AS limit_sell FROM panel")
def limit_masks(spark: SparkSession, sf: str) -> DataFrame:
    return X.tradable(panel(spark, sf), 0.02).select("instrument", "cal_idx", "limit_buy", "limit_sell")


@query("topk_simulation")
def topk_simulation(spark: SparkSession, sf: str) -> DataFrame:
    p = market(spark, sf, {"score": SCORE, "price": "$close", "factor": "$factor", "amount": "$amount", "volume": "$volume", "close": "$close", "change": "$change"})
    p = X.tradable(p, 0.095)
    accounts = p.withColumn("account", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("score", F.when(F.col("account") == "b", -F.col("score")).otherwise(F.col("score")))
    return X.simulate_topk(accounts, terms=X.Exchange(volume_share=0.1))


_QUOTES_SQL = f"{PANEL_SQL}, q AS (SELECT instrument, datetime, cal_idx, close AS price, factor, amount, volume, close IS NULL OR coalesce(abs(change) >= 0.02, false) AS barred, lead(close) OVER w / nullif(close, 0) - 1 AS ret FROM panel WINDOW w AS (PARTITION BY instrument ORDER BY cal_idx))"


@query(
    "deal_orders",
    f"""{_QUOTES_SQL}, o AS (SELECT instrument, datetime, cal_idx, k, cal_idx * 2 + k AS order_id, k AS direction, abs(volume) * (0.04 + 0.05 * k) AS wanted FROM panel, (VALUES (0), (1)) v(k)),
j AS (SELECT o.*, price, factor, amount, volume, CASE WHEN price > 0 AND NOT barred THEN greatest(coalesce(wanted, 0.0), 0.0) ELSE 0.0 END AS ok FROM o LEFT JOIN q USING (instrument, datetime, cal_idx)),
r AS (SELECT *, greatest(0.0, least(ok, coalesce(volume, 0.0) * 0.05 - coalesce(sum(ok) OVER (PARTITION BY instrument, datetime ORDER BY order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))) AS capped FROM j),
d AS (SELECT *, CASE WHEN factor > 0 THEN floor((capped * factor + 0.1) / 100) * 100 / factor ELSE capped END AS done FROM r),
x AS (SELECT *, done * coalesce(price, 0.0) AS worth FROM d)
SELECT instrument, cal_idx, direction, round(done, 6) + 0.0 AS done, round(worth, 6) + 0.0 AS worth,
  round(CASE WHEN worth > 1e-5 THEN greatest(worth * (CASE WHEN direction = 1 THEN 0.0005 ELSE 0.0015 END + 0.1 * CASE WHEN amount > 0 THEN pow(worth / amount, 2) ELSE 1.0 END), 5.0) ELSE 0.0 END, 6) + 0.0 AS fee FROM x""",
)
def deal_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Two orders a name and day against limits, a shared volume cap, lots and fees with impact."""
    p = panel(spark, sf)
    quotes = X.tradable(p, 0.02).withColumn("price", F.col("close"))
    orders = p.select("instrument", "datetime", "cal_idx", "volume", F.explode(F.array(F.lit(0), F.lit(1))).alias("direction"))
    orders = orders.select("instrument", "datetime", "cal_idx", "direction", (F.col("cal_idx") * 2 + F.col("direction")).alias("order_id"), (F.abs("volume") * (0.04 + 0.05 * F.col("direction"))).alias("wanted"))
    done = X.deal(orders, quotes, X.Exchange(impact=0.1, volume_share=0.05))
    return done.select("instrument", "cal_idx", "direction", *[_r(c) for c in ("done", "worth", "fee")])


@query(
    "long_short_tradable",
    f"""{_QUOTES_SQL}, s AS (SELECT datetime, instrument, close / nullif(lag(close, 5) OVER w, 0) - 1 AS score FROM panel WINDOW w AS (PARTITION BY instrument ORDER BY cal_idx)),
r AS (SELECT datetime, instrument, row_number() OVER (PARTITION BY datetime ORDER BY score DESC, instrument) AS hi, row_number() OVER (PARTITION BY datetime ORDER BY score, instrument DESC) AS lo FROM s WHERE score IS NOT NULL),
j AS (SELECT r.*, price > 0 AS quoted, coalesce(price > 0, false) AND NOT coalesce(barred, false) AS free, coalesce(ret, 0.0) AS gain FROM r LEFT JOIN q USING (datetime, instrument)),
g AS (SELECT datetime, avg(CASE WHEN hi <= 5 AND free THEN gain END) AS l, avg(CASE WHEN lo <= 5 AND free THEN -gain END) AS s, avg(CASE WHEN quoted THEN gain END) AS a FROM j GROUP BY 1)
SELECT datetime, round(l - a, 6) + 0.0 AS long, round(s + a, 6) + 0.0 AS short, round(l + s, 6) + 0.0 AS long_short FROM g""",
)
def long_short_tradable(spark: SparkSession, sf: str) -> DataFrame:
    p = market(spark, sf, {"score": SCORE, "close": "$close", "price": "$close", "change": "$change", "ret": "Ref($close, -1) / $close - 1"})
    return _rounded(X.long_short_tradable(p.select("datetime", "instrument", "score"), X.tradable(p, 0.02), 5))


@query(
    "long_short_pnl",
    f"""{FRAME_SQL}, c AS (SELECT *, quantile_cont(score, 0.8) OVER d AS hi, quantile_cont(score, 0.2) OVER d AS lo FROM frame WHERE score IS NOT NULL AND label IS NOT NULL WINDOW d AS (PARTITION BY datetime)),
s AS (SELECT datetime, instrument, label, 1 AS side FROM c WHERE score >= hi UNION ALL SELECT datetime, instrument, label, -1 FROM c WHERE score <= lo),
d AS (SELECT datetime, row_number() OVER (ORDER BY datetime) AS d FROM (SELECT datetime FROM s GROUP BY 1 HAVING count(DISTINCT side) = 2)),
x AS (SELECT s.*, d.d FROM s JOIN d USING (datetime)),
e AS (SELECT a.datetime, a.side, avg(a.label) AS m, avg(CASE WHEN b.side IS NULL THEN 1.0 ELSE 0.0 END) AS fresh FROM x a LEFT JOIN x b ON b.d = a.d - 1 AND b.instrument = a.instrument AND b.side = a.side GROUP BY 1, 2)
SELECT datetime, round(sum(m * side), 6) + 0.0 AS gross, round(avg(fresh), 6) AS turnover, round(sum(m * side) - 0.0015 * avg(fresh), 6) + 0.0 AS net FROM e GROUP BY 1""",
)
def long_short_pnl(spark: SparkSession, sf: str) -> DataFrame:
    f = frame(spark, sf)
    out = B.long_short_pnl(f, f.select("datetime", "instrument", F.col("label").alias("ret")))
    return _rounded(out.select("datetime", "gross", "turnover", "net"))


@query("pool_signal", f"{PANEL_SQL}, f AS (SELECT datetime, instrument, cal_idx, close / nullif(lag(close, 5) OVER w, 0) - 1 AS a, change AS b FROM panel WINDOW w AS (PARTITION BY instrument ORDER BY cal_idx))\nSELECT instrument, cal_idx, round(CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN coalesce(0.7 * (a - avg(a) OVER d) / CASE WHEN stddev_pop(a) OVER d < 1e-8 THEN 1.0 ELSE stddev_pop(a) OVER d END, 0.0) + coalesce(-0.3 * (b - avg(b) OVER d) / CASE WHEN stddev_pop(b) OVER d < 1e-8 THEN 1.0 ELSE stddev_pop(b) OVER d END, 0.0) END, 6) + 0.0 AS score FROM f WINDOW d AS (PARTITION BY datetime)")
def pool_signal(spark: SparkSession, sf: str) -> DataFrame:
    f = market(spark, sf, {"a": SCORE, "b": "$change"})
    return B.combine_signals(f, {"a": 0.7, "b": -0.3}).select("instrument", "cal_idx", _r("score"))


#: Decimal places of whole catalogs, of which a million values are compared.
_PLACES = 4


def _catalog_query(name: str, formulas: dict[str, str]) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        scale = float(10**_PLACES)
        cut = lambda x: F.when(F.abs(x) < 1e10, F.floor(x * scale + 0.4999) / scale).otherwise(F.floor(x / 1e9 + 0.4999) * 1e9)
        return market(spark, sf, formulas).select("instrument", "cal_idx", *[cut(F.col(c)).alias(c) for c in formulas])

    QUERIES[name] = run
    ORACLE[name] = f"{PANEL_SQL}\n{formulas_sql(formulas, 'panel', _PLACES)}"


_catalog_query("alpha158", catalogs.catalog_158())
_catalog_query("alpha360", catalogs.catalog_360())


@query("alpha158_subset", f"{PANEL_SQL}\nSELECT instrument, cal_idx, round((close - open) / nullif(open, 0), 6) + 0.0 AS \"KMID\", round((high - CASE WHEN open IS NOT NULL AND close IS NOT NULL THEN greatest(open, close) END) / nullif(high - low + 1e-12, 0), 6) + 0.0 AS \"KUP2\", round(avg(close) OVER w20 / nullif(close, 0), 6) AS \"MA20\", round(max(high) OVER w60 / nullif(close, 0), 6) AS \"MAX60\", round((close - min(low) OVER w10) / nullif(max(high) OVER w10 - min(low) OVER w10 + 1e-12, 0), 6) + 0.0 AS \"RSV10\", round(min(low) OVER w5 / nullif(close, 0), 6) AS \"MIN5\" FROM panel {windows('w20 w60 w10 w5')}")
def alpha158_subset(spark: SparkSession, sf: str) -> DataFrame:
    names = ("KMID", "KUP2", "MA20", "MAX60", "RSV10", "MIN5")
    every = catalogs.catalog_158()
    return market(spark, sf, {n: every[n] for n in names}).select("instrument", "cal_idx", *[_r(n) for n in names])


@query("alpha360_subset", f"{PANEL_SQL}\nSELECT instrument, cal_idx, round(lag(close, 59) OVER w / nullif(close, 0), 6) AS \"CLOSE59\", round(open / nullif(close, 0), 6) AS \"OPEN0\", round(lag(vwap, 3) OVER w / nullif(close, 0), 6) AS \"VWAP3\" FROM panel WINDOW w AS (PARTITION BY instrument ORDER BY cal_idx)")
def alpha360_subset(spark: SparkSession, sf: str) -> DataFrame:
    every = catalogs.catalog_360()
    return market(spark, sf, {n: every[n] for n in ("CLOSE59", "OPEN0", "VWAP3")}).select("instrument", "cal_idx", *[_r(n) for n in ("CLOSE59", "OPEN0", "VWAP3")])
