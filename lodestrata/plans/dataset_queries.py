"""Named queries over processors, resampling, minute bars, formula pools and streams-as-tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import catalogs
from lodestrata.operators import metrics as M
from lodestrata.operators import orders as O
from lodestrata.operators import portfolio as B
from lodestrata.operators import processors as P
from lodestrata.operators import programs as G
from lodestrata.operators import research as R
from lodestrata.plans.compiler import evaluate
from lodestrata.plans.engine_queries import _CORR, _HASHED, FRAME_SQL, LABEL, PANEL_SQL, SCORE, _LAG, _WEIGHTS_SQL, _r, _rounded, frame, market, panel, same_rounding
from lodestrata.sources import panel as S
from lodestrata.sources.frequency import read_at
from lodestrata.streaming import windows as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = same_rounding(sql)
        return f

    return keep


def _panel_query(name: str, step: P.Processor, sql: str, source: str = "panel") -> None:
    """A processor on ``close``."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return panel(spark, sf).select("instrument", "datetime", "cal_idx", "close").transform(step).select("instrument", "cal_idx", _r("close"))

    query(name, f"{PANEL_SQL}\nSELECT instrument, cal_idx, round({sql}, 6) + 0.0 AS close FROM {source} t")(run)


_D = "OVER (PARTITION BY datetime)"
_panel_query("proc_fillna", P.fill(["close"], -1.0), "coalesce(close, -1.0)")
_panel_query("proc_tanh", P.squash(["close"]), "tanh(close - 1)")
_panel_query("cs_zscore_norm", P.day_zscore(["close"]), f"(close - avg(close) {_D}) / nullif(stddev_samp(close) {_D}, 0)")
_panel_query("cs_robust", P.day_robust(["close"]), f"CASE WHEN close IS NOT NULL AND median(abs(close - m)) {_D} > 0 THEN greatest(-3.0, least(3.0, (close - m) / (median(abs(close - m)) {_D} * 1.4826))) END", f"(SELECT *, median(close) {_D} AS m FROM panel)")
_panel_query("cs_rank_norm", P.day_rank(["close"]), "CASE WHEN close IS NOT NULL THEN ((rank() OVER (PARTITION BY datetime, close IS NULL ORDER BY close) + (count(*) OVER (PARTITION BY datetime, close) - 1) / 2.0) / count(close) OVER (PARTITION BY datetime) - 0.5) * 3.46 END")
_panel_query("cs_inf", P.pipeline(lambda df: df.withColumn("close", F.when(F.pmod("cal_idx", F.lit(50)) == 0, F.lit(float("inf"))).otherwise(F.col("close"))), P.infinite_to_mean(["close"]), lambda df: df.filter("pmod(cal_idx, 50) != 0")), "close", "(SELECT * FROM panel WHERE cal_idx % 50 <> 0)")
_WILD = "(cal_idx + ascii(right(instrument, 1))) % 5 = 0"
_panel_query("cs_inf_some", P.pipeline(lambda df: df.withColumn("close", F.when(F.expr(f"close IS NOT NULL AND {_WILD}"), F.when(F.pmod("cal_idx", F.lit(2)) == 0, float("inf")).otherwise(float("-inf"))).otherwise(F.col("close"))), P.infinite_to_mean(["close"])), f"CASE WHEN wild AND close IS NOT NULL THEN avg(CASE WHEN NOT wild THEN close END) {_D} ELSE close END", f"(SELECT *, {_WILD} AS wild FROM panel)")
for _kind, _sql in {
    "minmax": "(close - (SELECT min(close) FROM f)) / (SELECT max(close) - min(close) FROM f)",
    "zscore": "(close - (SELECT avg(close) FROM f)) / (SELECT stddev_pop(close) FROM f)",
    "robust": "CASE WHEN close IS NOT NULL THEN greatest(-3.0, least(3.0, (close - (SELECT median(close) FROM f)) / (SELECT median(abs(close - (SELECT median(close) FROM f))) * 1.4826 FROM f))) END",
}.items():

    def _run(spark: SparkSession, sf: str, kind: str = _kind) -> DataFrame:
        p = panel(spark, sf).select("instrument", "datetime", "cal_idx", "close")
        return P.fit(p, ["close"], kind, "2024-01-01", "2024-12-31")(p).select("instrument", "cal_idx", _r("close"))

    query(f"norm_{_kind}", f"{PANEL_SQL}, f AS (SELECT close FROM panel WHERE datetime BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-12-31')\nSELECT instrument, cal_idx, round({_sql}, 6) + 0.0 AS close FROM panel")(_run)


@query("proc_dropna", f"{PANEL_SQL}\nSELECT instrument, cal_idx FROM panel WHERE close IS NOT NULL AND volume IS NOT NULL")
def proc_dropna(spark: SparkSession, sf: str) -> DataFrame:
    return panel(spark, sf).transform(P.drop_missing(["close", "volume"])).select("instrument", "cal_idx")


@query("label_tail", f"{PANEL_SQL}, d AS (SELECT datetime, row_number() OVER (ORDER BY datetime DESC) AS n FROM (SELECT DISTINCT datetime FROM panel))\nSELECT instrument, cal_idx, CASE WHEN n > 5 THEN close END AS close FROM panel JOIN d USING (datetime)")
def label_tail(spark: SparkSession, sf: str) -> DataFrame:
    return P.without_tail(panel(spark, sf), "close", 5).select("instrument", "cal_idx", "close")


@query("ts_sampler_array", f"{PANEL_SQL}\nSELECT instrument, cal_idx, round(list_sum(list_transform(list_filter(list(close) OVER w5, lambda v: v IS NOT NULL), lambda v: v)), 6) AS total, (5 - count(*) OVER w5)::INT AS padded FROM panel WINDOW w5 AS (PARTITION BY instrument ORDER BY cal_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def ts_sampler_array(spark: SparkSession, sf: str) -> DataFrame:
    out = P.look_back(panel(spark, sf), ["close"], 5, fill_forward=False)
    values = F.filter(F.transform("window", lambda e: e["close"]), lambda v: v.isNotNull())
    total = F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, v: s + v))
    place = F.row_number().over(S.Window.partitionBy("instrument").orderBy("cal_idx"))
    return out.select("instrument", "cal_idx", total.alias("total"), F.greatest(F.lit(0), 5 - place).alias("padded")).select("instrument", "cal_idx", _r("total"), "padded")


@query("ts_sampler_filled")
def ts_sampler_filled(spark: SparkSession, sf: str) -> DataFrame:
    return P.look_back(panel(spark, sf), ["close", "volume"], 5).select("instrument", "cal_idx", "window")


@query("rolling_segments", "SELECT t::INT AS task, (a + t * 60)::INT AS train_start, (a + t * 60 + 199)::INT AS train_end, (a + t * 60 + 200)::INT AS valid_start, (a + t * 60 + 229)::INT AS valid_end, (a + t * 60 + 230)::INT AS test_start, least(a + t * 60 + 289, b)::INT AS test_end FROM (SELECT a, b, unnest(range(0, (b - a + 1 - 290) // 60 + 1)) AS t FROM (SELECT min(cal_idx) AS a, max(cal_idx) AS b FROM trade_calendar))")
def rolling_segments(spark: SparkSession, sf: str) -> DataFrame:
    return P.rolling_segments(spark.read.parquet(f"{sf}/trade_calendar.parquet"), 200, 30, 60, 60)


@query("select_paused", f"{PANEL_SQL}, k AS (SELECT instrument, datetime, close, row_number() OVER (PARTITION BY instrument ORDER BY cal_idx) - 1 AS cal_idx FROM panel WHERE volume > 0)\nSELECT instrument, datetime, cal_idx::INT AS cal_idx, round(avg(close) OVER (PARTITION BY instrument ORDER BY cal_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS value FROM k")
def select_paused(spark: SparkSession, sf: str) -> DataFrame:
    kept = P.select_rows(panel(spark, sf), F.col("volume") > 0)
    return evaluate(kept, {"value": "Mean($close, 5)"}).select("instrument", "datetime", "cal_idx", _r("value"))


@query("cut_ends", f"{PANEL_SQL}\nSELECT instrument, cal_idx FROM panel QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY cal_idx) > 3 AND row_number() OVER (PARTITION BY instrument ORDER BY cal_idx DESC) > 2")
def cut_ends(spark: SparkSession, sf: str) -> DataFrame:
    return P.cut_ends(panel(spark, sf), 3, -2).select("instrument", "cal_idx")


@query("tresample_month", f"{PANEL_SQL}\nSELECT instrument, date_trunc('month', datetime)::TIMESTAMP AS bucket, arg_min(open, datetime) FILTER (WHERE open IS NOT NULL) AS open, max(high) AS high, min(low) AS low, arg_max(close, datetime) FILTER (WHERE close IS NOT NULL) AS close, count(volume) AS volume FROM panel GROUP BY 1, 2")
def tresample_month(spark: SparkSession, sf: str) -> DataFrame:
    return P.resample(panel(spark, sf), "month", {"open": "first", "high": "max", "low": "min", "close": "last", "volume": "count"})


@query("tresample_week", f"{PANEL_SQL}\nSELECT instrument, date_trunc('week', datetime)::TIMESTAMP AS bucket, arg_max(close, datetime) FILTER (WHERE close IS NOT NULL) AS close FROM panel GROUP BY 1, 2")
def tresample_week(spark: SparkSession, sf: str) -> DataFrame:
    return P.resample(panel(spark, sf), "week", {"close": "last"})


# Minute bars.
_MIN = """
WITH bars AS (
  SELECT instrument || '/' || feed AS instrument, datetime, close, volume, paused_num FROM bars_1min
  QUALIFY row_number() OVER (PARTITION BY instrument, feed, datetime ORDER BY ingested_at DESC, bar_id DESC) = 1),
b AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY datetime)::INT AS cal_idx FROM bars)"""


def minutes(spark: SparkSession, sf: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf}/bars_1min.parquet").select(F.concat_ws("/", "instrument", "feed").alias("instrument"), "datetime", "close", "volume", "vwap", "open", "high", "low", "paused_num", "ingested_at", "bar_id")
    one = S.newest(raw, ["instrument", "datetime"], ["ingested_at", "bar_id"]).drop("ingested_at", "bar_id")
    return one.withColumn("cal_idx", F.row_number().over(S.Window.partitionBy("instrument").orderBy("datetime")))


@query("hf_day_last", f"{_MIN}\nSELECT instrument, cal_idx, last_value(close IGNORE NULLS) OVER (PARTITION BY instrument, datetime::DATE ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS value FROM b")
def hf_day_last(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate(minutes(spark, sf), {"value": "DayLast($close)"}).select("instrument", "cal_idx", "value")


@query("hf_day_cumsum", f"{_MIN}\nSELECT instrument, cal_idx, CASE WHEN i THEN coalesce(sum(CASE WHEN i THEN volume END) OVER (PARTITION BY instrument, datetime::DATE ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) ELSE 0.0 END AS value FROM (SELECT *, hour(datetime) * 60 + minute(datetime) BETWEEN 600 AND 690 AS i FROM b)")
def hf_day_cumsum(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate(minutes(spark, sf), {"value": "DayCumsum($volume, '10:00', '11:30')"}).select("instrument", "cal_idx", "value")


@query("hf_ffill_unpaused", f"{_MIN}\nSELECT instrument, cal_idx, last_value(x IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY cal_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM (SELECT *, CASE WHEN paused_num > 0 THEN NULL ELSE close END AS x FROM b)")
def hf_ffill_unpaused(spark: SparkSession, sf: str) -> DataFrame:
    rows = minutes(spark, sf).withColumn("missing", F.lit(None).cast("double"))
    return evaluate(rows, {"value": "FFillNan(If(Gt($paused_num, 0), $missing, $close))"}).select("instrument", "cal_idx", "value")


@query("hf_catalog")
def hf_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate(minutes(spark, sf).withColumn("missing", F.lit(None).cast("double")), catalogs.minute_catalog())


@query("hf_bars_5min", "SELECT instrument, feed, time_bucket(INTERVAL '5 minutes', datetime) AS bucket, max(close) AS high, min(close) AS low, count(*) AS n FROM bars_1min GROUP BY 1, 2, 3")
def hf_bars_5min(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/bars_1min.parquet")
    return rows.groupBy("instrument", "feed", F.window("datetime", "5 minutes")["start"].alias("bucket")).agg(F.max("close").alias("high"), F.min("close").alias("low"), F.count("*").alias("n"))


# Pools and search logs.
_POOL = {"mom": SCORE, "mom2": "Sub(Div($close,Ref($close,5)),1)", "vol": "Std($change, 10)", "rev": "Mean($close, 5) / $close"}


_POOL_SQL = f"{PANEL_SQL}, f AS (SELECT datetime, instrument, close / nullif(lag(close, 5) OVER w, 0) - 1 AS mom, CASE WHEN count(change) OVER v >= 2 THEN stddev_samp(change) OVER v END AS vol, avg(close) OVER u / nullif(close, 0) AS rev, lead(close) OVER w / nullif(close, 0) - 1 AS label FROM panel WINDOW w AS (PARTITION BY instrument ORDER BY cal_idx), v AS (PARTITION BY instrument ORDER BY cal_idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), u AS (PARTITION BY instrument ORDER BY cal_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"
_POOL_ICS = " UNION ALL ".join(f"SELECT '{n}' AS name, datetime, {_CORR.format(x=x, y='label')} AS ic FROM f GROUP BY datetime" for n, x in (("mom", "mom"), ("mom2", "mom"), ("vol", "vol"), ("rev", "rev")))


@query("pool_ics", f"{_POOL_SQL}\nSELECT name, round(avg(ic), 6) + 0.0 AS ic, round(avg(ic) / nullif(stddev_samp(ic), 0), 6) + 0.0 AS icir, count(ic) AS n FROM ({_POOL_ICS}) GROUP BY name")
def pool_ics(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(G.pool_ics(panel(spark, sf), _POOL, LABEL))


_Z = "coalesce(({0} - avg({0}) OVER d) / CASE WHEN stddev_pop({0}) OVER d < 1e-8 THEN 1.0 ELSE stddev_pop({0}) OVER d END, 0.0)"


@query("pool_combined_ic", f"{_POOL_SQL}, z AS (SELECT datetime, (({_Z.format('mom')} + {_Z.format('vol')}) / 2)::DECIMAL(20, 12)::DOUBLE AS score, label FROM f WINDOW d AS (PARTITION BY datetime))\nSELECT datetime, round({_CORR.format(x='score', y='label')}, 6) + 0.0 AS ic FROM z GROUP BY datetime")
def pool_combined_ic(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(G.evaluate_pool(panel(spark, sf), {"mom": SCORE, "vol": "Std($change, 10)"}, LABEL).select("datetime", "ic"))


@query("diversity")
def diversity(spark: SparkSession, sf: str) -> DataFrame:
    f = market(spark, sf, {k: f"CSZScore({v})" for k, v in _POOL.items()})
    return spark.createDataFrame([(M.diversity_entropy(M.covariance(f, list(_POOL))),)], "entropy double")


@query("diversity_cov", f"{PANEL_SQL}\nSELECT round(covar_samp(change, volume / 1e6), 6) + 0.0 AS c01, round(var_samp(change), 6) + 0.0 AS c00 FROM panel")
def diversity_cov(spark: SparkSession, sf: str) -> DataFrame:
    p = panel(spark, sf).withColumn("v", F.col("volume") / 1e6)
    return p.agg(F.covar_samp("change", "v").alias("c01"), F.var_samp("change").alias("c00")).select(_r("c01"), _r("c00"))


@query("hof_selection")
def hof_selection(spark: SparkSession, sf: str) -> DataFrame:
    f = market(spark, sf, _POOL)
    corr = G.mutual_ics(f, list(_POOL))
    names = list(_POOL)
    ics = {r.name: r.ic for r in G.pool_ics(panel(spark, sf), _POOL, LABEL).collect()}  # one row a formula
    kept = G.hall_of_fame(G.np.array([abs(ics[n] or 0.0) for n in names]), corr, 3)
    return spark.createDataFrame([(names[i],) for i in kept], "name string")


@query("rolling_ols")
def rolling_ols(spark: SparkSession, sf: str) -> DataFrame:
    f = market(spark, sf, {"mom": SCORE, "chg": "$change", "label": LABEL})
    return G.rolling_regression(f, ["mom", "chg"], "label", 60)


@query("trajectory_metrics", "WITH b AS (SELECT run_id, generation, formula, rec_id, CASE WHEN raw_fitness IS NOT NULL AND NOT isnan(raw_fitness) AND ast_similarity IS NOT NULL AND NOT isnan(ast_similarity) THEN floor(raw_fitness * 10)::INT END AS gx, CASE WHEN raw_fitness IS NOT NULL AND NOT isnan(raw_fitness) AND ast_similarity IS NOT NULL AND NOT isnan(ast_similarity) THEN floor(ast_similarity * 10)::INT END AS gy FROM aa_trajectory), f AS (SELECT run_id, gx, gy, min(generation) AS generation FROM b WHERE gx IS NOT NULL AND gy IS NOT NULL GROUP BY 1, 2, 3), n AS (SELECT run_id, generation, count(*) AS new_bins FROM f GROUP BY 1, 2), s AS (SELECT run_id, generation, count(*) AS n, count(DISTINCT formula) AS n_formulas FROM b GROUP BY 1, 2)\nSELECT s.run_id, s.generation, s.n, s.n_formulas, coalesce(new_bins, 0) AS new_bins, (sum(coalesce(new_bins, 0)) OVER (PARTITION BY s.run_id ORDER BY s.generation))::BIGINT AS cumulative_bins FROM s LEFT JOIN n ON n.run_id = s.run_id AND n.generation IS NOT DISTINCT FROM s.generation WHERE s.run_id IS NOT NULL AND s.generation IS NOT NULL")
def trajectory_metrics(spark: SparkSession, sf: str) -> DataFrame:
    log = spark.read.parquet(f"{sf}/aa_trajectory.parquet").filter("run_id is not null and generation is not null")
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    ok = good("raw_fitness") & good("ast_similarity")
    return G.generation_metrics(log.withColumns({"gx": F.when(ok, F.floor(F.col("raw_fitness") * 10)).cast("int"), "gy": F.when(ok, F.floor(F.col("ast_similarity") * 10)).cast("int")}), ["gx", "gy"])


@query("search_budget", "SELECT run_id, count(*) AS n_total, count(DISTINCT formula) AS n_unique, count(DISTINCT generation) AS n_generations, max(g) AS max_generation FROM (SELECT *, count(*) OVER (PARTITION BY run_id, generation) AS g FROM aa_trajectory) WHERE run_id IS NOT NULL GROUP BY run_id")
def search_budget(spark: SparkSession, sf: str) -> DataFrame:
    return G.search_budget(spark.read.parquet(f"{sf}/aa_trajectory.parquet").filter("run_id is not null"))


@query("exact_first", "SELECT run_id, formula, rec_id FROM aa_trajectory WHERE formula IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id, formula ORDER BY generation NULLS FIRST, idx_in_population NULLS FIRST, rec_id) = 1")
def exact_first(spark: SparkSession, sf: str) -> DataFrame:
    return G.first_occurrences(spark.read.parquet(f"{sf}/aa_trajectory.parquet"))


_GRID = "SELECT floor(greatest(0, least(19, floor((ic + 0.1) / 0.2 * 20))))::INT AS gx, floor(greatest(0, least(19, floor(mean_daily_coverage_ratio * 20))))::INT AS gy, NOT (ic BETWEEN -0.1 AND 0.1 AND mean_daily_coverage_ratio BETWEEN 0 AND 1) AS o FROM final_pool WHERE ic IS NOT NULL AND NOT isnan(ic) AND mean_daily_coverage_ratio IS NOT NULL AND NOT isnan(mean_daily_coverage_ratio)"


@query("grid_bins", f"SELECT gx, gy, count(*) AS n, count(CASE WHEN o THEN 1 END) AS n_outside FROM ({_GRID}) GROUP BY 1, 2")
def grid_bins(spark: SparkSession, sf: str) -> DataFrame:
    return _binned(spark, sf).groupBy("gx", "gy").agg(F.count("*").alias("n"), F.count(F.when(F.col("outside"), 1)).alias("n_outside"))


def _binned(spark: SparkSession, sf: str) -> DataFrame:
    pool = spark.read.parquet(f"{sf}/final_pool.parquet").filter("not isnan(ic) and not isnan(mean_daily_coverage_ratio)")
    return G.grid_bins(pool, "ic", "mean_daily_coverage_ratio", (-0.1, 0.1, 0.0, 1.0), 20)


@query("grid_summary", f"SELECT round(count(*) / 400.0, 6) AS coverage, round(-sum(n / t * ln(n / t)), 6) AS entropy, sum(no)::BIGINT AS n_outside FROM (SELECT gx, gy, count(*)::DOUBLE AS n, count(CASE WHEN o THEN 1 END) AS no, (sum(count(*)) OVER ())::DOUBLE AS t FROM ({_GRID}) GROUP BY 1, 2)")
def grid_summary(spark: SparkSession, sf: str) -> DataFrame:
    return G.grid_summary(_binned(spark, sf), 20).select(_r("coverage"), _r("entropy"), "n_outside")


@query("pool_integrity", "SELECT count(*) AS n, count(DISTINCT formula) AS n_distinct, count(*) = 50 AS full_size, count(formula) - count(DISTINCT formula) AS n_duplicates, count(CASE WHEN train_sign NOT IN (-1, 1) THEN 1 END) AS n_bad_signs FROM final_pool")
def pool_integrity(spark: SparkSession, sf: str) -> DataFrame:
    return G.pool_check(spark.read.parquet(f"{sf}/final_pool.parquet"), 50)


_FIT = "SELECT l_extendedprice / 1000 AS x, l_quantity AS y, 1 + l_discount AS w FROM lineitem"


@query("weighted_pearson", f"SELECT round(abs(c / sqrt(vx * vy)), 6) AS r FROM (SELECT sum(w * x * y) / sum(w) - sum(w * x) / sum(w) * (sum(w * y) / sum(w)) AS c, sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2) AS vx, sum(w * y * y) / sum(w) - pow(sum(w * y) / sum(w), 2) AS vy FROM ({_FIT}))")
def weighted_pearson(spark: SparkSession, sf: str) -> DataFrame:
    return _fit_rows(spark, sf).agg(M.weighted_pearson(F.col("x"), F.col("y"), F.col("w")).alias("r")).select(_r("r"))


def _fit_rows(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_extendedprice") / 1000).alias("x"), F.col("l_quantity").alias("y"), (1 + F.col("l_discount")).alias("w"))


@query("fit_errors", f"SELECT round(sum(w * abs(x - y)) / sum(w), 6) AS mae, round(sum(w * (x - y) * (x - y)) / sum(w), 6) AS mse, round(sqrt(sum(w * (x - y) * (x - y)) / sum(w)), 6) AS rmse FROM ({_FIT})")
def fit_errors(spark: SparkSession, sf: str) -> DataFrame:
    e = M.fit_errors(F.col("x"), F.col("y"), F.col("w"))
    return _fit_rows(spark, sf).agg(*[e[k].alias(k) for k in ("mae", "mse", "rmse")]).select(_r("mae"), _r("mse"), _r("rmse"))


@query("kmeans_factors")
def kmeans_factors(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", array_to_vector("embedding").alias("features"))
    return KMeans(k=8, seed=7).fit(rows).transform(rows).groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("n"))


@query("pca_projection")
def pca_projection(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", array_to_vector("embedding").alias("raw"))
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(rows).transform(rows)
    out = PCA(k=2, inputCol="features", outputCol="pc").fit(scaled).transform(scaled)
    return out.select("vec_id", *[F.round(F.abs(vector_to_array("pc")[i]), 4).alias(f"abs_pc{i + 1}") for i in range(2)])


# Streams as tables: the same functions run on both.
def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


_STATS = "count(value) AS n, round(sum(value), 6) AS total, min(value) AS least, max(value) AS most"


@query("tumbling", f"SELECT time_bucket(INTERVAL '1 hour', ts) AS start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS end, event_type, {_STATS} FROM events GROUP BY 1, 2, 3")
def tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return W.tumbling(_events(spark, sf), "event_type", "1 hour").withColumn("total", _r("total"))


@query("sliding", f"SELECT s AS start, s + INTERVAL '1 hour' AS end, event_type, {_STATS} FROM (SELECT *, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS s FROM events) GROUP BY 1, 2, 3")
def sliding(spark: SparkSession, sf: str) -> DataFrame:
    return W.sliding(_events(spark, sf), "event_type", "1 hour", "30 minutes").withColumn("total", _r("total"))


@query("session", f"WITH g AS (SELECT *, sum(CASE WHEN ts - p <= INTERVAL '30 minutes' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))\nSELECT min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS end, user_id, {_STATS} FROM g GROUP BY user_id, s")
def session(spark: SparkSession, sf: str) -> DataFrame:
    return W.sessions(_events(spark, sf), "user_id", "30 minutes").withColumn("total", _r("total"))


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return W.deduplicated(_events(spark, sf), ["user_id", "event_type"]).select("user_id", "event_type")


@query("append_series", "SELECT instrument, cal_idx, close FROM (SELECT *, row_number() OVER (PARTITION BY instrument, cal_idx ORDER BY v DESC) AS n FROM (SELECT instrument, cal_idx, max(close) AS close, 0 AS v FROM bars_day WHERE cal_idx < 300 GROUP BY 1, 2 UNION ALL SELECT instrument, cal_idx, min(close), 1 FROM bars_day WHERE cal_idx >= 250 GROUP BY 1, 2)) WHERE n = 1")
def append_series(spark: SparkSession, sf: str) -> DataFrame:
    bars = spark.read.parquet(f"{sf}/bars_day.parquet")
    old = bars.filter("cal_idx < 300").groupBy("instrument", "cal_idx").agg(F.max("close").alias("close"))
    new = bars.filter("cal_idx >= 250").groupBy("instrument", "cal_idx").agg(F.min("close").alias("close"))
    return S.append_series(old, new)


@query("replace_range", f"{PANEL_SQL}\nSELECT instrument, datetime, close FROM panel WHERE cal_idx NOT BETWEEN 100 AND 150 UNION ALL SELECT instrument, datetime, -close FROM panel WHERE cal_idx BETWEEN 100 AND 150")
def replace_range(spark: SparkSession, sf: str) -> DataFrame:
    p = panel(spark, sf).select("instrument", "datetime", "cal_idx", "close")
    cal = spark.read.parquet(f"{sf}/trade_calendar.parquet").filter("cal_idx between 100 and 150")
    new = p.join(cal.select("cal_idx"), "cal_idx", "left_semi").withColumn("close", -F.col("close"))
    return S.replace_range(p, new).select("instrument", "datetime", "close")


# Further research steps.
@query("pfs_modes")
def pfs_modes(spark: SparkSession, sf: str) -> DataFrame:
    sigma = R.market_volatility(market(spark, sf, {"score": "$close / Ref($close, 1) - 1"}))
    prices = S.market_panel(spark, sf, wanted={"close", "volume"})
    each = [R.perturbation_fidelity(prices, "$close / Ref($close, 5) - Corr($close, $volume, 10)", sigma, mode) for mode in R.PFS_MODES]
    return _rounded(each[0].unionByName(each[1]).unionByName(each[2]))


_PCT = "(rank() OVER (PARTITION BY datetime, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY datetime, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY datetime)"


@query("illiquidity", f"{PANEL_SQL}, x AS (SELECT *, abs(change) / CASE WHEN amount > 0 THEN amount END * 1e9 AS x FROM panel)\nSELECT instrument, cal_idx, round(CASE WHEN count(x) OVER w >= 10 THEN avg(x) OVER w END, 6) AS illiquidity FROM x WINDOW w AS (PARTITION BY instrument ORDER BY cal_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def illiquidity(spark: SparkSession, sf: str) -> DataFrame:
    return R.illiquidity(panel(spark, sf)).select("instrument", "cal_idx", _r("illiquidity"))


@query("vol_regimes", f"{FRAME_SQL}, b AS (SELECT datetime, avg(label) AS bench FROM frame GROUP BY 1 HAVING avg(label) IS NOT NULL), v AS (SELECT datetime, CASE WHEN count(bench) OVER w = 20 THEN stddev_samp(bench) OVER w END AS vol FROM b WINDOW w AS (ORDER BY datetime ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))\nSELECT datetime, round(vol, 6) AS vol, CASE WHEN vol <= (SELECT quantile_cont(vol, 0.3) FROM v) THEN 'low' WHEN vol >= (SELECT quantile_cont(vol, 0.7) FROM v) THEN 'high' WHEN vol IS NOT NULL THEN 'middle' END AS regime FROM v")
def vol_regimes(spark: SparkSession, sf: str) -> DataFrame:
    bench = frame(spark, sf).groupBy("datetime").agg(F.avg("label").alias("bench")).filter("bench is not null")
    return _rounded(R.volatility_regimes(bench))


@query("position_status", f"{_WEIGHTS_SQL}, days AS (SELECT datetime, row_number() OVER (ORDER BY datetime) AS d FROM (SELECT DISTINCT datetime FROM weights)), h AS (SELECT d, instrument FROM weights JOIN days USING (datetime))\nSELECT days.datetime, coalesce(a.instrument, b.instrument) AS instrument, (CASE WHEN a.d IS NULL THEN 0 ELSE 1 END - CASE WHEN b.d IS NULL THEN 0 ELSE 1 END)::INT AS status FROM h a FULL JOIN h b ON a.instrument = b.instrument AND a.d = b.d + 1 JOIN days ON days.d = coalesce(a.d, b.d + 1)")
def position_status(spark: SparkSession, sf: str) -> DataFrame:
    return R.position_status(B.long_short_weights(frame(spark, sf)))


@query("common_turnover", f"{FRAME_SQL}, f AS (SELECT * FROM frame WHERE score IS NOT NULL), z AS (SELECT datetime, instrument, coalesce((score - avg(score) OVER d) / CASE WHEN stddev_pop(score) OVER d < 1e-8 THEN 1.0 ELSE stddev_pop(score) OVER d END, 0.0) AS score FROM f WINDOW d AS (PARTITION BY datetime)), j AS (SELECT * FROM {_LAG.format(v='score', t='z')} t WHERE past IS NOT NULL), m AS (SELECT datetime, abs(score / nullif(sum(abs(score)) OVER d, 0) - past / nullif(sum(abs(past)) OVER d, 0)) AS x FROM j WINDOW d AS (PARTITION BY datetime))\nSELECT datetime, round(sum(x) / 2, 6) AS turnover FROM m GROUP BY datetime")
def common_turnover(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.common_turnover(frame(spark, sf)))


@query("average_ensemble", f"{PANEL_SQL}, f AS (SELECT datetime, instrument, close / nullif(lag(close, 5) OVER w, 0) - 1 AS a, change AS b FROM panel WINDOW w AS (PARTITION BY instrument ORDER BY cal_idx)), z AS (SELECT datetime, instrument, (a - avg(a) OVER d) / nullif(stddev_samp(a) OVER d, 0) AS a, (b - avg(b) OVER d) / nullif(stddev_samp(b) OVER d, 0) AS b FROM f WINDOW d AS (PARTITION BY datetime))\nSELECT datetime, instrument, round((coalesce(a, 0.0) + coalesce(b, 0.0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT, 0), 6) + 0.0 AS score FROM z")
def average_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    f = market(spark, sf, {"a": SCORE, "b": "$change"})
    return _rounded(R.average_ensemble([f.select("datetime", "instrument", F.col(c).alias("score")) for c in ("a", "b")]))


@query("pool_profile", "SELECT method, round(median(x), 6) + 0.0 AS median, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr, round(min(x), 6) + 0.0 AS worst, count(x) AS n FROM (SELECT method, CASE WHEN NOT isnan(effective_fitness) THEN effective_fitness END AS x FROM final_pool) GROUP BY method")
def pool_profile(spark: SparkSession, sf: str) -> DataFrame:
    pool = spark.read.parquet(f"{sf}/final_pool.parquet").withColumn("x", F.when(~F.isnan("effective_fitness"), F.col("effective_fitness")))
    return _rounded(R.profile(pool, "method", "x"))


@query("grid_nearest", f"SELECT a.gx, a.gy, a.n, round(min(sqrt(pow(a.gx - b.gx, 2) + pow(a.gy - b.gy, 2))), 6) AS nearest FROM (SELECT gx, gy, count(*) AS n FROM ({_GRID}) GROUP BY 1, 2) a LEFT JOIN (SELECT DISTINCT gx, gy FROM ({_GRID})) b ON a.gx <> b.gx OR a.gy <> b.gy GROUP BY 1, 2, 3")
def grid_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.nearest_on_grid(_binned(spark, sf), "ic", "mean_daily_coverage_ratio"))


_TILT = f"{PANEL_SQL}, f AS (SELECT datetime, instrument, close / nullif(lag(close, 5) OVER w, 0) - 1 AS score, avg(amount) OVER u AS amount FROM panel WINDOW w AS (PARTITION BY instrument ORDER BY cal_idx), u AS (PARTITION BY instrument ORDER BY cal_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), p AS (SELECT datetime, abs({_Z.format('score')}) AS w, CASE WHEN amount IS NOT NULL THEN {_PCT.format(x='amount')} END AS pct, CASE WHEN score IS NOT NULL THEN {_PCT.format(x='score')} END AS p FROM f WINDOW d AS (PARTITION BY datetime))"


@query("liquidity_tilt", f"{_TILT}\nSELECT datetime, round(sum(w * pct) / CASE WHEN sum(w) > 0 THEN sum(w) END, 6) + 0.0 AS footprint, round(avg(CASE WHEN p > 0.8 THEN pct END) - avg(CASE WHEN p <= 0.2 THEN pct END), 6) + 0.0 AS tilt, round(abs({_CORR.format(x='p', y='pct')}), 6) + 0.0 AS rank_corr FROM p GROUP BY datetime")
def liquidity_tilt(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.footprint(market(spark, sf, {"score": SCORE, "amount": "Mean($amount, 20)"}), "amount"))


_DEALT = _HASHED.format(text="concat_ws('|', instrument, epoch_us(datetime), 7)")


@query("permutation_null", f"{FRAME_SQL}, a AS (SELECT datetime, label, row_number() OVER (PARTITION BY datetime ORDER BY instrument) AS k FROM frame), b AS (SELECT datetime, score, row_number() OVER (PARTITION BY datetime ORDER BY {_DEALT}, instrument) AS k FROM frame)\nSELECT datetime, round({_CORR.format(x='score', y='label')}, 6) + 0.0 AS ic FROM a JOIN b USING (datetime, k) GROUP BY datetime")
def permutation_null(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(M.daily_ic(R.permuted(frame(spark, sf))).select("datetime", "ic"))


@query("execution_trend")
def execution_trend(spark: SparkSession, sf: str) -> DataFrame:
    return R.execution_trend(panel(spark, sf))


@query("twap_orders", "SELECT o_orderkey AS order_id, s::INT AS step, round(CASE WHEN s = 3 THEN o_totalprice - CASE WHEN s = 0 THEN 0.0 ELSE floor(o_totalprice * s / 4 / 100 + 1e-9) * 100 END ELSE floor(o_totalprice * (s + 1) / 4 / 100 + 1e-9) * 100 - CASE WHEN s = 0 THEN 0.0 ELSE floor(o_totalprice * s / 4 / 100 + 1e-9) * 100 END END, 6) AS part FROM orders, range(4) t(s)")
def twap_orders(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("amount"))
    return B.twap_schedule(orders, 4).select("order_id", "step", _r("part"))


@query("base_prices", f"{_MIN}\nSELECT instrument, datetime::DATE AS day, round(avg(CASE WHEN close > 1e-8 THEN close END), 6) AS twap, round(sum(CASE WHEN close > 1e-8 THEN close * volume END) / CASE WHEN sum(CASE WHEN close > 1e-8 THEN volume END) > 0 THEN sum(CASE WHEN close > 1e-8 THEN volume END) END, 6) + 0.0 AS vwap FROM b GROUP BY 1, 2")
def base_prices(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(O.base_prices(minutes(spark, sf).withColumn("price", F.col("close"))))


@query("trade_hours", f"{_MIN}\nSELECT instrument, cal_idx FROM b WHERE strftime(datetime, '%H:%M') BETWEEN '09:45' AND '10:15'")
def trade_hours(spark: SparkSession, sf: str) -> DataFrame:
    return O.within_times(minutes(spark, sf), "09:45", "10:15").select("instrument", "cal_idx")


@query("bars_30min", "WITH b AS (SELECT * FROM bars_1min QUALIFY row_number() OVER (PARTITION BY instrument, feed, datetime ORDER BY ingested_at DESC, bar_id DESC) = 1)\nSELECT instrument, feed, time_bucket(INTERVAL '30 minutes', datetime) AS bucket, arg_min(open, datetime) FILTER (WHERE open IS NOT NULL) AS open, max(high) AS high, min(low) AS low, arg_max(close, datetime) FILTER (WHERE close IS NOT NULL) AS close, round(sum(volume), 6) AS volume FROM b GROUP BY 1, 2, 3")
def bars_30min(spark: SparkSession, sf: str) -> DataFrame:
    return read_at(spark, sf, "30min").withColumn("volume", _r("volume"))
