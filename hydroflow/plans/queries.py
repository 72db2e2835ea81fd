"""Registered queries (Spark) and their DuckDB oracle SQL.

Stand-ins for the reference's inputs (see README): ``events`` is the raw rain feed
(site = event_type, rain = value * RAIN_SCALE), ``orders``/``lineitem`` carry the multi-year
daily series and the actual-vs-predicted pairs.

Every query returns doubles rounded to 6 decimals, in Spark and in SQL alike, so that
different (equally valid) float summation orders compare equal. Both sides round with the
same IEEE arithmetic, floor(x * 1e6 + 0.5000001) / 1e6 (Spark's ``round`` is decimal HALF_UP,
DuckDB's works on the binary value; they disagree on ties such as 3.4238255). The small excess over a half puts exact
decimal ties, common in prices, on one side whatever the summation order. Magnitudes from 1e12 on, where a double has
fewer than 6 exact decimals and floor() leaves the long range, stay unrounded.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import features, resample, windows
from ..functions import calendar as cal
from ..sources.tables import load, sensor_feed

RAIN_SCALE = 0.01
ROUND = 6

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        SPARK[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


_SCALE = 10.0 ** ROUND
_HALF = 0.5000001


def _round_col(c):
    x = c.cast("double")
    r = F.floor(x * F.lit(_SCALE) + F.lit(_HALF)).cast("double") / F.lit(_SCALE)
    return F.when(F.abs(x) < F.lit(1e12), r + F.lit(0.0)).otherwise(x)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[_round_col(F.col(f.name)).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def R(expr: str, alias: str) -> str:
    x = f"CAST({expr} AS DOUBLE)"
    return (f"(CASE WHEN abs({x}) < {D(1e12)} THEN floor({x} * {D(_SCALE)} + {D(_HALF)}) / {D(_SCALE)} "
            f"+ CAST(0 AS DOUBLE) ELSE {x} END) AS {alias}")


def D(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


# ---------------------------------------------------------------- sensor feed (events)

def hourly_rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.hourly_sum(sensor_feed(spark, sf_dir), ["site"], "ts", "value", out="Rainfall",
                               scale=RAIN_SCALE)


SQL_HOURLY = f"""
ev AS (SELECT event_type AS site, date_trunc('hour', ts) AS ts, value * {D(RAIN_SCALE)} AS rain FROM events),
bnd AS (SELECT site, min(ts) AS lo, max(ts) AS hi FROM ev GROUP BY site),
grid AS (SELECT site, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM bnd),
hs AS (SELECT site, ts, sum(rain) AS rain FROM ev GROUP BY site, ts),
hr AS MATERIALIZED (SELECT g.site, g.ts, coalesce(hs.rain, 0.0) AS Rainfall,
              CAST(row_number() OVER (PARTITION BY g.site ORDER BY g.ts) AS BIGINT) AS rn
       FROM grid g LEFT JOIN hs ON g.site = hs.site AND g.ts = hs.ts)"""


def _w(frame: str = "") -> str:
    return f"OVER (PARTITION BY site ORDER BY ts {frame})"


def _roll(x: str, n: int, how: str = "sum") -> str:
    """Full-window rolling sum/mean. The sum is spelled out oldest-first, the order in which
    Spark accumulates a bounded ROWS frame, so both engines add the same doubles in the
    same order."""
    fr = _w(f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW")
    terms = " + ".join([f"lag({x}, {k}) {_w()}" for k in range(n - 1, 0, -1)] + [x])
    total = f"({terms})" if how == "sum" else f"({terms}) / {D(float(n))}"
    return f"CASE WHEN count({x}) {fr} = {n} THEN {total} END"


def _bfill(x: str) -> str:
    return f"coalesce({x}, first_value({x} IGNORE NULLS) {_w('ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING')})"


def _ffill(x: str) -> str:
    return f"last_value({x} IGNORE NULLS) {_w('ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')}"


@register("hourly_resample", f"""WITH {SQL_HOURLY}
SELECT site, ts, {R('Rainfall', 'Rainfall')} FROM hr""")
def q_hourly_resample(spark, sf_dir):
    """A1: hourly sum per site, every hour from first to last present, empty hours 0."""
    return rounded(hourly_rain(spark, sf_dir).select("site", "ts", "Rainfall"))


@register("hourly_sum_no_gap", f"""
SELECT event_type AS site, date_trunc('hour', ts) AS ts, {R(f'sum(value) * {D(RAIN_SCALE)}', 'Rainfall')},
       CAST(count(*) AS BIGINT) AS n
FROM events WHERE value IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2""")
def q_hourly_sum_no_gap(spark, sf_dir):
    """A2: hourly sums without gap fill, NULL rows dropped first (R path)."""
    ev = sensor_feed(spark, sf_dir).where(F.col("ts").isNotNull())
    return rounded(resample.hourly_sum_no_gap(ev, ["site"], "ts", ["value"], RAIN_SCALE, "n").withColumnRenamed("value", "Rainfall"))


@register("calendar_features", f"""WITH {SQL_HOURLY}
SELECT site, ts, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS wday,
       CAST(dayofweek(ts) + 1 AS INTEGER) AS wday_r, CAST(month(ts) AS INTEGER) AS month,
       CAST(day(last_day(ts)) AS INTEGER) AS mday, CAST(dayofyear(ts) AS INTEGER) AS doy,
       {R(f'sin({D(6.283185307179586)} * hour(ts) / {D(24.0)})', 'sin_hour')},
       {R(f'cos({D(6.283185307179586)} * hour(ts) / {D(24.0)})', 'cos_hour')}
FROM hr""")
def q_calendar_features(spark, sf_dir):
    """F1-F7 on the hourly grid; wday Monday=0 (Python), wday_r Sunday=1 (R)."""
    h = hourly_rain(spark, sf_dir).select("site", "ts")
    c = cal.calendar_columns("ts")
    return rounded(h.select("site", "ts", c["hour"].alias("hour"), c["wday"].alias("wday"),
                            cal.weekday_sun1("ts").alias("wday_r"), c["month"].alias("month"),
                            c["mday"].alias("mday"), c["doy"].alias("doy"),
                            c["sin_hour"].alias("sin_hour"), c["cos_hour"].alias("cos_hour")))


@register("rain_lags_bfill", f"""WITH {SQL_HOURLY},
l AS (SELECT site, ts, lag(Rainfall, 1) {_w()} AS l1, lag(Rainfall, 2) {_w()} AS l2 FROM hr)
SELECT site, ts, {R(_bfill('l1'), 'Rainlag1')}, {R(_bfill('l2'), 'Rainlag2')} FROM l""")
def q_rain_lags_bfill(spark, sf_dir):
    """Lag 1, 2 of hourly rain, leading NULLs back-filled."""
    h = hourly_rain(spark, sf_dir).withColumn("_pos", cal.hour_id("ts"))
    out = windows.add_lags(h, ["site"], "_pos", {"Rainlag1": ("Rainfall", 1), "Rainlag2": ("Rainfall", 2)},
                           fill_how="bfill")
    return rounded(out.select("site", "ts", "Rainlag1", "Rainlag2"))


_WINS = features.RAIN_WINDOWS


@register("rain_rolling_bfill", f"""WITH {SQL_HOURLY},
r AS (SELECT site, ts, {', '.join(f"{_roll('Rainfall', n)} AS r{n}" for n in _WINS)} FROM hr)
SELECT site, ts, {', '.join(R(_bfill(f'r{n}'), f'Rain_L{n}HR') for n in _WINS)} FROM r""")
def q_rain_rolling_bfill(spark, sf_dir):
    """Full-window rolling sums 3/6/12/24/48 h, back-filled."""
    h = hourly_rain(spark, sf_dir).withColumn("_pos", cal.hour_id("ts"))
    specs = {f"Rain_L{n}HR": ("Rainfall", n) for n in _WINS}
    out = windows.add_rolling(h, ["site"], "_pos", specs, "sum", fill_how="bfill")
    return rounded(out.select("site", "ts", *specs))


@register("rain_rolling_nofill", f"""WITH {SQL_HOURLY}
SELECT site, ts, {', '.join(R(_roll('Rainfall', n), f'Rain_L{n}HR') for n in (3, 6))},
       {R('lag(Rainfall, 1) ' + _w(), 'Rainlag1')}, {R('lag(Rainfall, 3) ' + _w(), 'Rainlag3')} FROM hr""")
def q_rain_rolling_nofill(spark, sf_dir):
    """W3 + W9 (R path): lag 1, 3 and right-aligned rolling sums 3/6 without fill."""
    h = hourly_rain(spark, sf_dir).withColumn("_pos", cal.hour_id("ts"))
    from ..operators.blocked import with_series_windows
    out = with_series_windows(h, ["site"], "_pos", lambda w: {
        "Rain_L3HR": windows.rolling_full("Rainfall", 3, w), "Rain_L6HR": windows.rolling_full("Rainfall", 6, w),
        "Rainlag1": windows.lag("Rainfall", 1, w), "Rainlag3": windows.lag("Rainfall", 3, w)}, halo=5)
    return rounded(out.select("site", "ts", "Rain_L3HR", "Rain_L6HR", "Rainlag1", "Rainlag3"))


@register("first_difference", f"""WITH {SQL_HOURLY}
SELECT site, ts, {R('Rainfall - lag(Rainfall, 1) ' + _w(), 'rain_diff')} FROM hr""")
def q_first_difference(spark, sf_dir):
    """X - lag(x, 1) per series."""
    h = hourly_rain(spark, sf_dir).withColumn("_pos", cal.hour_id("ts"))
    out = windows.add_diff(h, ["site"], "_pos", {"rain_diff": "Rainfall"})
    return rounded(out.select("site", "ts", "rain_diff"))


SQL_REC = f"""
rec AS (
  SELECT site, rn, ts, Rainfall, CAST(0.0 AS DOUBLE) AS api, least({D(100.0)}, Rainfall) AS soil
  FROM hr WHERE rn = 1
  UNION ALL
  SELECT hr.site, hr.rn, hr.ts, hr.Rainfall, {D(0.85)} * rec.api + rec.Rainfall,
         least({D(100.0)}, {D(0.95)} * rec.soil + rec.Rainfall)
  FROM rec JOIN hr ON hr.site = rec.site AND hr.rn = rec.rn + 1)"""


@register("api_recurrence", f"""WITH RECURSIVE {SQL_HOURLY}, {SQL_REC}
SELECT site, ts, {R('api', 'API')} FROM rec""")
def q_api_recurrence(spark, sf_dir):
    """API_i = 0.85 API_{i-1} + rain_{i-1}, API_0 = 0 (blocked affine scan)."""
    return rounded(features.rain_recurrences(hourly_rain(spark, sf_dir), ["site"]).select("site", "ts", "API"))


@register("soil_moisture", f"""WITH RECURSIVE {SQL_HOURLY}, {SQL_REC}
SELECT site, ts, {R('soil', 'SoilMoisture')} FROM rec""")
def q_soil_moisture(spark, sf_dir):
    """Capped bucket s_i = min(100, 0.95 s_{i-1} + rain_{i-1}), s_0 = min(100, rain_0)."""
    return rounded(features.rain_recurrences(hourly_rain(spark, sf_dir), ["site"])
                   .select("site", "ts", "SoilMoisture"))


_PREP_SQL = f"""WITH RECURSIVE {SQL_HOURLY}, {SQL_REC},
f AS (SELECT site, ts, Rainfall,
        lag(Rainfall, 1) {_w()} AS l1, lag(Rainfall, 2) {_w()} AS l2,
        {', '.join(f"{_roll('Rainfall', n)} AS r{n}" for n in _WINS)}
      FROM hr)
SELECT f.site, f.ts, {R('f.Rainfall', 'Rainfall')}, CAST(hour(f.ts) AS INTEGER) AS hour,
       CAST(isodow(f.ts) - 1 AS INTEGER) AS wday, CAST(month(f.ts) AS INTEGER) AS month,
       CAST(day(last_day(f.ts)) AS INTEGER) AS mday, CAST(dayofyear(f.ts) AS INTEGER) AS doy,
       {R(_bfill('l1').replace('PARTITION BY site ORDER BY ts', 'PARTITION BY f.site ORDER BY f.ts'), 'Rainlag1')},
       {R(_bfill('l2').replace('PARTITION BY site ORDER BY ts', 'PARTITION BY f.site ORDER BY f.ts'), 'Rainlag2')},
       {', '.join(R(_bfill(f'r{n}').replace('PARTITION BY site ORDER BY ts', 'PARTITION BY f.site ORDER BY f.ts'), f'Rain_L{n}HR') for n in _WINS)},
       {R(f'sin({D(6.283185307179586)} * hour(f.ts) / {D(24.0)})', 'sin_hour')},
       {R(f'cos({D(6.283185307179586)} * hour(f.ts) / {D(24.0)})', 'cos_hour')},
       {R('rec.api', 'API')}, {R('rec.soil', 'SoilMoisture')}
FROM f JOIN rec ON f.site = rec.site AND f.ts = rec.ts"""


@register("prep_rainfall", _PREP_SQL)
def q_prep_rainfall(spark, sf_dir):
    """Full rain feature table for every site at once (the reference's per-file loop)."""
    return rounded(features.prep_rainfall(hourly_rain(spark, sf_dir), ["site"]))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_prep_rainfall(spark, sf_dir)


# ---------------------------------------------------------------- extra lags / temperature

from ..operators import joins, metrics, ranking, reshape, split  # noqa: E402
from ..operators.blocked import fill as blocked_fill  # noqa: E402
from ..operators.blocked import attach, materialize  # noqa: E402
from ..operators.blocked import with_series_windows  # noqa: E402

TEMP_SCALE = 0.1


def hourly_temp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in temperature: peak reading per (site, hour) x 0.1, only hours that have readings."""
    ev = sensor_feed(spark, sf_dir)
    return (ev.groupBy("site", cal.trunc_hour("ts").alias("ts"))
            .agg((F.max("value") * F.lit(TEMP_SCALE)).alias("temp")))


SQL_TEMP = f"""
tp AS (SELECT event_type AS site, date_trunc('hour', ts) AS ts, max(value) * {D(TEMP_SCALE)} AS temp
       FROM events GROUP BY 1, 2),
ft AS MATERIALIZED (SELECT hr.site, hr.ts, hr.Rainfall, tp.temp FROM hr LEFT JOIN tp ON hr.site = tp.site AND hr.ts = tp.ts)"""


def _ffbf(x: str) -> str:
    return f"coalesce({_ffill(x)}, {_bfill(x)})"


@register("feature_join", f"""WITH {SQL_HOURLY}, {SQL_TEMP}
SELECT site, ts, {R('Rainfall', 'Rainfall')}, {R('temp', 'temp')} FROM ft""")
def q_feature_join(spark, sf_dir):
    """Gap-free hourly rain ⟕ temperature on (site, hour); missing temperature stays NULL."""
    out = joins.left_on_hour(hourly_rain(spark, sf_dir).select("site", "ts", "Rainfall"),
                             [hourly_temp(spark, sf_dir)], ["site"])
    return rounded(out)


_TL = (1, 2, 3, 24)


@register("lags_ffill_bfill", f"""WITH {SQL_HOURLY}, {SQL_TEMP},
l AS (SELECT site, ts, {', '.join(f'lag(temp, {k}) {_w()} AS t{k}' for k in _TL)}, lag(Rainfall, 3) {_w()} AS r3 FROM ft)
SELECT site, ts, {', '.join(R(_ffbf(f't{k}'), f'temp_lag{k}') for k in _TL)}, {R(_ffbf('r3'), 'Rainlag3')} FROM l""")
def q_lags_ffill_bfill(spark, sf_dir):
    """shift(k) then forward fill then back fill, on a temperature series with gaps."""
    t = q_feature_join(spark, sf_dir).withColumn("_pos", cal.hour_id("ts"))
    specs = {f"temp_lag{k}": ("temp", k) for k in _TL}
    specs["Rainlag3"] = ("Rainfall", 3)
    out = windows.add_lags(t, ["site"], "_pos", specs, fill_how="ffill_bfill")
    return rounded(out.select("site", "ts", *specs))


@register("temp_rolling_mean", f"""WITH {SQL_HOURLY}, {SQL_TEMP},
m AS (SELECT site, ts, {', '.join(f"{_roll('temp', n, 'avg')} AS m{n}" for n in (6, 12, 24))} FROM ft)
SELECT site, ts, {', '.join(R(_bfill(f'm{n}'), f'Temp_{n}HR_mean') for n in (6, 12, 24))} FROM m""")
def q_temp_rolling_mean(spark, sf_dir):
    """Full-window rolling means 6/12/24 h (NULL while any hour in the window is missing),
    then back fill."""
    t = q_feature_join(spark, sf_dir).withColumn("_pos", cal.hour_id("ts"))
    specs = {f"Temp_{n}HR_mean": ("temp", n) for n in (6, 12, 24)}
    out = windows.add_rolling(t, ["site"], "_pos", specs, "mean", fill_how="bfill")
    return rounded(out.select("site", "ts", *specs))


@register("ffill_temperature", f"""WITH {SQL_HOURLY}, {SQL_TEMP}
SELECT site, ts, {R(_ffill('temp'), 'temp_ffill')}, {R(_bfill('temp'), 'temp_bfill')} FROM ft""")
def q_ffill_temperature(spark, sf_dir):
    """W4 + W5: forward fill and backward fill of every gap, exact across blocks."""
    t = q_feature_join(spark, sf_dir).withColumn("_pos", cal.hour_id("ts"))
    t = t.withColumns({"temp_ffill": F.col("temp"), "temp_bfill": F.col("temp")})
    t = blocked_fill(materialize(t), ["site"], "_pos", {"temp_ffill": "ffill", "temp_bfill": "bfill"})
    return rounded(t.select("site", "ts", "temp_ffill", "temp_bfill"))


# ---------------------------------------------------------------- actual vs predicted (orders ⟕ lineitem)

MODELS = ("gross", "net", "charge")
PRICE_SCALE = 0.001  # prices in thousands


def order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual = o_totalprice; three 'model predictions' = per-order line sums. site =
    o_orderpriority (5), scenario = o_orderstatus (3): 15 series like the reference's 3x5."""
    o = load(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus",
                                       "o_totalprice"])
    l = load(spark, sf_dir, "lineitem", ["l_orderkey", "l_extendedprice", "l_discount", "l_tax"])
    k = F.lit(PRICE_SCALE)
    ext = F.col("l_extendedprice") * k
    net = ext * (1 - F.col("l_discount"))
    agg = l.groupBy("l_orderkey").agg(F.sum(ext).alias("gross"), F.sum(net).alias("net"),
                                      F.sum(net * (1 + F.col("l_tax"))).alias("charge"))
    return (o.join(agg, o.o_orderkey == agg.l_orderkey, "left")
            .select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"),
                    F.col("o_orderpriority").alias("site"), F.col("o_orderstatus").alias("scenario"),
                    (F.col("o_totalprice") * k).alias("actual"), *MODELS))


def long_pairs(spark, sf_dir):
    return reshape.unpivot(order_pairs(spark, sf_dir), ["id", "ts", "site", "scenario", "actual"], MODELS,
                           "model", "pred")


_K = D(PRICE_SCALE)
SQL_PAIRS = f"""
pairs AS (SELECT o_orderkey AS id, o_orderdate AS ts, o_orderpriority AS site, o_orderstatus AS scenario,
                 o_totalprice * {_K} AS actual, l.gross, l.net, l.charge
          FROM orders o LEFT JOIN (
            SELECT l_orderkey, sum(l_extendedprice * {_K}) AS gross, sum(l_extendedprice * {_K} * (1 - l_discount)) AS net,
                   sum(l_extendedprice * {_K} * (1 - l_discount) * (1 + l_tax)) AS charge
            FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey),
lp AS (SELECT id, ts, site, scenario, actual, 'gross' AS model, gross AS pred FROM pairs
       UNION ALL SELECT id, ts, site, scenario, actual, 'net', net FROM pairs
       UNION ALL SELECT id, ts, site, scenario, actual, 'charge', charge FROM pairs)"""

_E = "(pred - actual)"
SQL_ERR = (f"CAST(count({_E}) AS BIGINT) AS n, {R(f'avg({_E}*{_E})', 'mse')}, {R(f'sqrt(avg({_E}*{_E}))', 'rmse')}, "
           f"{R(f'avg(abs({_E}))', 'mae')}, "
           f"{R(f'1 - sum({_E}*{_E}) / (count({_E}) * var_pop(CASE WHEN pred IS NOT NULL THEN actual END))', 'r2')}")


@register("unpivot_models", f"""WITH {SQL_PAIRS}
SELECT id, site, scenario, model, {R('actual', 'actual')}, {R('pred', 'pred')} FROM lp""")
def q_unpivot_models(spark, sf_dir):
    """V2 + U1: wide predictions -> long (model, pred)."""
    return rounded(long_pairs(spark, sf_dir).select("id", "site", "scenario", "model", "actual", "pred"))


@register("error_metrics", f"""WITH {SQL_PAIRS}
SELECT model, {SQL_ERR} FROM lp GROUP BY model""")
def q_error_metrics(spark, sf_dir):
    """A7 + A8 + A11: n, MSE, RMSE, MAE, R2 (1 - SSE/SST) per model, one aggregation."""
    return rounded(long_pairs(spark, sf_dir).groupBy("model").agg(*metrics.error_metric_columns("actual", "pred")))


@register("site_metrics", f"""WITH {SQL_PAIRS}
SELECT site, scenario, model, {SQL_ERR} FROM lp GROUP BY site, scenario, model""")
def q_site_metrics(spark, sf_dir):
    """Accuracy per (site, scenario, model), the shape of the published metrics table."""
    lp = long_pairs(spark, sf_dir)
    return rounded(lp.groupBy("site", "scenario", "model").agg(*metrics.error_metric_columns("actual", "pred")))


@register("nse_bias_corr", f"""WITH {SQL_PAIRS}
SELECT model, {R(f'1 - sum({_E}*{_E}) / (count({_E}) * var_pop(CASE WHEN pred IS NOT NULL THEN actual END))', 'nse')},
       {R(f'avg({_E})', 'bias')}, {R('corr(actual, pred)', 'r')}, {R('corr(actual, pred) * corr(actual, pred)', 'r2_corr')}
FROM lp GROUP BY model""")
def q_nse_bias_corr(spark, sf_dir):
    """A9 + A10: NSE, mean bias, Pearson r and squared correlation per model."""
    return rounded(long_pairs(spark, sf_dir).groupBy("model").agg(*metrics.agreement_columns("actual", "pred")))


@register("taylor_stats", f"""WITH {SQL_PAIRS}
SELECT model, {R('stddev_samp(actual)', 'sd_obs')}, {R('stddev_samp(pred)', 'sd_sim')},
       {R('corr(actual, pred)', 'r')}, {R(f'stddev_pop({_E})', 'crmsd')} FROM lp GROUP BY model""")
def q_taylor_stats(spark, sf_dir):
    """Taylor diagram statistics per model."""
    return rounded(metrics.taylor_stats(long_pairs(spark, sf_dir), ["model"], "actual", "pred"))


@register("fit_line", f"""WITH {SQL_PAIRS}
SELECT model, {R('regr_slope(pred, actual)', 'slope')}, {R('regr_intercept(pred, actual)', 'intercept')},
       {R('regr_r2(pred, actual)', 'fit_r2')} FROM lp GROUP BY model""")
def q_fit_line(spark, sf_dir):
    """Least-squares line prediction ~ actual per model."""
    return rounded(metrics.fit_line(long_pairs(spark, sf_dir), ["model"], "actual", "pred"))


@register("residual_histogram", f"""WITH {SQL_PAIRS},
e AS (SELECT model, pred - actual AS e FROM lp WHERE pred IS NOT NULL),
b AS (SELECT model, min(e) AS lo, max(e) AS hi FROM e GROUP BY model),
x AS (SELECT e.model, b.lo, (b.hi - b.lo) / {D(60.0)} AS w, e.e FROM e JOIN b ON e.model = b.model),
y AS (SELECT model, lo, w, CAST(CASE WHEN w > 0 THEN least(floor((e - lo) / w), 59) ELSE 0 END AS INTEGER) AS bin FROM x)
SELECT model, bin, CAST(count(*) AS BIGINT) AS count, {R('min(lo + bin * w)', 'bin_lo')} FROM y GROUP BY model, bin""")
def q_residual_histogram(spark, sf_dir):
    """Residual histogram, 60 equal-width bins per model."""
    lp = long_pairs(spark, sf_dir).withColumn("e", F.col("pred") - F.col("actual"))
    return rounded(metrics.residual_histogram(lp, ["model"], "e", 60))


@register("zscore_metrics", f"""WITH {SQL_PAIRS},
m AS (SELECT model, sqrt(avg({_E}*{_E})) AS rmse, avg(abs({_E})) AS mae,
             1 - sum({_E}*{_E}) / (count({_E}) * var_pop(CASE WHEN pred IS NOT NULL THEN actual END)) AS r2
      FROM lp GROUP BY model)
SELECT model, {', '.join(R(f'({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()', f'z_{c}') for c in ('rmse', 'mae', 'r2'))}
FROM m""")
def q_zscore_metrics(spark, sf_dir):
    """Z-scores of the per-model metrics (radar chart data)."""
    m = long_pairs(spark, sf_dir).groupBy("model").agg(*metrics.error_metric_columns("actual", "pred"))
    return rounded(metrics.zscore(m.select("model", "rmse", "mae", "r2"), ["rmse", "mae", "r2"]))


@register("pivot_site_metric", f"""WITH {SQL_PAIRS},
m AS (SELECT site, model, 1 - sum({_E}*{_E}) / (count({_E}) * var_pop(CASE WHEN pred IS NOT NULL THEN actual END)) AS r2
      FROM lp GROUP BY site, model)
SELECT site, {', '.join(R(f"max(CASE WHEN model = '{m}' THEN r2 END)", m) for m in MODELS)} FROM m GROUP BY site""")
def q_pivot_site_metric(spark, sf_dir):
    """V1: site x model R2 table."""
    m = long_pairs(spark, sf_dir).groupBy("site", "model").agg(*metrics.error_metric_columns("actual", "pred"))
    return rounded(reshape.pivot(m, ["site"], "model", MODELS, "r2"))


@register("clip_negative", f"""WITH {SQL_PAIRS}
SELECT id, {R('CASE WHEN net - actual < 0 THEN 0.0 ELSE net - actual END', 'excess')} FROM pairs""")
def q_clip_negative(spark, sf_dir):
    """P8 + P9: residual clipped at 0; NULL (orders without lines) stays NULL."""
    p = order_pairs(spark, sf_dir)
    r = F.col("net") - F.col("actual")
    return rounded(p.select("id", F.when(r < 0, F.lit(0.0)).otherwise(r).alias("excess")))


def _season_sql(ts: str) -> str:
    return (f"CASE WHEN month({ts}) IN (12, 1, 2) THEN 'Summer' WHEN month({ts}) IN (3, 4, 5) THEN 'Autumn' "
            f"WHEN month({ts}) IN (6, 7, 8) THEN 'Winter' ELSE 'Spring' END")


@register("season_year_mean", f"""WITH {SQL_PAIRS}
SELECT CAST(year(ts) AS INTEGER) AS year, {_season_sql('ts')} AS season, {R('avg(actual)', 'mean_actual')},
       {R('avg(net)', 'mean_net')},
       CAST(CASE {_season_sql('ts')} WHEN 'Summer' THEN 1 WHEN 'Autumn' THEN 2 WHEN 'Winter' THEN 3 ELSE 4 END AS INTEGER) AS season_order
FROM pairs GROUP BY 1, 2, 5""")
def q_season_year_mean(spark, sf_dir):
    """A4 + P17: mean per (year, NZ season)."""
    return rounded(reshape.season_year_mean(order_pairs(spark, sf_dir), "ts", ["actual", "net"]))


@register("month_mean", f"""WITH {SQL_PAIRS}
SELECT CAST(month(ts) AS INTEGER) AS month, {R('avg(actual)', 'mean_actual')}, {R('avg(net)', 'mean_net')},
       strftime(make_date(2000, month(ts), 1), '%b') AS month_label
FROM pairs GROUP BY 1, 4""")
def q_month_mean(spark, sf_dir):
    """A5 + F10: mean per calendar month with its label."""
    return rounded(reshape.month_mean(order_pairs(spark, sf_dir), "ts", ["actual", "net"]))


@register("high_inflow_flag", f"""WITH {SQL_PAIRS},
q AS (SELECT site, quantile_cont(actual, 0.9) AS threshold FROM pairs GROUP BY site)
SELECT p.site, {R('q.threshold', 'threshold')}, CAST(count_if(p.actual > q.threshold) AS BIGINT) AS n_high,
       CAST(count(*) AS BIGINT) AS n
FROM pairs p JOIN q ON p.site = q.site GROUP BY p.site, q.threshold""")
def q_high_inflow_flag(spark, sf_dir):
    """A6 + P18: exact 0.9 quantile (type 7) per site, rows above it flagged and counted.
    The quantile is found by histogram refinement, never by sorting a site in one task."""
    p = order_pairs(spark, sf_dir)
    t = ranking.quantile_type7(p, ["site"], "actual", 0.9, "threshold")
    j = attach(p, t, ["site"])
    return rounded(j.groupBy("site", "threshold").agg(
        F.sum((F.col("actual") > F.col("threshold")).cast("long")).alias("n_high"),
        F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- splits

def _h_sql(key: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5(concat_ws('|', CAST({key} AS VARCHAR), '{seed}')), 1, 8))::UBIGINT"


@register("time_split_counts", f"""WITH {SQL_HOURLY},
s AS (SELECT site, Rainfall, CASE WHEN rn - 1 < floor(count(*) OVER (PARTITION BY site) * {D(0.8)}) THEN 'train' ELSE 'test' END AS split FROM hr)
SELECT site, split, CAST(count(*) AS BIGINT) AS n, {R('sum(Rainfall)', 'rain')} FROM s GROUP BY site, split""")
def q_time_split_counts(spark, sf_dir):
    """First 80% of each series by time is train."""
    s = split.time_split(hourly_rain(spark, sf_dir), ["site"], "ts", 0.8, pos="hid")
    return rounded(s.groupBy("site", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("Rainfall").alias("rain")))


@register("hash_split_counts", f"""
SELECT CASE WHEN {_h_sql('o_orderkey')} < {D(0.8 * 2 ** 32)} THEN 'train' ELSE 'test' END AS split,
       CAST(count(*) AS BIGINT) AS n, {R('sum(o_totalprice)', 'total')}
FROM orders GROUP BY 1""")
def q_hash_split_counts(spark, sf_dir):
    """M2: seeded 80/20 split by md5 prefix of the key."""
    o = load(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"])
    s = split.hash_split(o, ["o_orderkey"], 0.8, 42)
    return rounded(s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")))


_LKC = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")  # the row key of lineitem
_LK = "concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in _LKC) + ")"


@register("stratified_split", f"""
WITH l AS (SELECT coalesce(CAST(l_linenumber AS INTEGER), 0) AS stratum, {_LK} AS k, l_quantity FROM lineitem),
r AS (SELECT stratum, k, l_quantity,
             row_number() OVER (PARTITION BY stratum ORDER BY {_h_sql('k')}, k) - 1 AS rk,
             count(*) OVER (PARTITION BY stratum) AS n FROM l)
SELECT stratum, CASE WHEN rk < floor(n * {D(0.7)}) THEN 'train' ELSE 'test' END AS split,
       CAST(count(*) AS BIGINT) AS n, {R('sum(l_quantity)', 'qty')}
FROM r GROUP BY 1, 2""")
def q_stratified_split(spark, sf_dir):
    """M3 + P19: exact 70% train per stratum (l_linenumber), rows chosen by hash rank."""
    l = load(spark, sf_dir, "lineitem", [*_LKC, "l_quantity"])
    l = l.withColumn("k", F.concat_ws("|", *[F.col(c).cast("string") for c in _LKC]))
    s = split.stratified_split(l, "l_linenumber", "k", 0.7, 42)
    return rounded(s.groupBy(F.coalesce(F.col("l_linenumber").cast("int"), F.lit(0)).alias("stratum"), "split")
                   .agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty")))


@register("kfold_assign", f"""
SELECT CAST({_h_sql('o_orderkey')} % 5 AS INTEGER) AS fold, CAST(count(*) AS BIGINT) AS n,
       {R('sum(o_totalprice)', 'total')} FROM orders GROUP BY 1""")
def q_kfold_assign(spark, sf_dir):
    """M4: 5 folds by hash."""
    o = load(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"])
    f = split.kfold(o, ["o_orderkey"], 5, 42)
    return rounded(f.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")))


@register("month_sample", f"""
WITH o AS (SELECT o_orderkey, o_orderdate, strftime(o_orderdate, '%Y-%m') AS ym FROM orders),
m AS (SELECT ym, count(*) AS nm FROM o GROUP BY ym),
c AS (SELECT ym, nm, greatest(1, floor(5000 / count(*) OVER ())) AS cap FROM m),
r AS (SELECT o.*, c.nm, c.cap, row_number() OVER (PARTITION BY o.ym ORDER BY {_h_sql('o.o_orderkey')}, o.o_orderkey) - 1 AS rk
      FROM o JOIN c ON o.ym = c.ym)
SELECT o_orderkey, o_orderdate FROM r WHERE rk < least(nm, cap)""")
def q_month_sample(spark, sf_dir):
    """Month-stratified sample of about 5,000 rows, hash-ranked per month."""
    o = load(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"])
    return split.month_sample(o, "o_orderdate", "o_orderkey", 5000, 42).select("o_orderkey", "o_orderdate")


# ---------------------------------------------------------------- forecast ablation (L8 vote, A3, A19, A20, W14)

from ..operators import tsstats  # noqa: E402

# Fixed order of the cumulative feature groups (order matters: groups are added one by one).
ABL_GROUPS = ("lag1", "lag2", "mean2h", "mean5h", "mean11h", "mean23h", "mean47h")
ABL_ALGOS = ("MEAN", "MAX", "MIN", "MID")


def _abl_features(spark, sf_dir) -> DataFrame:
    """Per-hour-rate rain features of the previous hours (no fill, rows with a NULL dropped)."""
    h = hourly_rain(spark, sf_dir).withColumn("_pos", cal.hour_id("ts"))
    r = "Rainfall"

    def build(w):
        cols = {"f1": windows.lag(r, 1, w), "f2": windows.lag(r, 2, w)}
        for i, n in enumerate((3, 6, 12, 24, 48), start=3):
            cols[f"f{i}"] = (windows.rolling_full(r, n, w) - F.col(r)) / F.lit(float(n - 1))
        return cols

    d = with_series_windows(h, ["site"], "_pos", build, halo=47)
    return d.dropna(subset=[f"f{i}" for i in range(1, 8)])


def _abl_preds(k: int) -> dict[str, Column]:
    fs = [F.col(f"f{i}") for i in range(1, k + 1)]
    tot = fs[0]
    for f in fs[1:]:
        tot = tot + f
    mx = F.greatest(*fs) if k > 1 else fs[0]
    mn = F.least(*fs) if k > 1 else fs[0]
    return {"MEAN": tot / F.lit(float(k)), "MAX": mx, "MIN": mn, "MID": (mx + mn) / F.lit(2.0)}


def forecast_ablation_table(spark, sf_dir) -> DataFrame:
    """Long ablation table: site, step, feature_group, n_features, algorithm, rmse, mae.
    All 7 x 4 predictors are columns of one pass; ONE grouped aggregation computes every
    error sum; the small result is reshaped with an explode."""
    d = _abl_features(spark, sf_dir)
    aggs, cells = [], []
    for k in range(1, len(ABL_GROUPS) + 1):
        for a, p in _abl_preds(k).items():
            e = p - F.col("Rainfall")
            aggs += [F.sum(e * e).alias(f"_se_{k}_{a}"), F.sum(F.abs(e)).alias(f"_ae_{k}_{a}")]
            cells.append(F.struct(F.lit(k).alias("step"), F.lit(ABL_GROUPS[k - 1]).alias("feature_group"),
                                  F.lit(k).alias("n_features"), F.lit(a).alias("algorithm"),
                                  F.sqrt(F.col(f"_se_{k}_{a}") / F.col("_n")).alias("rmse"),
                                  (F.col(f"_ae_{k}_{a}") / F.col("_n")).alias("mae")))
    g = d.groupBy("site").agg(F.count(F.lit(1)).alias("_n"), *aggs)
    return g.select("site", F.explode(F.array(*cells)).alias("_c")).select("site", "_c.*")


def _sql_abl_feats() -> str:
    fs = ", ".join([f"lag(Rainfall, 1) {_w()} AS f1", f"lag(Rainfall, 2) {_w()} AS f2"]
                   + [f"({_roll('Rainfall', n)} - Rainfall) / {D(float(n - 1))} AS f{i}"
                      for i, n in enumerate((3, 6, 12, 24, 48), start=3)])
    return f"af0 AS (SELECT site, ts, Rainfall, {fs} FROM hr), af AS (SELECT * FROM af0 WHERE " + \
        " AND ".join(f"f{i} IS NOT NULL" for i in range(1, 8)) + ")"


def _sql_pred(k: int, a: str) -> str:
    fs = [f"f{i}" for i in range(1, k + 1)]
    mx = f"greatest({', '.join(fs)})" if k > 1 else fs[0]
    mn = f"least({', '.join(fs)})" if k > 1 else fs[0]
    return {"MEAN": f"({' + '.join(fs)}) / {D(float(k))}", "MAX": mx, "MIN": mn,
            "MID": f"({mx} + {mn}) / {D(2.0)}"}[a]


def _sql_abl() -> str:
    sums = ", ".join(f"sum(({_sql_pred(k, a)} - Rainfall) * ({_sql_pred(k, a)} - Rainfall)) AS se_{k}_{a}, "
                     f"sum(abs({_sql_pred(k, a)} - Rainfall)) AS ae_{k}_{a}"
                     for k in range(1, 8) for a in ABL_ALGOS)
    rows = " UNION ALL ".join(
        f"SELECT site, {k} AS step, '{ABL_GROUPS[k - 1]}' AS feature_group, {k} AS n_features, '{a}' AS algorithm, "
        f"sqrt(se_{k}_{a} / n) AS rmse, ae_{k}_{a} / n AS mae FROM ag"
        for k in range(1, 8) for a in ABL_ALGOS)
    return (f"{_sql_abl_feats()}, ag AS (SELECT site, count(*) AS n, {sums} FROM af GROUP BY site), "
            f"abl AS ({rows}), "
            f"eff AS (SELECT *, coalesce(rmse < lag(rmse) OVER (PARTITION BY site, algorithm ORDER BY step), true) "
            f"AND coalesce(mae < lag(mae) OVER (PARTITION BY site, algorithm ORDER BY step), true) AS eff FROM abl), "
            f"votes AS (SELECT site, step, feature_group, n_features, CAST(sum(CAST(eff AS INTEGER)) AS BIGINT) AS n_effective, "
            f"sum(CAST(eff AS INTEGER)) >= 3 AS consensus FROM eff GROUP BY site, step, feature_group, n_features)")


SQL_ABL = _sql_abl()


@register("forecast_ablation", f"""WITH {SQL_HOURLY}, {SQL_ABL}
SELECT site, CAST(step AS INTEGER) AS step, feature_group, CAST(n_features AS INTEGER) AS n_features, algorithm,
       {R('rmse', 'rmse')}, {R('mae', 'mae')} FROM abl""")
def q_forecast_ablation(spark, sf_dir):
    """L8 metrics: cumulative feature groups x 4 naive forecasters, RMSE/MAE per site."""
    return rounded(forecast_ablation_table(spark, sf_dir))


@register("ablation_votes", f"""WITH {SQL_HOURLY}, {SQL_ABL}
SELECT site, CAST(step AS INTEGER) AS step, feature_group, CAST(n_features AS INTEGER) AS n_features,
       n_effective, consensus FROM votes""")
def q_ablation_votes(spark, sf_dir):
    """A20 + L8: effective when RMSE and MAE both fell vs the previous step; consensus >= 3 of 4."""
    v = reshape.consensus_from_ablation(forecast_ablation_table(spark, sf_dir), ["site"])
    return v.select("site", "step", "feature_group", "n_features", F.col("n_effective").cast("long"), "consensus")


@register("consensus_summary", f"""WITH {SQL_HOURLY}, {SQL_ABL}
SELECT feature_group, {R('avg(CAST(consensus AS DOUBLE)) * 100', 'consensus_pct')},
       CAST(min(n_features) AS INTEGER) AS n_features, {R('avg(n_effective)', 'avg_n_effective')}
FROM votes GROUP BY feature_group""")
def q_consensus_summary(spark, sf_dir):
    """A3: % of series with consensus per feature group, n_features, mean n_effective."""
    v = reshape.consensus_from_ablation(forecast_ablation_table(spark, sf_dir), ["site"])
    return rounded(reshape.consensus_summary(v))


@register("improvement_pct", f"""WITH {SQL_HOURLY}, {SQL_ABL}
SELECT site, algorithm, {R('arg_min(rmse, step)', 'first_rmse')}, {R('arg_max(rmse, step)', 'last_rmse')},
       {R('(arg_min(rmse, step) - arg_max(rmse, step)) / arg_min(rmse, step) * 100', 'improvement_pct')}
FROM abl GROUP BY site, algorithm""")
def q_improvement_pct(spark, sf_dir):
    """W15 + A19: first vs last step of each (site, algorithm), improvement %."""
    a = forecast_ablation_table(spark, sf_dir)
    g = a.groupBy("site", "algorithm").agg(F.min_by("rmse", "step").alias("first_rmse"),
                                           F.max_by("rmse", "step").alias("last_rmse"))
    return rounded(g.withColumn("improvement_pct", metrics.improvement_pct(F.col("first_rmse"), F.col("last_rmse"))))


@register("best_algorithm", f"""WITH {SQL_HOURLY}, {SQL_ABL}
SELECT site, first(algorithm ORDER BY rmse, algorithm) AS best_algorithm, {R('min(rmse)', 'best_rmse')}
FROM abl WHERE step = 7 GROUP BY site""")
def q_best_algorithm(spark, sf_dir):
    """Argmin of RMSE over algorithms at the last step (ties by name)."""
    a = forecast_ablation_table(spark, sf_dir).where(F.col("step") == len(ABL_GROUPS))
    return rounded(a.groupBy("site").agg(
        F.min_by("algorithm", F.struct("rmse", "algorithm")).alias("best_algorithm"),
        F.min("rmse").alias("best_rmse")))


# ---------------------------------------------------------------- ACF

ACF_LAGS = 48


def rain_acf(spark, sf_dir) -> DataFrame:
    h = hourly_rain(spark, sf_dir).withColumn("_pos", cal.hour_id("ts"))
    return tsstats.acf(h, ["site"], "_pos", "Rainfall", ACF_LAGS)


def _sql_acf() -> str:
    prods = ", ".join(f"x * lag(x, {k}) {_w()} AS p{k}" for k in range(1, ACF_LAGS + 1))
    sums = ", ".join(f"sum(p{k}) AS s{k}" for k in range(1, ACF_LAGS + 1))
    rows = " UNION ALL ".join([f"SELECT site, n, 0 AS lag, 1.0 AS acf FROM sa"]
                              + [f"SELECT site, n, {k}, s{k} / s0 FROM sa" for k in range(1, ACF_LAGS + 1)])
    return (f"cx AS (SELECT site, ts, Rainfall - avg(Rainfall) OVER (PARTITION BY site) AS x FROM hr), "
            f"px AS (SELECT site, x * x AS p0, {prods} FROM cx), "
            f"sa AS (SELECT site, count(*) AS n, sum(p0) AS s0, {sums} FROM px GROUP BY site), "
            f"acf AS ({rows})")


SQL_ACF = _sql_acf()


@register("acf", f"""WITH {SQL_HOURLY}, {SQL_ACF}
SELECT site, CAST(n AS BIGINT) AS n, CAST(lag AS INTEGER) AS lag, {R('acf', 'acf')} FROM acf""")
def q_acf(spark, sf_dir):
    """Biased autocorrelation of hourly rain, lags 0..48, per site."""
    return rounded(rain_acf(spark, sf_dir))


@register("acf_significant", f"""WITH {SQL_HOURLY}, {SQL_ACF}
SELECT site, CAST(n AS BIGINT) AS n,
       CAST(sum(CASE WHEN lag BETWEEN 1 AND 24 AND abs(acf) > 1.96 / sqrt(n) THEN 1 ELSE 0 END) AS INTEGER) AS sig_lags,
       {R('1.96 / sqrt(n)', 'band')},
       sum(CASE WHEN lag BETWEEN 1 AND 24 AND abs(acf) > 1.96 / sqrt(n) THEN 1 ELSE 0 END) < 17 AS acf_decays
FROM acf GROUP BY site, n""")
def q_acf_significant(spark, sf_dir):
    """Y3 + Y6 (ACF part): lags 1..24 outside 1.96/sqrt(n); decays when fewer than 17."""
    s = tsstats.acf_significance(rain_acf(spark, sf_dir), ["site"])
    return rounded(s.select("site", "n", F.col("sig_lags").cast("int"), "band", "acf_decays"))


# ---------------------------------------------------------------- lookups and job matrix

@register("per_capita", f"""
WITH pop AS (SELECT c_nationkey AS nation, count(*) AS population FROM customer GROUP BY 1),
fl AS (SELECT c.c_nationkey AS nation, o.o_orderdate AS ts, sum(o.o_totalprice * {D(PRICE_SCALE)}) AS flow
       FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2)
SELECT fl.nation, fl.ts, {R('fl.flow', 'flow')},
       {R(f'abs(fl.flow) * {D(3600.0)} / pop.population', 'per_capita')}
FROM fl LEFT JOIN pop ON fl.nation = pop.nation""")
def q_per_capita(spark, sf_dir):
    """Per-capita flow abs(q) * 3600 / population where the lookup knows the site."""
    o = load(spark, sf_dir, "orders", ["o_custkey", "o_orderdate", "o_totalprice"])
    c = load(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    pop = c.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("population"))
    fl = (o.join(c, o.o_custkey == c.c_custkey)
          .groupBy(F.col("c_nationkey").alias("nation"), F.col("o_orderdate").alias("ts"))
          .agg(F.sum(F.col("o_totalprice") * F.lit(PRICE_SCALE)).alias("flow")))
    j = fl.join(pop, "nation", "left")
    return rounded(j.select("nation", "ts", "flow",
                            (F.abs(F.col("flow")) * F.lit(3600.0) / F.col("population")).alias("per_capita")))


# Run status codes a scoring job can end with (job matrix suffixes).
JOB_SUFFIXES = ("F", "O", "P", "Q", "R")


@register("job_matrix_anti", f"""
WITH s AS (SELECT DISTINCT o_orderpriority AS site FROM orders),
m AS (SELECT site, unnest(['{"', '".join(JOB_SUFFIXES)}']) AS scenario FROM s),
done AS (SELECT DISTINCT o_orderpriority AS site, o_orderstatus AS scenario FROM orders)
SELECT m.site, m.scenario FROM m ANTI JOIN done ON m.site = done.site AND m.scenario = done.scenario""")
def q_job_matrix_anti(spark, sf_dir):
    """J5 + J6: every site x suffix, minus the combinations that already have output."""
    o = load(spark, sf_dir, "orders", ["o_orderpriority", "o_orderstatus"])
    sites = o.select(F.col("o_orderpriority").alias("site")).distinct()
    m = joins.job_matrix(sites, "scenario", JOB_SUFFIXES)
    done = o.select(F.col("o_orderpriority").alias("site"), F.col("o_orderstatus").alias("scenario"))
    return joins.pending_jobs(m, done, ["site", "scenario"])


@register("theta_first_match", """
WITH l AS (SELECT s_suppkey, s_nationkey, s_name, s_nationkey % 5 AS grp FROM supplier),
r AS (SELECT n_nationkey, n_name, n_nationkey % 5 AS grp, CAST(n_nationkey % 7 AS VARCHAR) AS tag FROM nation),
c AS (SELECT s_suppkey, min(n_nationkey) AS k FROM l JOIN r ON l.grp = r.grp WHERE contains(s_name, tag) GROUP BY s_suppkey)
SELECT l.s_suppkey, l.s_nationkey, c.k AS match_n_nationkey, r.n_name AS match_n_name
FROM l LEFT JOIN c ON l.s_suppkey = c.s_suppkey LEFT JOIN r ON c.k = r.n_nationkey""")
def q_theta_first_match(spark, sf_dir):
    """Equal key AND the listing entry's tag is a substring of the name; of up to five candidates per row the
    first by listing order, with its columns; unmatched rows kept with NULL (never reusing a previous match)."""
    s = load(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey", "s_name"]).withColumn("grp", F.col("s_nationkey") % 5)
    n = load(spark, sf_dir, "nation", ["n_nationkey", "n_name"]).withColumns(
        {"grp": F.col("n_nationkey") % 5, "tag": (F.col("n_nationkey") % 7).cast("string")})
    out = joins.first_match(s, n, ["grp"], F.col("s_name").contains(F.col("tag")), "n_nationkey", "s_suppkey")
    return out.select("s_suppkey", "s_nationkey", "match_n_nationkey", "match_n_name")


@register("leap_free_calendar", f"""
WITH b AS (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders),
g AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ts FROM b),
d AS (SELECT o_orderdate AS ts, sum(o_totalprice * {D(PRICE_SCALE)}) AS total, count(*) AS n FROM orders GROUP BY 1)
SELECT g.ts, {R('coalesce(d.total, 0.0)', 'total')}, CAST(coalesce(d.n, 0) AS BIGINT) AS n_orders
FROM g LEFT JOIN d ON g.ts = d.ts WHERE NOT (month(g.ts) = 2 AND day(g.ts) = 29)""")
def q_leap_free_calendar(spark, sf_dir):
    """F11 + P16 + A1 (daily): gap-free daily grid without 29 February, zero-filled totals."""
    o = load(spark, sf_dir, "orders", ["o_orderdate", "o_totalprice"])
    b = o.agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    g = b.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("ts")) \
         .where(~cal.is_leap_day("ts"))
    d = o.groupBy(F.col("o_orderdate").alias("ts")).agg(
        F.sum(F.col("o_totalprice") * F.lit(PRICE_SCALE)).alias("total"), F.count(F.lit(1)).alias("n"))
    j = g.join(d, "ts", "left")
    return rounded(j.select("ts", F.coalesce("total", F.lit(0.0)).alias("total"),
                            F.coalesce("n", F.lit(0)).cast("long").alias("n_orders")))


@register("top_features", f"""
SELECT p.p_name AS feature, {R(f'avg(l.l_extendedprice * {D(PRICE_SCALE)})', 'importance')}
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
GROUP BY p.p_name ORDER BY avg(l.l_extendedprice * {D(PRICE_SCALE)}) DESC, p.p_name LIMIT 10""")
def q_top_features(spark, sf_dir):
    """A16 + R1: mean score per feature, top 10 (ties by name)."""
    l = load(spark, sf_dir, "lineitem", ["l_partkey", "l_extendedprice"])
    p = load(spark, sf_dir, "part", ["p_partkey", "p_name"])
    m = (l.join(p, l.l_partkey == p.p_partkey).groupBy(F.col("p_name").alias("feature"))
         .agg(F.avg(F.col("l_extendedprice") * F.lit(PRICE_SCALE)).alias("importance")))
    return rounded(reshape.top_n(m, "importance", 10, "feature"))


def _sql_greedy() -> str:
    """The search of L14 over its possible outcomes: (1), (1/2, 1/2), (1/4, 1/4, 1/2), the last one added last."""
    k = range(len(MODELS))
    sums = [f"sum(actual * {m}) AS y{i}" for i, m in enumerate(MODELS)] + [
        f"sum({MODELS[i]} * {MODELS[j]}) AS s{i}{j}" for i in k for j in k if i <= j]
    rows = []
    for order in [(i,) for i in k] + [(i, j) for i in k for j in k if i != j] + [
            (i, j, x) for i in k for j in k for x in k if len({i, j, x}) == 3]:
        w = dict.fromkeys(k, 0.0) | dict(zip(order, {1: (1.0,), 2: (0.5, 0.5), 3: (0.25, 0.25, 0.5)}[len(order)]))
        spp = " + ".join(f"{D(w[i] * w[j])} * s{min(i, j)}{max(i, j)}" for i in order for j in order)
        syp = " + ".join(f"{D(w[i])} * y{i}" for i in order)
        path = [*order, -1, -1][:3]
        rows.append(f"SELECT {len(order)} AS step, {path[0]} AS a, {path[1]} AS b, {path[2]} AS c, "
                    + ", ".join(f"{D(w[i])} AS w{i}" for i in k) + f", 1 - (syy - 2 * ({syp}) + {spp}) / (syy - sy * sy / n) AS r2 FROM g")
    out = " UNION ALL ".join(f"SELECT '{m}' AS model, w{i} AS weight, {R('r2', 'r2')} FROM best" for i, m in enumerate(MODELS))
    ok = " AND ".join(f"{m} IS NOT NULL" for m in MODELS)
    return (f"WITH {SQL_PAIRS}, g AS (SELECT count(*) AS n, sum(actual) AS sy, sum(actual * actual) AS syy, {', '.join(sums)} "
            f"FROM pairs WHERE {ok}), t AS ({' UNION ALL '.join(rows)}), "
            "s1 AS (SELECT * FROM t WHERE step = 1 ORDER BY r2 DESC, a LIMIT 1), "
            "s2 AS (SELECT t.* FROM t, s1 WHERE t.step = 2 AND t.a = s1.a AND t.r2 > s1.r2 ORDER BY t.r2 DESC, t.b LIMIT 1), "
            "s3 AS (SELECT t.* FROM t, s2 WHERE t.step = 3 AND t.a = s2.a AND t.b = s2.b AND t.r2 > s2.r2 ORDER BY t.r2 DESC LIMIT 1), "
            "best AS (SELECT * FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3) ORDER BY step DESC LIMIT 1) "
            + out)


@register("greedy_weights", _sql_greedy())
def q_greedy_weights(spark, sf_dir):
    """Greedy forward ensemble weights of the three predictors maximising R2. The data
    pass is ONE aggregation (Gramian); the search runs on its 15 numbers on the driver."""
    p = order_pairs(spark, sf_dir).dropna(subset=list(MODELS))
    g = metrics.gramian(p, "actual", MODELS).first().asDict()
    w, r2 = metrics.halving_weights(g, MODELS)
    return rounded(spark.createDataFrame([(m, float(x), float(r2)) for m, x in zip(MODELS, w)],
                                         "model string, weight double, r2 double"))


# ---------------------------------------------------------------- data profile (Q1, Q3, Q4, Q7, Q8, Q10-Q12, Q14)

from ..operators import profile  # noqa: E402

PROF_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
PROF_ALL = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *PROF_NUM, "l_returnflag", "l_linestatus",
            "l_shipdate")


def _lineitem(spark, sf_dir, cols=PROF_ALL):
    return load(spark, sf_dir, "lineitem", list(cols))


def _union_cols(cols, body) -> str:
    return " UNION ALL ".join(body(c) for c in cols)


@register("profile_missing", "SELECT * FROM (" + _union_cols(PROF_ALL, lambda c: (
    f"SELECT '{c}' AS column, CAST(sum(CASE WHEN {c} IS NULL"
    + (f" OR trim({c}) = ''" if c in ("l_returnflag", "l_linestatus") else "")
    + (f" OR isnan({c})" if c in PROF_NUM else "")
    + f" THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, "
    + R(f"sum(CASE WHEN {c} IS NULL" + (f" OR trim({c}) = ''" if c in ("l_returnflag", "l_linestatus") else "")
        + (f" OR isnan({c})" if c in PROF_NUM else "") + " THEN 1 ELSE 0 END) * 100.0 / count(*)", "missing_pct")
    + " FROM lineitem")) + ")")
def q_profile_missing(spark, sf_dir):
    """Q10: missing-value share per column (NULL, NaN, blank strings)."""
    return rounded(profile.missing_ranking(_lineitem(spark, sf_dir)))


@register("profile_cardinality", "SELECT * FROM (" + _union_cols(PROF_ALL, lambda c: (
    f"SELECT '{c}' AS column, CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique FROM lineitem")) + ")")
def q_profile_cardinality(spark, sf_dir):
    """Q11: exact distinct count per column."""
    return profile.cardinality_ranking(_lineitem(spark, sf_dir))


def _sql_describe(c: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    return (f"SELECT '{c}' AS column, CAST(count({x}) AS BIGINT) AS n, {R(f'avg({x})', 'mean')}, "
            f"{R(f'(max(mm.t) - count({x})) * 100.0 / max(mm.t)', 'missing_pct')}, "
            f"{R(f'min({x})', 'min')}, {R(f'max({x})', 'max')}, {R(f'stddev_pop({x})', 'std')}, "
            f"{R(f'avg(power({x} - m, 3)) / power(avg(power({x} - m, 2)), 1.5)', 'skew')}, "
            f"{R(f'avg(power({x} - m, 4)) / power(avg(power({x} - m, 2)), 2)', 'kurtosis')}, "
            f"CAST(count(DISTINCT {x}) AS BIGINT) AS n_unique, {R(f'quantile_cont({x}, 0.5)', 'median')}, "
            f"abs(avg(power({x} - m, 3)) / power(avg(power({x} - m, 2)), 1.5)) > 3 AS skew_warning "
            f"FROM lineitem, (SELECT avg({x}) AS m, count(*) AS t FROM lineitem) mm WHERE {x} IS NOT NULL")


@register("profile_describe", "SELECT * FROM (" + _union_cols(PROF_NUM, _sql_describe) + ")")
def q_profile_describe(spark, sf_dir):
    """Q3 + Q12 + Q14: descriptive statistics per numeric column with exact medians."""
    return rounded(profile.describe(_lineitem(spark, sf_dir, PROF_NUM), PROF_NUM))


def _sql_outliers(c: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    return (f"SELECT '{c}' AS column, {R('q.p5', 'p5')}, {R('q.p95', 'p95')}, {R('q.med', 'median')}, "
            f"{R('r.rstd', 'rstd')}, CAST(r.n AS BIGINT) AS n, "
            f"CAST(sum(CASE WHEN {x} > q.med + 5 * r.rstd OR {x} < q.med - 5 * r.rstd THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers, "
            f"{R(f'sum(CASE WHEN {x} > q.med + 5 * r.rstd OR {x} < q.med - 5 * r.rstd THEN 1 ELSE 0 END) * 100.0 / r.n', 'outlier_pct')} "
            f"FROM lineitem, (SELECT quantile_cont({x}, 0.05) AS p5, quantile_cont({x}, 0.95) AS p95, "
            f"quantile_cont({x}, 0.5) AS med FROM lineitem) q, "
            f"(SELECT stddev_pop(least(greatest({x}, q2.p5), q2.p95)) AS rstd, count(*) AS n FROM lineitem, "
            f"(SELECT quantile_cont({x}, 0.05) AS p5, quantile_cont({x}, 0.95) AS p95 FROM lineitem) q2 "
            f"WHERE {x} IS NOT NULL) r WHERE {x} IS NOT NULL GROUP BY q.p5, q.p95, q.med, r.rstd, r.n")


@register("profile_outliers", "SELECT * FROM (" + _union_cols(PROF_NUM, _sql_outliers) + ")")
def q_profile_outliers(spark, sf_dir):
    """Q4: robust outliers per numeric column (median ± 5 RSTD, RSTD from [p5, p95] clipping)."""
    return rounded(profile.outliers(_lineitem(spark, sf_dir, PROF_NUM), PROF_NUM))


@register("profile_duplicates", f"""
WITH g AS (SELECT {', '.join(PROF_ALL)}, count(*) AS c FROM lineitem GROUP BY ALL)
SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS n_duplicates,
       {R('sum(c - 1) * 100.0 / sum(c)', 'duplicate_pct')} FROM g""")
def q_profile_duplicates(spark, sf_dir):
    """Q7: duplicate-row share over the full table."""
    return rounded(profile.duplicate_share(_lineitem(spark, sf_dir)))


@register("profile_corr", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {R(f'corr({a}, {b})', 'r')} FROM lineitem"
    for i, a in enumerate(PROF_NUM) for b in PROF_NUM[i + 1:]) + ")")
def q_profile_corr(spark, sf_dir):
    """Q8: Pearson matrix of the numeric columns, one aggregation."""
    return rounded(profile.corr_matrix(_lineitem(spark, sf_dir, PROF_NUM), PROF_NUM))


@register("profile_overview", f"""
SELECT CAST(count(*) AS BIGINT) AS n_rows,
       CAST(sum({' + '.join(f'CAST({c} IS NULL AS BIGINT)' for c in PROF_ALL)}) AS BIGINT) AS n_missing_cells,
       {len(PROF_ALL)} AS n_columns,
       {R(f"sum({' + '.join(f'CAST({c} IS NULL AS BIGINT)' for c in PROF_ALL)}) * 100.0 / (count(*) * {len(PROF_ALL)})", 'missing_pct')}
FROM lineitem""")
def q_profile_overview(spark, sf_dir):
    """Q1: rows, columns, missing cells."""
    return rounded(profile.overview(_lineitem(spark, sf_dir)))


# ---------------------------------------------------------------- model training table and MLlib jobs (tier 3)

from ..operators import models  # noqa: E402


def training_table(spark, sf_dir) -> DataFrame:
    """The reference's processed feature table for every site at once: rain features, the
    temperature stand-in and its lags/means, and a target ``flow`` = number of readings in the
    hour (an inflow proxy, zero-filled on the same grid)."""
    ev = sensor_feed(spark, sf_dir)
    rain = features.prep_rainfall(hourly_rain(spark, sf_dir), ["site"])
    flow = resample.hourly_sum(ev.withColumn("one", F.lit(1.0)), ["site"], "ts", "one", out="flow").drop("hid")
    temp = hourly_temp(spark, sf_dir).withColumnRenamed("temp", TEMP_COL)
    t = joins.left_on_hour(rain, [temp, flow], ["site"])
    t = features.add_lag_features(t, ["site"], "ts", temp=TEMP_COL)
    t = t.withColumn("_pos", cal.hour_id("ts"))
    t = windows.fill_columns(materialize(t), ["site"], "_pos", [TEMP_COL], "ffill_bfill")
    # a feature with no value at all in a series (e.g. a 24 h mean on a sparse feed) stays
    # NULL after ffill/bfill; MLlib rejects NaN, so such cells are imputed with 0
    feats = [c for c in ALL_FEATURES if c in t.columns]
    return materialize(t.drop("_pos", "_blk").fillna(0.0, subset=feats))


ALL_FEATURES = [c for g in models.FEATURE_GROUPS.values() for c in g]
TEMP_COL = "Dry bulb degC"  # the reference's temperature column name (feature groups use it)


def _split(t: DataFrame):
    s = materialize(split.time_split(t, ["site"], "ts", 0.7))
    return s.where("split = 'train'"), s.where("split = 'test'")


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    """Impurity importances (extra-trees configuration), sorted."""
    tr, _ = _split(training_table(spark, sf_dir))
    return models.feature_importance(tr, "flow", ALL_FEATURES).orderBy(F.desc("importance"))


@register("hybrid_model")
def q_hybrid_model(spark, sf_dir):
    """Linear base + GBT on residuals; test metrics per site."""
    tr, te = _split(training_table(spark, sf_dir))
    p = models.hybrid(tr, te, "flow", ALL_FEATURES)
    return p.groupBy("site").agg(*metrics.error_metric_columns("flow", "prediction"))


# ---------------------------------------------------------------- stationarity, PACF, lag recommendation (tier 3)

PACF_LAGS = 20


def _sql_pacf() -> str:
    """Durbin-Levinson unrolled: step k adds the coefficients f<k>_1..k and the residual variance v<k>."""
    r = ", ".join(f"max(CASE WHEN lag = {k} THEN acf * n / (n - {k}) END) AS r{k}" for k in range(1, PACF_LAGS + 1))
    steps = [f"d0 AS (SELECT site, {r}, 1.0 AS v0 FROM acf GROUP BY site)"]
    for k in range(1, PACF_LAGS + 1):
        dot = " + ".join(f"f{k - 1}_{j} * r{k - j}" for j in range(1, k)) or "0"
        new = "".join(f", f{k - 1}_{j} - a{k} * f{k - 1}_{k - j} AS f{k}_{j}" for j in range(1, k))
        steps.append(f"e{k} AS (SELECT *, (r{k} - ({dot})) / v{k - 1} AS a{k} FROM d{k - 1})")
        steps.append(f"d{k} AS (SELECT *{new}, a{k} AS f{k}_{k}, v{k - 1} * (1 - a{k} * a{k}) AS v{k} FROM e{k})")
    rows = " UNION ALL ".join([f"SELECT site, 0 AS lag, 1.0 AS p FROM d{PACF_LAGS}"]
                              + [f"SELECT site, {k}, a{k} FROM d{PACF_LAGS}" for k in range(1, PACF_LAGS + 1)])
    return f"{', '.join(steps)} SELECT site, CAST(lag AS INTEGER) AS lag, {R('p', 'pacf')} FROM ({rows})"


@register("pacf", f"WITH {SQL_HOURLY}, {SQL_ACF}, {_sql_pacf()}")
def q_pacf(spark, sf_dir):
    """Y2: Yule-Walker PACF (adjusted autocovariances) of hourly rain, lags 0..20, per site."""
    return rounded(tsstats.pacf(rain_acf(spark, sf_dir), ["site"], PACF_LAGS))


def _sql_kpss() -> str:
    """KPSS from the autocovariance sums s0..s48: bandwidth rule, Bartlett weights, interpolated p."""
    cov = range(1, ACF_LAGS + 1)
    cut = "floor(power(n, 2.0 / 9.0))"
    t0 = f"(s0 + {' + '.join(f'CASE WHEN {i} <= {cut} THEN 2 * s{i} ELSE 0 END' for i in range(1, 9))}) / n"
    t1 = f"({' + '.join(f'CASE WHEN {i} <= {cut} THEN {2 * i} * s{i} ELSE 0 END' for i in range(1, 9))}) / n"
    lr = "(s0 + " + " + ".join(f"CASE WHEN {i} <= l THEN 2 * (1 - {i} / (l + 1)) * s{i} ELSE 0 END" for i in cov) + ") / n"
    crit = [(0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01)]
    p = "CASE WHEN k <= 0.347 THEN 0.1 " + " ".join(
        f"WHEN k <= {b} THEN {pa} + (k - {a}) / ({b} - {a}) * ({pb} - {pa})" for (a, pa), (b, pb) in zip(crit, crit[1:])) + " ELSE 0.01 END"
    return (f"cs AS (SELECT site, sum(x) OVER (PARTITION BY site ORDER BY ts) AS s FROM cx), "
            f"ss AS (SELECT site, sum(s * s) AS ss FROM cs GROUP BY site), "
            f"b AS (SELECT *, least(floor(1.1447 * power(power(({t1}) / ({t0}), 2), 1.0 / 3.0) * power(n, 1.0 / 3.0)), n - 1) AS l FROM sa), "
            f"k AS (SELECT b.site, b.n, b.l, ss.ss / (n * n) / ({lr}) AS k FROM b JOIN ss ON b.site = ss.site) "
            f"SELECT site, CAST(n AS BIGINT) AS n, {R('k', 'kpss_stat')}, CAST(l AS BIGINT) AS kpss_lags, {R(p, 'kpss_pvalue')} FROM k")


@register("kpss", f"WITH {SQL_HOURLY}, {SQL_ACF}, {_sql_kpss()}")
def q_kpss(spark, sf_dir):
    """KPSS level test of hourly rain per site (automatic bandwidth)."""
    h = hourly_rain(spark, sf_dir).withColumn("_pos", cal.hour_id("ts"))
    return rounded(tsstats.kpss_level(h, ["site"], "_pos", "Rainfall"))


@register("lag_recommendation")
def q_lag_recommendation(spark, sf_dir):
    """Significant PACF lags 1..10 of the original series where it is stationary, else of the differenced
    one; those <= 3 with |pacf| > 0.05 recommended."""
    h = hourly_rain(spark, sf_dir).withColumn("_pos", cal.hour_id("ts"))
    return tsstats.analyse(h, ["site"], "_pos", "Rainfall", 40)["lag_recommendations"]


@register("stationarity")
def q_stationarity(spark, sf_dir):
    """ADF (AIC lag order), KPSS (auto bandwidth) and ACF significant lags of the
    original and the differenced hourly rain per site; stationary = ADF p < .05 and
    KPSS p > .05 and fewer than 17 of lags 1..24 significant. Original and differenced
    series are two keys of ONE long table, so every test runs once over all series. The
    differenced series reuses the original n for its ACF band, as the reference does."""
    h = hourly_rain(spark, sf_dir).withColumn("_pos", cal.hour_id("ts"))
    long = tsstats.analyse(h, ["site"], "_pos", "Rainfall", 40)["stationarity"]
    vals = ["adf_pvalue", "kpss_pvalue", "sig_lags", "stationary"]
    wide = long.groupBy("site").pivot("variant", ["orig", "diff"]).agg(*[F.first(c).alias(c) for c in vals])
    return wide.select("site", *[F.col(f"{t}_{c}") for t in ("orig", "diff") for c in vals])


# ---------------------------------------------------------------- streaming form of A1

@register("stream_hourly_sum", f"""
SELECT event_type AS site, date_trunc('hour', ts) AS ts, {R(f'sum(value) * {D(RAIN_SCALE)}', 'Rainfall')},
       CAST(count(*) AS BIGINT) AS n
FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""")
def q_stream_hourly_sum(spark, sf_dir):
    """A1 in Structured Streaming: the events table read as a stream, event-time hourly
    windows with a watermark, update mode into an upsert log; final table per (site, hour)."""
    from ..streaming.hourly import run_to_completion
    import os
    schema = spark.read.parquet(os.path.join(sf_dir, "events.parquet")).schema
    out = run_to_completion(spark, sf_dir, schema, "event_type", "ts", "value", scale=RAIN_SCALE,
                            glob="events.parquet")
    out = out.withColumnRenamed("event_type", "site")
    return rounded(out.select("site", "ts", "Rainfall", F.col("n").cast("long")))


# ---------------------------------------------------------------- more profile pieces (Q2, Q5, Q6, Q9, F14) and L11

from ..functions import clean  # noqa: E402

_RB = f"""
q AS (SELECT quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.5) AS med FROM ev0),
rb AS (SELECT q.med, stddev_pop(least(greatest(v, q.p5), q.p95)) AS rstd FROM ev0, q GROUP BY q.med)"""


@register("target_histogram", f"""
WITH ev0 AS (SELECT CAST(value AS DOUBLE) AS v FROM events WHERE value IS NOT NULL), {_RB},
j AS (SELECT v, (v > med + 5 * rstd OR v < med - 5 * rstd) AS o FROM ev0, rb),
r AS (SELECT min(v) AS lo, max(v) AS hi FROM j WHERE NOT o),
b AS (SELECT v, o, CAST(CASE WHEN o THEN 20 WHEN (hi - lo) / {D(20.0)} > 0
                 THEN least(floor((v - lo) / ((hi - lo) / {D(20.0)})), 19) ELSE 0 END AS INTEGER) AS bin FROM j, r)
SELECT bin, o AS outlier_bar, CAST(count(*) AS BIGINT) AS n,
       {R('avg(v)', 'mean_value')} FROM b GROUP BY bin, o""")
def q_target_histogram(spark, sf_dir):
    """Q5: histogram of raw readings, outliers (median ± 5 RSTD) averaged in a last bar."""
    ev = load(spark, sf_dir, "events", ["value"])
    return rounded(profile.target_histogram(ev, "value", 20))


@register("outlier_sample", f"""
WITH ev0 AS (SELECT CAST(value AS DOUBLE) AS v FROM events WHERE value IS NOT NULL), {_RB}
SELECT e.event_id, e.event_type, {R('e.value', 'value')} FROM events e, rb
WHERE e.value > rb.med + 5 * rb.rstd OR e.value < rb.med - 5 * rb.rstd
ORDER BY {_h_sql('e.event_id')}, e.event_id LIMIT 10""")
def q_outlier_sample(spark, sf_dir):
    """Q6: ten outlier readings (the sampling is the feature: smallest key hash)."""
    ev = load(spark, sf_dir, "events", ["event_id", "event_type", "value"])
    return rounded(profile.outlier_rows(ev, "value", "event_id", 10))


_CT_COLS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def _sql_ct(c: str) -> str:
    dt = c == "l_shipdate"
    s = f"CAST({c} AS VARCHAR)"
    ok = f"({c} IS NOT NULL AND trim({s}) <> '')"
    num = f"TRY_CAST({s} AS DOUBLE)"
    n, k, u = f"sum(CAST({ok} AS BIGINT))", f"sum(CAST({ok} AND {num} IS NOT NULL AND NOT isnan({num}) AS BIGINT))", \
        f"count(DISTINCT {c})"
    share = f"CASE WHEN {n} > 0 THEN {k} / {n} ELSE 0.0 END"
    kind = (f"CASE WHEN {str(dt).upper()} THEN 'datetime' WHEN {u} = 2 THEN 'binary' "
            f"WHEN {share} >= 0.9 AND {u} > 20 THEN 'numeric' WHEN {u} <= greatest(20, floor({n} * 0.01)) "
            f"THEN 'categorical' WHEN {share} >= 0.9 THEN 'numeric' ELSE 'text' END")
    return (f"SELECT '{c}' AS column, {kind} AS type, {R(share, 'numeric_share')}, CAST({u} AS BIGINT) AS n_unique "
            f"FROM lineitem")


@register("column_types", "SELECT * FROM (" + " UNION ALL ".join(_sql_ct(c) for c in _CT_COLS) + ")")
def q_column_types(spark, sf_dir):
    """Q2: numeric / categorical / binary / text / datetime per column, one aggregation."""
    return rounded(profile.column_types(_lineitem(spark, sf_dir, _CT_COLS)))


_PP_FEATS = ("l_quantity", "l_discount", "l_tax", "l_linenumber")


def _sql_prediction_power() -> str:
    edges = ", ".join(f"quantile_cont(x, {D(i / 10)}) AS e{i}" for i in range(1, 10))
    binexpr = " + ".join(f"CAST(x > e{i} AS INTEGER)" for i in range(1, 10))
    longs = " UNION ALL ".join(f"SELECT '{c}' AS feature, y, CAST({c} AS DOUBLE) AS x, tr FROM base WHERE {c} IS NOT NULL"
                               for c in _PP_FEATS)
    return f"""
WITH base AS (SELECT *, CAST(l_extendedprice AS DOUBLE) AS y,
                     {_h_sql(_LK)} < {D(0.8 * 2 ** 32)} AS tr FROM lineitem),
lg AS ({longs}),
ed AS (SELECT feature, {edges} FROM lg WHERE tr GROUP BY feature),
bn AS (SELECT lg.feature, lg.y, lg.tr, {binexpr} AS bin FROM lg JOIN ed ON lg.feature = ed.feature),
bm AS (SELECT feature, bin, avg(y) AS bm FROM bn WHERE tr GROUP BY feature, bin),
om AS (SELECT feature, avg(y) AS om FROM bn WHERE tr GROUP BY feature),
v AS (SELECT bn.feature, bn.y, coalesce(bm.bm, om.om) AS p FROM bn LEFT JOIN bm ON bn.feature = bm.feature AND bn.bin = bm.bin
      JOIN om ON bn.feature = om.feature WHERE NOT bn.tr)
SELECT feature, {R('least(greatest(1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)), 0.0), 1.0)', 'prediction_power')}
FROM v GROUP BY feature"""


@register("prediction_power", _sql_prediction_power())
def q_prediction_power(spark, sf_dir):
    """Q9 (re-aimed): decile-bin mean model per feature, validation R2 in [0, 1]."""
    l = load(spark, sf_dir, "lineitem", [*_LKC, *_PP_FEATS, "l_extendedprice"])
    l = l.withColumn("k", F.concat_ws("|", *[F.col(c).cast("string") for c in _LKC]))
    return rounded(profile.prediction_power(l, "l_extendedprice", _PP_FEATS, "k", 0.8, 10))


@register("text_word_stats", """
SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words, CAST(len(list_distinct(w)) AS INTEGER) AS n_unique_words
FROM (SELECT doc_id, list_filter(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12)), '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS w
      FROM documents)""")
def q_text_word_stats(spark, sf_dir):
    """words and distinct words of every whole document (whitespace split)."""
    d = load(spark, sf_dir, "documents", ["doc_id", "text"])
    w = F.filter(F.split(F.col("text"), r"[ \t\n\r\f]+"), lambda x: x != "")
    return d.select("doc_id", F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_unique_words"))


# Features of each forecast-ablation group, in group order.
ABL_FEATURES = {"lag1": ["Rainlag1"], "lag2": ["Rainlag2"], "mean2h": ["Rain_L3HR"], "mean5h": ["Rain_L6HR"],
                "mean11h": ["Rain_L12HR"], "mean23h": ["Rain_L24HR"], "mean47h": ["Rain_L48HR"]}


@register("consensus_features", f"""WITH {SQL_HOURLY}, {SQL_ABL},
gf AS (SELECT * FROM (VALUES {', '.join(f"('{g}', {i}, '{f}')" for g, fs in ABL_FEATURES.items() for i, f in enumerate(fs))}) t(feature_group, pos, feature))
SELECT v.site, list(gf.feature ORDER BY v.step, gf.pos) AS features, CAST(count(*) AS BIGINT) AS n_features
FROM votes v JOIN gf ON v.feature_group = gf.feature_group WHERE v.consensus GROUP BY v.site""")
def q_consensus_features(spark, sf_dir):
    """Features of the groups that reached consensus, in group order, per site."""
    v = reshape.consensus_from_ablation(forecast_ablation_table(spark, sf_dir), ["site"]).where("consensus")
    gf = spark.createDataFrame([(g, i, f) for g, fs in ABL_FEATURES.items() for i, f in enumerate(fs)],
                               "feature_group string, pos int, feature string")
    j = v.join(F.broadcast(gf), "feature_group")
    s = F.array_sort(F.collect_list(F.struct("step", "pos", "feature")))
    return j.groupBy("site").agg(F.transform(s, lambda e: e["feature"]).alias("features"),
                                 F.count(F.lit(1)).alias("n_features"))


@register("ar_error_regression")
def q_ar_error_regression(spark, sf_dir):
    """L7 (re-aimed ARIMAX): per site, regression of the inflow proxy on rain features with
    AR(p) errors (p by AIC), forecast over the last 30% of hours; test metrics per site."""
    from ..operators.regress import ar_error_regression
    t = training_table(spark, sf_dir).withColumn("_pos", cal.hour_id("ts"))
    s = materialize(split.time_split(t, ["site"], "ts", 0.7))
    tr, te = s.where("split = 'train'"), s.where("split = 'test'")
    p = ar_error_regression(tr, te, ["site"], "_pos", "flow", ["Rainfall", "Rain_L6HR", "API", "SoilMoisture"])
    return p.groupBy("site", "ar_p").agg(*metrics.error_metric_columns("flow", "prediction"))


@register("anomalous_rows")
def q_anomalous_rows(spark, sf_dir):
    """Q13: isolation-forest scores of every line item on its numeric columns; the ten most
    anomalous rows (the report lists the lowest-scoring rows; here higher = more anomalous)."""
    from ..operators import anomaly
    l = load(spark, sf_dir, "lineitem", [*_LKC, *PROF_NUM])
    l = l.select(F.concat_ws("|", *[F.col(c).cast("string") for c in _LKC]).alias("k"), *PROF_NUM)
    forest = anomaly.fit_isolation_forest(l, PROF_NUM, "k", trees=100)
    s = anomaly.score(l, forest, PROF_NUM)
    return reshape.top_n(s, "anomaly_score", 10, "k")


# ---------------------------------------------------------------- P15, A17, R3

@register("year_month_filter", f"""
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
       CAST(count(*) AS BIGINT) AS n, {R(f'sum(o_totalprice * {D(PRICE_SCALE)})', 'total')}
FROM orders WHERE year(o_orderdate) IN (1996, 1998) AND month(o_orderdate) IN (6, 7, 8) GROUP BY 1, 2""")
def q_year_month_filter(spark, sf_dir):
    """Rows of a year set and a month set (the R script's winter-of-given-years subset)."""
    o = load(spark, sf_dir, "orders", ["o_orderdate", "o_totalprice"])
    f = o.where(clean.in_years_months("o_orderdate", [1996, 1998], [6, 7, 8]))
    return rounded(f.groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
                   .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice") * F.lit(PRICE_SCALE)).alias("total")))


_PIV_SQL = f"""
m AS (SELECT site, model, 1 - sum({_E}*{_E}) / (count({_E}) * var_pop(CASE WHEN pred IS NOT NULL THEN actual END)) AS r2
      FROM lp GROUP BY site, model)"""


@register("pivot_summary", f"""WITH {SQL_PAIRS}, {_PIV_SQL}
SELECT model, CAST(count(r2) AS BIGINT) AS count, {R('avg(r2)', 'mean')}, {R('stddev_samp(r2)', 'std')},
       {R('min(r2)', 'min')}, {R('quantile_cont(r2, 0.25)', 'q25')}, {R('quantile_cont(r2, 0.5)', 'q50')},
       {R('quantile_cont(r2, 0.75)', 'q75')}, {R('max(r2)', 'max')} FROM m GROUP BY model""")
def q_pivot_summary(spark, sf_dir):
    """Count, mean, std, min, quartiles, max of each column of the site x model R2 table
    (exact quartiles)."""
    m = long_pairs(spark, sf_dir).groupBy("site", "model").agg(*metrics.error_metric_columns("actual", "pred"))
    # m has one row per (site, model): its exact quartiles need no refinement over the facts
    q = [F.percentile("r2", F.lit(v)).alias(n) for n, v in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))]
    st = m.groupBy("model").agg(F.count("r2").alias("count"), F.avg("r2").alias("mean"),
                                F.stddev_samp("r2").alias("std"), F.min("r2").alias("min"), F.max("r2").alias("max"), *q)
    return rounded(st.select("model", "count", "mean", "std", "min", "q25", "q50", "q75", "max"))


@register("leaderboard_top20", f"""WITH {SQL_PAIRS}
SELECT site, scenario, model, {R('sqrt(avg(' + _E + '*' + _E + '))', 'rmse')} FROM lp GROUP BY site, scenario, model
ORDER BY sqrt(avg({_E}*{_E})), site, scenario, model LIMIT 20""")
def q_leaderboard_top20(spark, sf_dir):
    """The 20 best (site, scenario, model) candidates by RMSE (the limit is the feature)."""
    m = long_pairs(spark, sf_dir).groupBy("site", "scenario", "model").agg(
        F.sqrt(F.avg((F.col("pred") - F.col("actual")) ** 2)).alias("rmse"))
    return rounded(m.orderBy("rmse", "site", "scenario", "model").limit(20))


from . import ingest_queries, model_queries  # noqa: E402,F401  (register their queries)
