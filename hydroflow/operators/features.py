"""Feature table builders: ``prep_rainfall`` (F1-F7, W1, W7, W11, W12) and ``add_lag_features``."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import calendar_columns
from .blocked import DEFAULT_BLOCK, fill, materialize, row_position, with_series_windows
from .scan import affine_scan_many
from .windows import lag, rolling_full

# Fixed values of the rainfall features.
RAIN_LAGS = (1, 2)
RAIN_WINDOWS = (3, 6, 12, 24, 48)
API_DECAY = 0.85
SOIL_DECAY = 0.95
SOIL_MAX = 100.0


def prep_rainfall(hourly: DataFrame, keys: Sequence[str], ts: str = "ts", rain: str = "Rainfall",
                  fill_how: str | None = "bfill", block: int = DEFAULT_BLOCK,
                  api_decay: float = API_DECAY, soil_decay: float = SOIL_DECAY,
                  soil_max: float = SOIL_MAX) -> DataFrame:
    """Rain feature block for every series at once. Lags, windows and recurrences go by row, as on the
    gap-free grid of ``resample.hourly_sum``; in a series with gaps the previous row counts, however old.

    ``fill_how='bfill'`` follows the Python path (leading NULLs back-filled); ``None`` the R path."""
    d = row_position(hourly, keys, ts)

    def build(w):
        cols = {f"Rainlag{k}": lag(rain, k, w) for k in RAIN_LAGS}
        cols.update({f"Rain_L{n}HR": rolling_full(rain, n, w) for n in RAIN_WINDOWS})
        cols["_first"] = F.lag(F.col("_pos"), 1).over(w).isNull()
        return cols

    d = materialize(with_series_windows(d, keys, "_pos", build, halo=max(RAIN_WINDOWS) - 1, block=block))
    # the recurrences use the previous hour's raw rain (Rainlag1 before any fill)
    first, prev = F.col("_first"), F.col("Rainlag1")
    d = affine_scan_many(d, keys, "_pos", {
        "API": (F.lit(None), F.when(first, 0.0).otherwise(api_decay), F.when(first, 0.0).otherwise(prev)),
        "SoilMoisture": (F.lit(soil_max), F.when(first, 0.0).otherwise(soil_decay),
                         F.when(first, F.col(rain)).otherwise(prev)),
    }, block=block)
    filled = [f"Rainlag{k}" for k in RAIN_LAGS] + [f"Rain_L{n}HR" for n in RAIN_WINDOWS]
    if fill_how:
        d = fill(materialize(d), keys, "_pos", filled, fill_how, block)
    d = d.withColumns(calendar_columns(ts))
    order = [*keys, ts, rain, "hour", "wday", "month", "mday", "doy", *filled,
             "sin_hour", "cos_hour", "API", "SoilMoisture"]
    extra = [c for c in d.columns if c not in order and not c.startswith("_") and c != "hid"]
    return d.select(*order, *extra)


def rain_recurrences(hourly: DataFrame, keys: Sequence[str], ts: str = "ts", rain: str = "Rainfall",
                     block: int = DEFAULT_BLOCK) -> DataFrame:
    """W11 + W12 alone: API and soil moisture without the other rain features."""
    d = row_position(hourly, keys, ts)
    d = materialize(with_series_windows(d, keys, "_pos", lambda w: {
        "_prev": lag(rain, 1, w), "_first": F.lag(F.col("_pos"), 1).over(w).isNull()}, halo=1, block=block))
    first, prev = F.col("_first"), F.col("_prev")
    d = affine_scan_many(d, keys, "_pos", {
        "API": (F.lit(None), F.when(first, 0.0).otherwise(API_DECAY), F.when(first, 0.0).otherwise(prev)),
        "SoilMoisture": (F.lit(SOIL_MAX), F.when(first, 0.0).otherwise(SOIL_DECAY),
                         F.when(first, F.col(rain)).otherwise(prev)),
    }, block=block)
    return d.select(*keys, ts, rain, "API", "SoilMoisture")


def add_lag_features(df: DataFrame, keys: Sequence[str], ts: str = "ts", site_name: str | None = None,
                     temp: str = "temp", block: int = DEFAULT_BLOCK) -> DataFrame:
    """W2 + W8: extra lags (shift, ffill, bfill) and back-filled rolling temperature means,
    each only if its source column is present (checked at plan time)."""
    cols = set(df.columns)
    lags: dict[str, tuple[str, int]] = {}
    means: dict[str, tuple[str, int]] = {}
    if "API" in cols:
        lags["lag1API"] = ("API", 1)
    if "SoilMoisture" in cols:
        lags["SoilMoisturelag1"] = ("SoilMoisture", 1)
    if temp in cols:
        for k in (1, 2, 3, 24):
            lags[f"{temp} lag{k}"] = (temp, k)
        for n in (6, 12, 24):
            means[f"Temp_{n}HR_mean"] = (temp, n)
    if "Rainfall" in cols:
        lags["Rainlag3"] = ("Rainfall", 3)
    stat = f"{site_name} stat" if site_name else "stat"
    if stat in cols:
        for k in (1, 2, 3):
            lags[f"{site_name} statlag{k}" if site_name else f"statlag{k}"] = (stat, k)
    if not lags and not means:
        return df
    d = row_position(df, keys, ts)
    halo = max([k for _, k in lags.values()] + [n - 1 for _, n in means.values()] + [1])

    def build(w):
        out = {o: lag(s, k, w) for o, (s, k) in lags.items()}
        out.update({o: rolling_full(s, n, w, "mean") for o, (s, n) in means.items()})
        return out

    d = materialize(with_series_windows(d, keys, "_pos", build, halo=halo, block=block))
    d = fill(d, keys, "_pos", {**{c: "ffill_bfill" for c in lags}, **{c: "bfill" for c in means}}, block=block)
    return d.drop("_pos", "_blk")
