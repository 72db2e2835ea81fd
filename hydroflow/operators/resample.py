"""Hourly resampling (A1, A2)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import from_hour_id, hour_id, trunc_hour
from .blocked import DEFAULT_BLOCK

HID = "hid"


def hourly_grid(bounds: DataFrame, keys: Sequence[str], lo: str, hi: str,
                block: int = DEFAULT_BLOCK) -> DataFrame:
    """Every hour id from ``lo`` to ``hi`` per series. Exploded block by block so no single
    row expands into more than ``block`` rows."""
    b = bounds.select(*keys, lo, hi, F.explode(F.sequence(F.floor(F.col(lo) / block),
                                                           F.floor(F.col(hi) / block))).alias("_b"))
    start = F.greatest(F.col(lo), F.col("_b") * block).cast("long")
    end = F.least(F.col(hi), F.col("_b") * block + (block - 1)).cast("long")
    return b.select(*keys, F.explode(F.sequence(start, end)).alias(HID))


def hourly_sum(df: DataFrame, keys: Sequence[str], ts: str, value: str, out: str = "rainfall",
               scale: float = 1.0, fill_zero: bool = True, block: int = DEFAULT_BLOCK) -> DataFrame:
    """A1: sum ``value * scale`` per (series, hour). With ``fill_zero`` (pandas ``resample().sum()``)
    every hour from the series' first to last hour is present and empty hours are 0.

    The raw rows are read once: map-side partial sums, one shuffle, then the (much smaller)
    sparse hourly table is materialised; the grid rows (value 0) are unioned into a second,
    hourly-sized aggregation instead of a join."""
    from .blocked import materialize
    v = F.col(value).cast("double")
    if scale != 1.0:
        v = v * F.lit(float(scale))
    h = (df.select(*keys, hour_id(ts).alias(HID), v.alias(out))
         .groupBy(*keys, HID).agg(F.sum(out).alias(out)))
    if fill_zero:
        h = materialize(h)
        bounds = h.groupBy(*keys).agg(F.min(HID).alias("_lo"), F.max(HID).alias("_hi"))
        grid = hourly_grid(bounds, keys, "_lo", "_hi", block).withColumn(out, F.lit(0.0))
        h = h.unionByName(grid).groupBy(*keys, HID).agg(F.sum(out).alias(out))
    return h.withColumn(ts, from_hour_id(HID))


def hourly_sum_no_gap(df: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str],
                      scale: float = 1.0, count: str | None = None) -> DataFrame:
    """A2 (R ``aggregate``): rows with any NULL among ``values`` dropped first; only hours that
    have rows are emitted; ``count`` names a column for their number."""
    # explicit IS NOT NULL (not dropna, whose AtLeastNNonNulls is not pushed to the scan)
    cond = F.lit(True)
    for c in values:
        cond = cond & F.col(c).isNotNull()
    d = df.where(cond)
    return (d.groupBy(*keys, trunc_hour(ts).alias(ts))
            .agg(*[(F.sum(F.col(c).cast("double")) * F.lit(float(scale))).alias(c) for c in values],
                 *([F.count(F.lit(1)).alias(count)] if count else [])))
