"""Accuracy metrics (A7-A15, A19-A21, L14) as single-pass aggregations.

Ratios without a value are NULL: R2 and NSE of constant actuals, correlations with a constant side, z-scores of equal metrics,
improvements on a first value of 0. The other columns of such a group keep their values.

Every metric is a sum over rows, so Spark aggregates partially on each partition and
shuffles one row per group: no group is ever gathered in one task."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _corr(y, p) -> Column:
    """Pearson r, NULL where a side is constant (``corr`` itself divides by zero there)."""
    both = _c(y).isNotNull() & _c(p).isNotNull()
    a, b = F.when(both, _c(y)), F.when(both, _c(p))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def error_metric_columns(y: str, p: str) -> list[Column]:
    """A7 + A8: n, mse, rmse, mae, r2 = 1 - SSE/SST (SST = n * var_pop(y))."""
    e = _c(p) - _c(y)
    sse = F.sum(e * e)
    n = F.count(e)
    return [n.alias("n"), (sse / n).alias("mse"), F.sqrt(sse / n).alias("rmse"),
            F.avg(F.abs(e)).alias("mae"),
            (F.lit(1.0) - F.try_divide(sse, n * F.var_pop(F.when(e.isNotNull(), _c(y))))).alias("r2")]


def agreement_columns(y: str, p: str) -> list[Column]:
    """A9 + A10: NSE (same formula as R2), mean bias p - y, Pearson r and its square (R's 'R2')."""
    e = _c(p) - _c(y)
    r = _corr(y, p)
    return [(F.lit(1.0) - F.try_divide(F.sum(e * e), F.count(e) * F.var_pop(F.when(e.isNotNull(), _c(y))))).alias("nse"),
            F.avg(e).alias("bias"), r.alias("r"), (r * r).alias("r2_corr")]


def error_metrics(df: DataFrame, groups: Sequence[str], y: str, p: str) -> DataFrame:
    """One metric row per group (model, site, ...)."""
    return df.groupBy(*groups).agg(*error_metric_columns(y, p), *agreement_columns(y, p)[:3])


def taylor_stats(df: DataFrame, groups: Sequence[str], y: str, p: str) -> DataFrame:
    """Sd of observations and simulations, correlation, centred RMS difference."""
    return df.groupBy(*groups).agg(
        F.stddev_samp(_c(y)).alias("sd_obs"), F.stddev_samp(_c(p)).alias("sd_sim"),
        _corr(y, p).alias("r"), F.stddev_pop(_c(p) - _c(y)).alias("crmsd"))


def fit_line(df: DataFrame, groups: Sequence[str], y: str, p: str) -> DataFrame:
    """Least-squares line prediction ~ actual."""
    both = _c(y).isNotNull() & _c(p).isNotNull()
    a, b = F.when(both, _c(y)), F.when(both, _c(p))
    slope = F.try_divide(F.covar_pop(a, b), F.var_pop(a))
    r = _corr(y, p)
    return df.groupBy(*groups).agg(slope.alias("slope"), (F.avg(b) - slope * F.avg(a)).alias("intercept"), (r * r).alias("fit_r2"))


def zscore(metrics: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / sd_samp across the rows of a (small, aggregated) metric table.
    The one-row statistics table is broadcast: its size is one row by construction."""
    from .blocked import with_scalars
    stats = metrics.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols],
                        *[F.stddev_samp(c).alias(f"_s_{c}") for c in cols])
    j = with_scalars(metrics, stats)
    return j.select(*[c for c in metrics.columns if c not in cols],
                    *[F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")).alias(f"z_{c}") for c in cols])


def residual_histogram(df: DataFrame, groups: Sequence[str], e: str, bins: int = 60) -> DataFrame:
    """Equal-width bins from each group's min to max; the top edge goes to the last bin.
    Per-group edges are a small table (one row per group) joined back."""
    from .blocked import attach
    edges = df.groupBy(*groups).agg(F.min(e).alias("_lo"), F.max(e).alias("_hi"))
    j = attach(df, edges, groups).where(F.col(e).isNotNull())
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    b = F.when(width > 0, F.least(F.floor((F.col(e) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
    return (j.withColumn("bin", b.cast("int"))
            .groupBy(*groups, "bin")
            .agg(F.count(F.lit(1)).alias("count"),
                 F.first(F.col("_lo") + F.col("bin") * width).alias("bin_lo")))


def improvement_pct(first: Column, last: Column) -> Column:
    """(first - last) / first * 100."""
    return F.try_divide(first - last, first) * F.lit(100.0)


def halving_weights(g: dict, models: Sequence[str]) -> tuple[list[float], float]:
    """L14 on summed products (``gramian_columns``): blend weights and the R2 of the blend.

    Weights sum to 1, so giving an unused model weight 1 and renormalising maps w to (w + e_i) / 2. With b = sums of y * p and
    A = sums of p * p the blend's squared error is syy - 2 w.b + w.A w; each round scores all unused models at once and stops
    where none lowers the error. A constant target has no R2 (NaN); its weights still minimise the error."""
    k = len(models)
    a = np.array([[g[f"s_{m}_{q}"] for q in models] for m in models], float).reshape(k, k)
    b = np.array([g[f"s_y_{m}"] for m in models], float)
    w, error = np.zeros(k), np.inf
    while (w == 0).any():
        trials = np.eye(k) if not w.any() else (w + np.eye(k)) / 2
        cost = g["syy"] - 2 * trials @ b + ((trials @ a) * trials).sum(1)
        cost[w > 0] = np.inf
        best = int(np.argmin(cost))
        if not cost[best] < error:
            break
        w, error = trials[best], cost[best]
    sst = g["syy"] - g["sy"] ** 2 / g["n"] if g["n"] else 0.0
    return w.tolist(), float(1 - error / sst) if sst > 0 else float("nan")


def gramian_columns(y: str, models: Sequence[str]) -> list[Column]:
    """The sums that ``halving_weights`` needs."""
    cols = [F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(F.col(y) * F.col(y)).alias("syy")]
    for m in models:
        cols.append(F.sum(F.col(y) * F.col(m)).alias(f"s_y_{m}"))
        cols += [F.sum(F.col(m) * F.col(k)).alias(f"s_{m}_{k}") for k in models]
    return cols


def gramian(df: DataFrame, y: str, models: Sequence[str]) -> DataFrame:
    """One row of ``gramian_columns``."""
    return df.agg(*gramian_columns(y, models))
