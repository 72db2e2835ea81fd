"""Additive models per series: y = s(x) + cyclic s(hour) + weekday effect, penalised least squares.

``s(x)`` is a cubic P-spline (uniform B-splines over the series' range of x, second-difference penalty), the hour's smooth the same on a
circle of 24, the weekday a random effect. One Gramian of the basis per series holds all that the fit needs: the two smoothing parameters
minimise the generalised cross-validation score n RSS / (n - edf)^2 over a logarithmic grid, and the weekday's variance follows by EM steps at
each point. Values of x outside the fitted range get the value at its border. NULL x, hour, weekday or label: the row is not learned from;
NULL x, hour or weekday: no prediction. A series whose x or label is constant is fitted without error (the penalties decide)."""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .blocked import attach, materialize

X_BASIS, HOUR_BASIS, DAYS, PERIOD = 10, 8, 7, 24.0
WIDTH = X_BASIS + HOUR_BASIS + DAYS
#: Grid of each smoothing parameter.
LAMBDAS = 10.0 ** np.linspace(-4, 6, 11)
EM_STEPS = 12


def _cubic(t: np.ndarray, size: int, cyclic: bool) -> np.ndarray:
    """Uniform cubic B-splines at ``t`` (in knot spacings from the first knot)."""
    seg = np.floor(t).astype(int) if cyclic else np.clip(np.floor(t).astype(int), 0, size - 4)
    u = t - seg
    parts = [(1 - u) ** 3, 3 * u**3 - 6 * u**2 + 4, -3 * u**3 + 3 * u**2 + 3 * u + 1, u**3]
    out = np.zeros((len(t), size))
    for j, p in enumerate(parts):
        out[np.arange(len(t)), (seg + j) % size if cyclic else seg + j] += p / 6
    return out


def basis(x, hour, wday, lo, hi) -> np.ndarray:
    """Rows of the design: smooth of x between ``lo`` and ``hi``, cyclic smooth of the hour, weekday indicators. The constant is in each part."""
    x, lo, hi = (np.asarray(v, float) for v in (x, lo, hi))
    span = np.where(hi > lo, hi - lo, 1.0)
    a = _cubic((np.clip(x, lo, hi) - lo) / span * (X_BASIS - 3), X_BASIS, False)
    b = _cubic(np.mod(np.asarray(hour, float), PERIOD) / PERIOD * HOUR_BASIS, HOUR_BASIS, True)
    return np.column_stack((a, b, np.eye(DAYS)[np.asarray(wday, int) % DAYS]))


def penalties() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Penalty matrices of the three parts."""
    out = []
    d = np.diff(np.eye(X_BASIS), 2, axis=0)
    e = np.eye(HOUR_BASIS)
    c = e - 2 * np.roll(e, 1, 1) + np.roll(e, 2, 1)
    at = 0
    for s in (d.T @ d, c.T @ c, np.eye(DAYS)):
        p = np.zeros((WIDTH, WIDTH))
        p[at:at + len(s), at:at + len(s)] = s
        out.append(p)
        at += len(s)
    return tuple(out)


def _at(xx, xy, yy, n, pen):
    """Coefficients, residual sum of squares, effective degrees of freedom and the inverse at one penalty."""
    scale = max(np.trace(xx) / len(xx), 1e-300)
    inv = np.linalg.inv(xx + pen + 1e-9 * scale * np.eye(len(xx)))  # the parts share the constant
    beta = inv @ xy
    return beta, max(yy - 2 * beta @ xy + beta @ xx @ beta, 0.0), float(np.trace(inv @ xx)), inv


def fit_gramian(gram: np.ndarray, n: int) -> dict:
    """Fit from the Gramian of [basis, y]: smoothing parameters by GCV, weekday variance by EM."""
    xx, xy, yy = gram[:-1, :-1], gram[:-1, -1], float(gram[-1, -1])
    px, ph, pd = penalties()
    best = None
    for lx in LAMBDAS:
        for lh in LAMBDAS:
            ld = 1.0
            for _ in range(EM_STEPS):  # ld is the ratio of residual and weekday variance
                beta, rss, edf, inv = _at(xx, xy, yy, n, lx * px + lh * ph + ld * pd)
                sigma = rss / max(n - edf, 1e-9)
                day = beta[-DAYS:]
                tau = (day @ day + sigma * np.trace(inv[-DAYS:, -DAYS:])) / DAYS
                ld = float(np.clip(sigma / tau, 1e-6, 1e6)) if tau > 0 else 1e6
            beta, rss, edf, _ = _at(xx, xy, yy, n, lx * px + lh * ph + ld * pd)
            gcv = n * rss / (n - edf) ** 2 if n > edf else math.inf
            if best is None or gcv < best["gcv"] * (1 - 1e-12):
                best = {"beta": beta, "lambda_x": lx, "lambda_hour": lh, "lambda_day": ld, "edf": edf, "gcv": gcv, "rss": rss}
    return best


def fit(train: DataFrame, keys: Sequence[str], x: str, hour: str, wday: str, label: str) -> DataFrame:
    """One row per series: n, low and high x, beta, lambda_x, lambda_hour, lambda_day, edf, gcv."""
    k = list(keys)
    rows = train.select(*k, *[F.col(f"`{c}`").cast("double").alias(n) for c, n in ((x, "_x"), (hour, "_h"), (wday, "_w"), (label, "_y"))])
    rows = rows.where(" and ".join(f"{c} is not null and not isnan({c})" for c in ("_x", "_h", "_w", "_y")))
    rows = attach(rows, rows.groupBy(*k).agg(F.min("_x").alias("low"), F.max("_x").alias("high")), k)
    ddl = ", ".join(f"`{c}` {train.schema[c].dataType.simpleString()}" for c in k)

    def partial(it):
        import pandas as pd
        for pdf in it:
            d = np.column_stack((basis(pdf["_x"], pdf["_h"], pdf["_w"], pdf["low"], pdf["high"]), pdf["_y"]))
            for at in pdf.groupby(k, sort=False, dropna=False).indices.values():
                cells = (d[at].T @ d[at]).ravel()
                out = pd.DataFrame({c: [pdf[c].iloc[at[0]]] * (len(cells) + 1) for c in k})
                out["cell"], out["v"] = np.arange(-1, len(cells)), np.concatenate(([len(at)], cells))
                out["low"], out["high"] = pdf["low"].iloc[at[0]], pdf["high"].iloc[at[0]]
                yield out

    ship_package(train.sparkSession)
    sums = rows.mapInPandas(partial, f"{ddl}, cell long, v double, low double, high double").groupBy(*k, "cell").agg(F.sum("v").alias("v"), F.min("low").alias("low"), F.max("high").alias("high"))
    grams = sums.groupBy(*k).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.transform(F.array_sort(F.collect_list(F.struct("cell", "v"))), lambda e: e["v"]).alias("g"))

    def solve(it):
        import pandas as pd
        for pdf in it:
            out = pdf[[*k, "low", "high"]].copy()
            fits = [fit_gramian(np.asarray(g[1:], float).reshape(WIDTH + 1, WIDTH + 1), int(g[0])) for g in pdf["g"]]
            out["n"] = [int(g[0]) for g in pdf["g"]]
            out["beta"] = [f["beta"].tolist() for f in fits]
            for c in ("lambda_x", "lambda_hour", "lambda_day", "edf", "gcv"):
                out[c] = pd.Series([float(f[c]) for f in fits], index=out.index)
            yield out

    return materialize(grams.mapInPandas(solve, f"{ddl}, low double, high double, n long, beta array<double>, lambda_x double, lambda_hour double, lambda_day double, edf double, gcv double"))


def predict(model: DataFrame, table: DataFrame, keys: Sequence[str], x: str, hour: str, wday: str, out: str = "prediction") -> DataFrame:
    """``table`` with predictions; NULL for a series that was not fitted."""
    work = attach(table.withColumns({"_x": F.col(f"`{x}`").cast("double"), "_h": F.col(f"`{hour}`").cast("double"), "_w": F.col(f"`{wday}`").cast("double")}),
                  model.select(*keys, F.col("low").alias("_low"), F.col("high").alias("_high"), F.col("beta").alias("_beta")), list(keys), "left")
    names = table.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)

    def run(batches):
        for batch in batches:
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("_x", "_h", "_w", "_low", "_high")}
            ok = ~np.isnan(np.column_stack(list(cols.values()))).any(1)
            p = np.full(batch.num_rows, np.nan)
            if ok.any():
                beta = np.array([b for b, g in zip(batch.column("_beta").to_pylist(), ok, strict=True) if g], float)
                p[ok] = (basis(*[cols[c][ok] for c in ("_x", "_h", "_w", "_low", "_high")]) * beta).sum(1)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(p, from_pandas=True)], names=[*names, out])

    ship_package(table.sparkSession)
    return work.select(*[F.col(f"`{c}`") for c in names], "_x", "_h", "_w", "_low", "_high", "_beta").mapInArrow(run, f"{kinds}, `{out}` double")
