"""L7 re-aimed: linear regression with AR(p) errors and exogenous columns, per series.

The reference fits a seasonal ARIMA with regressors per site and forecasts over the test
range. Here, per series and all series in one job:
1. OLS of y on [1, X] from ONE Gramian aggregation (solved per series in ``mapInPandas``);
2. residuals u; AR(p) on u for p = 1..max_p from one Gramian of lagged residuals (blocked
   windows), p chosen by AIC on the common sample;
3. forecast over the test positions: u_hat(T+h) = first row of A^h (companion matrix) applied
   to the last p training residuals; the (h -> coefficients) table is built per series in
   ``mapInPandas`` (bounded by the test length), then joined on (series, h).
``arma.arma_error_regression`` adds moving-average terms."""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocked import attach, materialize, with_series_windows

#: Horizons of forecast coefficients held at once.
CHUNK = 10_000


def _gram_aggs(cols: Sequence[str], cond=None):
    out = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            v = F.col(a) * F.col(b)
            out.append(F.sum(F.when(cond, v) if cond is not None else v).alias(f"{a}*{b}"))
    return out


def _mat(row: dict, cols: Sequence[str], y: str):
    G = np.array([[row[f"{a}*{b}"] if f"{a}*{b}" in row else row[f"{b}*{a}"] for b in cols] for a in cols], float)
    Xy = np.array([row[f"{a}*{y}"] if f"{a}*{y}" in row else row[f"{y}*{a}"] for a in cols], float)
    return G, Xy, float(row[f"{y}*{y}"])


def ar_error_regression(train: DataFrame, test: DataFrame, keys: Sequence[str], pos: str, label: str,
                        features: Sequence[str], max_p: int = 5) -> DataFrame:
    """Returns the test rows with ``prediction`` (regression + AR error forecast), ``ar_p``."""
    k = list(keys)
    xs = ["_one", *features]
    tr = materialize(train.withColumn("_one", F.lit(1.0)).select(*k, pos, label, *xs))
    g = tr.groupBy(*k).agg(*_gram_aggs([*xs, label]))
    keyschema = [train.schema[c] for c in k]

    def solve(it):
        for pdf in it:
            rows = []
            for r in pdf.to_dict("records"):
                G, Xy, _ = _mat(r, xs, label)
                beta = np.linalg.lstsq(G, Xy, rcond=None)[0]
                rows.append([r[c] for c in k] + [float(b) for b in beta])
            import pandas as pd
            yield pd.DataFrame(rows, columns=[*k, *[f"_b_{c}" for c in xs]])

    bschema = T.StructType([*keyschema, *[T.StructField(f"_b_{c}", T.DoubleType()) for c in xs]])
    betas = materialize(g.mapInPandas(solve, bschema))
    fit = sum(F.col(c) * F.col(f"_b_{c}") for c in xs)
    r = attach(tr, betas, k).withColumn("_u", F.col(label) - fit)
    r = materialize(with_series_windows(r, k, pos, lambda w: {f"_u{i}": F.lag("_u", i).over(w)
                                                             for i in range(1, max_p + 1)}, halo=max_p))
    lagged = [f"_u{i}" for i in range(1, max_p + 1)]
    ga = r.groupBy(*k).agg(F.max(pos).alias("_T"),
                           *_gram_aggs([*lagged, "_u"], F.col(f"_u{max_p}").isNotNull()),
                           F.sum(F.col(f"_u{max_p}").isNotNull().cast("long")).alias("_n"))

    def pick(it):
        import pandas as pd
        for pdf in it:
            rows = []
            for row in pdf.to_dict("records"):
                n = int(row["_n"])
                best = None
                for p in range(1, max_p + 1):
                    G, Xy, yy = _mat(row, lagged[:p], "_u")
                    phi = np.linalg.lstsq(G, Xy, rcond=None)[0]
                    ssr = max(yy - 2 * phi @ Xy + phi @ G @ phi, 1e-300)
                    aic = n * math.log(ssr / n) + 2 * p
                    if best is None or aic < best[0]:
                        best = (aic, p, phi)
                phi = [float(v) for v in best[2]] + [0.0] * (max_p - best[1])
                rows.append([row[c] for c in k] + [int(row["_T"]), best[1]] + phi)
            yield pd.DataFrame(rows, columns=[*k, "_T", "ar_p", *[f"_phi{i}" for i in range(1, max_p + 1)]])

    pschema = T.StructType([*keyschema, T.StructField("_T", T.LongType()), T.StructField("ar_p", T.LongType()),
                            *[T.StructField(f"_phi{i}", T.DoubleType()) for i in range(1, max_p + 1)]])
    phis = materialize(ga.mapInPandas(pick, pschema))
    # last max_p training residuals per series (bounded array)
    last = (attach(r, phis.select(*k, "_T"), k).where(F.col(pos) > F.col("_T") - max_p)
            .groupBy(*k).agg(F.map_from_entries(F.collect_list(F.struct((F.col("_T") - F.col(pos)).cast("int"),
                                                                        "_u"))).alias("_last")))
    te = attach(test.withColumn("_one", F.lit(1.0)), phis, k).withColumn("_h", F.col(pos) - F.col("_T"))
    horizons = te.groupBy(*k).agg(F.max("_h").alias("_H"))
    hp = attach(horizons, phis, k)

    def coefs(it):
        import pandas as pd
        for pdf in it:
            out = []
            for row in pdf.to_dict("records"):
                p = int(row["ar_p"])
                A = np.zeros((p, p))
                A[0, :] = [row[f"_phi{i}"] for i in range(1, p + 1)]
                A[1:, :-1] += np.eye(p - 1) if p > 1 else 0
                M = np.eye(p)
                for h in range(1, int(row["_H"]) + 1):
                    M = A @ M
                    out.append([row[c] for c in k] + [h] + [float(v) for v in M[0]] + [0.0] * (max_p - p))
                    if len(out) == CHUNK:
                        yield pd.DataFrame(out, columns=[*k, "_h", *[f"_c{i}" for i in range(max_p)]])
                        out = []
            yield pd.DataFrame(out, columns=[*k, "_h", *[f"_c{i}" for i in range(max_p)]])

    cschema = T.StructType([*keyschema, T.StructField("_h", T.LongType()),
                            *[T.StructField(f"_c{i}", T.DoubleType()) for i in range(max_p)]])
    ctab = hp.mapInPandas(coefs, cschema)
    te = te.join(ctab, [*k, "_h"], "left")
    te = attach(attach(te, betas, k), last, k)
    err = sum(F.coalesce(F.col(f"_c{i}") * F.try_element_at("_last", F.lit(i)), F.lit(0.0)) for i in range(max_p))
    pred = sum(F.col(c) * F.col(f"_b_{c}") for c in xs) + err
    drop = [c for c in te.columns if c.startswith("_")]
    return te.withColumn("prediction", pred).drop(*drop)
