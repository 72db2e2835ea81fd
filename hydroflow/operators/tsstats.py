"""Time-series statistics (Y1-Y7): ACF from one window pass + one aggregation, PACF by
Durbin-Levinson on the tiny (series x lag) table, ADF and KPSS from aggregated sums.

A constant series (a dry site) has no autocorrelation: its ACF is 1 at lag 0 and NULL elsewhere, it has no significant lags and no
PACF; KPSS and ADF statistics and p-values are NULL with 0 lags, as for series too short for a test. Its verdict is ``stationary`` NULL
(unknown), and its lag advice comes from the differenced series, which has none. Empty tables give empty results."""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .blocked import with_series_windows
from .scan import affine_scan


def acf(df: DataFrame, keys: Sequence[str], pos: str, x: str, max_lag: int = 48) -> DataFrame:
    """Biased ACF  sum_{t>=k}(x_t - m)(x_{t-k} - m) / sum_t (x_t - m)^2  for k = 0..max_lag.
    ``pos`` must be dense within each series. One blocked window pass yields all lag products,
    one grouped aggregation sums them: no self-joins, no series in one task."""
    from .blocked import attach
    k = list(keys)
    means = df.groupBy(*k).agg(F.avg(x).alias("_m"), F.count(x).alias("n"))
    d = attach(df, means, k).withColumn("_c", F.col(x) - F.col("_m"))
    d = with_series_windows(d, k, pos, lambda w: {f"_p{j}": F.col("_c") * F.lag("_c", j).over(w)
                                                  for j in range(1, max_lag + 1)}, halo=max_lag)
    agg = d.groupBy(*k).agg(F.first("n").alias("n"), F.sum(F.col("_c") * F.col("_c")).alias("_s0"),
                            *[F.sum(f"_p{j}").alias(f"_s{j}") for j in range(1, max_lag + 1)])
    cells = [F.struct(F.lit(j).alias("lag"), (F.try_divide(F.col(f"_s{j}"), F.col("_s0")) if j else F.lit(1.0)).alias("acf"))
             for j in range(0, max_lag + 1)]
    return agg.select(*k, "n", F.explode(F.array(*cells)).alias("_e")).select(*k, "n", "_e.lag", "_e.acf")


def acf_significance(acf_long: DataFrame, keys: Sequence[str], n_col: str = "n", upto: int = 24,
                     max_sig: int = 17) -> DataFrame:
    """Band 1.96/sqrt(n), number of lags 1..upto outside it, and 'decays' = count < max_sig."""
    band = F.lit(1.96) / F.sqrt(F.col(n_col))
    sig = F.sum(F.when((F.col("lag") >= 1) & (F.col("lag") <= upto) & (F.abs(F.col("acf")) > band), 1)
                .otherwise(0))
    return (acf_long.groupBy(*keys, n_col).agg(sig.alias("sig_lags"))
            .withColumn("band", F.lit(1.96) / F.sqrt(F.col(n_col)))
            .withColumn("acf_decays", F.col("sig_lags") < max_sig))


def durbin_levinson(r: np.ndarray, nlags: int) -> np.ndarray:
    """PACF from autocorrelations r[0..nlags] (r[0] = 1); NaN from the lag on at which a step divides by zero."""
    pacf = np.full(nlags + 1, np.nan)
    pacf[0] = 1.0
    phi = np.zeros(nlags + 1)
    v = 1.0
    prev = np.zeros(nlags + 1)
    for k in range(1, nlags + 1):
        if not np.isfinite(r[k]) or v == 0:
            break
        a = (r[k] - np.dot(prev[1:k], r[1:k][::-1])) / v if k > 1 else r[1]
        phi[:] = prev
        phi[k] = a
        for j in range(1, k):
            phi[j] = prev[j] - a * prev[k - j]
        v *= (1 - a * a)
        pacf[k] = a
        prev = phi.copy()
    return pacf


def pacf(acov_long: DataFrame, keys: Sequence[str], max_lag: int = 20) -> DataFrame:
    """Y2: Yule-Walker PACF with n/(n-k)-adjusted autocovariances (the library default) per
    series, from the aggregated (series x lag) table via ``applyInPandas`` (max_lag+1 rows per
    group, bounded). Input columns: keys, n, lag, acf (biased)."""
    k = list(keys)
    schema = T.StructType([*[acov_long.schema[c] for c in k],
                           T.StructField("lag", T.IntegerType()), T.StructField("pacf", T.DoubleType())])

    def run(pdf):
        import pandas as pd
        pdf = pdf.sort_values("lag")
        n = float(pdf["n"].iloc[0])
        lags = pdf["lag"].to_numpy()
        r = pdf["acf"].to_numpy(dtype=float)
        adj = r * n / (n - lags)          # unbiased autocovariance ratios
        adj = adj / adj[0]
        p = durbin_levinson(adj, int(lags.max()))
        out = pd.DataFrame({c: pdf[c].iloc[0] for c in k}, index=range(len(p)))
        out["lag"] = range(len(p))
        out["pacf"] = [None if np.isnan(v) else v for v in p]
        return out[[*k, "lag", "pacf"]]

    src = acov_long.where(F.col("lag") <= max_lag).select(*k, "n", F.col("lag").cast("int"), "acf")
    ship_package(src.sparkSession)
    return src.groupBy(*k).applyInPandas(run, schema)


def lag_recommendation(pacf_long: DataFrame, keys: Sequence[str], n_col_df: DataFrame,
                       max_lag: int = 10, min_abs: float = 0.05, max_keep: int = 3) -> DataFrame:
    """Significant PACF lags in 1..max_lag (|pacf| > 1.96/sqrt(n)), the first 7 of them listed with
    their values; of all significant ones, those <= max_keep with |pacf| > min_abs are recommended."""
    k = list(keys)
    j = pacf_long.join(n_col_df.select(*k, "n"), k)
    band = F.lit(1.96) / F.sqrt(F.col("n"))
    sig = j.where((F.col("lag") >= 1) & (F.col("lag") <= max_lag) & (F.abs(F.col("pacf")) > band))
    strong = (F.col("lag") <= max_keep) & (F.abs(F.col("pacf")) > min_abs)
    listed = F.slice(F.array_sort(F.collect_list(F.struct("lag", "pacf"))), 1, 7)
    found = sig.groupBy(*k).agg(listed.alias("_l"), F.array_sort(F.collect_list(F.when(strong, F.col("lag")))).alias("recommended_lags"))
    every = n_col_df.select(*k).distinct().join(found, k, "left")
    return every.select(*k, F.coalesce(F.col("_l.lag"), F.array().cast("array<int>")).alias("sig_pacf_lags"),
                        F.coalesce(F.transform("_l", lambda e: F.format_string("%.3f", e["pacf"])),
                                   F.array().cast("array<string>")).alias("pacf_values"),
                        F.coalesce("recommended_lags", F.array().cast("array<int>")).alias("recommended_lags"))


def with_differences(df: DataFrame, keys: Sequence[str], pos: str, x: str) -> DataFrame:
    """Each series twice, keyed by ``variant``: as it is (orig) and its first differences (diff)."""
    from .blocked import with_series_windows
    k = list(keys)
    d = with_series_windows(df.select(*k, pos, x), k, pos, lambda w: {"_dx": F.col(x) - F.lag(x, 1).over(w)}, halo=1)
    orig = d.select(*k, F.lit("orig").alias("variant"), pos, x)
    diff = d.where(F.col("_dx").isNotNull()).select(*k, F.lit("diff").alias("variant"), (F.col(pos) - 1).alias(pos), F.col("_dx").alias(x))
    return orig.unionByName(diff)


def analyse(df: DataFrame, keys: Sequence[str], pos: str, x: str, max_lag: int = 48) -> dict[str, DataFrame]:
    """Y1-Y7 for every series: ACF and PACF of the original and the differenced series, the stationarity tests of
    both (the ACF band of either uses the original length), and the lag advice from the original series where that
    is stationary, else from the differenced one. ``pos`` must be dense. All series and variants go through each test in one job."""
    from .blocked import materialize
    k = list(keys)
    kv = [*k, "variant"]
    both = materialize(with_differences(df, k, pos, x))
    n0 = both.where("variant = 'orig'").groupBy(*k).agg(F.count(F.lit(1)).alias("n0"))
    ac = materialize(acf(both, kv, pos, x, max(max_lag, 40)))
    sig = acf_significance(ac.where("lag <= 40").drop("n").join(n0, k), kv, "n0").drop("n0", "band")
    tests = materialize(adf_test(both, kv, pos, x).drop("n").join(kpss_level(both, kv, pos, x).drop("n"), kv).join(sig, kv)
                        .withColumn("stationary", (F.col("adf_pvalue") < 0.05) & (F.col("kpss_pvalue") > 0.05) & F.col("acf_decays")))
    n = ac.select(*kv, "n").distinct()
    used = tests.where("variant = 'orig'").select(*k, F.when(F.col("stationary"), "orig").otherwise("diff").alias("variant"))
    short = pacf(ac.join(used, kv, "left_semi"), kv, 20)
    recs = lag_recommendation(short, kv, n.join(used, kv, "left_semi")).withColumn(
        "data_used", F.when(F.col("variant") == "orig", "original").otherwise("differenced")).drop("variant")
    return {"acf": ac.where(F.col("lag") <= max_lag), "pacf": pacf(ac, kv, max_lag), "stationarity": tests, "lag_recommendations": recs}


# ------------------------------------------------------------------ KPSS (level) and ADF

# KPSS level-stationarity critical values (Kwiatkowski et al. 1992, table 1).
KPSS_CRIT = ((0.10, 0.347), (0.05, 0.463), (0.025, 0.574), (0.01, 0.739))

# MacKinnon (1994) response surface for the constant-only unit-root test, N = 1:
# bounds, switch point, small-p and large-p polynomial coefficients (lowest order first).
ADF_TAU_MAX = 2.74
ADF_TAU_MIN = -18.83
ADF_TAU_STAR = -1.61
ADF_SMALLP = (2.1659, 1.4412, 0.038269)
ADF_LARGEP = (1.7339, 0.93202, -0.12745, -0.010368)


def _norm_cdf(z: float) -> float:
    return 0.5 * (1.0 + math.erf(z / math.sqrt(2.0)))


def adf_pvalue(stat: float) -> float:
    if stat > ADF_TAU_MAX:
        return 1.0
    if stat < ADF_TAU_MIN:
        return 0.0
    coef = ADF_SMALLP if stat <= ADF_TAU_STAR else ADF_LARGEP
    return _norm_cdf(sum(c * stat ** i for i, c in enumerate(coef)))


def kpss_pvalue(stat: float) -> float:
    """Interpolated in the published table, clipped to [0.01, 0.10]."""
    return float(np.interp(stat, [c for _, c in KPSS_CRIT], [p for p, _ in KPSS_CRIT]))


def _autocov_sums(d: DataFrame, keys: Sequence[str], pos: str, e: str, lags: int, block: int) -> DataFrame:
    """sum_t e_t e_{t-i} for i = 0..lags per series as an array: one blocked window pass + one
    aggregation."""
    w = with_series_windows(d, keys, pos, lambda w: {f"_g{i}": F.col(e) * F.lag(e, i).over(w)
                                                     for i in range(1, lags + 1)}, halo=lags, block=block)
    return w.groupBy(*keys).agg(F.array(F.sum(F.col(e) * F.col(e)),
                                        *[F.sum(f"_g{i}") for i in range(1, lags + 1)]).alias("_g"))


def _kpss_lags(n: float, g: list) -> int:
    """Hobijn et al. (1998) automatic bandwidth from autocovariance sums g[0..]."""
    cl = int(np.power(n, 2.0 / 9.0))
    s0 = g[0] / n + sum(2 * g[i] / n for i in range(1, cl + 1) if g[i] is not None)
    s1 = sum(i * 2 * g[i] / n for i in range(1, cl + 1) if g[i] is not None)
    if not s0 > 0:
        return 0
    gamma = 1.1447 * np.power((s1 / s0) ** 2, 1.0 / 3.0)
    return min(int(gamma * np.power(n, 1.0 / 3.0)), int(n) - 1)


def kpss_level(df: DataFrame, keys: Sequence[str], pos: str, x: str, block: int = 720) -> DataFrame:
    """KPSS level test per series (automatic Hobijn et al. bandwidth, Bartlett kernel).
    Partial sums of (x - mean) are a running sum: the blocked affine scan with coef 1. Pass 1
    gets the autocovariances the bandwidth rule needs, pass 2 those of the chosen lag count.
    Per-series arithmetic runs in ``mapInPandas`` over one row per series; only the largest
    lag count (a scalar, it sizes the window halo) reaches the driver."""
    from .blocked import attach, materialize
    k = list(keys)
    means = df.groupBy(*k).agg(F.avg(x).alias("_m"), F.count(x).alias("n"))
    d = attach(df, means, k).withColumn("_e", F.col(x) - F.col("_m"))
    d = affine_scan(d, k, pos, cap=F.lit(None), coef=F.lit(1.0), offset=F.col("_e"), out="_S").drop("_blk")
    d = materialize(d)
    base = d.groupBy(*k).agg(F.first("n").alias("n"), F.sum(F.col("_S") * F.col("_S")).alias("_ss"))
    cov = max(1, int(np.power(base.agg(F.max("n")).first()[0] or 1, 2.0 / 9.0)))
    t1 = base.join(_autocov_sums(d, k, pos, "_e", cov, max(block, cov)), k)

    ship_package(df.sparkSession)

    def lags_fn(it):
        for pdf in it:
            pdf["kpss_lags"] = [_kpss_lags(float(n), list(g)) for n, g in zip(pdf["n"], pdf["_g"])]
            yield pdf.drop(columns=["_g"])

    t1 = materialize(t1.mapInPandas(lags_fn, T.StructType([f for f in t1.schema.fields if f.name != "_g"]
                                                          + [T.StructField("kpss_lags", T.LongType())])))
    mx = max(1, int(t1.agg(F.max("kpss_lags")).first()[0] or 1))
    t2 = t1.join(_autocov_sums(d, k, pos, "_e", mx, max(block, mx)), k)

    def stat_fn(it):
        import pandas as pd
        for pdf in it:
            st, pv = [], []
            for n, ss, L, g in zip(pdf["n"], pdf["_ss"], pdf["kpss_lags"], pdf["_g"]):
                n, L = float(n), int(L)
                lr = (g[0] + 2 * sum((1 - i / (L + 1)) * g[i] for i in range(1, L + 1) if g[i] is not None and not np.isnan(g[i]))) / n
                v = ss / (n * n) / lr if lr > 0 else None
                st.append(v if v is None else float(v))
                pv.append(v if v is None else kpss_pvalue(v))
            out = pdf[k + ["n", "kpss_lags"]].copy()
            out["kpss_stat"], out["kpss_pvalue"] = pd.Series(st, dtype=object, index=out.index), pd.Series(pv, dtype=object, index=out.index)
            yield out[k + ["n", "kpss_stat", "kpss_lags", "kpss_pvalue"]]

    schema = T.StructType([*[df.schema[c] for c in k], T.StructField("n", T.LongType()),
                           T.StructField("kpss_stat", T.DoubleType()), T.StructField("kpss_lags", T.LongType()),
                           T.StructField("kpss_pvalue", T.DoubleType())])
    return t2.mapInPandas(stat_fn, schema)


def _gram_names(ml: int) -> list[str]:
    return ["_one", "_lev"] + [f"_d{i}" for i in range(1, ml + 1)] + ["_dy"]


def _gramians(rows: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Per series the matrix of summed products of the columns ``names`` (NULL counts as 0), row by row in an
    array: products are summed per Arrow batch and series in numpy, then by an aggregation."""
    k, names = list(keys), list(names)

    def run(it):
        import pandas as pd
        for pdf in it:
            x = np.nan_to_num(pdf[names].to_numpy(dtype=float))
            for at in pdf.groupby(k, sort=False, dropna=False).indices.values():
                cells = (x[at].T @ x[at]).ravel()
                out = pd.DataFrame({c: [pdf[c].iloc[at[0]]] * len(cells) for c in k})
                out["_cell"], out["_v"] = np.arange(len(cells)), cells
                yield out

    ship_package(rows.sparkSession)
    schema = T.StructType([*[rows.schema[c] for c in k], T.StructField("_cell", T.LongType()), T.StructField("_v", T.DoubleType())])
    sums = rows.select(*k, *names).mapInPandas(run, schema).groupBy(*k, "_cell").agg(F.sum("_v").alias("_v"))
    return sums.groupBy(*k).agg(F.transform(F.array_sort(F.collect_list(F.struct("_cell", "_v"))), lambda e: e["_v"]).alias("_g"))


def _gram_matrix(g, m: int):
    """Normal equations of the first ``m`` columns against the last one."""
    full = np.asarray(list(g), dtype=float)
    full = full.reshape(math.isqrt(len(full)), -1)
    return full[:m, :m], full[:m, -1], float(full[-1, -1])


def _ols(G, Xy, yy):
    """Coefficients and squared error, or None where the columns are dependent (to 1e-12 of their scale) or nothing is left to explain."""
    scale = np.sqrt(np.diag(G))
    if not scale.all() or np.linalg.matrix_rank(G / np.outer(scale, scale), tol=1e-12, hermitian=True) < len(G):
        return None
    beta = np.linalg.solve(G, Xy)
    ssr = yy - 2 * beta @ Xy + beta @ G @ beta
    return (beta, ssr) if ssr > 0 else None


def adf_test(df: DataFrame, keys: Sequence[str], pos: str, x: str, block: int = 720) -> DataFrame:
    """Augmented Dickey-Fuller with constant, lag order by AIC (library default maxlag
    ceil(12 (n/100)^(1/4)), at most n/2 - 2). Candidate orders are compared on the common
    sample t > maxlag from ONE Gramian of [1, x_{t-1}, dx_{t-1..t-maxlag}, dx_t]; the chosen
    order is refitted on its own sample from a second Gramian. The small solves run per series
    in ``mapInPandas``; only the largest maxlag (it sizes the halo) reaches the driver.
    Returns keys, n, adf_stat, adf_lags, adf_pvalue."""
    from .blocked import attach, materialize
    k = list(keys)
    first = df.groupBy(*k).agg(F.min(pos).alias("_p0"), F.count(x).alias("n"))
    longest = F.least(F.floor(F.col("n") / 2) - 2, F.ceil(F.lit(12.0) * F.pow(F.col("n") / 100.0, 0.25)))
    first = materialize(first.withColumn("_ml", F.greatest(longest, F.lit(0)).cast("int")))
    ml = int(first.agg(F.max("_ml")).first()[0] or 0)
    d = attach(df, first, k).withColumn("_t", F.col(pos) - F.col("_p0"))

    def build(w):
        cols = {"_lev": F.lag(x, 1).over(w), "_dy": F.col(x) - F.lag(x, 1).over(w)}
        for i in range(1, ml + 1):
            cols[f"_d{i}"] = F.lag(x, i).over(w) - F.lag(x, i + 1).over(w)
        return cols

    d = materialize(with_series_windows(d, k, pos, build, halo=ml + 1, block=max(block, ml + 1))
                    .withColumn("_one", F.lit(1.0)))
    names = _gram_names(ml)
    ship_package(df.sparkSession)

    def pick(it):
        for pdf in it:
            best = []
            for row in pdf.to_dict("records"):
                L, nobs = int(row["_ml"]), int(row["n"]) - 1 - int(row["_ml"])
                aics = []
                for p in range(0, L + 1):
                    if nobs <= 2 + p or (fit := _ols(*_gram_matrix(row["_g"], 2 + p))) is None:
                        continue
                    ssr = fit[1]
                    llf = -nobs / 2.0 * (math.log(2 * math.pi) + math.log(ssr / nobs) + 1)
                    aics.append((-2 * llf + 2 * (2 + p), p))
                best.append(min(aics)[1] if aics else 0)
            out = pdf[k].copy()
            out["_bp"] = best
            yield out

    size = first.select(*k, "n", "_ml")
    common = _gramians(d.where(F.col("_t") >= F.col("_ml") + 1), k, names).join(size, k)
    bp = materialize(common.mapInPandas(pick, T.StructType([*[df.schema[c] for c in k], T.StructField("_bp", T.LongType())])))
    g2 = (_gramians(attach(d, bp, k).where(F.col("_t") >= F.col("_bp") + 1), k, names)
          .join(size.drop("_ml"), k).join(bp, k))

    def final(it):
        import pandas as pd
        for pdf in it:
            st, pv, lags = [], [], []
            for row in pdf.to_dict("records"):
                p = int(row["_bp"])
                nobs = int(row["n"]) - 1 - p
                G, Xy, yy = _gram_matrix(row["_g"], 2 + p)
                fit = _ols(G, Xy, yy) if nobs > 2 + p else None
                v = None if fit is None else float(fit[0][1] / math.sqrt(fit[1] / (nobs - (2 + p)) * np.linalg.inv(G)[1, 1]))
                st.append(v)
                pv.append(None if v is None else adf_pvalue(v))
                lags.append(p)
            out = pdf[k + ["n"]].copy()
            out["adf_stat"], out["adf_lags"], out["adf_pvalue"] = pd.Series(st, dtype=object, index=out.index), lags, pd.Series(pv, dtype=object, index=out.index)
            yield out

    schema = T.StructType([*[df.schema[c] for c in k], T.StructField("n", T.LongType()),
                           T.StructField("adf_stat", T.DoubleType()), T.StructField("adf_lags", T.LongType()),
                           T.StructField("adf_pvalue", T.DoubleType())])
    return g2.mapInPandas(final, schema)
