"""Dry sites, one-row series and empty tables beside ordinary series: stated results, no failing job."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hydroflow.operators import metrics, tsstats


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(4)
    wet = rng.normal(size=300).cumsum() * 0.1 + rng.normal(size=300)
    rows = [("wet", i, float(v)) for i, v in enumerate(wet)] + [("dry", i, 0.0) for i in range(300)] + [("one", 0, 5.0)] + [("flat", i, 0.1) for i in range(40)]
    return spark.createDataFrame(rows, "s string, pos long, x double")


def by_site(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.s, []).append(r)
    return out


def test_acf_and_pacf(series):
    ac = tsstats.acf(series, ["s"], "pos", "x", 10)
    got = by_site(ac)
    assert set(got) == {"wet", "dry", "one", "flat"}
    assert {r.lag: r.acf for r in got["dry"]} == {0: 1.0} | dict.fromkeys(range(1, 11))
    assert all(r.acf is not None for r in got["wet"])
    alone = by_site(tsstats.acf(series.where("s = 'wet'"), ["s"], "pos", "x", 10))["wet"]
    assert {r.lag: round(r.acf, 9) for r in alone} == {r.lag: round(r.acf, 9) for r in got["wet"]}
    sig = {r.s: (r.sig_lags, r.acf_decays) for r in tsstats.acf_significance(ac, ["s"]).collect()}
    assert sig["dry"] == (0, True)
    pa = by_site(tsstats.pacf(ac, ["s"], 10))
    assert [r.pacf for r in sorted(pa["dry"], key=lambda r: r.lag)] == [1.0] + [None] * 10
    assert all(r.pacf is not None for r in pa["wet"])


def test_kpss_and_adf(series):
    k = {r.s: r for r in tsstats.kpss_level(series, ["s"], "pos", "x").collect()}
    assert k["wet"].kpss_stat > 0
    assert all((k[s].kpss_stat, k[s].kpss_pvalue) == (None, None) for s in ("dry", "one"))
    a = {r.s: r for r in tsstats.adf_test(series, ["s"], "pos", "x").collect()}
    assert a["wet"].adf_stat is not None and 0 <= a["wet"].adf_pvalue <= 1
    assert all((a[s].adf_stat, a[s].adf_pvalue) == (None, None) for s in ("dry", "flat") if s in a)


def test_analyse_with_a_dry_site(series):
    res = tsstats.analyse(series.where("s <> 'one'"), ["s"], "pos", "x", 20)
    st = {(r.s, r.variant): r.stationary for r in res["stationarity"].collect()}
    assert st["dry", "orig"] is None and st["wet", "diff"] is not None
    rec = {r.s: r for r in res["lag_recommendations"].collect()}
    assert rec["dry"].recommended_lags == [] and rec["dry"].data_used == "differenced"


def test_empty_tables(series):
    none = series.limit(0)
    for df in (tsstats.acf(none, ["s"], "pos", "x", 5), tsstats.kpss_level(none, ["s"], "pos", "x"), tsstats.adf_test(none, ["s"], "pos", "x")):
        assert df.count() == 0


def test_metrics_of_constant_actuals(spark):
    rows = [("a", float(i), i + 0.5) for i in range(10)] + [("b", 2.0, float(i)) for i in range(5)] + [("c", float(i), 3.0) for i in range(5)] + [("d", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, y double, p double")
    got = {r.g: r for r in metrics.error_metrics(df, ["g"], "y", "p").collect()}
    assert got["a"].r2 == pytest.approx(1 - 0.25 / 8.25) and got["a"].r == pytest.approx(1)
    assert (got["b"].r2, got["b"].nse, got["b"].r) == (None, None, None) and got["b"].rmse == pytest.approx(np.sqrt(2))
    assert got["c"].r is None and got["c"].r2 is not None and got["d"].r2 is None and got["d"].mae == 0
    tay = {r.g: r for r in metrics.taylor_stats(df, ["g"], "y", "p").collect()}
    assert tay["b"].r is None and tay["a"].r == pytest.approx(1)
    line = {r.g: r for r in metrics.fit_line(df, ["g"], "y", "p").collect()}
    assert line["a"].slope == pytest.approx(1) and line["a"].intercept == pytest.approx(0.5) and line["b"].slope is None


def test_zscore_and_improvement(spark):
    m = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 4.0)], "model string, x double, y double")
    z = {r.model: (r.z_x, r.z_y) for r in metrics.zscore(m, ["x", "y"]).collect()}
    assert z["a"][0] is None and z["a"][1] == pytest.approx(-np.sqrt(0.5))
    got = spark.createDataFrame([(0.0, 1.0), (4.0, 3.0)], "f double, l double").select(metrics.improvement_pct(F.col("f"), F.col("l")).alias("i"))
    assert [r.i for r in got.collect()] == [None, 25.0]


def test_halving_weights():
    rng = np.random.default_rng(0)
    y = rng.normal(size=50)
    df = pd.DataFrame({"y": y, "a": y + rng.normal(size=50), "b": y + rng.normal(size=50), "c": rng.normal(size=50)})

    def sums(d):
        g = {"n": len(d), "sy": d.y.sum(), "syy": (d.y**2).sum()}
        for m in "abc":
            g[f"s_y_{m}"] = (d.y * d[m]).sum()
            g |= {f"s_{m}_{k}": (d[m] * d[k]).sum() for k in "abc"}
        return g

    w, r2 = metrics.halving_weights(sums(df), list("abc"))
    p = df[list("abc")].to_numpy() @ w
    assert sum(w) == pytest.approx(1) and r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert set(w) <= {0.0, 0.25, 0.5, 1.0}
    assert np.isnan(metrics.halving_weights(sums(df.assign(y=1.0)), list("abc"))[1])
