import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hydroflow.operators import gam, metrics, models


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    n = 2400
    d = pd.DataFrame({"site": np.where(np.arange(n) % 2 == 0, "a", "b"), "id": range(n), "rain": rng.gamma(1.5, 2, n), "hour": np.arange(n) // 2 % 24, "wday": np.arange(n) // 48 % 7})
    effect = np.array([0.5, -0.2, 0.1, 0.0, -0.4, 0.3, -0.3])
    d["flow"] = 3 * np.tanh(d.rain / 4) + np.sin(2 * np.pi * d.hour / 24) + 0.8 * np.cos(4 * np.pi * d.hour / 24) + effect[d.wday] + rng.normal(size=n) * 0.3
    return d


def test_basis_is_a_partition_and_periodic():
    b = gam.basis([-1.0, 0.0, 3.3, 10.0, 99.0], [0, 23.999999, 24, 12.5, 1], [0, 1, 2, 6, 3], 0.0, 10.0)
    assert np.allclose(b[:, :gam.X_BASIS].sum(1), 1) and np.allclose(b[:, gam.X_BASIS:gam.X_BASIS + gam.HOUR_BASIS].sum(1), 1)
    assert np.allclose(b[0, :gam.X_BASIS], b[1, :gam.X_BASIS])  # clipped to the range
    assert np.allclose(b[0, gam.X_BASIS:-gam.DAYS], b[2, gam.X_BASIS:-gam.DAYS]) and np.allclose(b[0, gam.X_BASIS:-gam.DAYS], b[1, gam.X_BASIS:-gam.DAYS], atol=1e-5)


def test_gcv_equals_the_hat_matrix(data):
    d = data[data.site == "a"].head(300)
    x = gam.basis(d.rain, d.hour, d.wday, d.rain.min(), d.rain.max())
    full = np.column_stack((x, d.flow))
    f = gam.fit_gramian(full.T @ full, len(d))
    px, ph, pd_ = gam.penalties()
    pen = f["lambda_x"] * px + f["lambda_hour"] * ph + f["lambda_day"] * pd_
    hat = x @ np.linalg.inv(x.T @ x + pen + 1e-9 * np.trace(x.T @ x) / gam.WIDTH * np.eye(gam.WIDTH)) @ x.T
    rss = ((d.flow - hat @ d.flow) ** 2).sum()
    assert f["edf"] == pytest.approx(np.trace(hat), rel=1e-6) and f["gcv"] == pytest.approx(len(d) * rss / (len(d) - np.trace(hat)) ** 2, rel=1e-6)


def test_beats_a_fixed_ridge_per_series(spark, data):
    df = spark.createDataFrame(data)
    tr, te = df.where("id % 3 <> 0"), df.where("id % 3 = 0")
    model = gam.fit(tr, ["site"], "rain", "hour", "wday", "flow")
    p = gam.predict(model, te, ["site"], "rain", "hour", "wday")
    got = {r.site: r.rmse for r in p.groupBy("site").agg(*metrics.error_metric_columns("flow", "prediction")).collect()}
    b, cols = models.gam_basis(df, "rain", [1.0, 3.0, 6.0])
    for s in "ab":
        m = models.gam_fit(b.where((F.col("id") % 3 != 0) & (F.col("site") == s)), "flow", cols)
        q = m.transform(b.where((F.col("id") % 3 == 0) & (F.col("site") == s))).agg(*metrics.error_metric_columns("flow", "prediction")).first()
        assert got[s] < q.rmse and got[s] < 0.34
    edf = {r.site: r.edf for r in model.collect()}
    assert all(5 < v < gam.WIDTH for v in edf.values())


def test_nulls_constant_and_unknown(spark):
    rows = [("c", 1.0, h % 24, h % 7, 2.0) for h in range(60)] + [("v", float(h), h % 24, h % 7, float(h) if h % 6 else None) for h in range(200)]
    df = spark.createDataFrame(rows, "site string, rain double, hour int, wday int, flow double")
    model = gam.fit(df, ["site"], "rain", "hour", "wday", "flow")
    more = df.unionByName(spark.createDataFrame([("new", 1.0, 1, 1, 1.0), ("v", None, 1, 1, 1.0)], df.schema))
    p = gam.predict(model, more, ["site"], "rain", "hour", "wday").toPandas()
    assert len(p) == 262 and np.allclose(p[p.site == "c"].prediction, 2.0, atol=1e-3)
    assert p[p.site == "new"].prediction.isna().all() and p[(p.site == "v") & p.rain.isna()].prediction.isna().all()
    assert gam.fit(df.limit(0), ["site"], "rain", "hour", "wday", "flow").count() == 0
