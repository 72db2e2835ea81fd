"""Cases the test tables do not show: gaps, NaN, tiny magnitudes, late stream rows, partitioning."""
import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hydroflow import session
from hydroflow.operators import anomaly, blocked, features, profile, ranking, tsstats
from hydroflow.streaming.hourly import run_to_completion


@pytest.mark.parametrize("seed,block", [(0, 24), (1, 48), (2, 720)])
def test_lags_on_gapped_series_match_pandas(spark, seed, block):
    rng = np.random.default_rng(seed)
    hours = pd.date_range("2019-12-20", periods=24 * 90, freq="h")
    frames = []
    for site in ("a", "b"):
        keep = rng.random(len(hours)) > 0.1
        for start in rng.integers(0, len(hours) - 80, 3):
            keep[start:start + rng.integers(12, 72)] = False
        keep &= ~((hours.month == 2) & (hours.day == 29))
        frames.append(pd.DataFrame({"site": site, "ts": hours[keep], "temp": rng.normal(size=keep.sum()), "Rainfall": rng.random(keep.sum())}))
    pdf = pd.concat(frames)
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = features.add_lag_features(df, ["site"], "ts", block=block).toPandas().sort_values(["site", "ts"]).reset_index(drop=True)
    want = pdf.sort_values(["site", "ts"]).reset_index(drop=True)
    g = want.groupby("site")
    for name, col, k in (("Rainlag3", "Rainfall", 3), ("temp lag1", "temp", 1), ("temp lag24", "temp", 24)):
        x = g[col].transform(lambda s, k=k: s.shift(k).ffill().bfill())
        np.testing.assert_allclose(got[name], x)
    for n in (6, 24):
        np.testing.assert_allclose(got[f"Temp_{n}HR_mean"], g["temp"].transform(lambda s, n=n: s.rolling(n).mean().bfill()))


def test_recurrences_go_on_over_a_gap(spark):
    hours = [h for h in pd.date_range("2020-01-01", periods=60, freq="h") if not 20 <= (h - pd.Timestamp("2020-01-01")).total_seconds() / 3600 < 31]
    pdf = pd.DataFrame({"site": "a", "ts": hours, "Rainfall": np.arange(len(hours)) % 7 * 1.0})
    got = features.rain_recurrences(spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")), ["site"], block=24).toPandas().sort_values("ts")
    api, want = 0.0, []
    for i, r in enumerate(pdf.Rainfall):
        api = 0.0 if i == 0 else features.API_DECAY * api + pdf.Rainfall[i - 1]
        want.append(api)
    np.testing.assert_allclose(got.API, want)


def test_profile_small_values_and_nan(spark):
    df = spark.createDataFrame([(4e-7, 1.0), (3e-7, 2.0), (1.5364e-6, float("nan")), (None, 4.0)], "a double, b double")
    r = {x["column"]: x for x in profile.describe(df, ["a", "b"]).collect()}
    assert r["a"]["mean"] == pytest.approx(7.4546666667e-7) and r["a"]["n"] == 3
    assert r["b"]["mean"] == pytest.approx(7 / 3) and r["b"]["median"] == 2.0 and not r["b"]["skew_warning"]
    assert r["b"]["missing_pct"] == 25.0 and r["b"]["n_unique"] == 3
    out = {x["column"]: x for x in profile.outliers(df, ["a", "b"]).collect()}
    assert out["b"]["n"] == 3 and out["b"]["n_outliers"] == 0


def test_quantiles_with_heavy_tails(spark):
    x = [float(10.0 ** k) for k in range(-300, 301, 2)] * 3
    df = spark.createDataFrame([(v,) for v in x], "x double")
    targets = spark.createDataFrame([(0,), (10,), (451,), (len(x) - 1,)], "k long")
    got = {r.k: r.value for r in ranking.order_statistics(df, [], "x", targets, bins=256, final_rows=2).collect()}
    assert got == {k: sorted(x)[k] for k in (0, 10, 451, len(x) - 1)}


def test_forest_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(4000), "a": rng.normal(size=4000), "b": rng.normal(size=4000)}))
    scores = []
    for n in (1, 16):
        d = df.repartition(n, "b")
        f = anomaly.fit_isolation_forest(d, ["a", "b"], "id", trees=4)
        scores.append(anomaly.score(d, f, ["a", "b"]).toPandas().sort_values("id").anomaly_score.to_numpy())
    np.testing.assert_array_equal(*scores)


def test_stream_keeps_rows_that_come_out_of_order(spark):
    d = tempfile.mkdtemp(prefix="hf-late-")
    for i, day in enumerate((5, 6, 1, 7)):
        rows = [("s", pd.Timestamp(2020, 1, day, h).to_pydatetime(), 1.0) for h in range(24)]
        (spark.createDataFrame(rows, "event_type string, ts timestamp_ntz, value double").coalesce(1)
         .write.parquet(os.path.join(d, f"{i}.parquet")))
    schema = spark.read.parquet(os.path.join(d, "0.parquet")).schema
    out = run_to_completion(spark, d + "/*.parquet", schema, "event_type", "ts", "value")
    assert out.agg(F.sum("n")).first()[0] == 96


def test_lag_advice_lists_all_significant_lags(spark):
    p = spark.createDataFrame([("s", k, v) for k, v in ((1, 0.5), (2, 0.04), (3, 0.045), (4, 0.2), (5, 0.001))], "s string, lag int, pacf double")
    n = spark.createDataFrame([("s", 10_000)], "s string, n long")
    r = tsstats.lag_recommendation(p, ["s"], n).first()
    assert r.sig_pacf_lags == [1, 2, 3, 4] and r.recommended_lags == [1] and r.pacf_values == ["0.500", "0.040", "0.045", "0.200"]


def test_adf_matches_least_squares(spark):
    rng = np.random.default_rng(4)
    y = np.cumsum(rng.normal(size=300)) * 0.1 + rng.normal(size=300)
    got = tsstats.adf_test(spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)], "s string, pos long, y double"), ["s"], "pos", "y").first()
    p, dy = got.adf_lags, np.diff(y)
    t = np.arange(p, len(dy))
    x = np.column_stack([np.ones(len(t)), y[t], *[dy[t - i] for i in range(1, p + 1)]])
    beta, res = np.linalg.lstsq(x, dy[t], rcond=None)[:2]
    se = np.sqrt(res[0] / (len(t) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
    assert got.adf_stat == pytest.approx(beta[1] / se, rel=1e-6)


def test_salted_attach_equals_broadcast(spark):
    big = spark.range(500).withColumn("g", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7))
    small = spark.createDataFrame([(g, f"v{g}") for g in range(6)], "g long, v string")
    for how in ("inner", "left"):
        a = blocked.attach(big, small, ["g"], how)
        b = blocked.attach(big, small, ["g"], how, max_bytes=0)
        assert sorted(map(tuple, a.select("id", "g", "v").collect())) == sorted(map(tuple, b.select("id", "g", "v").collect()))


def test_checkpoint_folder_must_be_shared_on_a_cluster():
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                class S:
                    def getCheckpointDir(self):
                        return None
                return S()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
