import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from hydroflow.operators import models, split, tsstats
from hydroflow.sources.files import synthetic_hourly
from hydroflow.functions.calendar import hour_id


def _series(spark):
    rng = np.random.default_rng(5)
    e = rng.normal(size=800)
    ar = np.zeros(800)
    for i in range(1, 800):
        ar[i] = 0.6 * ar[i - 1] + e[i]
    rows = [("ar", 10 + i, float(v)) for i, v in enumerate(ar)]
    rows += [("rw", 10 + i, float(v)) for i, v in enumerate(np.cumsum(rng.normal(size=800)))]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["s", "pos", "x"])), ar


def test_acf_pacf_ar1(spark):
    df, ar = _series(spark)
    a = tsstats.acf(df, ["s"], "pos", "x", 10)
    got = {r.lag: r.acf for r in a.where("s = 'ar'").collect()}
    m = ar.mean()
    exp = [((ar[k:] - m) * (ar[:len(ar) - k] - m)).sum() / ((ar - m) ** 2).sum() for k in range(11)]
    assert abs(got[0] - 1) < 1e-12
    assert max(abs(got[k] - exp[k]) for k in range(11)) < 1e-9
    p = {r.lag: r.pacf for r in tsstats.pacf(a, ["s"], 10).where("s = 'ar'").collect()}
    assert abs(p[1] - 0.6) < 0.08 and max(abs(p[k]) for k in range(2, 11)) < 0.12


def test_adf_kpss_separate_stationary_from_random_walk(spark):
    df, _ = _series(spark)
    adf = {r.s: r.adf_pvalue for r in tsstats.adf_test(df, ["s"], "pos", "x").collect()}
    kp = {r.s: r.kpss_pvalue for r in tsstats.kpss_level(df, ["s"], "pos", "x").collect()}
    assert adf["ar"] < 0.05 and adf["rw"] > 0.05
    assert kp["ar"] > 0.05 and kp["rw"] < 0.05


def test_adf_pvalue_table():
    assert abs(tsstats.adf_pvalue(-2.86) - 0.05) < 0.005
    assert abs(tsstats.adf_pvalue(-3.43) - 0.01) < 0.003
    assert tsstats.kpss_pvalue(0.463) == 0.05


def test_models_learn_synthetic_inflow(spark):
    s = synthetic_hourly(spark, days=60).withColumn("site", F.lit("a"))
    s = s.withColumn("id", hour_id("ts"))
    tr, te = (split.hash_split(s, ["id"], 0.7).cache().where(f"split = '{x}'") for x in ("train", "test"))
    res = {r.algorithm: r.r2 for r in models.algorithm_benchmark(
        tr, te, "inflow", ["Rainfall", "temp"], algos=("RF", "LR"), trees=10).collect()}
    assert res["LR"] > 0.5 and res["RF"] > 0.4
    imp = models.feature_importance(tr, "inflow", ["Rainfall", "temp"], trees=10).toPandas()
    assert imp.sort_values("importance").feature.iloc[-1] == "Rainfall"
    abl, votes = models.ablation_study(tr, te, "inflow", {"temp": ["temp"], "rain": ["Rainfall"]},
                                       algos=("LR", "RF", "ET"), trees=5)
    v = {r.feature_group: r.n_effective for r in votes.collect()}
    assert v["temp"] == 3 and v["rain"] >= 2
    ens = models.stacked_ensemble(tr, te, "inflow", ["Rainfall", "temp"], "id", layer1=("LR", "RF"),
                                  layer2=("LR",), folds=3, trees=5)
    assert ens["test_r2"] > 0.5 and abs(sum(ens["weights"].values()) - 1) < 1e-12
    hy = models.hybrid(tr, te, "inflow", ["Rainfall", "temp"], trees=5)
    assert hy.where(F.col("prediction").isNull()).count() == 0


def test_gam_preprocessing_search_outcomes(spark):
    from pyspark.ml import Pipeline
    from hydroflow.functions.calendar import calendar_columns
    s = synthetic_hourly(spark, days=40).withColumns(calendar_columns("ts"))
    b, cols = models.gam_basis(s, "Rainfall", [1.0, 3.0, 6.0])
    m = models.gam_fit(b, "inflow", cols, reg=0.01)
    assert m.stages[-1].summary.r2 > 0.5
    stages, out = models.preprocessing(["Rainfall", "temp"], ["wday"], pca_k=3)
    p = Pipeline(stages=stages).fit(s.withColumn("wday", F.col("wday").cast("string"))).transform(
        s.withColumn("wday", F.col("wday").cast("string")))
    assert len(p.select(out).first()[0]) == 3
    _, trials = models.random_search(s, "inflow", ["Rainfall", "temp"], algo="LR", n_trials=4, parallelism=2)
    assert trials.count() == 4
    log = spark.createDataFrame([("Completed", 10.0), ("Failed", 4.0), ("Completed", 20.0)], "status string, seconds double")
    o = models.job_outcomes(log).first()
    assert (o.n_jobs, o.n_completed, o.n_failed) == (3, 2, 1) and abs(o.success_pct - 200 / 3) < 1e-9


def test_ar_error_regression_recovers_ar1(spark):
    from hydroflow.operators.regress import ar_error_regression
    rng = np.random.default_rng(11)
    rows = []
    for s in ("a", "b"):
        n = 900
        x = rng.normal(size=n)
        u = np.zeros(n)
        e = rng.normal(scale=0.3, size=n)
        for i in range(1, n):
            u[i] = 0.8 * u[i - 1] + e[i]
        y = 2.0 + 1.5 * x + u
        rows += [(s, i, float(x[i]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["s", "pos", "x", "y"]))
    tr, te = df.where("pos < 800"), df.where("pos >= 800")
    p = ar_error_regression(tr, te, ["s"], "pos", "y", ["x"], max_p=3).toPandas()
    assert len(p) == 200 and set(p.ar_p) <= {1, 2, 3}
    # the AR forecast helps most right after the end of training
    first = p[p.pos == 800]
    for _, r in first.iterrows():
        assert abs(r.prediction - r.y) < 1.5
    rmse = float(np.sqrt(((p.prediction - p.y) ** 2).mean()))
    assert rmse < 0.8


def test_isolation_forest_flags_planted_outliers(spark):
    from hydroflow.operators import anomaly
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"id": range(3000), "a": rng.normal(size=3000), "b": rng.normal(size=3000)})
    pdf.loc[:4, ["a", "b"]] = [[8, 8], [-9, 7], [10, -8], [-8, -9], [9, 0]]
    df = spark.createDataFrame(pdf)
    forest = anomaly.fit_isolation_forest(df, ["a", "b"], "id", trees=50)
    sc = anomaly.score(df, forest, ["a", "b"]).toPandas().sort_values("anomaly_score", ascending=False)
    assert set(sc.id.iloc[:4]) == {0, 1, 2, 3}          # extreme on both axes
    assert sc.set_index("id").anomaly_score[4] > sc.anomaly_score.quantile(0.95)  # extreme on one axis


def test_benchmark_per_series(spark):
    a = synthetic_hourly(spark, days=20).withColumn("site", F.lit("a"))
    b = synthetic_hourly(spark, days=20, seed=9).withColumn("site", F.lit("b"))
    s = a.unionByName(b).withColumn("id", hour_id("ts"))
    tr, te = (split.hash_split(s, ["site", "id"], 0.7).cache().where(f"split = '{x}'") for x in ("train", "test"))
    res = models.algorithm_benchmark(tr, te, "inflow", ["Rainfall", "temp"], algos=("LR",), trees=3,
                                     per_series=["site"]).collect()
    assert sorted(r.site for r in res) == ["a", "b"] and all(r.r2 > 0.4 for r in res)
