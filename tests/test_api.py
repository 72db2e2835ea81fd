import os
import tempfile

from pyspark.sql import functions as F

from hydroflow import api
from hydroflow.functions.calendar import calendar_columns
from hydroflow.sources.files import synthetic_hourly


def test_prepare_acf_evaluate(spark):
    s = synthetic_hourly(spark, days=20).withColumn("site", F.lit("a")).unionByName(
        synthetic_hourly(spark, days=20, seed=7).withColumn("site", F.lit("b")))
    raw = s.select("site", F.date_format("ts", "dd/MM/yyyy HH:mm:ss").alias("Time"),
                   F.col("Rainfall").cast("string").alias("Rainfall"),
                   F.when(F.rand(1) < 0.05, F.lit("bad")).otherwise(F.col("temp").cast("string")).alias("Dry bulb degC"),
                   F.col("inflow").cast("string").alias("flow"))
    prep = api.prepare_data(raw, ["site"], "Time")
    assert {"Dry bulb degC lag24", "Temp_24HR_mean", "Rainlag3"} <= set(prep.columns)
    assert prep.where(F.col("Dry bulb degC").isNull()).count() == 0  # coerced then forward-filled
    res = api.run_acf_analysis(prep, ["site"], "Time", "flow", ["Rainfall"], max_lag=10)
    st = res["stationarity"].collect()
    # one row per (site, variable, variant): the original and the differenced series of the target and each variable
    assert {(r.site, r.variable, r.variant) for r in st} == {(s, v, x) for s in "ab" for v in ("flow", "Rainfall") for x in ("orig", "diff")}
    assert len(st) == 8 and all(r.adf_pvalue is not None for r in st)
    assert res["acf"].where("lag = 0").agg(F.min("acf"), F.max("acf")).first() == (1.0, 1.0)
    ev = api.evaluate_predictions(prep.withColumn("m1", F.col("flow") * 1.1).withColumn("m2", F.lit(0.5)),
                                  "flow", ["m1", "m2"], ["site"])
    assert ev.count() == 4 and {"rmse", "nse", "bias", "r2_corr"} <= set(ev.columns)


def test_consolidate_and_statistics_table(spark):
    d = tempfile.mkdtemp(prefix="hf-abl-")
    rows = {"ablation_Upper_Hutt_CUR.csv": [("date_basic", 5, 4, True), ("temp", 6, 2, False)],
            "ablation_Upper_Hutt_ABI.csv": [("date_basic", 5, 3, True), ("temp", 6, 3, True)]}
    for name, rs in rows.items():
        with open(os.path.join(d, name), "w") as f:
            f.write("feature_group,n_features,n_effective,consensus\n")
            for r in rs:
                f.write(",".join(map(str, r)) + "\n")
    comb, summ = api.consolidate_ablation_results(spark, d)
    got = {r.feature_group: (r.consensus_pct, r.avg_n_effective) for r in summ.collect()}
    assert got == {"date_basic": (100.0, 3.5), "temp": (50.0, 2.5)}
    assert {r.scenario for r in comb.collect()} == {"CUR", "ABI"}
    algos = spark.createDataFrame([("s", "RF", 1.0, 0.9), ("s", "LR", 2.0, 0.5)], "site string, algorithm string, rmse double, r2 double")
    abl = spark.createDataFrame([("s", 1, 4.0), ("s", 2, 3.0)], "site string, step int, rmse double")
    t = api.generate_statistics_table(algos, abl).first()
    assert (t.best_algorithm, t.best_rmse, t.best_r2, t.feature_improvement_pct) == ("RF", 1.0, 0.9, 25.0)


def test_run_experiments_pipeline(spark):
    s = synthetic_hourly(spark, days=15).withColumn("site", F.lit("a"))
    s = s.withColumns(calendar_columns("ts")).withColumnRenamed("inflow", "flow")
    res = api.run_experiments(s, ["site"], "ts", "flow", ["Rainfall"], run_acf=False, trees=3)
    assert {"ablation", "votes", "algorithms", "importance"} <= set(res)
    assert res["algorithms"].count() == 6


def test_stratified_split_of_the_api(spark):
    rows = [("a" if i % 2 else "b", i, None if i % 10 == 0 else float(i % 3), 1.0) for i in range(600)]
    df = spark.createDataFrame(rows, "site string, ts int, `Restriction level` double, y double")
    tr, te = api._split(df, ["site"], "ts", 0.7, "stratified", None)
    assert set(tr.columns) == {*df.columns, "split"} and tr.count() + te.count() == 600
    level = F.coalesce(F.col("Restriction level").cast("int"), F.lit(0))
    n = {r[0]: r[1] for r in df.groupBy(level).count().collect()}
    got = {r[0]: r[1] for r in tr.groupBy(level).count().collect()}
    assert all(abs(got[k] - 0.7 * n[k]) < 1 for k in n)
    plain = api._split(df.drop("Restriction level"), ["site"], "ts", 0.7, "stratified", None)[0]
    by_hash = api._split(df.drop("Restriction level"), ["site"], "ts", 0.7, "hash", None)[0]
    assert sorted(r.ts for r in plain.collect()) == sorted(r.ts for r in by_hash.collect())
