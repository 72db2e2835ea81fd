"""Model fitting, selection and scoring on MLlib.

The reference fits scikit-learn / XGBoost / CatBoost models per site and scenario. Here every
learner is an MLlib estimator (distributed fit); a driver loop runs over *model configurations*
(steps x algorithms x folds), never over data. Deviations, stated once:
extra trees -> random forest without bootstrap on a third of the features per split (MLlib
has no random thresholds); XGBoost / CatBoost / sklearn GB -> three GBT configurations;
MLP -> not built (no MLlib regressor of that kind).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import error_metric_columns, gramian, halving_weights
from .reshape import consensus_from_ablation

SEED = 42

# The ordered feature groups of the ablation (order matters).
FEATURE_GROUPS: dict[str, list[str]] = {
    "date_basic": ["doy", "month", "mday", "wday", "hour"],
    "temp": ["Dry bulb degC"],
    "temp_lag1": ["Dry bulb degC lag1"],
    "temp_lag2_3": ["Dry bulb degC lag2", "Dry bulb degC lag3"],
    "temp_lag24": ["Dry bulb degC lag24"],
    "temp_rolling": ["Temp_6HR_mean", "Temp_12HR_mean", "Temp_24HR_mean"],
    "soilm": ["SoilMoisture"],
    "soilm_lag1": ["SoilMoisturelag1"],
    "rain": ["Rainfall"],
    "rain_lag1_2": ["Rainlag1", "Rainlag2"],
    "rain_lag3": ["Rainlag3"],
    "rain_rolling": ["Rain_L3HR", "Rain_L6HR", "Rain_L12HR", "Rain_L24HR", "Rain_L48HR"],
    "cyclical": ["sin_hour", "cos_hour"],
    "api": ["API"],
    "api_lag1": ["lag1API"],
}

ABLATION_ALGOS = ("RF", "XGB", "ET", "CB")
BENCH_ALGOS = ("XGBoost", "GradientBoosting", "CatBoost", "RandomForest", "ExtraTrees", "LinearRegression")


def regressor(name: str, label: str = "label", features: str = "features", pred: str = "prediction",
              trees: int = 50):
    common = dict(labelCol=label, featuresCol=features, predictionCol=pred)
    if name in ("RF", "RandomForest"):
        return RandomForestRegressor(numTrees=trees, seed=SEED, **common)
    if name in ("ET", "ExtraTrees"):
        return RandomForestRegressor(numTrees=trees, bootstrap=False, featureSubsetStrategy="onethird",
                                     seed=SEED, **common)
    if name in ("XGB", "XGBoost"):
        return GBTRegressor(maxIter=trees, maxDepth=6, stepSize=0.3, seed=SEED, **common)
    if name in ("GB", "GradientBoosting"):
        return GBTRegressor(maxIter=trees, maxDepth=3, stepSize=0.1, seed=SEED, **common)
    if name in ("CB", "CatBoost"):
        return GBTRegressor(maxIter=trees, maxDepth=6, stepSize=0.1, subsamplingRate=0.8, seed=SEED, **common)
    if name in ("LR", "LinearRegression"):
        return LinearRegression(solver="normal", **common)
    raise ValueError(name)


def pipeline(features: Sequence[str], algo: str, label: str, pred: str = "prediction", trees: int = 50) -> Pipeline:
    va = VectorAssembler(inputCols=list(features), outputCol=f"_fv_{pred}", handleInvalid="keep")
    return Pipeline(stages=[va, regressor(algo, label, f"_fv_{pred}", pred, trees)])


def _metrics(pred: DataFrame, label: str, p: str = "prediction") -> dict:
    return pred.agg(*error_metric_columns(label, p)).first().asDict()


def available(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Plan-time check: keep the feature names the table has (the reference's
    ``[f for f in features if f in train.columns]``)."""
    return [c for c in names if c in df.columns]


def ablation_study(train: DataFrame, test: DataFrame, label: str,
                   groups: dict[str, list[str]] = FEATURE_GROUPS, algos: Sequence[str] = ABLATION_ALGOS,
                   trees: int = 50) -> tuple[DataFrame, DataFrame]:
    """Add groups cumulatively, fit every algorithm, RMSE/MAE/R2 on the test rows; the
    vote (effective when RMSE and MAE both fell, consensus >= 3 of 4) runs on the result
    table. Returns (long metrics, votes)."""
    spark = train.sparkSession
    rows, cum = [], []
    for step, (g, feats) in enumerate(groups.items(), start=1):
        cum += feats
        have = available(train, cum)
        if not have:
            continue
        for a in algos:
            m = pipeline(have, a, label, trees=trees).fit(train)
            r = _metrics(m.transform(test), label)
            rows.append(("all", step, g, len(have), a, float(r["rmse"]), float(r["mae"]), float(r["r2"])))
    res = spark.createDataFrame(rows, "site string, step int, feature_group string, n_features int, "
                                      "algorithm string, rmse double, mae double, r2 double")
    return res, consensus_from_ablation(res, ["site"])


def algorithm_benchmark(train: DataFrame, test: DataFrame, label: str, features: Sequence[str],
                        algos: Sequence[str] = BENCH_ALGOS, trees: int = 50,
                        per_series: Sequence[str] = ()) -> DataFrame:
    """Every algorithm on one split; the metrics of all models come from ONE aggregation
    over the stacked predictions. ``per_series`` (key columns) fits one model per series, as
    the reference does per site and scenario: the driver loops over the distinct keys (a few
    rows), every fit is distributed, and metrics are grouped by (keys, algorithm)."""
    keys = list(per_series)
    series = [r.asDict() for r in train.select(*keys).distinct().collect()] if keys else [{}]
    preds = None
    for sk in series:
        cond = F.lit(True)
        for c, v in sk.items():
            cond = cond & (F.col(c) == F.lit(v))
        tr, te = train.where(cond), test.where(cond)
        for a in algos:
            p = (pipeline(available(train, features), a, label, trees=trees).fit(tr).transform(te)
                 .select(*keys, F.lit(a).alias("algorithm"), F.col(label).alias("y"), F.col("prediction").alias("p")))
            preds = p if preds is None else preds.unionByName(p)
    return preds.groupBy(*keys, "algorithm").agg(*error_metric_columns("y", "p"))


def feature_importance(train: DataFrame, label: str, features: Sequence[str], algo: str = "ET",
                       trees: int = 50) -> DataFrame:
    """Impurity importances of a tree ensemble as a (feature, importance) table."""
    feats = available(train, features)
    m = pipeline(feats, algo, label, trees=trees).fit(train)
    imp = m.stages[-1].featureImportances.toArray().tolist()
    return train.sparkSession.createDataFrame(list(zip(feats, [float(v) for v in imp])),
                                              "feature string, importance double")


def stacked_ensemble(train: DataFrame, test: DataFrame, label: str, features: Sequence[str], key: str | Sequence[str],
                     layer1: Sequence[str] = ("XGB", "GB", "CB", "RF", "ET", "LR"),
                     layer2: Sequence[str] = ("RF", "XGB", "ET"), folds: int = 5, trees: int = 50) -> dict:
    """L12-L14. Layer 1: each model x k folds; out-of-fold predictions become columns for the
    train rows, the mean over fold models for the test rows. Layer 2: features + layer-1
    columns, same folds. Layer 3: greedy weights (R2) on the layer-2 out-of-fold columns from
    ONE Gramian aggregation. Folds come from a hash of ``key`` (same folds in both layers); ``key`` is one or more columns
    that identify a row, over several series the series keys and the position."""
    from .split import kfold
    feats = available(train, features)
    key = [key] if isinstance(key, str) else list(key)
    tr = kfold(train, key, folds, SEED).cache()
    te = test

    def layer(tr, te, feats, models, prefix):
        for mname in models:
            col = f"{prefix}{mname}"
            oof, tests = None, []
            for f in range(folds):
                fit = pipeline(feats, mname, label, pred=col, trees=trees).fit(tr.where(F.col("fold") != f))
                o = fit.transform(tr.where(F.col("fold") == f)).select(*key, col)
                oof = o if oof is None else oof.unionByName(o)
                tests.append(fit.transform(te).select(*key, F.col(col).alias(f"_t{f}")))
            tmean = tests[0]
            for t in tests[1:]:
                tmean = tmean.join(t, key)
            tmean = tmean.select(*key, (sum(F.col(f"_t{f}") for f in range(folds)) / folds).alias(col))
            tr = tr.join(oof, key)
            te = te.join(tmean, key)
        return tr.cache(), te.cache()

    tr1, te1 = layer(tr, te, feats, layer1, "l1_")
    l1cols = [f"l1_{m}" for m in layer1]
    tr2, te2 = layer(tr1, te1, feats + l1cols, layer2, "l2_")
    l2cols = [f"l2_{m}" for m in layer2]
    g = gramian(tr2, label, l2cols).first().asDict()
    w, train_r2 = halving_weights(g, l2cols)
    blend = sum(F.col(c) * F.lit(x) for c, x in zip(l2cols, w))
    test_m = te2.withColumn("_p", blend).agg(*error_metric_columns(label, "_p")).first().asDict()
    return {"weights": dict(zip(l2cols, w)), "train_r2": float(train_r2), "test_r2": float(test_m["r2"]),
            "test_rmse": float(test_m["rmse"]), "test_mae": float(test_m["mae"])}


def hybrid(train: DataFrame, test: DataFrame, label: str, features: Sequence[str], base: str = "LR",
           booster: str = "XGB", trees: int = 50) -> DataFrame:
    """Base model, then a booster fitted on its residuals; prediction = base + booster."""
    feats = available(train, features)
    b = pipeline(feats, base, label, pred="_base", trees=trees).fit(train)
    tr = b.transform(train).withColumn("_resid", F.col(label) - F.col("_base"))
    r = pipeline(feats, booster, "_resid", pred="_boost", trees=trees).fit(tr)
    out = r.transform(b.transform(test)).withColumn("prediction", F.col("_base") + F.col("_boost"))
    return out.drop("_base", "_boost")


def save(model: PipelineModel, path: str) -> None:
    """Persist a fitted pipeline (replaces the reference's pickles)."""
    model.write().overwrite().save(path)


def score(models: dict[str, PipelineModel], table: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Score one feature table with every model (features computed once, not per model),
    clip negatives to 0 keeping NULLs (P8); long output (keep..., model, pred)."""
    out = None
    for name, m in models.items():
        s = m.transform(table).select(*keep, F.lit(name).alias("model"),
                                      F.when(F.col("prediction") < 0, F.lit(0.0))
                                      .otherwise(F.col("prediction")).alias("pred"))
        out = s if out is None else out.unionByName(s)
    return out


# ---------------------------------------------------------------- L16, L17, L18, A21

def gam_basis(df: DataFrame, x: str, knots: Sequence[float], hour: str = "hour", wday: str = "wday",
              harmonics: int = 3) -> tuple[DataFrame, list[str]]:
    """L16 re-aimed: smooth(x) as a truncated cubic spline basis at fixed knots, cyclic
    smooth(hour) as Fourier harmonics, day of week as indicator columns. Fit with a ridge
    ``LinearRegression(regParam)`` (penalised least squares, the GAM's smoothing)."""
    cols = {f"{x}_p1": F.col(x), f"{x}_p2": F.pow(F.col(x), 2), f"{x}_p3": F.pow(F.col(x), 3)}
    for i, k in enumerate(knots):
        cols[f"{x}_k{i}"] = F.pow(F.greatest(F.col(x) - F.lit(float(k)), F.lit(0.0)), 3)
    for h in range(1, harmonics + 1):
        ang = F.lit(2 * 3.141592653589793 * h) * F.col(hour) / F.lit(24.0)
        cols[f"{hour}_s{h}"] = F.sin(ang)
        cols[f"{hour}_c{h}"] = F.cos(ang)
    for d in range(1, 7):
        cols[f"{wday}_{d}"] = (F.col(wday) == d).cast("double")
    return df.withColumns(cols), list(cols)


def gam_fit(train: DataFrame, label: str, basis: Sequence[str], reg: float = 0.1):
    va = VectorAssembler(inputCols=list(basis), outputCol="_fv_gam", handleInvalid="keep")
    lr = LinearRegression(featuresCol="_fv_gam", labelCol=label, regParam=reg, elasticNetParam=0.0,
                          standardization=True)
    return Pipeline(stages=[va, lr]).fit(train)


def preprocessing(numeric: Sequence[str], categorical: Sequence[str] = (), pca_k: int | None = None,
                  min_level_share: float = 0.01, clip: tuple[float, float] | None = None, ordinal: bool = False) -> tuple[list, str]:
    """The candidate pipelines' preprocessing as pipeline stages: median imputation of numeric columns plus missing
    indicators, optional clipping at two quantiles (``clip``), folding of levels below ``min_level_share`` of the rows into one
    (``preprocess.LevelEncoder``), one-hot encoding of the rest (``ordinal``: their indices instead), standard scaling, optional
    PCA. Returns (stages, output column)."""
    from pyspark.ml.feature import Imputer, OneHotEncoder, PCA, SQLTransformer, StandardScaler
    from .preprocess import ExtremeClipper, LevelEncoder
    stages: list = []
    num = list(numeric)
    imp = [f"{c}_imp" for c in num]
    if num:
        ind = ", ".join(f"CAST(`{c}` IS NULL AS DOUBLE) AS `{c}_missing`" for c in num)
        stages.append(SQLTransformer(statement=f"SELECT *, {ind} FROM __THIS__"))
        stages.append(Imputer(inputCols=num, outputCols=imp, strategy="median"))
        if clip:
            stages.append(ExtremeClipper(inputCols=imp, outputCols=[f"{c}_clip" for c in num], lower=clip[0], upper=clip[1]))
            imp = [f"{c}_clip" for c in num]
    for c in categorical:
        stages.append(LevelEncoder(inputCol=c, outputCol=f"{c}_idx", minShare=min_level_share))
    cat_out = [f"{c}_idx" if ordinal else f"{c}_oh" for c in categorical]
    if categorical and not ordinal:
        stages.append(OneHotEncoder(inputCols=[f"{c}_idx" for c in categorical], outputCols=cat_out, handleInvalid="keep"))
    va = VectorAssembler(inputCols=imp + [f"{c}_missing" for c in num] + cat_out, outputCol="_pre_raw", handleInvalid="keep")
    stages += [va, StandardScaler(inputCol="_pre_raw", outputCol="_pre_scaled", withMean=True, withStd=True)]
    out = "_pre_scaled"
    if pca_k:
        stages.append(PCA(k=pca_k, inputCol=out, outputCol="_pre_pca"))
        out = "_pre_pca"
    return stages, out


# The published search ranges (low, high, logarithmic) under the names of the MLlib parameters that carry them; the
# booster's gamma, lambda and alpha and the linear learner's batch size have none.
SEARCH_RANGES = {
    "booster": {"maxIter": (64, 1024, True), "maxDepth": (2, 8, True), "stepSize": (1e-3, 1.0, True), "minInstancesPerNode": (1, 32, True),
                "subsamplingRate": (0.5, 1.0, False), "featureSubsetStrategy": (0.3, 1.0, False)},
    "linear": {"regParam": (1e-12, 1e-2, True)},
}


def random_params(est, rnd, ranges: dict) -> dict:
    """One draw from ``ranges`` for the parameters that ``est`` has (a forest has no step size and takes ``numTrees`` for ``maxIter``)."""
    import math
    out = {}
    for name, (lo, hi, log) in ranges.items():
        if name == "maxIter" and not est.hasParam(name):
            name = "numTrees"
        if not est.hasParam(name):
            continue
        v = math.exp(rnd.uniform(math.log(lo), math.log(hi))) if log else rnd.uniform(lo, hi)
        whole = isinstance(lo, int)
        out[est.getParam(name)] = min(max(round(v), lo), hi) if whole else f"{min(v, 1.0):.6f}" if name == "featureSubsetStrategy" else v
    return out


def random_search(train: DataFrame, label: str, features: Sequence[str], algo: str = "XGB", n_trials: int = 20,
                  parallelism: int = 7, train_ratio: float = 0.8, seed: int = SEED, ranges: dict | None = None):
    """Random search over ``ranges`` (default: the published ones for boosters or the linear learner) minimising MSE with
    ``TrainValidationSplit``, ``parallelism`` fits at a time. The Bayesian strategy of the hosted tuner is not built."""
    import random
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import TrainValidationSplit
    rnd = random.Random(seed)
    va = VectorAssembler(inputCols=available(train, features), outputCol="_fv_rs", handleInvalid="keep")
    est = regressor(algo, label, "_fv_rs", "prediction", trees=20)
    ranges = ranges or SEARCH_RANGES["linear" if algo in ("LR", "LinearRegression") else "booster"]
    grid = [random_params(est, rnd, ranges) for _ in range(n_trials)]
    tvs = TrainValidationSplit(estimator=Pipeline(stages=[va, est]), estimatorParamMaps=grid,
                               evaluator=RegressionEvaluator(labelCol=label, metricName="mse"),
                               trainRatio=train_ratio, parallelism=parallelism, seed=seed)
    model = tvs.fit(train)
    trials = train.sparkSession.createDataFrame(
        [(i, float(m)) for i, m in enumerate(model.validationMetrics)], "trial int, mse double")
    return model, trials


def job_outcomes(log: DataFrame, status: str = "status", seconds: str = "seconds",
                 groups: Sequence[str] = ()) -> DataFrame:
    """Outcome counts, success rate and mean run time of a scoring run log."""
    return log.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_jobs"),
        F.count_if(F.col(status) == "Completed").alias("n_completed"),
        F.count_if(F.col(status) == "Failed").alias("n_failed"),
        (F.count_if(F.col(status) == "Completed") / F.count(F.lit(1)) * 100).alias("success_pct"),
        F.avg(seconds).alias("mean_seconds"))
