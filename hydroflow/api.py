"""The reference's user-facing functions, under the same names, on Spark semantics.

Every function takes and returns DataFrames, takes the series key(s) as a parameter and
handles all series in one job (the reference loops over one file per site and scenario).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import calendar as cal
from .functions import clean
from .operators import blocked, features, metrics, models, reshape, split, tsstats
from .sources import files

define_feature_groups = models.FEATURE_GROUPS.copy


def prepare_data(df: DataFrame, keys: Sequence[str], ts: str = "Time", site_name: str | None = None,
                 ts_formats: Sequence[str] = clean.TS_FORMATS) -> DataFrame:
    """Parse the time column, coerce every other column to numbers (bad values -> NULL),
    forward-fill every numeric column per series, add the extra lag features."""
    d = df.withColumn(ts, clean.parse_ts(ts, ts_formats))
    d = d.withColumns({c: clean.to_number(c) for c in d.columns if c not in (ts, *keys)})
    num = [c for c in d.columns if c not in (ts, *keys)]
    d = blocked.row_position(d, list(keys), ts)
    d = blocked.fill(blocked.materialize(d), list(keys), "_pos", num, "ffill").drop("_pos", blocked.BLK)
    return features.add_lag_features(d, list(keys), ts, site_name=site_name, temp="Dry bulb degC")


def prep_rainfall(df: DataFrame, keys: Sequence[str], ts: str = "Time", rain: str = "Rainfall") -> DataFrame:
    """Calendar, lag, rolling, API and soil-moisture features of a gap-free hourly table."""
    return features.prep_rainfall(df, list(keys), ts, rain)


def add_lag_features(df: DataFrame, keys: Sequence[str], ts: str = "Time", site_name: str | None = None,
                     temp: str = "Dry bulb degC") -> DataFrame:
    return features.add_lag_features(df, list(keys), ts, site_name=site_name, temp=temp)


def run_acf_analysis(df: DataFrame, keys: Sequence[str], ts: str, target: str, variables: Sequence[str],
                     max_lag: int = 48) -> dict[str, DataFrame]:
    """ACF and PACF (of the original and the differenced series; the reference reports the latter), stationarity
    tests of both and lag advice for the target and each variable, all series and variables keyed by
    (keys, variable, variant)."""
    k = [*keys, "variable"]
    cols = [target, *variables]
    long = (df.select(*keys, cal.hour_id(ts).alias("_pos"), *[F.col(c).cast("double").alias(c) for c in cols])
            .unpivot([*keys, "_pos"], cols, "variable", "v").where(F.col("v").isNotNull() & ~F.isnan("v")))
    long = blocked.dense_position(long, k, "_pos", F.floor(F.col("_pos") / 720), out="_dpos").drop("_pos")
    return tsstats.analyse(long, k, "_dpos", "v", max_lag)


def feature_ablation_study(df: DataFrame, keys: Sequence[str], ts: str, target: str,
                           groups: dict | None = None, train_size: float = 0.7, split_method: str = "time",
                           key: str | None = None, trees: int = 50):
    """Cumulative feature-group ablation with the 4-algorithm vote (one model over all series;
    series keys stay available as columns)."""
    tr, te = _split(df, keys, ts, train_size, split_method, key)
    return models.ablation_study(tr, te, target, groups or models.FEATURE_GROUPS, trees=trees)


def algorithm_benchmark(df: DataFrame, keys: Sequence[str], ts: str, target: str, features_: Sequence[str],
                        train_size: float = 0.7, split_method: str = "time", key: str | None = None,
                        trees: int = 50) -> DataFrame:
    tr, te = _split(df, keys, ts, train_size, split_method, key)
    return models.algorithm_benchmark(tr, te, target, features_, trees=trees)


def feature_importance_analysis(df: DataFrame, keys: Sequence[str], ts: str, target: str,
                                features_: Sequence[str], train_size: float = 0.7, split_method: str = "time",
                                key: str | None = None, trees: int = 50) -> DataFrame:
    tr, _ = _split(df, keys, ts, train_size, split_method, key)
    return models.feature_importance(tr, target, features_, trees=trees).orderBy(F.desc("importance"))


def train_stacked_ensemble(df: DataFrame, keys: Sequence[str], ts: str, target: str, features_: Sequence[str],
                           key: str, n_folds: int = 5, train_size: float = 0.7, split_method: str = "time",
                           trees: int = 50) -> dict:
    tr, te = _split(df, keys, ts, train_size, split_method, key)
    return models.stacked_ensemble(tr, te, target, features_, key, folds=n_folds, trees=trees)


def create_pivot(long: DataFrame, rows: Sequence[str], col: str, values: Sequence[str], value: str) -> DataFrame:
    """Algorithm x site R2 or site x feature importance tables."""
    return reshape.pivot(long, rows, col, values, value)


def consolidate_ablation_results(spark: SparkSession, results_dir: str) -> tuple[DataFrame, DataFrame]:
    """Read every ``ablation_<site>_<scenario>.csv`` in one multi-file scan with provenance,
    then the consensus summary per feature group. Returns (combined, summary)."""
    comb = files.read_csv(spark, f"{results_dir}/ablation_*.csv", with_path=True, infer=True)
    comb = comb.withColumns(files.ablation_file_metadata(F.col("file_path"))).drop("file_path")
    comb = comb.withColumn("consensus", F.col("consensus").cast("boolean"))
    return comb, reshape.consensus_summary(comb)


def generate_statistics_table(algorithms: DataFrame, ablation: DataFrame, site: str = "site") -> DataFrame:
    """Per site: best algorithm (argmin RMSE), its RMSE and R2, and the RMSE improvement from
    the first to the last ablation step."""
    best = algorithms.groupBy(site).agg(
        F.min_by("algorithm", F.struct("rmse", "algorithm")).alias("best_algorithm"),
        F.min("rmse").alias("best_rmse"), F.min_by("r2", F.struct("rmse", "algorithm")).alias("best_r2"))
    imp = ablation.groupBy(site).agg(F.min_by("rmse", "step").alias("_f"), F.max_by("rmse", "step").alias("_l"))
    imp = imp.select(site, metrics.improvement_pct(F.col("_f"), F.col("_l")).alias("feature_improvement_pct"))
    return best.join(imp, site, "left")


def evaluate_predictions(df: DataFrame, actual: str, model_cols: Sequence[str],
                         groups: Sequence[str] = ()) -> DataFrame:
    """Per model (and group): RMSE, MAE, R2 (1 - SSE/SST), NSE, bias, correlation and the
    squared correlation (the R script's 'R2')."""
    long = reshape.unpivot(df, [*groups, actual], model_cols, "model", "pred")
    return long.groupBy(*groups, "model").agg(*metrics.error_metric_columns(actual, "pred"),
                                              *metrics.agreement_columns(actual, "pred"))


STRATA = "Restriction level"


def _split(df, keys, ts, frac, method, key):
    """Train and test rows: ``time`` (first part of each series), ``stratified`` (exact share of each ``STRATA`` level if the table has
    that column, else by hash, as in the reference) or any other name: by hash of the row's key."""
    if method == "time":
        s = split.time_split(df, keys, ts, frac)
    elif method == "stratified" and STRATA in df.columns:
        level = F.coalesce(F.col(f"`{STRATA}`").cast("double").cast("int"), F.lit(0))
        ident = F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in dict.fromkeys([*keys, key or ts])])
        s = split.stratified_split(df.withColumns({"_level": level, "_row": ident}), "_level", "_row", frac).drop("_level", "_row")
    else:
        s = split.hash_split(df, [key or ts, *keys], frac)
    s = blocked.materialize(s)
    return s.where("split = 'train'"), s.where("split = 'test'")


def run_experiments(df: DataFrame, keys: Sequence[str], ts: str, target: str, variables: Sequence[str] = (),
                    run_acf: bool = True, run_ablation: bool = True, run_benchmark: bool = True,
                    run_importance: bool = True, run_ensemble: bool = False, key: str | None = None,
                    train_size: float = 0.7, split_method: str = "time", trees: int = 50) -> dict:
    """The reference's ``main(flags)`` pipeline as one call over all series: ACF/stationarity,
    ablation with vote, benchmark and importance on the consensus features (all features when
    no ablation ran), optional stacked ensemble. Returns a dict of result DataFrames."""
    out: dict = {}
    groups = models.FEATURE_GROUPS
    feats = [c for fs in groups.values() for c in fs if c in df.columns]
    if run_acf:
        out.update(run_acf_analysis(df, keys, ts, target, [v for v in variables if v in df.columns]))
    if run_ablation:
        abl, votes = feature_ablation_study(df, keys, ts, target, groups, train_size, split_method, key, trees)
        out["ablation"], out["votes"] = abl, votes
        chosen = {r.feature_group for r in votes.where("consensus").select("feature_group").distinct().collect()}
        consensus = [c for g, fs in groups.items() if g in chosen for c in fs if c in df.columns]
        feats = consensus or feats
    if run_benchmark:
        out["algorithms"] = algorithm_benchmark(df, keys, ts, target, feats, train_size, split_method, key, trees)
    if run_importance:
        out["importance"] = feature_importance_analysis(df, keys, ts, target, feats, train_size, split_method,
                                                        key, trees)
    if run_ensemble and key:
        out["ensemble"] = train_stacked_ensemble(df, keys, ts, target, feats, key, 5, train_size, split_method, trees)
    return out
