"""Model jobs with one fit per series (site and scenario) and learner, all in one set of Spark jobs.

The driver loops over nothing but boosting rounds and tree levels (``keyed_trees``); series, learners, ablation steps and
folds are rows. Rows are told apart by ``ids`` (an hour, an order number); equal ids fall into the same fold."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from . import keyed_trees as kt
from .blocked import attach, materialize
from .metrics import error_metric_columns, gramian_columns, halving_weights
from .models import ABLATION_ALGOS, BENCH_ALGOS, FEATURE_GROUPS, available
from .reshape import consensus_from_ablation


def _long(wide: DataFrame, ids: Sequence[str], names: Sequence[str], algorithm: str = "algorithm", value: str = "prediction") -> DataFrame:
    return wide.unpivot(list(ids), list(names), algorithm, value)


def predictions_table(model: dict, train: DataFrame, test: DataFrame, ids: Sequence[str], label: str, clip: bool = False) -> DataFrame:
    """U1 + P8 + P9: train and test rows with ``split``, ``ground_truth``, ``algorithm``, ``prediction`` and ``residual``. ``clip``
    replaces negative predictions by 0."""
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")), allowMissingColumns=True)
    keep = list(dict.fromkeys([*model["keys"], *ids, "split", label]))
    p = _long(kt.predict(model, both, keep), keep, [a.name for a in model["learners"]])
    if clip:
        p = p.withColumn("prediction", F.when(F.col("prediction") < 0, F.lit(0.0)).otherwise(F.col("prediction")))
    out = [c for c in keep if c != label]
    return p.select(*out, F.col(f"`{label}`").alias("ground_truth"), "algorithm", "prediction", (F.col(f"`{label}`") - F.col("prediction")).alias("residual"))


def benchmark(train: DataFrame, test: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, ids: Sequence[str],
              algos: Sequence[str] = BENCH_ALGOS, trees: int = 50) -> DataFrame:
    """Every learner on every series; one row of test metrics per (keys, algorithm)."""
    model = kt.fit(train, keys, available(train, features), label, learners(algos, trees), ids)
    p = _long(kt.predict(model, test, [*keys, *[i for i in ids if i not in keys], label]), [*keys, *[i for i in ids if i not in keys], label], algos)
    return p.groupBy(*keys, "algorithm").agg(*error_metric_columns(label, "prediction"))


def learners(algos, trees):
    return [kt.learner(a, **({} if kt.learner(a).kind == "linear" else {"trees": trees})) for a in algos]


def feature_importance(train: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, ids: Sequence[str], algo: str = "ET", trees: int = 50) -> DataFrame:
    """Importances of a tree ensemble per series; they sum to 1 in each series that has a split."""
    return kt.importance(kt.fit(train, keys, available(train, features), label, learners([algo], trees), ids)).drop("algorithm")


def ablation(train: DataFrame, test: DataFrame, keys: Sequence[str], label: str, ids: Sequence[str], groups: dict[str, list[str]] = FEATURE_GROUPS,
             algos: Sequence[str] = ABLATION_ALGOS, trees: int = 50) -> tuple[DataFrame, DataFrame]:
    """L8 per series: groups are added cumulatively, every learner is fitted at every step (all steps at once: a step is a learner that
    sees the features so far), then the vote. Returns (metrics per step and algorithm, votes)."""
    feats, steps = [], []
    for step, (group, names) in enumerate(groups.items(), start=1):
        feats += [f for f in available(train, names) if f not in feats]
        if feats:
            steps.append((step, group, len(feats)))
    runs, rows = [], []
    for step, group, n in steps:
        for a in learners(algos, trees):
            name = f"s{step}_{a.name}"
            runs.append(kt.replace(a, name=name, features=tuple(range(n))))
            rows.append((name, step, group, n, a.name))
    model = kt.fit(train, keys, feats, label, runs, ids)
    keep = [*keys, *[i for i in ids if i not in keys], label]
    p = _long(kt.predict(model, test, keep), keep, [a.name for a in runs], "_run")
    steps = train.sparkSession.createDataFrame(rows, "_run string, step int, feature_group string, n_features int, algorithm string")
    got = p.groupBy(*keys, "_run").agg(*error_metric_columns(label, "prediction"))
    res = materialize(got.join(F.broadcast(steps), "_run").select(*keys, "step", "feature_group", "n_features", "algorithm", "n", "rmse", "mae", "r2"))
    return res, consensus_from_ablation(res, list(keys))


def stacked_ensemble(train: DataFrame, test: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, ids: Sequence[str],
                     layer1: Sequence[str] = ("XGB", "GB", "CB", "RF", "ET", "LR"), layer2: Sequence[str] = ("RF", "XGB", "ET"), folds: int = 5,
                     trees: int = 50) -> tuple[DataFrame, DataFrame]:
    """L12-L14 per series. Every layer fits (learner, fold) pairs together; training rows get the prediction of the model that did not see
    their fold, test rows the mean over the folds' models. The second layer sees features and first-layer columns; halving weights blend it.
    Returns (weights and metrics per series, predictions: keys, ids, split, ground_truth, layer-2 columns, prediction)."""
    feats = available(train, features)
    own = [*keys, *[i for i in ids if i not in keys]]
    keep = [*own, "split", label]
    both = materialize(train.select(*own, label, *feats).withColumn("split", F.lit("train")).unionByName(test.select(*own, label, *feats).withColumn("split", F.lit("test"))))

    def layer(table, cols, algos, prefix):
        runs = [kt.replace(a, name=f"{prefix}{a.name}_{f}", fold=f, folds=folds) for a in learners(algos, trees) for f in range(folds)]
        model = kt.fit(table.where("split = 'train'"), keys, cols, label, runs, ids)
        unseen = kt.predict(model, table.where("split = 'train'"), [*keep, *cols], out_of_fold=True)
        fresh = kt.predict(model, table.where("split = 'test'"), [*keep, *cols])
        new = [f"{prefix}{a}" for a in algos]
        pick = lambda a: [F.col(f"{prefix}{a}_{f}") for f in range(folds)]
        rest = [F.col(f"`{c}`") for c in (*keep, *cols)]
        return materialize(unseen.select(*rest, *[F.coalesce(*pick(a)).alias(n) for a, n in zip(algos, new, strict=True)]).unionByName(
            fresh.select(*rest, *[(sum(pick(a)) / F.lit(folds)).alias(n) for a, n in zip(algos, new, strict=True)]))), new

    first, l1 = layer(both, feats, layer1, "l1_")
    second, l2 = layer(first, [*feats, *l1], layer2, "l2_")
    weights = materialize(series_weights(second.where("split = 'train'"), keys, label, l2))
    blend = sum(F.col(c) * F.element_at("weights", F.lit(i + 1)) for i, c in enumerate(l2))
    out = attach(second.select(*keep, *l2), weights.select(*keys, "weights"), list(keys)).withColumn("prediction", blend)
    scores = out.where("split = 'test'").groupBy(*keys).agg(*error_metric_columns(label, "prediction"))
    table = weights.join(scores, list(keys), "left")
    return table, out.withColumnRenamed(label, "ground_truth").drop("weights")


def series_weights(df: DataFrame, keys: Sequence[str], label: str, models: Sequence[str]) -> DataFrame:
    """L14 per series: halving weights of the columns ``models`` (an array in their order) and the R2 of the blend, from one
    aggregation of products and one small solve per series."""
    sums = df.groupBy(*keys).agg(*gramian_columns(label, models))
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("weights", T.ArrayType(T.DoubleType())), T.StructField("train_r2", T.DoubleType())])

    def run(it):
        for pdf in it:
            got = [halving_weights(r, models) for r in pdf.to_dict("records")]
            out = pdf[list(keys)].copy()
            out["weights"], out["train_r2"] = [w for w, _ in got], [r if np.isfinite(r) else None for _, r in got]
            yield out

    ship_package(df.sparkSession)
    return sums.mapInPandas(run, schema)
