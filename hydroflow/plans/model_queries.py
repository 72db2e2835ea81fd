"""Queries for models fitted per series: trees (L2-L5), importance (L10), ablation (L8), benchmark (L9), stacking (L12-L14), scoring
(L20, L21, U1).

Fits on the hourly table are per site; what SQL can state about a fit (a first boosted tree in closed form, sums over
its nodes) runs on the line items, per (return flag, line status)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keyed_trees as kt
from ..operators import metrics, series_models
from ..operators.blocked import materialize
from ..sources.tables import load
from .queries import ALL_FEATURES, D, PRICE_SCALE, R, _split, register, rounded, training_table

_SERIES = ["l_returnflag", "l_linestatus"]
_CUTS = {"l_quantity": [float(v) for v in range(4, 50, 3)], "l_discount": [round(0.005 + 0.01 * i, 3) for i in range(10)],
         "l_tax": [round(0.005 + 0.01 * i, 3) for i in range(8)]}
_IDS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _items(spark, sf_dir):
    return load(spark, sf_dir, "lineitem", [*_SERIES, *_IDS, *_CUTS, "l_extendedprice"]).withColumn("y", F.col("l_extendedprice") * F.lit(PRICE_SCALE))


def _sql_stump() -> str:
    cells = [(f, i, c) for f, cs in _CUTS.items() for i, c in enumerate(cs)]
    sums = ", ".join(f"sum(CASE WHEN {f} <= {D(c)} THEN g ELSE 0 END) AS g{k}, sum(CASE WHEN {f} <= {D(c)} THEN 1.0 ELSE 0 END) AS h{k}" for k, (f, _, c) in enumerate(cells))
    rows = " UNION ALL ".join(f"SELECT l_returnflag, l_linestatus, '{f}' AS feature, {k} AS k, CAST({D(c)} AS DOUBLE) AS cut, g{k} AS gl, h{k} AS hl, g, h FROM s"
                              for k, (f, _, c) in enumerate(cells))
    return f"""
WITH b AS (SELECT l_returnflag, l_linestatus, avg(l_extendedprice * {D(PRICE_SCALE)}) AS base FROM lineitem GROUP BY ALL),
x AS (SELECT l.*, l_extendedprice * {D(PRICE_SCALE)} - base AS g FROM lineitem l JOIN b USING (l_returnflag, l_linestatus)),
s AS (SELECT l_returnflag, l_linestatus, sum(g) AS g, CAST(count(*) AS DOUBLE) AS h, {sums} FROM x GROUP BY l_returnflag, l_linestatus),
c AS (SELECT *, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1) AS gain FROM ({rows}) WHERE hl >= 1 AND h - hl >= 1),
w AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY gain DESC, k) AS place FROM c)
SELECT l_returnflag, l_linestatus, feature, {R('cut', 'cut')}, {R('gain / h', 'gain_per_row')}, {R('0.3 * gl / (hl + 1)', 'left_value')},
       {R('0.3 * (g - gl) / (h - hl + 1)', 'right_value')}, CAST(hl AS BIGINT) AS n_left, CAST(h - hl AS BIGINT) AS n_right FROM w WHERE place = 1"""


@register("newton_stump", _sql_stump())
def q_newton_stump(spark, sf_dir):
    """L4: the first tree of second-order boosting at depth 1, per series, at given cuts: best cut, gain and Newton leaves."""
    feats = list(_CUTS)
    model = kt.fit(_items(spark, sf_dir), _SERIES, feats, "y", [kt.learner("XGB", trees=1, depth=1)], _IDS, edges=list(_CUTS.values()))
    at = lambda node, i: F.max(F.when(F.col("node") == node, F.col("blob")[i]))
    n = model["nodes"].groupBy("_key").agg(at(0, 0).alias("f"), at(0, 1).alias("b"), (at(0, 4) / at(0, 3)).alias("gain_per_row"), at(1, 2).alias("left_value"),
                                           at(2, 2).alias("right_value"), at(1, 3).cast("long").alias("n_left"), at(2, 3).cast("long").alias("n_right"))
    cuts = F.array(*[F.array(*[F.lit(v) for v in c]) for c in _CUTS.values()])
    return rounded(n.select(*[F.get_json_object("_key", f"$.{k}").alias(k) for k in _SERIES], F.array(*[F.lit(f) for f in feats])[F.col("f").cast("int")].alias("feature"),
                            cuts[F.col("f").cast("int")][F.col("b").cast("int")].alias("cut"), "gain_per_row", "left_value", "right_value", "n_left", "n_right"))


_ET_TREES = 10


@register("extra_trees_sums", f"""
SELECT l_returnflag, l_linestatus, CAST({_ET_TREES} AS BIGINT) AS n_trees, CAST({_ET_TREES} * count(*) AS BIGINT) AS root_rows,
  CAST({_ET_TREES} * count(*) AS BIGINT) AS leaf_rows, {R(f'{_ET_TREES} * avg(l_extendedprice * {D(PRICE_SCALE)})', 'root_values')},
  {R(f'{_ET_TREES} * sum(l_extendedprice * {D(PRICE_SCALE)}) / count(*)', 'leaf_values')}, {R('1.0', 'importance')}, TRUE AS better_than_mean
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def q_extra_trees_sums(spark, sf_dir):
    """L3 + L10: extra trees with drawn thresholds on all line items, per series: every tree holds all rows at its root and in its leaves, the mean
    over leaves is the mean over rows, importances sum to 1, and the fit beats the mean."""
    items = _items(spark, sf_dir)
    model = kt.fit(items, _SERIES, list(_CUTS), "y", [kt.learner("ET", trees=_ET_TREES, depth=6)], _IDS)
    root, leaf = F.col("node") == 0, F.col("blob")[0] < 0
    s = model["nodes"].groupBy("_key").agg(
        F.countDistinct("t").alias("n_trees"), F.sum(F.when(root, F.col("blob")[3])).cast("long").alias("root_rows"),
        F.sum(F.when(leaf, F.col("blob")[3])).cast("long").alias("leaf_rows"), F.sum(F.when(root, F.col("blob")[2])).alias("root_values"),
        (F.sum(F.when(leaf, F.col("blob")[2] * F.col("blob")[3])) / F.sum(F.when(root, F.col("blob")[3])) * F.countDistinct("t")).alias("leaf_values"))
    s = s.select(*[F.get_json_object("_key", f"$.{k}").alias(k) for k in _SERIES], "n_trees", "root_rows", "leaf_rows", "root_values", "leaf_values")
    imp = kt.importance(model).groupBy(*_SERIES).agg(F.sum("importance").alias("importance"))
    fit = kt.predict(model, items, [*_SERIES, "y"]).groupBy(*_SERIES).agg((F.avg((F.col("ET") - F.col("y")) ** 2) < F.var_pop("y")).alias("better_than_mean"))
    return rounded(s.join(imp, _SERIES).join(fit, _SERIES))


@register("algorithm_benchmark")
def q_algorithm_benchmark(spark, sf_dir):
    """The six learners of the reference, fitted per site, all sites and learners in one set of jobs; time split 70/30 per site."""
    tr, te = _split(training_table(spark, sf_dir))
    return series_models.benchmark(tr, te, ["site"], ALL_FEATURES, "flow", ["ts"])


@register("series_importance")
def q_series_importance(spark, sf_dir):
    """Extra-trees importances per site."""
    tr, _ = _split(training_table(spark, sf_dir))
    return series_models.feature_importance(tr, ["site"], ALL_FEATURES, "flow", ["ts"])


@register("scored_predictions")
def q_scored_predictions(spark, sf_dir):
    """L20 + L21 + U1: all six learners of every site score all its hours (features built once, predictions clipped at 0); the accuracy table per
    (site, model) over train and test rows."""
    t = training_table(spark, sf_dir)
    tr, te = _split(t)
    model = kt.fit(tr, ["site"], ALL_FEATURES, "flow", series_models.learners(series_models.BENCH_ALGOS, 50), ["ts"])
    p = materialize(series_models.predictions_table(model, tr.drop("split"), te.drop("split"), ["ts"], "flow", clip=True))
    return p.withColumnRenamed("algorithm", "model").groupBy("site", "model").agg(*metrics.error_metric_columns("ground_truth", "prediction"))


@register("arma_error_regression")
def q_arma_error_regression(spark, sf_dir):
    """Per site, regression of the inflow proxy on rain features with ARMA(p, q) errors (orders by BIC), forecast over the last 30% of
    hours; test metrics per site."""
    from ..functions.calendar import hour_id
    from ..operators.arma import arma_error_regression
    tr, te = _split(training_table(spark, sf_dir).withColumn("_pos", hour_id("ts")))
    p = arma_error_regression(tr, te, ["site"], "_pos", "flow", ["Rainfall", "Rain_L6HR", "API", "SoilMoisture"])
    return p.groupBy("site", "ar_p", "ma_q").agg(*metrics.error_metric_columns("flow", "prediction"))


#: Trees of each learner in the registered ablation: 15 steps x 4 learners x all sites take minutes at the library's default of 50.
ABLATION_TREES = 10


@register("series_ablation")
def q_series_ablation(spark, sf_dir):
    """Cumulative ablation over the 15 feature groups with four learners per site (``ABLATION_TREES`` trees each), and the vote."""
    tr, te = _split(training_table(spark, sf_dir))
    return series_models.ablation(tr, te, ["site"], "flow", ["ts"], trees=ABLATION_TREES)[1]


_SHARE = 0.05


@register("rare_levels", f"""
WITH c AS (SELECT source AS level, count(*) AS n FROM documents GROUP BY source),
k AS (SELECT level, row_number() OVER (ORDER BY n DESC, level) - 1 AS i FROM c WHERE level IS NOT NULL AND n >= {D(_SHARE)} * (SELECT count(*) FROM documents))
SELECT coalesce(k.i, (SELECT count(*) FROM k)) AS level_index, CAST(sum(c.n) AS BIGINT) AS n FROM c LEFT JOIN k ON c.level = k.level GROUP BY 1""")
def q_rare_levels(spark, sf_dir):
    """Documents per encoded source, sources below ``_SHARE`` of the rows folded into one level."""
    from ..operators.preprocess import LevelEncoder
    d = load(spark, sf_dir, "documents", ["source"])
    coded = LevelEncoder(inputCol="source", outputCol="i", minShare=_SHARE).fit(d).transform(d)
    return coded.groupBy(F.col("i").cast("long").alias("level_index")).agg(F.count(F.lit(1)).alias("n"))


@register("gam_per_site")
def q_gam_per_site(spark, sf_dir):
    """Per site, smooth of rain + cyclic smooth of the hour + weekday effect, smoothing by GCV; effective degrees of freedom and test metrics."""
    from ..operators import gam
    tr, te = _split(training_table(spark, sf_dir))
    model = gam.fit(tr, ["site"], "Rainfall", "hour", "wday", "flow")
    p = gam.predict(model, te, ["site"], "Rainfall", "hour", "wday")
    return p.groupBy("site").agg(*metrics.error_metric_columns("flow", "prediction")).join(model.select("site", "edf"), "site")


_SEG_FEATURES, _SEG_BINS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"], 64


def _sql_feature_segments() -> str:
    longs = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y, (l_orderkey % 5) <> 0 AS tr FROM lineitem"
                               for f in _SEG_FEATURES)
    part = [f"sum({c}) FILTER (WHERE {w})" for w in ("bin <= c1", "bin > c1 AND bin <= c2", "bin > c2") for c in ("n", "s")]
    m = "CASE WHEN bin <= c1 THEN m1 WHEN bin <= c2 THEN m2 ELSE m3 END"
    return f"""
WITH lg AS ({longs}),
rg AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM lg GROUP BY feature),
b AS (SELECT lg.feature, CAST(least(floor((x - lo) / (hi - lo) * {_SEG_BINS}), {_SEG_BINS - 1}) AS INTEGER) AS bin, min(lo) AS lo, min(hi) AS hi,
      sum(CASE WHEN tr THEN 1.0 ELSE 0 END) AS n, sum(CASE WHEN tr THEN y ELSE 0 END) AS s, sum(CASE WHEN tr THEN y * y ELSE 0 END) AS ss,
      sum(CASE WHEN tr THEN 0 ELSE 1.0 END) AS nv, sum(CASE WHEN tr THEN 0 ELSE y END) AS sv, sum(CASE WHEN tr THEN 0 ELSE y * y END) AS ssv
      FROM lg JOIN rg ON lg.feature = rg.feature GROUP BY 1, 2),
p AS (SELECT feature, bin, sum(n) OVER w AS cn, sum(s) OVER w AS cs, sum(n) OVER (PARTITION BY feature) AS tn, sum(s) OVER (PARTITION BY feature) AS ts
      FROM b WHERE n > 0 WINDOW w AS (PARTITION BY feature ORDER BY bin)),
g AS (SELECT i.feature, i.bin AS c1, j.bin AS c2,
      i.cs * i.cs / i.cn + (j.cs - i.cs) * (j.cs - i.cs) / (j.cn - i.cn) + (i.ts - j.cs) * (i.ts - j.cs) / (i.tn - j.cn) AS gain
      FROM p i JOIN p j ON i.feature = j.feature AND i.bin < j.bin WHERE j.cn < j.tn),
c AS (SELECT feature, c1, c2 FROM g QUALIFY row_number() OVER (PARTITION BY feature ORDER BY gain DESC, c1, c2) = 1),
t AS (SELECT b.*, c1, c2 FROM b JOIN c ON b.feature = c.feature),
ms AS (SELECT feature, {part[1]} / {part[0]} AS m1, {part[3]} / {part[2]} AS m2, {part[5]} / {part[4]} AS m3 FROM t GROUP BY feature),
e AS (SELECT t.*, {m} AS m FROM t JOIN ms ON t.feature = ms.feature)
SELECT feature, [min(lo) + (min(hi) - min(lo)) * (min(c1) + 1) / {_SEG_BINS}, min(lo) + (min(hi) - min(lo)) * (min(c2) + 1) / {_SEG_BINS}] AS cuts,
       {R('1 - sum(ss - 2 * m * s + m * m * n) / (sum(ss) - sum(s) * sum(s) / sum(n))', 'train_r2')},
       {R('least(greatest(1 - sum(ssv - 2 * m * sv + m * m * nv) / (sum(ssv) - sum(sv) * sum(sv) / sum(nv)), 0.0), 1.0)', 'power')}
FROM e GROUP BY feature"""


@register("feature_segments", _sql_feature_segments())
def q_feature_segments(spark, sf_dir):
    """Q9: per feature, the three segments that predict the price best (cuts by dynamic programming on bin sums), R2 on the training
    orders and on the held-out fifth."""
    from ..operators.segmentation import feature_segments
    l = load(spark, sf_dir, "lineitem", ["l_orderkey", *_SEG_FEATURES, "l_extendedprice"])
    return rounded(feature_segments(l, "l_extendedprice", _SEG_FEATURES, F.col("l_orderkey") % 5 != 0, segments=3, bins=_SEG_BINS))
