"""Data-profile report (Q1, Q3, Q4, Q7, Q8, Q10-Q12, Q14) as wide aggregations + unpivots.

Per-column statistics run on the long (column, value) table grouped by column: one shuffle of
partial aggregates; exact medians/percentiles via ``ranking.quantile_type7`` (histogram
refinement, no column gathered in one task)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import quantile_type7, quantiles_type7


def _missing(c: str, dtype) -> F.Column:
    """Missing = NULL, NaN, or a string that is empty / only white space."""
    col = F.col(c)
    if isinstance(dtype, T.StringType):
        return col.isNull() | (F.trim(col) == "")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def missing_ranking(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Q10: share of missing values per column (%), one aggregation, unpivoted."""
    cols = list(cols or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    agg = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.sum(_missing(c, types[c]).cast("long")).alias(c) for c in cols])
    long = agg.unpivot(["_n"], cols, "column", "n_missing")
    return long.select("column", "n_missing", (F.col("n_missing") / F.col("_n") * 100).alias("missing_pct"))


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact distinct count per column as ONE job: a union of single-column aggregations.
    Each branch reads only its column (columnar pruning) and deduplicates map-side; a single
    multi-column ``count(DISTINCT)`` would instead expand every row once per column."""
    from functools import reduce
    parts = [df.agg(F.lit(c).alias("column"), F.count_distinct(F.col(c)).alias("n_unique")) for c in cols]
    return reduce(lambda a, b: a.unionByName(b), parts)


def cardinality_ranking(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Q11: exact number of distinct non-null values per column."""
    return distinct_counts(df, list(cols or df.columns))


def number(c: str) -> F.Column:
    """A column as a double; NaN counts as missing, like NULL."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def to_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[number(c).alias(c) for c in cols]).unpivot([], list(cols), "column", "x")


def _per_column(agg: DataFrame, cols: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row of ``<column>__<name>`` cells -> one row per column."""
    cells = [F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}__{n}`").alias(n) for n in names]) for c in cols]
    return agg.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Q3/Q12/Q14: count, mean, median, min, max, std, population skew, Pearson kurtosis
    (Spark's kurtosis is excess, +3), skew warning (|skew| > 3), share of missing values. All moments of all
    columns come from one wide aggregation of the table."""
    wide = df.select(*[number(c).alias(c) for c in cols])
    names = ["n", "mean", "min", "max", "std", "skew", "kurtosis", "missing_pct"]
    aggs = []
    for c in cols:
        x = F.col(f"`{c}`")
        made = [F.count(x), F.avg(x), F.min(x), F.max(x), F.stddev_pop(x), F.skewness(x), F.kurtosis(x) + 3,
                (F.count(F.lit(1)) - F.count(x)) / F.count(F.lit(1)) * 100]
        aggs += [m.alias(f"{c}__{n}") for m, n in zip(made, names)]
    stats = _per_column(wide.agg(*aggs), cols, names)
    med = quantile_type7(to_long(df, cols), ["column"], "x", 0.5, "median")
    return (stats.join(distinct_counts(wide, cols), "column").join(med, "column", "left")  # one row per column each
            .withColumn("skew_warning", F.abs(F.col("skew")) > 3))


def outliers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Q4: RSTD = std of the values clipped to [p5, p95]; outliers lie outside median ± 5 RSTD.

    The bounds (three numbers per column) become literals, so both passes are plain wide aggregations."""
    q = {r["column"]: r for r in quantiles_type7(to_long(df, cols), ["column"], "x",
                                                 {"p5": 0.05, "p95": 0.95, "median": 0.5}).collect()}
    cols = [c for c in cols if c in q]  # a column without values has no bounds
    wide = df.select(*[number(c).alias(c) for c in cols])
    row = wide.agg(*[F.stddev_pop(F.least(F.greatest(F.col(f"`{c}`"), F.lit(q[c]["p5"])), F.lit(q[c]["p95"]))).alias(c)
                     for c in cols], F.lit(0).alias("_")).first()
    names = ["p5", "p95", "median", "rstd", "n", "n_outliers"]
    aggs = []
    for c in cols:
        x, m, r = F.col(f"`{c}`"), q[c]["median"], row[c]
        out = (x > F.lit(m + 5 * r)) | (x < F.lit(m - 5 * r))
        made = [F.lit(q[c]["p5"]), F.lit(q[c]["p95"]), F.lit(m), F.lit(r), F.count(x), F.sum(out.cast("long"))]
        aggs += [v.alias(f"{c}__{n}") for v, n in zip(made, names)]
    return (_per_column(wide.agg(*aggs), cols, names)
            .withColumn("outlier_pct", F.col("n_outliers") / F.col("n") * 100))


def duplicate_share(df: DataFrame) -> DataFrame:
    """Q7: share of rows that repeat an earlier identical row, over the full data."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.sum("_c").alias("n_rows"), F.sum(F.col("_c") - 1).alias("n_duplicates")) \
            .withColumn("duplicate_pct", F.col("n_duplicates") / F.col("n_rows") * 100)


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Q8: Pearson correlation of every column pair in ONE aggregation, returned long."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    agg = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("r")) for a, b in pairs]
    return agg.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def overview(df: DataFrame) -> DataFrame:
    """Q1: rows, columns, share of missing cells."""
    types = {f.name: f.dataType for f in df.schema.fields}
    miss = sum((_missing(c, t).cast("long") for c, t in types.items()), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(miss).alias("n_missing_cells")) \
             .withColumn("n_columns", F.lit(len(types))) \
             .withColumn("missing_pct", F.col("n_missing_cells") / (F.col("n_rows") * F.col("n_columns")) * 100)


def _robust_bounds(long: DataFrame, groups: Sequence[str]) -> DataFrame:
    """median, p5, p95, RSTD per group (the Q4 rule's inputs)."""
    from .blocked import attach
    q = quantiles_type7(long, list(groups), "x", {"p5": 0.05, "p95": 0.95, "median": 0.5})
    j = attach(long, q, groups)
    clipped = F.least(F.greatest(F.col("x"), F.col("p5")), F.col("p95"))
    return j.groupBy(*groups, "median").agg(F.stddev_pop(clipped).alias("rstd"))


def target_histogram(df: DataFrame, x: str, bins: int = 20) -> DataFrame:
    """Q5: histogram of the target without its outliers (equal width between the inlier
    min and max) plus one last bar holding the outliers' count and mean (bin = bins)."""
    from .blocked import with_scalars
    long = df.select(number(x).alias("x"), F.lit(0).alias("_g")).where(F.col("x").isNotNull())
    rb = _robust_bounds(long, ["_g"])
    j = with_scalars(long, rb.drop("_g"))
    is_out = (F.col("x") > F.col("median") + 5 * F.col("rstd")) | (F.col("x") < F.col("median") - 5 * F.col("rstd"))
    j = j.withColumn("_out", is_out)
    rng = j.where(~F.col("_out")).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    k = with_scalars(j, rng)
    w = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    b = F.when(F.col("_out"), F.lit(bins)).when(w > 0, F.least(F.floor((F.col("x") - F.col("_lo")) / w),
                                                                 F.lit(bins - 1))).otherwise(F.lit(0))
    return (k.withColumn("bin", b.cast("int")).groupBy("bin", F.col("_out").alias("outlier_bar"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_value")))


def outlier_rows(df: DataFrame, x: str, key: str, n: int = 10, seed: int = 42) -> DataFrame:
    """Q6: a sample of outlier rows (Q4 rule), the n with the smallest key hash."""
    from .blocked import with_scalars
    from .ranking import hash32
    long = df.select(number(x).alias("x"), F.lit(0).alias("_g")).where(F.col("x").isNotNull())
    rb = _robust_bounds(long, ["_g"]).drop("_g")
    j = with_scalars(df.where(number(x).isNotNull()), rb)
    out = (F.col(x) > F.col("median") + 5 * F.col("rstd")) | (F.col(x) < F.col("median") - 5 * F.col("rstd"))
    return (j.where(out).withColumn("_h", hash32(key, seed=seed))
            .orderBy("_h", key).limit(n).drop("_h", "median", "rstd"))


def column_types(df: DataFrame) -> DataFrame:
    """Q2 with explicit rules (the report gives definitions, not thresholds): datetime by type;
    binary = 2 distinct values; numeric = at least 90% of non-missing values cast to a finite
    double and more than 20 distinct values; categorical = at most max(20, 1% of rows)
    distinct values; otherwise numeric if castable, else text. One plain aggregation for the
    counts, one union of single-column aggregations for the distinct counts."""
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs = []
    for c, t in types.items():
        if isinstance(t, T.NumericType):      # no string round trip for typed numbers
            ok = F.col(c).isNotNull()
            good = ok & ~F.isnan(F.col(c).cast("double"))
        else:
            s = F.col(c).cast("string")
            ok = F.col(c).isNotNull() & (F.trim(s) != "")
            num = s.try_cast("double")
            good = ok & num.isNotNull() & ~F.isnan(num)
        aggs += [F.sum(ok.cast("long")).alias(f"{c}__n"), F.sum(good.cast("long")).alias(f"{c}__num")]
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__n").alias("n"), F.col(f"{c}__num").alias("num"),
                      F.lit(isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))).alias("is_dt"))
             for c, t in types.items()]
    counts = df.agg(*aggs).select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")
    j = counts.join(distinct_counts(df, list(types)), "column")   # both one row per column
    n, num, u = F.col("n"), F.col("num"), F.col("n_unique")
    share = F.when(n > 0, num / n).otherwise(F.lit(0.0))
    kind = (F.when(F.col("is_dt"), "datetime").when(u == 2, "binary")
            .when((share >= 0.9) & (u > 20), "numeric")
            .when(u <= F.greatest(F.lit(20), F.floor(n * 0.01)), "categorical")
            .when(share >= 0.9, "numeric").otherwise("text"))
    return j.select("column", kind.alias("type"), share.alias("numeric_share"), "n_unique")


def prediction_power(df: DataFrame, target: str, features: Sequence[str], key: str, frac: float = 0.8,
                     bins: int = 10, seed: int = 42) -> DataFrame:
    """Q9 re-aimed: per feature, decile bins fitted on an 80% hash split, the bin's train
    mean as the prediction, validation R2 clipped to [0, 1]. All features in one job on the
    unpivoted table; bin edges are exact quantiles (histogram refinement)."""
    from .ranking import hash32
    d = df.select((hash32(key, seed=seed) < F.lit(frac * 2.0 ** 32)).alias("_train"), number(target).alias("_y"),
                  *[number(c).alias(c) for c in features])
    edges = {r["column"]: r for r in quantiles_type7(to_long(d.where("_train"), features), ["column"], "x",
                                                     {f"e{i}": i / bins for i in range(1, bins)}).collect()}
    cells = []
    for c in features:
        if c in edges:
            x = F.col(f"`{c}`")
            b = sum(((x > F.lit(edges[c][f"e{i}"])).cast("int") for i in range(1, bins)), F.lit(0))
            cells.append(F.when(x.isNotNull(), F.struct(F.lit(c).alias("feature"), b.alias("bin"))))
    # one scan; every row adds to (feature, bin, split) counts and sums, combined map-side: no write, no join of rows
    sums = (d.select("_train", "_y", F.explode(F.filter(F.array(*cells), lambda s: s.isNotNull())).alias("_c"))
            .groupBy("_c.feature", "_c.bin").agg(*[agg.alias(n) for split in ("t", "v") for agg, n in _split_sums(split)]))
    total = sums.groupBy("feature").agg(F.sum("tn").alias("fn"), F.sum("ts").alias("fs"), F.sum("vn").alias("n"),
                                        F.sum("vs").alias("s"), F.sum("vq").alias("q"))
    j = sums.join(total, "feature")  # features x bins rows
    p = F.coalesce(F.col("ts") / F.when(F.col("tn") > 0, F.col("tn")), F.col("fs") / F.col("fn"))
    sse = F.when(F.col("vn") > 0, F.col("vq") - 2 * p * F.col("vs") + F.col("vn") * p * p).otherwise(F.lit(0.0))
    res = j.groupBy("feature").agg((F.lit(1.0) - F.sum(sse) / F.first(F.col("q") - F.col("s") * F.col("s") / F.col("n"))).alias("_r2"))
    return res.select("feature", F.least(F.greatest(F.col("_r2"), F.lit(0.0)), F.lit(1.0)).alias("prediction_power"))


def _split_sums(split: str) -> list[tuple[F.Column, str]]:
    """Count, sum and sum of squares of the target in the train (t) or validation (v) rows."""
    mine = F.col("_train") if split == "t" else ~F.col("_train")
    y = F.when(mine, F.col("_y"))
    return [(F.count(y), split + "n"), (F.coalesce(F.sum(y), F.lit(0.0)), split + "s"), (F.coalesce(F.sum(y * y), F.lit(0.0)), split + "q")]
