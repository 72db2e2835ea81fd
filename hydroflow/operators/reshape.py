"""Reshaping, ranking and roll-up reports."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import season, season_order


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str = "variable",
            value: str = "value") -> DataFrame:
    """V2: wide -> long."""
    return df.unpivot(list(ids), list(values), var, value)


def pivot(df: DataFrame, rows: Sequence[str], col: str, values: Sequence[str], value: str) -> DataFrame:
    """V1: long -> wide with a fixed value list (no extra job to discover it). Duplicate
    (row, col) pairs raise in the reference; here ``count`` guards it and ``first`` picks."""
    dup = df.groupBy(*rows, col).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > 1)
    if dup.limit(1).count():
        raise ValueError("pivot: duplicate entries")
    return df.groupBy(*rows).pivot(col, list(values)).agg(F.first(value))


def top_n(df: DataFrame, by: str, n: int, name: str, groups: Sequence[str] = ()) -> DataFrame:
    """The n largest ``by`` (ties by ``name``). Global top-n is ``orderBy().limit()``,
    which Spark plans as TakeOrderedAndProject (a per-partition heap, no full sort)."""
    if not groups:
        return df.orderBy(F.col(by).desc(), F.col(name)).limit(n)
    # two phases so a hot group is never ranked in one task: top n per (group, input
    # partition) first, then the final ranking over at most n x partitions rows per group
    order = [F.col(by).desc(), F.col(name)]
    pre = (df.withColumn("_pid", F.spark_partition_id())
           .withColumn("_rk", F.row_number().over(Window.partitionBy(*groups, "_pid").orderBy(*order)))
           .where(F.col("_rk") <= n).drop("_rk", "_pid"))
    w = Window.partitionBy(*groups).orderBy(*order)
    return pre.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= n).drop("_rk")


def season_year_mean(df: DataFrame, ts: str, cols: Sequence[str]) -> DataFrame:
    """A4: mean per (year, NZ season) of several columns."""
    return (df.withColumns({"year": F.year(ts), "season": season(ts)})
            .groupBy("year", "season").agg(*[F.avg(c).alias(f"mean_{c}") for c in cols])
            .withColumn("season_order", season_order("season")))


def month_mean(df: DataFrame, ts: str, cols: Sequence[str]) -> DataFrame:
    """A5: mean per calendar month, with the month label."""
    return (df.groupBy(F.month(ts).alias("month"))
            .agg(*[F.avg(c).alias(f"mean_{c}") for c in cols])
            .withColumn("month_label", F.date_format(F.make_date(F.lit(2000), F.col("month"), F.lit(1)), "MMM")))


def consensus_from_ablation(abl: DataFrame, keys: Sequence[str], algo: str = "algorithm",
                            step: str = "step", min_votes: int = 3) -> DataFrame:
    """L8 vote (A20) on a long ablation table (keys..., step, feature_group, n_features,
    algorithm, rmse, mae): a step is effective for an algorithm when RMSE and MAE both fell
    against its previous step (the first step always counts); consensus = votes >= min_votes.
    The table has one row per (series, step, algorithm): small, so plain windows are fine."""
    w = Window.partitionBy(*keys, algo).orderBy(step)
    eff = (F.coalesce(F.col("rmse") < F.lag("rmse").over(w), F.lit(True))
           & F.coalesce(F.col("mae") < F.lag("mae").over(w), F.lit(True)))
    e = abl.withColumn("eff", eff)
    return (e.groupBy(*keys, step, "feature_group", "n_features")
            .agg(F.sum(F.col("eff").cast("int")).alias("n_effective"))
            .withColumn("consensus", F.col("n_effective") >= min_votes))


def consensus_summary(votes: DataFrame) -> DataFrame:
    """A3: per feature group % of (site, scenario) with consensus, n_features, mean n_effective."""
    return (votes.groupBy("feature_group")
            .agg((F.avg(F.col("consensus").cast("double")) * 100).alias("consensus_pct"),
                 F.min("n_features").alias("n_features"),
                 F.avg("n_effective").alias("avg_n_effective")))
