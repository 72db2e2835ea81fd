"""Train/test splits and folds (M1-M6, R4), all stable under repartitioning."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocked import attach, dense_position, with_scalars
from .ranking import hash32, within_quota

TWO32 = float(2 ** 32)


def time_split(df: DataFrame, keys: Sequence[str], ts: str, frac: float = 0.8,
               bucket=None, pos: str | None = None) -> DataFrame:
    """First ``floor(frac * n)`` rows of each series (by time) are 'train'.
    With ``pos`` (a gap-free position such as the hour id of an hourly grid) the rank is
    ``pos - min(pos)``: two per-series aggregates, no window. Otherwise positions come from
    ``dense_position`` (distributed prefix counts), not a per-series ``row_number`` that
    would sort a whole series in one task."""
    if pos is not None:
        st = df.groupBy(*keys).agg(F.min(pos).alias("_p0"), F.count(F.lit(1)).alias("_n"))
        return (attach(df, st, keys)
                .withColumn("split", F.when(F.col(pos) - F.col("_p0") < F.floor(F.col("_n") * F.lit(frac)), "train")
                            .otherwise("test"))
                .drop("_p0", "_n"))
    b = bucket if bucket is not None else F.date_trunc("month", F.col(ts))
    d = dense_position(df, keys, ts, b, out="_tpos")
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return (attach(d, n, keys)
            .withColumn("split", F.when(F.col("_tpos") < F.floor(F.col("_n") * F.lit(frac)), "train")
                        .otherwise("test"))
            .drop("_tpos", "_n"))


def hash_split(df: DataFrame, key_cols: Sequence[str], frac: float = 0.8, seed: int = 42) -> DataFrame:
    """M2: 'train' when the 32-bit md5 prefix of (key, seed) < frac * 2^32; sizes approximate."""
    return df.withColumn("split", F.when(hash32(*key_cols, seed=seed) < F.lit(frac * TWO32), "train")
                         .otherwise("test"))


def stratified_split(df: DataFrame, strata: str, key: str, frac: float = 0.7, seed: int = 42) -> DataFrame:
    """M3: exactly ``floor(frac * n_s)`` train rows per stratum (stratum key NULL -> 0, P19),
    chosen by hash order. Ranks come from ``hash_rank`` (no stratum in one task)."""
    d = df.withColumn("_s", F.coalesce(F.col(strata).cast("int"), F.lit(0))) \
          .withColumn("_h", hash32(key, seed=seed))
    q = d.groupBy("_s").agg(F.floor(F.count(F.lit(1)) * F.lit(frac)).alias("_q"))
    r = within_quota(d, ["_s"], "_h", key, q, out="_in")
    return (r.withColumn("split", F.when(F.col("_in"), "train").otherwise("test"))
            .drop("_s", "_h", "_in"))


def kfold(df: DataFrame, key_cols: Sequence[str], k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """M4: fold = hash mod k, the same folds for every layer that uses them."""
    return df.withColumn(out, F.pmod(hash32(*key_cols, seed=seed), F.lit(k)).cast("int"))


def ranked_sample(df: DataFrame, groups: Sequence[str], key: str, quota, seed: int = 42) -> DataFrame:
    """Per group keep the ``quota`` rows (int or column) with the smallest hash."""
    d = df.withColumn("_h", hash32(key, seed=seed))
    q = quota if not isinstance(quota, int) else F.lit(quota)
    qt = d.groupBy(*groups).agg(F.min(q).alias("_q"))
    r = within_quota(d, list(groups), "_h", key, qt, out="_in")
    return r.where("_in").drop("_h", "_in")


def month_sample(df: DataFrame, ts: str, key: str, total: int = 5000, seed: int = 42) -> DataFrame:
    """Within each year-month keep min(n_month, max(1, total // n_months)) rows.
    ``n_months`` is a window over the small month table, not a driver round trip."""
    d = df.withColumn("_ym", F.date_format(F.col(ts), "yyyy-MM"))
    months = d.groupBy("_ym").agg(F.count(F.lit(1)).alias("_nm"))
    n_months = months.agg(F.count(F.lit(1)).alias("_k"))
    months = with_scalars(months, n_months).withColumn(
        "_cap", F.greatest(F.lit(1), F.floor(F.lit(total) / F.col("_k")))).drop("_k")
    d = attach(d, months, ["_ym"])
    quota = F.least(F.col("_nm"), F.col("_cap"))
    return ranked_sample(d, ["_ym"], key, quota, seed).drop("_ym", "_nm", "_cap")
