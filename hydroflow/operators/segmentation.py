"""Best piecewise-constant model of a target on one feature at a time (Q9: how well a column predicts by itself).

One scan finds each feature's range, one aggregate reduces the rows to ``bins`` bins per feature (map-side combined, so a
shuffle moves bins and never rows), with the sums of training and validation rows side by side. On that table the segments
with the least squared error are found exactly by dynamic programming, per feature in a task that holds ``bins`` rows, and
their validation error follows from the same sums without reading the rows again."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SUMS = ["n", "s", "ss", "nv", "sv", "ssv"]


def best_cuts(n: np.ndarray, s: np.ndarray, segments: int) -> list[int]:
    """Last bin of every segment but the last, for at most ``segments`` runs of bins (all with n > 0) that maximise
    sum(s^2 / n), which minimises the squared error around the segment means. Ties: the earliest cuts."""
    k = len(n)
    segments = min(segments, k)
    cn, cs = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(s)])
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (cs[None, :] - cs[:, None]) ** 2 / (cn[None, :] - cn[:, None])  # of bins [i, j)
    gain[np.tril_indices(k + 1)] = -np.inf
    best = gain[:, k]  # of bins [i, k) as one segment
    after = []
    for _ in range(segments - 1):  # one segment more in front
        total = gain + best[None, :]
        after.append(total.argmax(1))
        best = total.max(1)
    cuts, at = [], 0
    for step in reversed(after):
        at = int(step[at])
        cuts.append(at - 1)
    return cuts


def bin_sums(df: DataFrame, target: str, features: Sequence[str], train: Column, bins: int = 64) -> DataFrame:
    """feature, bin, lo, hi (the feature's range) and count, sum and sum of squares of the target in training (n, s, ss) and
    validation rows (nv, sv, ssv). Rows whose feature or target is NULL or not finite are left out."""
    def finite(c):
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))

    y = F.col(target).cast("double")
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    long = (df.select(y.alias("y"), F.coalesce(train, F.lit(False)).alias("tr"), F.explode(cells).alias("c")).select("y", "tr", "c.*")
            .where(finite(F.col("y")) & finite(F.col("x"))))
    ends = df.where(finite(y)).agg(*[g(F.when(finite(F.col(f).cast("double")), F.col(f).cast("double"))).alias(f"{name}{i}")
                                     for i, f in enumerate(features) for name, g in (("lo", F.min), ("hi", F.max))])
    ranges = ends.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"))
                                             for i, f in enumerate(features)])).alias("r")).select("r.*")
    placed = long.join(F.broadcast(ranges), "feature")  # one row per feature named in the call
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    sums = [F.sum(F.when(F.col("tr") == flag, e).otherwise(0.0)).alias(f"{name}{tail}")
            for flag, tail in ((True, ""), (False, "v")) for name, e in (("n", F.lit(1.0)), ("s", F.col("y")), ("ss", F.col("y") * F.col("y")))]
    return placed.groupBy("feature", at.cast("int").alias("bin"), "lo", "hi").agg(*sums)


def feature_segments(df: DataFrame, target: str, features: Sequence[str], train: Column, segments: int = 4, bins: int = 64) -> DataFrame:
    """feature, cuts (upper ends of all segments but the last), train_r2 and power (validation R2 clipped to [0, 1]).
    R2 is NULL where the target does not vary or no row is left; a constant feature has no cuts and no power."""
    def fit(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("bin")
        t = b[b.n > 0]
        cuts, r2, power = [], None, None
        if len(t):
            last = t.bin.to_numpy()[best_cuts(t.n.to_numpy(), t.s.to_numpy(), segments)] if len(t) > 1 else np.zeros(0, dtype=int)
            seg = b.assign(seg=np.searchsorted(last, b.bin.to_numpy())).groupby("seg")[_SUMS].sum()
            mean = seg.s / seg.n
            lo, hi = float(b.lo.iloc[0]), float(b.hi.iloc[0])
            cuts = [lo + (hi - lo) * (int(i) + 1) / bins for i in last]
            r2 = _r2(seg.n.sum(), seg.s.sum(), seg.ss.sum(), (seg.ss - seg.s * mean).sum())
            power = _r2(seg.nv.sum(), seg.sv.sum(), seg.ssv.sum(), (seg.ssv - 2 * mean * seg.sv + mean * mean * seg.nv).sum())
        return pd.DataFrame({"feature": [b.feature.iloc[0]], "cuts": [cuts], "train_r2": [r2],
                             "power": [None if power is None else min(max(power, 0.0), 1.0)]})

    return (bin_sums(df, target, features, train, bins).groupBy("feature")
            .applyInPandas(fit, "feature string, cuts array<double>, train_r2 double, power double"))


def _r2(n: float, s: float, ss: float, error: float) -> float | None:
    spread = ss - s * s / n if n else 0.0
    return float(1 - error / spread) if spread > 1e-12 * max(abs(ss), 1e-300) else None
