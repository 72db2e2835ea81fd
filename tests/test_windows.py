"""Blocked windows, fills and the affine scan against plain pandas loops on small series
with NULL runs, using tiny blocks so that every cross-block path is exercised."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hydroflow.operators import windows
from hydroflow.operators.blocked import dense_position, fill, with_series_windows
from hydroflow.operators.scan import affine_scan


def _series(spark, n_series=3, n=57, null_frac=0.3, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(n_series):
        for i in range(n):
            v = float(rng.gamma(1.5, 2.0))
            if rng.random() < null_frac or (s == 1 and i < 9) or (s == 2 and i > n - 7):
                v = None
            rows.append((f"s{s}", i, v))
    pdf = pd.DataFrame(rows, columns=["site", "pos", "x"])
    return spark.createDataFrame(pdf, "site string, pos long, x double"), pdf


def _close(a, b):
    if a is None or (isinstance(a, float) and math.isnan(a)):
        return b is None or (isinstance(b, float) and math.isnan(b))
    return b is not None and not math.isnan(b) and abs(a - b) < 1e-9 * max(1.0, abs(a))


@pytest.mark.parametrize("block", [4, 8, 720])
def test_lags_rolling_and_fills_match_pandas(spark, block):
    df, pdf = _series(spark)
    halo = min(3, block)
    out = with_series_windows(df, ["site"], "pos", lambda w: {
        "l1": windows.lag("x", 1, w), "l3": windows.lag("x", halo, w),
        "r3": windows.rolling_full("x", halo, w), "m2": windows.rolling_full("x", 2, w, "mean")},
        halo=halo, block=block)
    out = fill(out.withColumns({"ff": F.col("x"), "bf": F.col("x"), "fb": F.col("l3")}), ["site"], "pos",
               ["ff"], "ffill", block)
    out = fill(out, ["site"], "pos", ["bf"], "bfill", block)
    out = fill(out, ["site"], "pos", ["fb"], "ffill_bfill", block)
    got = out.toPandas().sort_values(["site", "pos"]).reset_index(drop=True)
    exp = []
    for _, g in pdf.groupby("site"):
        g = g.sort_values("pos").copy()
        g["l1"] = g.x.shift(1)
        g["l3"] = g.x.shift(halo)
        g["r3"] = g.x.rolling(halo).sum()
        g["m2"] = g.x.rolling(2).mean()
        g["ff"] = g.x.ffill()
        g["bf"] = g.x.bfill()
        g["fb"] = g.x.shift(halo).ffill().bfill()
        exp.append(g)
    exp = pd.concat(exp).sort_values(["site", "pos"]).reset_index(drop=True)
    for c in ["l1", "l3", "r3", "m2", "ff", "bf", "fb"]:
        for a, b in zip(got[c].tolist(), exp[c].tolist()):
            assert _close(a, b), (c, a, b)


@pytest.mark.parametrize("block,sub,fanout", [(12, 3, 2), (24, 8, 512), (720, 120, 512)])
@pytest.mark.parametrize("cap", [None, 6.0])
def test_affine_scan_equals_loop(spark, block, sub, fanout, cap):
    rng = np.random.default_rng(7)
    rows = []
    for s in range(3):
        r = rng.gamma(0.6, 3.0, size=50 + 11 * s)
        for i, v in enumerate(r):
            rows.append((f"s{s}", 1000 + i, float(v)))
    pdf = pd.DataFrame(rows, columns=["site", "pos", "r"])
    df = spark.createDataFrame(pdf, "site string, pos long, r double")
    df = with_series_windows(df, ["site"], "pos", lambda w: {
        "prev": F.lag("r", 1).over(w), "first": F.lag("pos", 1).over(w).isNull()}, halo=1, block=block)
    a = 0.9
    capc = F.lit(cap) if cap is not None else F.lit(None)
    from hydroflow.operators.scan import affine_scan_many
    out = affine_scan_many(df, ["site"], "pos", {"x": (capc, F.when(F.col("first"), 0.0).otherwise(a),
                                                      F.when(F.col("first"), F.col("r")).otherwise(F.col("prev")))},
                           block=block, sub=sub, fanout=fanout)
    got = out.select("site", "pos", "x").toPandas().sort_values(["site", "pos"])
    for s, g in pdf.groupby("site"):
        r = g.sort_values("pos").r.tolist()
        x = [min(cap, r[0]) if cap else r[0]]
        for i in range(1, len(r)):
            v = a * x[-1] + r[i - 1]
            x.append(min(cap, v) if cap else v)
        gx = got[got.site == s].x.tolist()
        assert np.allclose(gx, x, rtol=1e-12, atol=1e-12)
        if cap:
            assert max(gx) <= cap


def test_dense_position(spark):
    df, pdf = _series(spark, null_frac=0.0)
    sparse = df.where((F.col("pos") % 3) != 1)
    out = dense_position(sparse, ["site"], "pos", F.floor(F.col("pos") / 5), out="p").toPandas()
    for _, g in out.groupby("site"):
        g = g.sort_values("pos")
        assert g.p.tolist() == list(range(len(g)))
