import os
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from hydroflow.operators import features, resample
from hydroflow.streaming.hourly import run_to_completion


def _raw(spark, seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for site, n in (("a", 400), ("b", 50), ("c", 1)):
        start = pd.Timestamp("2019-02-27 22:00:00") if site == "a" else pd.Timestamp("2019-03-01")
        secs = np.sort(rng.integers(0, 6 * 24 * 3600, size=n))
        for s in secs:
            v = float(rng.gamma(1.0, 2.0)) if rng.random() > 0.1 else None
            rows.append((site, start + pd.Timedelta(seconds=int(s)), v))
    pdf = pd.DataFrame(rows, columns=["site", "ts", "value"])
    return spark.createDataFrame(pdf, "site string, ts timestamp_ntz, value double"), pdf


def test_hourly_sum_matches_pandas_resample(spark):
    df, pdf = _raw(spark)
    got = resample.hourly_sum(df, ["site"], "ts", "value", out="rain").toPandas()
    for site, g in pdf.groupby("site"):
        exp = g.set_index("ts")["value"].resample("1h").sum()
        mine = got[got.site == site].sort_values("ts")
        assert len(mine) == len(exp)
        assert np.allclose(mine.rain.to_numpy(), exp.to_numpy())
        assert list(pd.to_datetime(mine.ts)) == list(exp.index)


def test_prep_rainfall_matches_reference_loop(spark):
    df, pdf = _raw(spark)
    hourly = resample.hourly_sum(df, ["site"], "ts", "value", out="Rainfall")
    got = features.prep_rainfall(hourly, ["site"], block=48).toPandas()
    for site, g in pdf.groupby("site"):
        r = g.set_index("ts")["value"].resample("1h").sum().reset_index(drop=True)
        e = pd.DataFrame({"Rainfall": r})
        e["Rainlag1"] = e.Rainfall.shift(1).bfill()
        e["Rain_L6HR"] = e.Rainfall.rolling(6).sum().bfill()
        api, soil = [0.0], [min(100.0, r[0])]
        for i in range(1, len(r)):
            api.append(0.85 * api[-1] + r[i - 1])
            soil.append(min(100.0, 0.95 * soil[-1] + r[i - 1]))
        m = got[got.site == site].sort_values("ts").reset_index(drop=True)
        for c, v in (("Rainlag1", e.Rainlag1), ("Rain_L6HR", e.Rain_L6HR), ("API", api), ("SoilMoisture", soil)):
            assert np.allclose(m[c].to_numpy(dtype=float), np.asarray(v, dtype=float), equal_nan=True), c


def test_streaming_equals_batch(spark):
    df, _ = _raw(spark)
    import time
    d = tempfile.mkdtemp(prefix="hf-stream-")
    ev = df.withColumnRenamed("site", "event_type")
    # a live feed: files arrive in time order (later files = later readings)
    cuts = ["2019-03-01 00:00:00", "2019-03-03 00:00:00", "2019-03-05 00:00:00", "2100-01-01 00:00:00"]
    lo = "1900-01-01 00:00:00"
    for hi in cuts:
        ev.where((F.col("ts") >= F.lit(lo).cast("timestamp_ntz")) & (F.col("ts") < F.lit(hi).cast("timestamp_ntz"))) \
          .coalesce(1).write.mode("append").parquet(os.path.join(d, "src"))
        lo = hi
        time.sleep(1.1)
    src = spark.read.parquet(os.path.join(d, "src"))
    out = run_to_completion(spark, os.path.join(d, "src"), src.schema, "event_type", "ts", "value")
    batch = resample.hourly_sum(src, ["event_type"], "ts", "value", out="Rainfall", fill_zero=False)
    a = out.select("event_type", "ts", F.round("Rainfall", 9).alias("r")).where("r IS NOT NULL")
    b = batch.select("event_type", "ts", F.round("Rainfall", 9).alias("r")).where("r IS NOT NULL")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
