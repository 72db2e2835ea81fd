"""Optimal segments of one feature against enumeration, planted steps and edge cases."""
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hydroflow.operators.segmentation import best_cuts, feature_segments


@pytest.mark.parametrize("segments", [1, 2, 3, 4, 9])
def test_cuts_equal_enumeration(segments):
    rng = np.random.default_rng(segments)
    for size in (1, 2, 5, 9):
        n, s = rng.integers(1, 20, size).astype(float), rng.normal(size=size) * 10
        gain = lambda cuts: sum(s[a:b].sum() ** 2 / n[a:b].sum() for a, b in zip([0, *cuts], [*cuts, size]))
        want = max(gain(c) for c in combinations(range(1, size), min(segments, size) - 1))
        got = best_cuts(n, s, segments)
        assert got == sorted(set(got)) and gain([c + 1 for c in got]) == pytest.approx(want)


def test_planted_steps_and_edges(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 64, 4000)
    pdf = pd.DataFrame({"id": range(4000), "step": x, "noise": rng.normal(size=4000), "flat": 3.0,
                        "y": np.select([x < 16, x < 40], [1.0, 5.0], -2.0) + 0.1 * rng.normal(size=4000)})
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame(
        [(5000, None, 1.0, 3.0, 1.0), (5001, float("nan"), 1.0, 3.0, 1.0), (5002, 1.0, None, 3.0, None), (5003, float("inf"), 0.0, 3.0, 2.0)],
        "id long, step double, noise double, flat double, y double"))
    train = F.col("id") % 5 != 0
    out = {r.feature: r for r in feature_segments(df, "y", ["step", "noise", "flat"], train, segments=3).collect()}
    assert np.allclose(out["step"].cuts, [16, 40], atol=1.1) and out["step"].power > 0.95
    assert out["noise"].power < 0.05 and len(out["noise"].cuts) == 2
    assert out["flat"].cuts == [] and out["flat"].power < 0.01
    same = feature_segments(df.withColumn("y", F.lit(1.0)), "y", ["step"], train).first()
    assert same.train_r2 is None and same.power is None
    assert feature_segments(df.limit(0), "y", ["step"], train).count() == 0
