import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hydroflow.operators import arma


def planted(seed, n, phi, theta):
    rng = np.random.default_rng(seed)
    e = rng.normal(scale=0.5, size=n)
    u = np.zeros(n)
    for t in range(n):
        u[t] = e[t] + sum(p * u[t - i - 1] for i, p in enumerate(phi) if t > i) + sum(q * e[t - j - 1] for j, q in enumerate(theta) if t > j)
    x = rng.normal(size=n)
    return x, u, 2 + 1.5 * x + u


@pytest.mark.parametrize("block", [3, 7, 720])
def test_recurrence_equals_loop(spark, block):
    rng = np.random.default_rng(1)
    coefs = {"a": [0.5, -0.3], "b": [-0.9, 0.05]}
    rows = [(s, i, float(v)) for s in "ab" for i, v in enumerate(rng.normal(size=50 if s == "a" else 11))]
    df = spark.createDataFrame(rows, "s string, pos long, b double")
    cs = spark.createDataFrame(list(coefs.items()), "s string, c array<double>")
    got = arma.recurrence(df, ["s"], "pos", "b", cs, "x", 2, block).toPandas()
    for s, c in coefs.items():
        want = []
        for _, _, b in [r for r in rows if r[0] == s]:
            want.append(b + sum(v * want[-1 - j] for j, v in enumerate(c) if len(want) > j))
        assert np.allclose(got[got.s == s].sort_values("pos").x, want)


def test_recovers_planted_arma(spark):
    models = {"m11": ([0.7], [0.5]), "ar2": ([0.5, 0.3], []), "noise": ([], [])}
    rows = []
    for i, (s, (phi, theta)) in enumerate(models.items()):
        x, _, y = planted(i, 4000, phi, theta)
        rows += [(s, t, float(x[t]), float(y[t])) for t in range(4000)]
    rows += [("flat", t, float(t % 3), 5.0) for t in range(120)] + [("tiny", t, 1.0, float(t)) for t in range(6)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["s", "pos", "x", "y"]))
    cut = F.when(F.col("s") == "flat", 100).when(F.col("s") == "tiny", 4).otherwise(3900)
    train, test = df.where(F.col("pos") < cut), df.where((F.col("pos") >= cut) & (F.col("pos") != 3950))
    p = arma.arma_error_regression(train, test, ["s"], "pos", "y", ["x"], block=500).toPandas()
    assert len(p) == 3 * 99 + 22 and p.prediction.notna().all()
    order = {s: tuple(g.iloc[0]) for s, g in p.groupby("s")[["ar_p", "ma_q"]]}
    assert order["m11"] == (1, 1) and order["ar2"][0] == 2 and order["noise"] == (0, 0) and order["tiny"] == (0, 0)
    assert np.allclose(p[p.s == "flat"].prediction, 5.0)
    # forecasts equal the planted model's, run from the true state
    x, u, _ = planted(0, 4000, [0.7], [0.5])
    e = np.random.default_rng(0).normal(scale=0.5, size=4000)
    first = p[(p.s == "m11")].sort_values("pos")
    ahead = 0.7 * u[3899] + 0.5 * e[3899]
    want = [2 + 1.5 * x[3900 + h] + ahead * 0.7**h for h in range(100) if h != 50]
    assert np.abs(first.prediction.to_numpy() - np.array(want)).max() < 0.15


def test_orders_from_a_gramian():
    _, u, _ = planted(5, 6000, [0.7], [0.5])
    e = np.zeros(6000)
    for t in range(1, 6000):
        e[t] = u[t] - 0.7 * u[t - 1] - 0.5 * e[t - 1]
    cols = np.column_stack([u[2:-1], u[1:-2], e[2:-1], e[1:-2], u[3:]])
    p, q, phi, theta = arma.arma_orders((cols.T @ cols).ravel(), len(cols), 2, 2)
    assert (p, q) == (1, 1) and phi[0] == pytest.approx(0.7, abs=0.05) and theta[0] == pytest.approx(0.5, abs=0.05)
