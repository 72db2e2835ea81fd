"""Trees grown for all series at once: closed forms, invariants under blocks, held-out accuracy."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hydroflow.operators import keyed_trees as kt
from hydroflow.operators import models, series_models

FEATS = ["x0", "x1", "x2", "x3"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    n = 1500
    d = pd.DataFrame({"site": np.where(np.arange(n) % 3 == 0, "a", "b"), "id": range(n), "x0": rng.normal(size=n), "x1": rng.normal(size=n),
                      "x2": rng.integers(0, 5, n).astype(float), "x3": 0.0})
    d["y"] = np.sin(2 * d.x0) + (d.x1 > 0) * d.x2 + np.where(d.site == "a", 5, 0) + rng.normal(size=n) * 0.1
    return d


@pytest.fixture(scope="module")
def split(spark, data):
    df = spark.createDataFrame(data).repartition(4)
    return df.where("id % 4 <> 0"), df.where("id % 4 = 0")


def rmse(p, a):
    return float(np.sqrt(((p[a] - p.y) ** 2).mean()))


def nodes_of(model, m=0):
    out = {}
    for r in model["nodes"].where(F.col("m") == m).collect():
        out[(r["_key"], r.t, r.node)] = r.blob
    return out


def test_linear_is_least_squares(split, data):
    model = kt.fit(split[0], ["site"], FEATS, "y", [kt.learner("LR")], ["id"])
    p = kt.predict(model, split[1], ["site", "id", "y"]).toPandas()
    for s in "ab":
        tr = data[(data.site == s) & (data.id % 4 != 0)]
        beta = np.linalg.lstsq(np.column_stack((np.ones(len(tr)), tr[FEATS])), tr.y, rcond=None)[0]
        te = data.set_index("id").loc[p[p.site == s].id]
        assert np.allclose(p[p.site == s].LR, np.column_stack((np.ones(len(te)), te[FEATS])) @ beta)


def test_first_boosted_tree_in_closed_form(split, data):
    edges = [list(np.linspace(-2, 2, 9)), [-1.0, 0.0, 1.0], [0.5, 1.5, 2.5, 3.5], []]
    model = kt.fit(split[0], ["site"], FEATS, "y", [kt.learner("XGB", trees=1, depth=1)], ["id"], edges=edges)
    got = nodes_of(model)
    for s in "ab":
        d = data[(data.site == s) & (data.id % 4 != 0)]
        g = d.y - d.y.mean()
        cuts = []
        for f, es in enumerate(edges):
            for b, e in enumerate(es):
                left = d[FEATS[f]] <= e
                gl, hl = g[left].sum(), left.sum()
                if hl and hl < len(d):
                    cuts.append((gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (len(d) - hl + 1) - g.sum() ** 2 / (len(d) + 1), -f, -b, gl, hl))
        gain, f, b, gl, hl = max(cuts)
        key = f'{{"site":"{s}"}}'
        assert got[key, 0, 0][:2] == [-f, -b] and got[key, 0, 0][4] == pytest.approx(gain)
        assert got[key, 0, 1][2] == pytest.approx(0.3 * gl / (hl + 1)) and got[key, 0, 1][3] == hl


def test_blocks_do_not_change_the_trees(spark, split, monkeypatch):
    runs = [kt.learner("XGB", trees=2, depth=3), kt.learner("ET", trees=2, depth=3), kt.learner("RF", trees=2, depth=3), kt.learner("CB", trees=2, depth=2), kt.learner("LR")]
    one = kt.fit(split[0], ["site"], FEATS, "y", runs, ["id"])
    plain = kt.pack
    monkeypatch.setattr(kt, "pack", lambda *a, **b: plain(*a, **{**b, "bits": 5}))
    monkeypatch.setattr(kt, "BROADCAST_MAX_BYTES", -1)
    many = kt.fit(split[0], ["site"], FEATS, "y", runs, ["id"])
    assert kt.pack(split[0], ["site"], FEATS, "y", ["id"]).count() > 30
    for m in range(len(runs)):
        a, b = nodes_of(one, m), nodes_of(many, m)
        assert a.keys() == b.keys()
        for k in a:
            assert np.allclose(a[k], b[k], atol=1e-8)
    p, q = (kt.predict(x, split[1], ["site", "id"]).toPandas().sort_values("id") for x in (one, many))
    assert np.allclose(p[["XGB", "ET", "RF", "CB", "LR"]], q[["XGB", "ET", "RF", "CB", "LR"]])


def test_extra_trees_draw_inside_the_node_and_beat_the_stand_in(split):
    model = kt.fit(split[0], ["site"], FEATS, "y", [kt.learner("ET", trees=20)], ["id"])
    got = kt.predict(model, split[1], ["site", "id", "y"]).toPandas()
    stand_in = models.pipeline(FEATS, "ET", "y", trees=20)
    err = []
    for s in "ab":
        q = stand_in.fit(split[0].where(F.col("site") == s)).transform(split[1].where(F.col("site") == s)).select("y", "prediction").toPandas()
        err.append(((q.prediction - q.y) ** 2).sum())
    assert rmse(got, "ET") < np.sqrt(sum(err) / len(got))
    cuts = {round(b[1], 12) for b in nodes_of(model).values() if b[0] == 2}
    assert len(cuts) > 50 and all(0 <= c < 4 for c in cuts)  # drawn anywhere between 0 and 4, not at a few edges
    imp = kt.importance(model).toPandas()
    assert np.allclose(imp.groupby("site").importance.sum(), 1) and (imp[imp.feature == "x3"].importance == 0).all()


def test_symmetric_trees_cut_a_level_alike(split):
    model = kt.fit(split[0], ["site"], FEATS, "y", [kt.learner("CB", trees=12, depth=3)], ["id"])
    by_level = {}
    for (key, t, node), b in nodes_of(model).items():
        if b[0] >= 0:
            by_level.setdefault((key, t, (node + 1).bit_length()), set()).add((b[0], b[1]))
    assert all(len(v) == 1 for v in by_level.values())
    p = kt.predict(model, split[1], ["site", "id", "y"]).toPandas()
    assert rmse(p, "CB") < 0.6 * p.groupby("site").y.std().mean()


def test_folds_never_see_their_rows(split):
    runs = [kt.replace(kt.learner("LR"), name=f"f{f}", fold=f, folds=3) for f in range(3)]
    model = kt.fit(split[0], ["site"], FEATS, "y", runs, ["id"])
    p = kt.predict(model, split[0], ["site", "id", "y"], out_of_fold=True).toPandas()
    assert (p[["f0", "f1", "f2"]].notna().sum(axis=1) == 1).all()
    one = p[(p.site == "a") & p.f0.notna()]
    rest = split[0].toPandas()
    rest = rest[(rest.site == "a") & ~rest.id.isin(one.id)]
    beta = np.linalg.lstsq(np.column_stack((np.ones(len(rest)), rest[FEATS])), rest.y, rcond=None)[0]
    mine = split[0].toPandas().set_index("id").loc[one.id]
    assert np.allclose(one.f0, np.column_stack((np.ones(len(mine)), mine[FEATS])) @ beta)


def test_nulls_constant_labels_and_unknown_series(spark):
    rows = [("a", i, float(i % 7), None if i % 5 == 0 else float(i), 1.0) for i in range(60)] + [("b", i, float("nan"), 2.0, float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "site string, id int, x0 double, y double, x1 double")
    runs = [kt.learner("XGB", trees=2, depth=2), kt.learner("ET", trees=2, depth=2), kt.learner("CB", trees=2, depth=2), kt.learner("LR")]
    model = kt.fit(df, ["site"], ["x0", "x1"], "y", runs, ["id"])
    p = kt.predict(model, df.unionByName(df.limit(3).withColumn("site", F.lit("new"))), ["site", "id"]).toPandas()
    assert len(p) == 83
    flat = p[p.site == "b"]
    assert np.allclose(flat[["XGB", "ET", "CB", "LR"]], 2.0)
    assert p[p.site == "new"][["XGB", "ET", "CB", "LR"]].isna().all().all() and p[p.site == "a"].XGB.notna().all()


def test_ablation_and_benchmark_per_series(split):
    groups = {"noise": ["x3"], "wave": ["x0"], "step": ["x1", "x2"], "none": ["missing"]}
    res, votes = series_models.ablation(*split, ["site"], "y", ["id"], groups, algos=("RF", "ET", "LR"), trees=5)
    assert res.count() == 2 * 4 * 3
    v = {(r.site, r.step): r for r in votes.collect()}
    assert v["a", 1].n_effective == 3 and v["b", 3].n_effective == 3 and v["a", 4].n_features == 4
    b = series_models.benchmark(*split, ["site"], FEATS, "y", ["id"], algos=("ET", "LR"), trees=5).toPandas()
    assert len(b) == 4 and set(b.columns) >= {"site", "algorithm", "rmse", "mae", "r2"}


def test_stacking_per_series(split):
    table, pred = series_models.stacked_ensemble(*split, ["site"], FEATS, "y", ["id"], layer1=("RF", "LR"), layer2=("ET", "RF"), folds=2, trees=4)
    t = {r.site: r for r in table.collect()}
    assert set(t) == {"a", "b"} and all(sum(r.weights) == pytest.approx(1) and r.r2 > 0.5 for r in t.values())
    p = pred.toPandas()
    assert len(p) == 1500 and set(p.split) == {"train", "test"} and p.prediction.notna().all()


def test_rows_are_shuffled_once_whatever_the_series(split, monkeypatch):
    plans, plain = [], kt.materialize
    monkeypatch.setattr(kt, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    kt.fit(split[0], ["site"], FEATS, "y", [kt.learner("ET", trees=1, depth=1)], ["id"])
    blocks = [p for p in plans if "rangepartitioning" in p]
    assert len(blocks) == 1 and "hashpartitioning" not in blocks[0]  # no second shuffle by series, which would leave one task a series
    assert not any("Window" in p or "percentile" in p for p in plans)


@pytest.mark.parametrize("keys", [["s", "n"], ["d"], []])
def test_packed_rows_come_back_once_in_blocks_of_one_series(spark, keys):
    rows = [(None if i % 3 == 0 else "ab"[i % 2], i % 4 if i % 5 else None, f"2020-01-0{1 + i % 2}", i, float(i % 7) if i % 11 else None, float(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "s string, n int, d string, id int, x double, y double").withColumn("d", F.col("d").cast("date")).repartition(3)
    got = kt.pack(df, keys, ["x", "id"], "y", ["id"], ["id", "y"], bits=4).withColumn("p", F.spark_partition_id()).collect()
    ids, firsts = [], {}
    want = {r.id: r._key for r in df.select("id", kt._key_column(keys).alias("_key")).collect()}
    for r in got:
        x, y, h = np.frombuffer(r.x).reshape(-1, 2), np.frombuffer(r.y), np.frombuffer(r.h, np.int64)
        assert 0 < len(y) <= 16 and len(h) == len(y) and [k.id for k in r.keep] == list(y) == list(x[:, 1])
        assert all(want[k.id] == r._key for k in r.keep) and all(x[:, 0] == [i % 7 if i % 11 else 0 for i in y])
        ids += [k.id for k in r.keep]
        firsts[r.p, r._key] = firsts.get((r.p, r._key), 0) + r.first
    assert sorted(ids) == list(range(900)) and set(firsts.values()) == {1}


def test_sums_and_ranges_of_nodes():
    rng = np.random.default_rng(3)
    x, node, g = rng.integers(0, 6, (500, 3)).astype(float), rng.choice([3, 4, 6], 500), rng.normal(size=500)
    nodes, at = kt._numbered(node)
    assert list(nodes) == [3, 4, 6] and (nodes[at] == node).all()
    own, rows, cuts = np.array([0, 2]), np.arange(500) * 3, rng.random((3, 2)) * 5
    lo, hi = kt._ranges(x.ravel(), rows, own, at, 3)
    sums, counts = kt._left_sums(x.ravel(), rows, own, at, 3, cuts, g)
    for i, k in enumerate(nodes):
        mine = x[node == k][:, own]
        left = mine <= cuts[i]
        assert (lo[i] == mine.min(0)).all() and (hi[i] == mine.max(0)).all() and (counts[i] == left.sum(0)).all()
        assert np.allclose(sums[i], (left * g[node == k][:, None]).sum(0))
