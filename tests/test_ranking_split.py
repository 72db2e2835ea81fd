import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from hydroflow.operators import metrics, ranking, split


def test_hash_rank_equals_sorted_order(spark):
    df = spark.range(0, 3000).withColumn("g", (F.col("id") % 3).cast("int"))
    df = df.withColumn("h", ranking.hash32("id", seed=3))
    # force ties on the hash for some rows
    df = df.withColumn("h", F.when(F.col("id") < 40, F.lit(123456)).otherwise(F.col("h")))
    got = ranking.hash_rank(df, ["g"], "h", "id", out="r").toPandas()
    for _, gr in got.groupby("g"):
        gr = gr.sort_values(["h", "id"])
        assert gr.r.tolist() == list(range(len(gr)))


def test_quantile_type7_matches_numpy(spark):
    rng = np.random.default_rng(0)
    vals = np.concatenate([np.zeros(400), rng.lognormal(0, 2, 900), [1e9]])
    pdf = pd.DataFrame({"g": ["a"] * 700 + ["b"] * 601, "x": vals})
    df = spark.createDataFrame(pdf)
    for q in (0.05, 0.5, 0.9, 1.0):
        got = {r.g: r.quantile for r in ranking.quantile_type7(df, ["g"], "x", q).collect()}
        for g, sub in pdf.groupby("g"):
            assert abs(got[g] - np.percentile(sub.x, q * 100)) <= 1e-9 * max(1, abs(got[g]))


def test_order_statistics_many_refinements(spark):
    # a narrow cluster inside a huge range forces several passes with tiny bins
    xs = [float(i) * 1e-9 for i in range(5000)] + [1e12]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    t = spark.createDataFrame([(2500,), (4999,)], "k long")
    res = {r.k: r.value for r in ranking.order_statistics(df, [], "x", t, bins=4, final_rows=50).collect()}
    assert res == {2500: 2500e-9, 4999: 4999e-9}


def test_splits_partition_rows(spark):
    df = spark.range(0, 5000).withColumn("s", (F.col("id") % 4).cast("int"))
    h = split.hash_split(df, ["id"], 0.8, 42)
    assert h.count() == 5000
    share = h.where("split = 'train'").count() / 5000
    assert 0.75 < share < 0.85
    st = split.stratified_split(df, "s", "id", 0.7, 42).groupBy("s", "split").count().toPandas()
    for s, g in st.groupby("s"):
        n = g["count"].sum()
        assert int(g[g.split == "train"]["count"].sum()) == int(np.floor(n * 0.7))
    f = split.kfold(df, ["id"], 5).groupBy("fold").count().toPandas()
    assert f["count"].sum() == 5000 and sorted(f.fold) == [0, 1, 2, 3, 4]


def test_greedy_weights_never_below_best_single(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=2000)
    pdf = pd.DataFrame({"y": y, "a": y + rng.normal(scale=0.5, size=2000),
                        "b": y + rng.normal(scale=0.7, size=2000), "c": rng.normal(size=2000)})
    df = spark.createDataFrame(pdf)
    g = metrics.gramian(df, "y", ["a", "b", "c"]).first().asDict()
    w, r2 = metrics.halving_weights(g, ["a", "b", "c"])
    singles = [1 - ((pdf[m] - y) ** 2).sum() / ((y - y.mean()) ** 2).sum() for m in "abc"]
    assert r2 >= max(singles) - 1e-12
    assert abs(sum(w) - 1) < 1e-12
    blend = sum(wi * pdf[m] for wi, m in zip(w, "abc"))
    assert abs(r2 - (1 - ((blend - y) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-9


def test_within_quota_exact_with_ties_and_edges(spark):
    df = spark.range(0, 4000).withColumn("g", (F.col("id") % 4).cast("int"))
    df = df.withColumn("h", ranking.hash32("id", seed=9))
    df = df.withColumn("h", F.when(F.col("id") < 60, F.lit(77)).otherwise(F.col("h")))  # ties
    quotas = {0: 0, 1: 37, 2: 500, 3: 5000}
    q = spark.createDataFrame(list(quotas.items()), "g int, _q long")
    got = ranking.within_quota(df, ["g"], "h", "id", q, out="sel").toPandas()
    for g, grp in got.groupby("g"):
        grp = grp.sort_values(["h", "id"])
        want = [True] * min(quotas[g], len(grp)) + [False] * max(0, len(grp) - quotas[g])
        assert grp.sel.tolist() == want


def test_grouped_top_n_two_phase(spark):
    from hydroflow.operators import reshape
    df = spark.range(0, 20000, numPartitions=7).withColumn("g", (F.col("id") % 3).cast("int")) \
        .withColumn("v", (F.col("id") * 7919) % 1000)
    got = reshape.top_n(df, "v", 5, "id", ["g"]).toPandas()
    pdf = df.toPandas()
    exp = pdf.sort_values(["v", "id"], ascending=[False, True]).groupby("g").head(5)
    assert sorted(map(tuple, got[["g", "id"]].values.tolist())) == sorted(map(tuple, exp[["g", "id"]].values.tolist()))


def test_time_split_dense_pos_equals_positions(spark):
    df = spark.range(0, 500).withColumn("g", (F.col("id") % 2).cast("int")).withColumn("p", F.col("id") + 1000)
    a = split.time_split(df.withColumn("ts", F.timestamp_seconds("p")), ["g"], "ts", 0.7).select("id", "split")
    assert a.where("split = 'train'").count() == 2 * 175  # dense_position path, 250 rows per group
    d = spark.range(0, 300).withColumn("g", F.lit(1)).withColumn("ts", F.timestamp_seconds("id"))
    x = split.time_split(d, ["g"], "ts", 0.7, pos="id").where("split = 'train'").agg(F.max("id"), F.count("id")).first()
    assert tuple(x) == (209, 210)


def test_hash32_ranges(spark):
    df = spark.range(0, 20000)
    for algo in ("md5", "xxhash"):
        r = df.select(ranking.hash32("id", seed=1, algo=algo).alias("h")).agg(F.min("h"), F.max("h"), F.avg("h")).first()
        assert r[0] >= 0 and r[1] < 2 ** 32 and abs(r[2] / 2 ** 32 - 0.5) < 0.02
