"""Hot-key behaviour: one site holds 75% of all rows. A plain per-series window puts that
site in one task; the blocked windows spread it over its blocks."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from hydroflow.operators.blocked import with_series_windows
from hydroflow.operators.windows import lag


def _rows_per_partition(df):
    # aggregating l1 keeps the window in the plan (unused window columns are pruned)
    g = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum("l1").alias("s"))
    return [r["n"] for r in g.collect()]


def test_hot_site_is_spread_over_blocks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keep the 8 shuffle partitions visible
    try:
        hot = spark.range(0, 12000).select(F.lit("hot").alias("site"), F.col("id").alias("pos"), F.rand(1).alias("x"))
        cold = spark.range(0, 4000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("site"),
                                           (F.col("id") / 2).cast("long").alias("pos"), F.rand(2).alias("x"))
        df = hot.unionByName(cold)
        naive = df.withColumn("l1", F.lag("x", 1).over(Window.partitionBy("site").orderBy("pos")))
        blocked = with_series_windows(df, ["site"], "pos", lambda w: {"l1": lag("x", 1, w)}, halo=1, block=720)
        n_naive, n_blocked = _rows_per_partition(naive), _rows_per_partition(blocked)
        assert max(n_naive) / sum(n_naive) >= 0.75
        assert max(n_blocked) / sum(n_blocked) < 0.4
        # same result either way
        a = naive.select("site", "pos", "l1").exceptAll(blocked.select("site", "pos", "l1")).count()
        assert a == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
