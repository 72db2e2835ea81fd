"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a minimum per node (map-side combine) and a join back; a node with very many links is a hot
join key that Spark's adaptive skew join splits. Links are never gathered per node or on the driver; each
round is checkpointed in the shared folder, and only a count and a checksum of the links come back."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, own_shuffle


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``links`` (a, b: long) -> node, root (the component's smallest node), for nodes with a link."""
    e = checkpointed(links.where(F.col(a) != F.col(b))
                     .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    while True:
        stat = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if stat == before or not stat[0]:
            break
        before = stat
        both = e.select(F.col("u").alias("n"), F.col("v").alias("nb")).unionAll(
            e.select(F.col("v").alias("n"), F.col("u").alias("nb")))
        low = both.groupBy("n").agg(F.min("nb").alias("m")).select(own_shuffle("n").alias("n"), F.least("n", "m").alias("m"))
        large = both.join(low, "n").where("nb > n").select(F.col("nb").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        to_low = low.select(own_shuffle("u").alias("u"), "m")
        small = (large.join(to_low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(low.select("u", F.col("m").alias("v"))))
        e = checkpointed(small.distinct())
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
