"""Joins of the reference (J1-J7) in Spark form."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocked import attach, dense_position


def left_on_hour(base: DataFrame, others: Sequence[DataFrame], keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Flow ⟕ rain features ⟕ temperature on (series, hour). Equi-joins on the full
    (series, hour) key: no hot key, sort-merge or AQE-chosen broadcast."""
    out = base
    for o in others:
        out = out.join(o, [*keys, ts], "left")
    return out


def bind_by_position(left: DataFrame, right: DataFrame, keys: Sequence[str], order_l: str,
                     order_r: str, bucket_l: Column, bucket_r: Column) -> DataFrame:
    """Column-bind two tables by row position within each series. Positions are made
    explicit with the distributed ``dense_position``; row counts must agree."""
    l = dense_position(left, keys, order_l, bucket_l, out="_row")
    r = dense_position(right, keys, order_r, bucket_r, out="_row")
    nl = l.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nl"))
    nr = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nr"))
    bad = nl.join(nr, list(keys), "full").where(~F.col("_nl").eqNullSafe(F.col("_nr")))
    if bad.limit(1).count():
        raise ValueError("bind_by_position: row counts differ")
    return l.join(r, [*keys, "_row"])


def first_match(left: DataFrame, right: DataFrame, on: Sequence[str], cond: Column, order: str, lid: str) -> DataFrame:
    """Each left row gets the first right row (by ``order``) with equal ``on`` keys that
    also satisfies the non-equi ``cond``, as columns ``match_<name>``; no match -> NULLs (reported, not silently
    reused). The right side is broadcast if its measured size allows (``attach``)."""
    rest = [c for c in right.columns if c not in on]
    hit = (attach(left, right, on).where(cond).groupBy(lid)
           .agg(F.min_by(F.struct(*rest), F.col(order)).alias("_m")))
    return left.join(hit, lid, "left").select(*left.columns, *[F.col(f"_m.{c}").alias(f"match_{c}") for c in rest])


def pending_jobs(matrix: DataFrame, finished: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Job matrix minus finished work as a keyed anti-join (no substring nested loop)."""
    return matrix.join(finished.select(*keys).distinct(), list(keys), "left_anti")


def job_matrix(items: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Every item × a fixed list of model suffixes, as a bounded ``explode`` instead of a
    cross join."""
    return items.withColumn(column, F.explode(F.array(*[F.lit(v) for v in values])))


def scoring_jobs(files: DataFrame, gauge: str, prefixes: Mapping[str, Sequence[str]], suffixes: Sequence[str]) -> DataFrame:
    """Every climate file x the flow-series prefixes of its gauge x the scenario suffixes. Files of a gauge
    without prefixes give no jobs. Two bounded explodes, no join."""
    per_gauge = F.create_map(*[x for g, ps in prefixes.items() for x in (F.lit(g), F.array(*[F.lit(p) for p in ps]))])
    out = files.withColumn("prefix", F.explode(F.try_element_at(per_gauge, F.col(gauge))))
    return job_matrix(out, "suffix", suffixes).withColumn("job", F.concat_ws(" ", "prefix", "suffix"))
