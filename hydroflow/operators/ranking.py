"""Exact per-group ranks and order statistics without gathering a group in one task.

``row_number().over(partitionBy(g))`` and the ``percentile`` aggregate both put a whole group
in one task (or one in-memory map). A group may hold a third of all rows, so:

* ``hash_rank``: rank of each row inside its group by a 32-bit hash (ties by a key), from a
  two-level histogram of the hash (high 16 bits, then low 16 bits) whose prefix windows hold
  at most 65,536 rows each;
* ``order_statistics``: value of rank k inside a group by repeated equal-width histograms
  over the group's current value interval; each pass shrinks the interval by ``bins``x and
  the last pass sorts at most ``final_rows`` rows per target.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash32(*cols, seed: int | str = 42, algo: str = "md5") -> Column:
    """Unsigned 32-bit hash in [0, 2^32).

    ``md5`` (default): first 8 hex digits of md5('c1|c2|...|seed'), reproducible in any engine
    (DuckDB: ('0x' || substr(md5(concat_ws('|', c1, ..., 'seed')), 1, 8))::UBIGINT), which is
    what the oracle checks need. ``xxhash``: Spark's native xxhash64 of the typed columns,
    masked to 32 bits - several times cheaper per row, for pipelines that do not need
    cross-engine reproducibility."""
    if algo == "xxhash":
        cs = [F.col(c) if isinstance(c, str) else c for c in cols]
        return F.xxhash64(*cs, F.lit(str(seed))).bitwiseAND(F.lit(0xFFFFFFFF))
    parts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    s = F.concat_ws("|", *parts, F.lit(str(seed)))
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long")


def hash_rank(df: DataFrame, groups: Sequence[str], h: str, tiebreak: str, out: str = "rank") -> DataFrame:
    """0-based rank of every row within its group ordered by (h, tiebreak); h in [0, 2^32)."""
    g = list(groups)
    d = df.withColumns({"_h1": F.shiftright(F.col(h), 16), "_h2": F.col(h).bitwiseAND(F.lit(0xFFFF))})
    c1 = d.groupBy(*g, "_h1").agg(F.count(F.lit(1)).alias("_n1"))
    w1 = Window.partitionBy(*g).orderBy("_h1").rowsBetween(Window.unboundedPreceding, -1)
    c1 = c1.withColumn("_b1", F.coalesce(F.sum("_n1").over(w1), F.lit(0))).drop("_n1")
    c2 = d.groupBy(*g, "_h1", "_h2").agg(F.count(F.lit(1)).alias("_n2"))
    w2 = Window.partitionBy(*g, "_h1").orderBy("_h2").rowsBetween(Window.unboundedPreceding, -1)
    c2 = c2.withColumn("_b2", F.coalesce(F.sum("_n2").over(w2), F.lit(0))).drop("_n2")
    wt = Window.partitionBy(*g, h).orderBy(tiebreak)
    return (d.join(c1, [*g, "_h1"]).join(c2, [*g, "_h1", "_h2"])
            .withColumn(out, (F.col("_b1") + F.col("_b2") + F.row_number().over(wt) - 1).cast("long"))
            .drop("_h1", "_h2", "_b1", "_b2"))


def within_quota(df: DataFrame, groups: Sequence[str], h: str, tiebreak: str, quota: DataFrame,
                 out: str = "selected") -> DataFrame:
    """Flag the ``_q`` rows of each group (``quota``: groups..., _q) with the smallest
    (h, tiebreak), h in [0, 2^32). Exact, and cheaper than ranking every row: a histogram of
    the top 16 hash bits (<= 65,536 rows per group) locates each group's boundary bucket;
    rows below it are in, rows above are out, and only the boundary bucket's rows (about
    n / 65,536 per group) are ranked."""
    from .blocked import attach
    g = list(groups)
    d = df.withColumn("_h1", F.shiftright(F.col(h), 16))
    c1 = d.groupBy(*g, "_h1").agg(F.count(F.lit(1)).alias("_n1"))
    w1 = Window.partitionBy(*g).orderBy("_h1").rowsBetween(Window.unboundedPreceding, -1)
    c1 = c1.withColumn("_b1", F.coalesce(F.sum("_n1").over(w1), F.lit(0)))
    bound = (c1.join(quota, g).where((F.col("_b1") < F.col("_q")) & (F.col("_q") <= F.col("_b1") + F.col("_n1")))
             .select(*g, F.col("_h1").alias("_hb"), F.col("_b1").alias("_bb")))
    j = attach(attach(d, quota, g), bound, g, "left")
    edge = F.coalesce((F.col("_q") > 0) & (F.col("_h1") == F.col("_hb")), F.lit(False))
    # only the boundary buckets (~n / 65,536 rows per group) are shuffled and ranked; every other row is decided
    # by comparing its bucket with the boundary
    wr = Window.partitionBy(*g, "_h1").orderBy(h, tiebreak)
    near = j.where(edge).withColumn(out, (F.row_number().over(wr) - 1) < (F.col("_q") - F.col("_bb")))
    rest = j.where(~edge).withColumn(out, (F.col("_q") > 0) & (F.col("_hb").isNull() | (F.col("_h1") < F.col("_hb"))))
    return near.unionByName(rest).drop("_h1", "_q", "_hb", "_bb")


def _log_scale(c: str):
    """An increasing function of a double: its logarithm by sign (745 is above every -ln of a double)."""
    return F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.signum(c) * (F.log(F.abs(c)) + 745.0))


def order_statistics(df: DataFrame, groups: Sequence[str], x: str, targets: DataFrame,
                     bins: int = 4096, final_rows: int = 200_000) -> DataFrame:
    """Value of 0-based rank ``k`` (ascending, NULLs excluded) for each row of ``targets``
    (columns: groups..., k). Returns groups..., k, value.

    Hierarchical histogram: level 1 bins every row of a group into ``bins`` equal-width bins
    of the group's [min, max]; each later level re-bins only the rows of still-open intervals
    inside their own [min, max]. Rows carry their bin path, so reaching an interval is an
    equi-join on (group, path) with a small broadcast table - every row matches at most one
    interval and no row is paired with targets. All targets in one interval share its
    histogram. A target is finished when its interval holds one distinct value, or at most
    ``final_rows`` rows, which are then sorted per interval. Each level ends in a smaller interval (the two
    ends of an open one fall into different bins), so the search always ends; NaN counts as missing."""
    if not groups:
        return order_statistics(df.withColumn("_all", F.lit(0)), ["_all"], x,
                                targets.withColumn("_all", F.lit(0)), bins, final_rows).drop("_all")
    g = list(groups)
    data = df.select(*g, F.col(x).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    bounds = data.groupBy(*g).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    # checked size: a few rows per group
    from .blocked import BROADCAST_MAX_BYTES, materialize, table_bytes
    targets = materialize(targets)
    small = 4 * table_bytes(targets) <= BROADCAST_MAX_BYTES
    bc = F.broadcast if small else (lambda d: d)
    t = materialize(targets.join(bc(bounds), g).withColumn("_base", F.lit(0).cast("long")))
    rows = data.join(bc(bounds), g)
    path: list[str] = []
    results = []
    level = 0
    while True:
        level += 1
        b = f"_b{level}"
        # equal widths inside a factor of 256, else equal ratios, so that heavy tails shrink as fast
        wide = F.col("_hi") - F.col("_lo") > 256 * F.least(F.abs("_lo"), F.abs("_hi"))
        lo, hi, at = (F.when(wide, _log_scale(c)).otherwise(F.col(c)) for c in ("_lo", "_hi", "_x"))
        binned = rows.withColumn(b, F.when(hi > lo, F.least(F.floor((at - lo) / (hi - lo) * bins), F.lit(bins - 1)))
                                 .otherwise(F.lit(0)).cast("int"))
        hist = (binned.groupBy(*g, *path, b)
                .agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_nlo"), F.max("_x").alias("_nhi")))
        wc = Window.partitionBy(*g, *path).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("_before", F.coalesce(F.sum("_n").over(wc), F.lit(0)))
        hit = (t.select(*g, *path, "k", "_base").join(hist, [*g, *path])
               .where((F.col("_base") + F.col("_before") <= F.col("k"))
                      & (F.col("k") < F.col("_base") + F.col("_before") + F.col("_n")))
               .select(*g, *path, b, "k", F.col("_nlo").alias("_lo"), F.col("_nhi").alias("_hi"),
                       (F.col("_base") + F.col("_before")).alias("_base"), "_n"))
        t = materialize(hit)
        path = [*path, b]
        # one distinct value left: resolved without touching rows again
        results.append(t.where(F.col("_lo") == F.col("_hi")).select(*g, "k", F.col("_lo").alias("value")))
        fin = t.where((F.col("_lo") < F.col("_hi")) & (F.col("_n") <= final_rows))
        iv = fin.select(*g, *path).distinct()
        if fin.limit(1).count():
            sub = binned.join(bc(iv), [*g, *path])
            wr = Window.partitionBy(*g, *path).orderBy("_x")
            ranked = sub.withColumn("_rn", F.row_number().over(wr) - 1).select(*g, *path, "_x", "_rn")
            results.append(ranked.join(fin.select(*g, *path, "k", "_base"), [*g, *path])
                           .where(F.col("_base") + F.col("_rn") == F.col("k")).select(*g, "k", F.col("_x").alias("value")))
        t = t.where((F.col("_lo") < F.col("_hi")) & (F.col("_n") > final_rows))
        if t.limit(1).count() == 0:
            break
        open_iv = t.select(*g, *path, "_lo", "_hi").distinct()
        rows = binned.drop("_lo", "_hi").join(bc(open_iv), [*g, *path])
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def quantile_type7(df: DataFrame, groups: Sequence[str], x: str, q: float, out: str = "quantile") -> DataFrame:
    """Exact linear-interpolated quantile (R type 7, numpy default, DuckDB quantile_cont)."""
    g = list(groups)
    n = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).groupBy(*g).agg(F.count(F.lit(1)).alias("_cnt"))
    h = (F.col("_cnt") - 1) * F.lit(float(q))
    base = n.withColumns({"_k0": F.floor(h).cast("long"), "_frac": h - F.floor(h)})
    base = base.withColumn("_k1", F.least(F.col("_k0") + 1, F.col("_cnt") - 1))
    targets = (base.select(*g, F.explode(F.array_distinct(F.array("_k0", "_k1"))).alias("k")))
    vals = order_statistics(df, g, x, targets)
    v0 = vals.withColumnRenamed("k", "_k0").withColumnRenamed("value", "_v0")
    v1 = vals.withColumnRenamed("k", "_k1").withColumnRenamed("value", "_v1")
    return (base.join(v0, [*g, "_k0"]).join(v1, [*g, "_k1"])
            .select(*g, (F.col("_v0") + F.col("_frac") * (F.col("_v1") - F.col("_v0"))).alias(out)))


def quantiles_type7(df: DataFrame, groups: Sequence[str], x: str, qs: dict[str, float]) -> DataFrame:
    """Several exact type-7 quantiles per group from ONE refinement run (all target ranks
    searched together). ``qs``: output column -> q."""
    g = list(groups)
    n = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).groupBy(*g).agg(F.count(F.lit(1)).alias("_cnt"))
    ks = []
    for name, q in qs.items():
        h = (F.col("_cnt") - 1) * F.lit(float(q))
        ks += [F.floor(h).cast("long").alias(f"_k0_{name}"),
               F.least(F.floor(h).cast("long") + 1, F.col("_cnt") - 1).alias(f"_k1_{name}"),
               (h - F.floor(h)).alias(f"_f_{name}")]
    base = n.select(*g, *ks)
    allk = F.array_distinct(F.array(*[F.col(f"_k{i}_{nm}") for nm in qs for i in (0, 1)]))
    vals = order_statistics(df, g, x, base.select(*g, F.explode(allk).alias("k")))
    vm = vals.groupBy(*g).agg(F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("_vm"))
    j = base.join(vm, g)
    outs = []
    for nm in qs:
        v0 = F.element_at("_vm", F.col(f"_k0_{nm}"))
        v1 = F.element_at("_vm", F.col(f"_k1_{nm}"))
        outs.append((v0 + F.col(f"_f_{nm}") * (v1 - v0)).alias(nm))
    return j.select(*g, *outs)
