"""Blocked (capped) affine scan: x_i = least(c_i, a_i * x_{i-1} + b_i), x_{-1} = 0.

Covers the antecedent precipitation index (W11), the capped soil-moisture bucket (W12) and
running sums (KPSS partial sums). Step maps f(x) = least(c, a x + b) with a >= 0 are closed
under composition:

    f=(c1,a1,b1) then g=(c2,a2,b2)  ->  (least(c2, a2*c1 + b2), a2*a1, a2*b1 + b2)

with c = NULL meaning "no cap" (``least`` skips NULL). So the scan runs in parallel over
blocks instead of as one sequential loop per series:

1. per (series, block, sub-block): fold the sub-block's maps (bounded ``collect_list``);
2. exclusive prefix over sub-blocks inside a block, over blocks inside superblocks of
   ``fanout`` blocks, and over superblock totals per series (tables ``sub``, ``block`` and
   ``block * fanout`` times smaller than the input; no frame grows beyond ``fanout``);
3. carry-in joined on (series, block); replay inside the sub-block with a growing window
   frame (cost ``sub`` per row).

No step shuffles the large side when the input is already partitioned by (series, _blk),
which is what ``with_series_windows`` returns.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocked import BLK, DEFAULT_BLOCK, block_of

SUB = "_sub"
DEFAULT_SUB = 120  # must divide the block

_ID = "named_struct('c', CAST(NULL AS DOUBLE), 'a', CAST(1.0 AS DOUBLE), 'b', CAST(0.0 AS DOUBLE))"
_COMPOSE = ("(acc, m) -> named_struct('c', least(m.c, m.a * acc.c + m.b), "
            "'a', m.a * acc.a, 'b', m.a * acc.b + m.b)")


def _fold(arr_sql: str) -> Column:
    return F.expr(f"aggregate({arr_sql}, {_ID}, {_COMPOSE})")


def _apply(m: str, x: str) -> str:
    return f"least({m}.c, {m}.a * {x} + {m}.b)"


def affine_scan(df: DataFrame, keys: Sequence[str], pos: str, cap: Column, coef: Column,
                offset: Column, out: str, block: int = DEFAULT_BLOCK,
                sub: int | None = None) -> DataFrame:
    """Add column ``out`` = scan of the maps (cap, coef, offset) along ``pos`` per series.

    ``coef`` must be >= 0. A row whose map has coef 0 restarts the recurrence (series start)."""
    return affine_scan_many(df, keys, pos, {out: (cap, coef, offset)}, block, sub)


def affine_scan_many(df: DataFrame, keys: Sequence[str], pos: str,
                     specs: dict[str, tuple[Column, Column, Column]], block: int = DEFAULT_BLOCK,
                     sub: int | None = None, fanout: int = 512) -> DataFrame:
    """Several scans over the same series in one pass: one sub-block aggregation, one carry
    table, one join, one replay window. ``specs``: out -> (cap, coef, offset).

    ``df`` is read twice (summaries and replay): pass a materialised table
    (``blocked.materialize``) when it is expensive to recompute."""
    if sub is None:  # largest divisor of the block not above DEFAULT_SUB
        sub = max(d for d in range(1, min(block, DEFAULT_SUB) + 1) if block % d == 0)
    if block % sub:
        raise ValueError("sub must divide block")
    if BLK not in df.columns:
        df = df.withColumn(BLK, block_of(pos, block))
    outs = list(specs)
    m = {o: f"_m{i}" for i, o in enumerate(outs)}
    d = df.withColumns({
        SUB: F.floor(F.col(pos) / F.lit(sub)).cast("long"),
        **{m[o]: F.struct(c.cast("double").alias("c"), a.cast("double").alias("a"),
                          b.cast("double").alias("b")) for o, (c, a, b) in specs.items()},
    })
    # 1. sub-block summaries (grouping keys include _blk: no shuffle after a blocked window)
    items = F.struct(F.col(pos).alias("p"), *[F.col(m[o]).alias(m[o]) for o in outs])
    subs = (d.groupBy(*keys, BLK, SUB).agg(F.sort_array(F.collect_list(items)).alias("_l"))
            .select(*keys, BLK, SUB, *[_fold(f"transform(_l, e -> e.{m[o]})").alias(f"_S{m[o]}") for o in outs]))
    # 2a. exclusive prefix of sub-blocks inside the block, and the block total
    wsub = Window.partitionBy(*keys, BLK).orderBy(SUB)
    before = wsub.rowsBetween(Window.unboundedPreceding, -1)
    whole = wsub.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for o in outs:
        subs = (subs.withColumn("_pl", F.collect_list(f"_S{m[o]}").over(before))
                .withColumn(f"_P{m[o]}", _fold("_pl"))
                .withColumn(f"_tl{m[o]}", F.collect_list(f"_S{m[o]}").over(whole)).drop("_pl"))
    # 2b. exclusive prefix of block totals per series, two levels so no window frame grows
    #     beyond ``fanout`` entries per block: inside superblocks of ``fanout`` blocks, then
    #     over superblock totals (one row per superblock)
    blocks = subs.groupBy(*keys, BLK).agg(*[F.first(f"_tl{m[o]}").alias(f"_tl{m[o]}") for o in outs])
    blocks = blocks.withColumn("_sb", F.floor(F.col(BLK) / F.lit(fanout)).cast("long"))
    wsb = Window.partitionBy(*keys, "_sb").orderBy(BLK)
    for o in outs:
        blocks = (blocks.withColumn(f"_T{m[o]}", _fold(f"_tl{m[o]}"))
                  .withColumn("_bl", F.collect_list(f"_T{m[o]}").over(wsb.rowsBetween(Window.unboundedPreceding, -1)))
                  .withColumn(f"_IP{m[o]}", _fold("_bl"))
                  .withColumn("_al", F.collect_list(f"_T{m[o]}").over(
                      wsb.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
                  .withColumn(f"_ST{m[o]}", _fold("_al")).drop("_bl", "_al", f"_T{m[o]}", f"_tl{m[o]}"))
    supers = blocks.groupBy(*keys, "_sb").agg(*[F.first(f"_ST{m[o]}").alias(f"_ST{m[o]}") for o in outs])
    wsup = Window.partitionBy(*keys).orderBy("_sb").rowsBetween(Window.unboundedPreceding, -1)
    for o in outs:
        supers = (supers.withColumn("_sl", F.collect_list(f"_ST{m[o]}").over(wsup))
                  .withColumn(f"_SP{m[o]}", _fold("_sl")).drop("_sl", f"_ST{m[o]}"))
    blocks = blocks.drop(*[f"_ST{m[o]}" for o in outs]).join(supers, [*keys, "_sb"])
    for o in outs:
        # block prefix = superblock prefix, then the blocks before it inside the superblock
        blocks = blocks.withColumn(f"_BP{m[o]}", F.expr(f"aggregate(array(_SP{m[o]}, _IP{m[o]}), {_ID}, {_COMPOSE})"))
    blocks = blocks.select(*keys, BLK, *[f"_BP{m[o]}" for o in outs])
    # carry into each sub-block = (block prefix, then in-block prefix) applied to 0
    carry = subs.join(blocks, [*keys, BLK])
    for o in outs:
        carry = carry.withColumn(f"_x{m[o]}", F.expr(_apply(f"_P{m[o]}", _apply(f"_BP{m[o]}", "CAST(0.0 AS DOUBLE)"))))
    carry = carry.groupBy(*keys, BLK).agg(
        F.map_from_entries(F.collect_list(F.struct(SUB, F.struct(*[f"_x{m[o]}" for o in outs])))).alias("_cm"))
    # 3. replay inside each sub-block from its carry
    wrow = Window.partitionBy(*keys, BLK, SUB).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    j = d.join(carry, [*keys, BLK], "left").withColumn("_c0", F.try_element_at("_cm", F.col(SUB)))
    res = {}
    for o in outs:
        x0 = F.coalesce(F.col(f"_c0._x{m[o]}"), F.lit(0.0))
        res[o] = F.aggregate(F.collect_list(m[o]).over(wrow), x0,
                             lambda x, e: F.least(e["c"], e["a"] * x + e["b"]))
    return j.withColumns(res).drop("_cm", "_c0", SUB, *m.values())
