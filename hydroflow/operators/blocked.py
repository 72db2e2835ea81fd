"""Blocked per-series windows.

Every series operator in the reference is a window "per series, ordered by time". A plain
``Window.partitionBy(series)`` puts a whole series in one task, so one hot site (a third of all
rows) would become one task. Instead each series is cut into fixed blocks of ``block`` positions
and the window runs per (series, block):

* frames that look back at most ``halo`` rows (lags, rolling windows) get the last ``halo``
  rows of the previous block copied in as read-only halo rows, so results equal the
  whole-series window exactly;
* fills and recurrences that carry state across the whole series use a small per-block
  summary table, an exclusive prefix over blocks, and a join back on (series, block).

``pos`` must be a dense integer position within the series (hour id on a gap-free hourly
grid, or ``dense_position`` for ragged series).
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLK = "_blk"
HALO = "_halo"
DEFAULT_BLOCK = 720  # 30 days of hours; halo of 47 rows adds ~6.5% rows


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the cluster's shared ``spark.checkpoint.dir``: cuts lineage at
    a stage boundary (so self-joins of carries do not recompute upstream stages) and survives
    executor loss. The checkpoint keeps the (series, block) hash partitioning."""
    from ..session import cut_lineage
    return cut_lineage(df)


# Largest per-series side we broadcast, in bytes; a larger one is joined on (keys, salt).
BROADCAST_MAX_BYTES = 64 << 20
SALTS = 64


def table_bytes(df: DataFrame) -> int:
    """Size of a small table: fixed widths by type, strings by their length (one aggregation)."""
    fixed = 16
    var = F.lit(0)
    for f in df.schema.fields:
        if f.dataType.typeName() in ("string", "binary"):
            var = var + F.coalesce(F.octet_length(F.col(f.name)), F.lit(0))
            fixed += 16
        elif f.dataType.typeName() in ("array", "map", "struct"):
            var = var + F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0))
        else:
            fixed += 16
    return int(df.agg(F.sum(var + F.lit(fixed))).first()[0] or 0)


def attach(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner",
           max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Join a per-series (or per-group) table onto the rows. A hot series would make a plain shuffle
    join put a third of all rows in one task. The small side is broadcast if its measured size allows;
    else both sides get a salt: rows by a hash of all their columns, the small side one copy per salt."""
    small = materialize(small)  # measured and joined: compute it once, hold no executor memory
    if table_bytes(small) <= max_bytes:
        return big.join(F.broadcast(small), list(keys), how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(SALTS)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row as literals: the aggregate runs
    once, its single row (a handful of numbers) comes back, and the main plan carries no join
    at all (a constant-key join would be folded into a nested-loop cross join)."""
    row = one_row.first()
    types = {f.name: f.dataType for f in one_row.schema.fields}
    return df.withColumns({c: F.lit(row[c]).cast(types[c]) for c in one_row.columns})


def block_of(pos: str, block: int) -> Column:
    return F.floor(F.col(pos) / F.lit(block)).cast("long")


def with_halo(df: DataFrame, pos: str, halo: int, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Add ``_blk``; append copies of each block's last ``halo`` rows to the next block."""
    if halo > block:
        raise ValueError(f"halo {halo} larger than block {block}")
    own = block_of(pos, block)
    if halo == 0:
        return df.withColumn(BLK, own).withColumn(HALO, F.lit(False))
    # one pass over the input: a tail row is emitted for its own block and, as a halo copy,
    # for the next one (no self-union, so the input is read once)
    tail = F.pmod(F.col(pos), F.lit(block)) >= F.lit(block - halo)
    blks = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    return (df.withColumn("_own", own).withColumn(BLK, F.explode(blks))
            .withColumn(HALO, F.col(BLK) != F.col("_own")).drop("_own"))


def block_window(keys: Sequence[str], pos: str, descending: bool = False):
    o = F.col(pos).desc() if descending else F.col(pos)
    return Window.partitionBy(*keys, BLK).orderBy(o)


def with_series_windows(df: DataFrame, keys: Sequence[str], pos: str,
                        build: Callable[[object], dict[str, Column]], halo: int,
                        block: int = DEFAULT_BLOCK) -> DataFrame:
    """Evaluate ``build(w)`` (look-back frames of at most ``halo`` rows) per (series, block).

    Output keeps ``_blk`` and is hash-partitioned on (keys, _blk), so later fills, scans and
    aggregations on the same blocks add no shuffle of the large side."""
    u = with_halo(df, pos, halo, block)
    w = block_window(keys, pos)
    return u.withColumns(build(w)).filter(~F.col(HALO)).drop(HALO)


def dense_position(df: DataFrame, keys: Sequence[str], order: str, bucket: Column,
                   out: str = "pos") -> DataFrame:
    """Dense 0-based row position within each series, fully distributed.

    ``bucket`` is a coarse monotone function of ``order`` (e.g. month of the timestamp). Rows
    are counted per (series, bucket); a prefix sum over the small bucket table gives each
    bucket's offset; ``row_number`` inside the bucket adds the rest."""
    b = df.withColumn("_bkt", bucket)
    counts = b.groupBy(*keys, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    wc = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(wc), F.lit(0))).drop("_n")
    wr = Window.partitionBy(*keys, "_bkt").orderBy(order)
    return (b.join(offs, [*keys, "_bkt"])
            .withColumn(out, (F.col("_off") + F.row_number().over(wr) - 1).cast("long"))
            .drop("_bkt", "_off"))


def row_position(df: DataFrame, keys: Sequence[str], ts: str, out: str = "_pos") -> DataFrame:
    """Dense row position per series in the order of ``ts`` (one row per hour). A series without gaps has
    its hour id as a dense position already; that is checked in one aggregation, and any gap makes the
    positions be counted, so that lags and windows go by row either way."""
    from ..functions.calendar import hour_id
    d = df.withColumn(out, hour_id(ts))
    gaps = (d.groupBy(*keys).agg(F.count(out).alias("_n"), (F.max(out) - F.min(out) + 1).alias("_span"))
            .where(F.col("_n") != F.col("_span")))
    if gaps.isEmpty():
        return d
    return dense_position(df.withColumn("_hid", hour_id(ts)), keys, "_hid", F.floor(F.col("_hid") / DEFAULT_BLOCK), out).drop("_hid")


def fill(df: DataFrame, keys: Sequence[str], pos: str, cols: Sequence[str] | dict[str, str], how: str = "ffill",
         block: int = DEFAULT_BLOCK) -> DataFrame:
    """Fill NULLs of ``cols`` along each series: ``ffill``, ``bfill`` or ``ffill_bfill``
    (``cols`` may also map column -> mode: all columns then share one carry table and join).

    Inside a block: ``last(ignorenulls)`` over a growing frame (ascending for ffill, descending
    for bfill; never ``first`` over an unbounded-following frame, which is quadratic). Across
    blocks: per-block first/last non-null values, a running ``last`` over the block table,
    joined back on (series, block)."""
    if not cols:
        return df
    modes = dict(cols) if isinstance(cols, dict) else {c: how for c in cols}
    if set(modes.values()) - {"ffill", "bfill", "ffill_bfill"}:
        raise ValueError(modes)
    cols = list(modes)
    if BLK not in df.columns:
        df = df.withColumn(BLK, block_of(pos, block))
    p = F.col(pos)
    aggs = []
    for c in cols:
        keep = F.when(F.col(c).isNotNull(), p)
        aggs.append(F.max_by(F.col(c), keep).alias(f"_last_{c}"))
        aggs.append(F.min_by(F.col(c), keep).alias(f"_first_{c}"))
    edges = df.groupBy(*keys, BLK).agg(*aggs)
    fwd = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    bwd = Window.partitionBy(*keys).orderBy(F.col(BLK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carries = {}
    for c in cols:
        carries[f"_cf_{c}"] = F.last(F.col(f"_last_{c}"), ignorenulls=True).over(fwd)
        carries[f"_cb_{c}"] = F.last(F.col(f"_first_{c}"), ignorenulls=True).over(bwd)
    carry = edges.withColumns(carries).select(*keys, BLK, *carries.keys())
    wf = block_window(keys, pos).rowsBetween(Window.unboundedPreceding, 0)
    wb = block_window(keys, pos, descending=True).rowsBetween(Window.unboundedPreceding, 0)
    j = df.join(carry, [*keys, BLK], "left")
    out = {}
    for c in cols:
        ff = F.coalesce(F.last(F.col(c), ignorenulls=True).over(wf), F.col(f"_cf_{c}"))
        bf = F.coalesce(F.last(F.col(c), ignorenulls=True).over(wb), F.col(f"_cb_{c}"))
        m = modes[c]
        out[c] = ff if m == "ffill" else bf if m == "bfill" else F.coalesce(ff, bf)
    return j.withColumns(out).drop(*carries.keys())
