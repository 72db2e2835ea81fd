"""Per-series window operators (W1-W10): lags, full-window rolling sums/means, fills, differences.

All of them run through ``blocked.with_series_windows`` (one sort per (series, block), halo
rows for look-back) and ``blocked.fill`` (exact fills across blocks)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocked import DEFAULT_BLOCK, fill, materialize, with_series_windows


def lag(x: str, k: int, w) -> Column:
    return F.lag(F.col(x), k).over(w)


def rolling_full(x: str, n: int, w, how: str = "sum") -> Column:
    """pandas ``rolling(n).sum()/.mean()``: NULL until the window holds n non-null values."""
    r = w.rowsBetween(-(n - 1), 0)
    agg = F.sum(F.col(x)) if how == "sum" else F.avg(F.col(x))
    return F.when(F.count(F.col(x)).over(r) == n, agg.over(r))


def diff(x: str, w) -> Column:
    return F.col(x) - F.lag(F.col(x), 1).over(w)


def add_lags(df: DataFrame, keys: Sequence[str], pos: str, specs: dict[str, tuple[str, int]],
             fill_how: str | None = None, block: int = DEFAULT_BLOCK) -> DataFrame:
    """``specs`` maps output name -> (source column, k). ``fill_how``: None (R, W3),
    'bfill' (W1) or 'ffill_bfill' (W2)."""
    halo = max(k for _, k in specs.values())
    out = with_series_windows(df, keys, pos, lambda w: {n: lag(s, k, w) for n, (s, k) in specs.items()},
                              halo=halo, block=block)
    if fill_how:
        out = fill(materialize(out), keys, pos, list(specs), fill_how, block)
    return out


def add_rolling(df: DataFrame, keys: Sequence[str], pos: str, specs: dict[str, tuple[str, int]],
                how: str = "sum", fill_how: str | None = None, block: int = DEFAULT_BLOCK) -> DataFrame:
    """W7 (sum + bfill), W8 (mean + bfill), W9 (sum, no fill)."""
    halo = max(n for _, n in specs.values()) - 1
    out = with_series_windows(df, keys, pos,
                              lambda w: {o: rolling_full(s, n, w, how) for o, (s, n) in specs.items()},
                              halo=halo, block=block)
    if fill_how:
        out = fill(materialize(out), keys, pos, list(specs), fill_how, block)
    return out


def add_diff(df: DataFrame, keys: Sequence[str], pos: str, specs: dict[str, str],
             block: int = DEFAULT_BLOCK) -> DataFrame:
    """First difference x - lag(x, 1)."""
    return with_series_windows(df, keys, pos, lambda w: {o: diff(s, w) for o, s in specs.items()},
                               halo=1, block=block)


def fill_columns(df: DataFrame, keys: Sequence[str], pos: str, cols: Sequence[str], how: str,
                 block: int = DEFAULT_BLOCK) -> DataFrame:
    """W4 (ffill), W5 (bfill), W6 (ffill then bfill)."""
    return fill(df, keys, pos, cols, how, block)
