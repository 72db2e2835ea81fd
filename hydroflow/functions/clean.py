"""Cleaning and string column functions."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Timestamp layouts found in the reference's inputs.
TS_FORMATS = ("yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_ts(c, formats: Sequence[str] = TS_FORMATS) -> Column:
    """First layout that parses wins; unparsable -> NULL (ANSI-safe ``try_to_timestamp``),
    result zone-free."""
    return F.coalesce(*[F.try_to_timestamp(_c(c), F.lit(f)) for f in formats]).cast("timestamp_ntz")


def to_number(c) -> Column:
    """``pd.to_numeric(errors='coerce')``: non-numbers and NaN become NULL."""
    x = _c(c).try_cast("double")
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def coerce_numeric(df: DataFrame, except_cols: Sequence[str] = ("Time",)) -> DataFrame:
    """P3 applied to every column but the time column(s)."""
    return df.withColumns({c: to_number(c) for c in df.columns if c not in except_cols})


def kelvin_to_celsius(c, offset: float = 273.0) -> Column:
    """P5: the reference subtracts 273 (not 273.15); the offset is a parameter."""
    return _c(c) - F.lit(offset)


def per_5min_rate_to_mm(c, per_hour: int = 12) -> Column:
    """A 5-minute reading in mm/hr is mm/hr / 12 millimetres."""
    return _c(c) / F.lit(float(per_hour))


def difference(a, b) -> Column:
    """Derived difference series (e.g. total inflow minus an upstream station)."""
    return _c(a) - _c(b)


def clip_negative(c) -> Column:
    """Negatives to 0, NULL stays NULL (``greatest(c, 0)`` would turn NULL into 0)."""
    return F.when(_c(c) < 0, F.lit(0.0)).otherwise(_c(c))


def model_matrix(df: DataFrame, target: str, drop: Sequence[str] = ("Time", "sin_hour", "cos_hour")) -> list[str]:
    """P10: feature columns = all but time, the cyclic pair and the target (plan-time)."""
    return [c for c in df.columns if c not in set(drop) | {target}]


def columns_containing(df: DataFrame, text: str) -> list[str]:
    """Column choice by substring (plan-time)."""
    return [c for c in df.columns if text in c]


def job_name(c) -> Column:
    """First three words plus the seventh word, or ``CUR`` when there is none."""
    w = F.split(F.trim(_c(c)), r"\s+")
    return F.concat_ws(" ", F.array_join(F.slice(w, 1, 3), " "),
                       F.coalesce(F.try_element_at(w, F.lit(7)), F.lit("CUR")))


def lookup(df: DataFrame, col: str, mapping: Mapping[str, str], out: str) -> DataFrame:
    """Dictionary lookup as a literal map (tiny, no join); unmatched -> NULL."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(out, F.try_element_at(m, F.col(col)))


def lookup_by_substring(df: DataFrame, col: str, table: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The first row of ``table`` (by ``order``, then ``key``) whose ``key`` is a substring of ``col``;
    rows with no match are skipped (inner join).

    No nested loop and no size limit: for each key length in the table (a handful), the distinct values of
    ``col`` are cut into their substrings of that length, which meet the keys in an equi-join; the first match
    per value then joins back on the value."""
    lengths = [r[0] for r in table.where(F.length(key) > 0).select(F.length(key)).distinct().collect()]
    values = df.select(F.col(col).alias("_v")).where(F.col("_v").isNotNull()).distinct()
    none = F.array().cast("array<string>")

    def pieces(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length("_v") - n + 1)
        return F.when(F.length("_v") >= n, F.transform(starts, lambda i: F.substring("_v", i, F.lit(n)))).otherwise(none)

    cut = values.select("_v", F.explode(F.array_distinct(F.concat(none, *[pieces(n) for n in lengths]))).alias("_k"))
    rank = F.struct(*([F.col(order)] if order else []), F.col(key))
    hit = cut.join(table, F.col("_k") == F.col(key)).groupBy("_v").agg(F.min_by(F.struct(*table.columns), rank).alias("_t"))
    return df.join(hit, F.col(col) == F.col("_v"), "inner").select(*[df[c] for c in df.columns], "_t.*")


def in_years_months(ts, years: Sequence[int] | None = None, months: Sequence[int] | None = None) -> Column:
    """Filter predicate on a year set and/or a month set. The years also give a range of the raw column,
    which reaches the scan (parquet row groups are skipped)."""
    cond = F.lit(True)
    if years:
        lo, hi = date(min(years), 1, 1), date(max(years) + 1, 1, 1)
        cond = cond & (_c(ts) >= F.lit(lo)) & (_c(ts) < F.lit(hi)) & F.year(_c(ts)).isin(list(years))
    if months:
        cond = cond & F.month(_c(ts)).isin(list(months))
    return cond


def word_stats(c) -> dict[str, Column]:
    """number of words and of unique words of a text value."""
    w = F.filter(F.split(F.lower(F.trim(_c(c))), r"\s+"), lambda x: x != "")
    return {"n_words": F.size(w), "n_unique_words": F.size(F.array_distinct(w))}
