"""Mixing sources to target weights, in DataFrame operations only.

A document's size is its number of words. Sources in code-point order (null last) weigh 5, 2, 1, 5, 2, ...
and share the total size by weight; a target stops at ``max_repeat`` times its source's size and the excess
goes to the others by weight until none is above. The fixed point has a closed form: with sources ordered by
cap / weight, the level L solves sum(min(cap, L * weight)) = total.

A source's rate is target / size. Each document comes out floor(rate) times, plus once more when a hash of
its id falls below the fraction. Reruns give the same copies.

Defined results: null text has size 0; a null source is a source of its own, after all others; a source of
size 0 has target 0 and rate 0 (nothing to take words from), so its empty documents get no copies; rows
that repeat an id share the same draw; an empty table gives an empty table; an extra column with a work
column's name is kept, one with an output's name is replaced."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, fresh, quoted, without

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
#: A rates table up to this size is broadcast; a larger one is joined on (source, salt).
BROADCAST_BYTES = 4 << 20
SALTS = 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``sizes`` (source, source_size): one row per source -> source, source_size, target, rate.

    The windows run over one row per source, after aggregation; no document passes through them."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    i = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (i + 1).cast("int")).cast("long")
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * max_repeat)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (s.withColumn("total", F.sum("source_size").over(everything))
         .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0))).cast("double")
                     / F.sum("w").over(rest)))
    # the first source (in cap / weight order) whose cap is not reached fixes the level of all after it
    s = s.withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    s = s.withColumn("final", F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(everything))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("final"), F.col("level")) * F.col("w"))
    return (s.withColumn("target", target)
            .select("source", "source_size", "target",
                    F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                    .otherwise(F.lit(0.0)).alias("rate")))


def draw(id_col: Column, seed: str) -> Column:
    """Uniform number in [0, 1) from a hash of the id (md5, so that any engine can repeat it)."""
    h = F.md5(F.concat_ws("|", F.coalesce(id_col.cast("string"), F.lit("")), F.lit(seed)).cast("binary"))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = "mix",
               out: tuple[str, str, str, str] = ("size", "source_size", "target", "copies")) -> DataFrame:
    """``docs`` with four more columns, named by ``out``; a column of ``docs`` with such a name is replaced (its
    values still serve as id, text or source where it is named as one)."""
    size, source_size, target, copies = out
    (words,) = fresh(docs, "_words")
    sized = docs.withColumn(words, n_words(quoted(text_col)))
    per_source = sized.groupBy(quoted(source_col).alias("source")).agg(F.sum(words).alias("source_size"))
    rates = checkpointed(source_targets(per_source, weights, max_repeat))
    bound = rates.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64)).first()[0] or 0
    key, s_size, t, rate, salt = fresh(sized, "_key", "_ssize", "_target", "_rate", "_salt")
    rates = rates.select(F.col("source").alias(key), F.col("source_size").alias(s_size),
                         F.col("target").alias(t), F.col("rate").alias(rate))
    if bound <= BROADCAST_BYTES:
        joined = sized.join(F.broadcast(rates), quoted(source_col).eqNullSafe(F.col(key)), "left")
    else:  # a hot source is dealt over SALTS tasks
        rates = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = sized.withColumn(salt, F.pmod(F.xxhash64(quoted(id_col), quoted(text_col)), F.lit(SALTS)).cast("int"))
        joined = left.join(rates, quoted(source_col).eqNullSafe(F.col(key)) & (left[salt] == rates[salt]), "left")
    whole = F.floor(F.col(rate)).cast("int")
    n = whole + F.when(draw(quoted(id_col), seed) < F.col(rate) - whole, 1).otherwise(0)
    return joined.select(*without(docs, *out), F.col(words).alias(size), F.col(s_size).alias(source_size),
                         F.col(t).alias(target), n.alias(copies))


def mix(docs: DataFrame, **kw) -> DataFrame:
    """The mixed corpus: every document as often as its copies say, with the columns of ``docs``."""
    out = tuple(fresh(docs, "_size", "_source_size", "_target_size", "_copies"))
    counted = mix_counts(docs, out=out, **kw).where(F.col(out[3]) > 0)
    (each,) = fresh(counted, "_each")
    return (counted.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(out[3]))))
            .select(*[quoted(c) for c in docs.columns]))


def op4(spark, sf_dir):
    from .common import table
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mix_counts(docs).select("doc_id", "size", "source_size", "target",
                                   (F.col("size") * F.col("copies")).cast("long").alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
named AS (SELECT *, list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INT)) AS w
  FROM per),
caps AS (SELECT *, source_size * 3 AS cap, sum(source_size) OVER () AS total FROM named),
levels AS (SELECT *, CAST(total - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM caps),
lvl AS (SELECT first(level ORDER BY cap / w, source IS NULL, source) FILTER (WHERE level * w <= cap) AS final FROM levels),
targets AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(final, level) * w) AS target FROM levels, lvl),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets)
SELECT s.doc_id, s.size, r.source_size, r.target,
  CAST(s.size * (floor(r.rate) + CASE WHEN
    CAST('0x' || substr(md5(concat_ws('|', coalesce(CAST(s.doc_id AS VARCHAR), ''), 'mix')), 1, 8) AS BIGINT) / 4294967296.0
      < r.rate - floor(r.rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
"""
