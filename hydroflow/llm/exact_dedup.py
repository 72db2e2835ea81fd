"""Exact dedup by distributed MSD radix partitioning.

Documents are split by successive bytes of their normalised text: round r groups the documents that agree
so far by their next digit (a run of bytes, widened each round). A group of one is unique and leaves; a group
whose digit is shorter than its width has ended, so its texts are equal, byte for byte. The rest goes on to
the next digit. No digest decides equality. A group is never gathered: rounds are a count per
(group, digit) with map-side combine and a join of the rows back to the groups that still have company,
whose hot keys Spark's adaptive skew join splits. Each round is stored in the shared folder.

Normalised text: each run of blanks (U+0020, U+0009-U+000D) becomes one space; null counts as empty. The row with the
smallest id stays (null ids last; rows that repeat an id: the first stored). An empty table gives an empty
table. Columns of the input with an output's name are replaced."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, first_rank, fresh, own_shuffle, quoted, stored, with_row_ids, without

FIRST_DIGIT = 64
WIDEN = 8
WIDEST_DIGIT = 1 << 20
OUT = ("keep_id", "group_size", "kept")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def equal_groups(rows: DataFrame, first_digit: int = FIRST_DIGIT, widen: int = WIDEN,
                 widest: int = WIDEST_DIGIT) -> DataFrame:
    """``rows`` (rid, rank, bytes) -> rid, size, first (least rank) of every row that has an equal one."""
    active, width, ended = rows.withColumn("gid", F.lit(0).cast("long")), first_digit, []
    while True:
        cut = active.select("rid", "rank", "gid", F.substring("bytes", 1, width).alias("digit"),
                            F.expr(f"substring(bytes, {width + 1})").alias("bytes"))
        groups = (cut.groupBy("gid", "digit").agg(F.count(F.lit(1)).alias("size"), F.min("rank").alias("first"))
                  .where("size > 1").select(own_shuffle("gid").alias("gid"), "digit", "size", "first"))
        over = F.octet_length("digit") < width
        split = stored(cut.join(groups, ["gid", "digit"])
                       .select("rid", "rank", "size", "first", over.alias("over"),
                               F.when(~over, F.col("bytes")).alias("bytes")))
        ended.append(split.where("over").select("rid", "size", "first"))
        active = split.where("not over").select("rid", "rank", "bytes", F.col("first.rid").alias("gid"))
        if active.isEmpty():
            return reduce(DataFrame.unionAll, ended)
        width = min(width * widen, widest)


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, str]:
    (rid,) = fresh(docs, "_rid")
    base = with_row_ids(docs, rid)
    rows = base.select(quoted(rid).alias("rid"), first_rank(id_col, rid).alias("rank"),
                       normalised(quoted(text_col)).cast("binary").alias("bytes"))
    return base, equal_groups(rows), rid


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                derive: dict[str, Column] | None = None) -> DataFrame:
    """``docs`` with keep_id, group_size and kept. ``derive``: computed before the labels are joined, in
    place of the columns of ``docs`` other than the id, so that texts need not be shuffled again."""
    base, equal, rid = _prepared(docs, id_col, text_col)
    keep = ([quoted(id_col)] + [c.alias(n) for n, c in derive.items()]) if derive else without(base, rid, *OUT)
    size, first = fresh(base, "_size", "_first")
    labels = equal.select(F.col("rid").alias(rid), F.col("size").alias(size), F.col("first").alias(first))
    out = base.select(quoted(rid), quoted(id_col).alias(fresh(base, "_own")[0]), *keep).join(labels, rid, "left")
    own = fresh(base, "_own")[0]
    done = [F.when(F.col(first).isNull(), F.col(own)).otherwise(F.col(first)["id"]).alias(OUT[0]),
            F.coalesce(F.col(size), F.lit(1)).cast("long").alias(OUT[1]),
            F.coalesce(F.col(first)["rid"] == F.col(rid), F.lit(True)).alias(OUT[2])]
    return out.select(*without(out, rid, own, size, first), *done)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    base, equal, rid = _prepared(docs, id_col, text_col)
    gone = equal.where("first.rid != rid").select(F.col("rid").alias(rid))
    return base.join(gone, rid, "left_anti").select(*[quoted(c) for c in docs.columns])


def op10(spark, sf_dir):
    from .common import table
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    sha = F.sha2(normalised(F.col("text")).cast("binary"), 256)
    return (exact_dedup(docs, derive={"text_sha256": sha})
            .select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
