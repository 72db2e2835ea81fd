"""Line dedup over overlapping windows of three lines, in DataFrame operations only.

Lines are compared with runs of blanks as one space and trimmed. Every three consecutive lines of a document
make a window (none if it has fewer than three lines; windows of blank lines only do not count), hashed by MD5. Windows with equal digests are found
globally; the earliest by (document id, line) stays. The lines that later occurrences cover are merged into ranges and removed.

The window digests are stored once; counting is a group by digest with map-side combine and a join back,
whose hot digests the adaptive skew join splits. Only a document's own repeats are ordered in a window.

Defined results: null text is one empty line; null ids rank last, rows that repeat an id are documents of
their own; an empty table gives an empty table; extra columns are kept, those named like an output replaced."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, own_shuffle, quoted, stored, with_row_ids, without

LINES = 3


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _compared(text: Column) -> Column:
    """The lines as compared: blanks folded and trimmed, in two passes over the text."""
    folded = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09\x0B-\x0D]+", " ")
    return F.split(F.regexp_replace(folded, "(?m)^ | $", ""), "\n", -1)


def covered_ranges(rows: DataFrame, lines: int = LINES) -> DataFrame:
    """rid, id, text -> rid, id, n_lines, ranges: line ranges [start, end) to remove, in order, and n_removed."""
    texts = rows.select("rid", "id", _compared(F.col("text")).alias("l"))
    window = F.when(F.size("l") >= lines, F.transform(
        F.sequence(F.lit(0), F.size("l") - lines),
        lambda i: F.concat_ws("\n", *[F.get("l", i + k) for k in range(lines)]))).otherwise(F.array().cast("array<string>"))
    digests = F.transform(window, lambda w: F.when(F.length(w) > lines - 1, F.unhex(F.md5(w.cast("binary")))))
    base = stored(texts.select("rid", "id", F.size("l").alias("n_lines"), digests.alias("windows")))
    win = base.select("rid", "id", F.posexplode("windows").alias("pos", "digest")).where("digest is not null")
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "rid", "pos")
    groups = (win.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first")).where("n > 1")
              .select(F.concat("digest", F.unhex(F.lit(""))).alias("digest"), "first"))
    later = win.join(groups, "digest").where("rid != first.rid or pos != first.pos").select("rid", "pos")
    by_doc = Window.partitionBy("rid").orderBy("pos")
    gap = F.col("pos") > F.coalesce(F.lag("pos").over(by_doc), F.lit(-1000000)) + lines
    islands = later.withColumn("gap", gap.cast("int")).withColumn("island", F.sum("gap").over(by_doc))
    ranges = (islands.groupBy("rid", "island").agg(F.min("pos").alias("start"), (F.max("pos") + lines).alias("end"))
              .groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"),
                                  F.sum(F.col("end") - F.col("start")).cast("int").alias("n_removed")))
    return (base.select("rid", "id", "n_lines").join(ranges, "rid", "left")
            .select("rid", "id", "n_lines", F.coalesce("ranges", F.array().cast("array<struct<start:int,end:int>>")).alias("ranges"),
                    F.coalesce("n_removed", F.lit(0)).alias("n_removed")))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and n_removed."""
    (rid,) = fresh(docs, "_rid")
    base = with_row_ids(docs, rid)
    rows = base.select(quoted(rid).alias("rid"), quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    ranges, n = fresh(base, "_ranges", "_n")
    found = covered_ranges(rows, lines).where("n_removed > 0").select(F.col("rid").alias(rid), F.col("ranges").alias(ranges), F.col("n_removed").alias(n))
    joined = base.join(found, rid, "left")
    all_lines = lines_of(quoted(text_col))
    starts = F.concat(F.array(F.lit(0)), F.transform(F.col(ranges), lambda r: r["end"]))
    ends = F.concat(F.transform(F.col(ranges), lambda r: r["start"]), F.array(F.size(all_lines)))
    left = F.flatten(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda z: F.slice(all_lines, z["a"] + 1, z["b"] - z["a"])))
    text = F.when(F.col(n).isNull(), quoted(text_col)).otherwise(F.array_join(left, "\n"))
    return joined.select(*[text.alias(c) if c == text_col else quoted(c) for c in docs.columns if c.lower() != "n_removed"],
                         F.coalesce(F.col(n), F.lit(0)).alias("n_removed"))


def op3(spark, sf_dir):
    from .common import table
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").alias("id"), "text")
    ranges = F.array_join(F.transform("ranges", lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string"))), ";")
    return covered_ranges(rows).select(F.col("id").alias("doc_id"), "n_lines", "n_removed", ranges.alias("removed"))


SQL = r"""
WITH d AS (
  SELECT doc_id, list_transform(string_split(regexp_replace(coalesce(text, ''), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10)),
    lambda x: trim(x, ' ')) AS l FROM documents),
w AS (SELECT doc_id, unnest(range(0, greatest(len(l) - 2, 0))) AS pos, l FROM d),
k AS (SELECT doc_id, pos, l[pos + 1] || chr(10) || l[pos + 2] || chr(10) || l[pos + 3] AS key FROM w),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS r
    FROM k WHERE length(key) > 2) WHERE r > 1),
islands AS (SELECT doc_id, pos, sum(gap) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM
  (SELECT doc_id, pos, CASE WHEN pos > coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), -1000000) + 3 THEN 1 ELSE 0 END AS gap
   FROM later)),
ranges AS (SELECT doc_id, min(pos) AS a, max(pos) + 3 AS b FROM islands GROUP BY doc_id, island),
per AS (SELECT doc_id, sum(b - a) AS n, string_agg(a || '-' || b, ';' ORDER BY a) AS removed FROM ranges GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.l) AS INT) AS n_lines, CAST(coalesce(per.n, 0) AS INT) AS n_removed, coalesce(per.removed, '') AS removed
FROM d LEFT JOIN per ON d.doc_id = per.doc_id
"""
