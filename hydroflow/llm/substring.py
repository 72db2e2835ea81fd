"""Substring dedup by hashing text units.

A text is cut into units: paragraphs (at blank lines), lines, or the sentences of its lines. Units are
normalised (A-Z lower-cased, runs of blanks to one space, trimmed) and hashed (MD5). Digests are grouped globally; the earliest
occurrence by (document id, position) stays, every later one is a repeat. Consecutive repeats of a document form a
span, which keeps the character offsets of the original.

Production removes by two rules at once. Every repeated paragraph goes, at any length, a whole short document included. Beyond that,
passages pasted into the middle of a line share no whole line or paragraph with their other copies, so repeated sentences go too, where the
units of two or more words of a span have at least ``min_words`` words together: chance repeats of short sentences
stay and short ones inside a repeated passage go with it. In scripts written without blanks (Han, kana, Thai, Lao, Khmer,
Burmese) each character counts as a word there. Spans of the two rules may overlap; removal takes their union.
A single unit ("line" for one) with its least number of words can be asked for instead; 0 takes every repeat.

The unit table is stored once; counting is a group by digest with map-side combine, and rows meet their
group in a join whose hot digests the adaptive skew join splits. A document's repeats are ordered in one
window, never those of a digest.

Defined results: null or empty texts and blank units have no units; rows that repeat an id are documents of their own (the first
stored is the earlier), null ids come last; an empty table gives an empty table; extra columns are kept (one named ``removed`` is replaced)."""
from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, map_arrow, own_shuffle, quoted, slices, stored, with_fields, with_row_ids

MIN_WORDS = 25
_UNITS = {
    "paragraph": re.compile(r"[^\n]+(?:\n(?![ \t\r\f\v]*(?:\n|$))[^\n]*)*"),
    "line": re.compile(r"[^\n]+"),
    "sentence": re.compile(r"[^.!?\n]+[.!?]*|[.!?]+"),
}
#: Letters of scripts written without blanks between words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def _rules(unit: str | None, min_words: int) -> dict[str, int]:
    """Least words of a span to remove, by unit."""
    return {"paragraph": 0, "sentence": min_words} if unit is None else {unit: min_words}


def units(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """rid, id, text -> one row per unit of each kind: rid, id, kind (its place in ``kinds``), no, start, end (code points), words, size, d1, d2."""
    patterns = [_UNITS[k] for k in kinds]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                row, kind, no, start, end, words, sizes, digests = [], [], [], [], [], [], [], []
                for r, text in enumerate(part.column("text").to_pylist()):
                    for k, pattern in enumerate(patterns):
                        n = 0
                        for m in pattern.finditer(text or ""):
                            u = m.group().encode("utf-8", "surrogatepass").lower().split()
                            if u:
                                row.append(r)
                                kind.append(k)
                                no.append(n)
                                start.append(m.start())
                                end.append(m.end())
                                words.append(len(u))
                                sizes.append(len(u) if m.group().isascii() else max(len(u), len(_UNSPACED.findall(m.group()))))
                                digests.append(hashlib.md5(b"%d " % k + b" ".join(u)).digest())
                                n += 1
                d = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("rid").take(at), part.column("id").take(at), *[pa.array(x, pa.int32()) for x in (kind, no, start, end, words, sizes)],
                     pa.array(d[:, 0]), pa.array(d[:, 1])], ["rid", "id", "kind", "no", "start", "end", "words", "size", "d1", "d2"])

    rows = rows.select("rid", "id", "text")
    schema = with_fields(rows.select("rid", "id").schema, ("kind", "int"), ("no", "int"), ("start", "int"), ("end", "int"), ("words", "int"),
                         ("size", "int"), ("d1", "long"), ("d2", "long"))
    return map_arrow(rows, run, schema)


def repeated_spans(rows: DataFrame, unit: str | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """rid, id, text -> rid, id, unit, start, end, n_units, n_words, keep_id of every span to remove."""
    rules = _rules(unit, min_words)
    u = stored(units(rows, list(rules)))
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "rid", "no")
    groups = (u.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first")).where("n > 1")
              .select(own_shuffle("d1").alias("d1"), "d2", "first"))
    repeats = u.join(groups, ["d1", "d2"]).where("rid != first.rid or no != first.no")
    run = Window.partitionBy("rid", "kind").orderBy("no")
    runs = repeats.withColumn("run", F.col("no") - F.row_number().over(run))
    return (runs.groupBy("rid", "id", "kind", "run")
            .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).cast("int").alias("n_units"),
                 F.sum("words").cast("int").alias("n_words"),
                 F.sum(F.when(F.col("size") > 1, F.col("size")).otherwise(0)).alias("counted"),
                 F.min_by("first.id", "no").alias("keep_id"))
            .where(F.col("counted") >= F.array(*map(F.lit, rules.values()))[F.col("kind")])
            .select("rid", "id", F.array(*map(F.lit, rules))[F.col("kind")].alias("unit"), "start", "end", "n_units", "n_words", "keep_id"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str | None = None,
                    min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the text left after removal and ``removed``: the (start, end) offsets taken from the original."""
    rid, spans, at = fresh(docs, "_rid", "_spans", "removed")
    base = with_row_ids(docs, rid)
    rows = base.select(quoted(rid).alias("rid"), quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    before = Window.partitionBy("rid").orderBy("start", "end")  # spans of one document
    reach = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    apart = repeated_spans(rows, unit, min_words).select("rid", "start", "end", F.when(F.col("start") <= reach, 0).otherwise(1).alias("new"))
    merged = (apart.withColumn("part", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy("rid", "part").agg(F.min("start").alias("start"), F.max("end").alias("end")))
    found = (merged.groupBy(F.col("rid").alias(rid))
             .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(spans)))
    n = F.length(quoted(text_col))
    removed = F.coalesce(F.col(spans), F.array().cast("array<struct<start:int,end:int>>"))
    starts = F.concat(F.array(F.lit(0)), F.transform(removed, lambda s: s["end"]))
    ends = F.concat(F.transform(removed, lambda s: s["start"]), F.array(n))
    left = F.array_join(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")),
                                    lambda z: F.substring(quoted(text_col), z["a"] + 1, z["b"] - z["a"])), "")
    joined = base.join(found, rid, "left")
    return joined.select(*[F.when(F.size(removed) == 0, quoted(c)).otherwise(left).alias(c) if c == text_col else quoted(c)
                           for c in docs.columns], removed.alias(at))


def op2(spark, sf_dir):
    from .common import table
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").alias("id"), "text")
    return repeated_spans(rows).select(F.col("id").alias("doc_id"), "unit", "start", "end", "n_units", "n_words",
                                       F.col("keep_id").alias("keep_doc_id"))
