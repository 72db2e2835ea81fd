"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprint: words of the text (A-Z lower-cased, split at blanks), word shingles, XXH64 of each (seed 42); a
bit is 1 if it is set in over half of the hashes. Fewer words than a shingle: the whole sequence is the only
shingle; no words: zero.

Links (``max_bits`` or fewer differing bits) are searched among the distinct fingerprints:

1. One pass counts how often each pair of bits is set together. Correlated bits are put into the same
   partition, so that what they cannot tell apart is lost in one partition only.
2. If two fingerprints differ in at most t bits, then for any thresholds t_i over m partitions with
   sum(t_i) = t - m + 1, some partition differs in at most t_i bits. Exact counts of equal partition values
   estimate the candidates of each partition; dynamic programming allots the thresholds (-1: not searched),
   and the cheapest of a few partition counts is taken. Any choice finds every link.
3. Fingerprints that probe only buckets of up to ``bucket`` members are paired by bucket and verified by
   their bit distance. The others (large buckets, such as thousands of near copies) are linked exactly without pairs:
   each is dealt to the fingerprints within max_bits / 2 of it; two that meet at one are within max_bits, and
   any two within max_bits meet, so linking all that meet to the least of them keeps every component whole.

Defined results: null text has no words; rows that repeat an id are rows of their own, component_id is the
smallest id of the component (null ids last); an empty table gives an empty table."""
from __future__ import annotations

import functools
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, first_rank, fresh, map_arrow, quoted, slices, stored, with_fields, with_row_ids
from .components import connected_components

SHINGLE = 3
MAX_BITS = 2
BUCKET = 64
BITS = 64
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned integer."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII blanks
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    h = np.fromiter(map(functools.partial(xxhash.xxh64_intdigest, seed=42), parts), dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), _CHUNK):
        ones += np.unpackbits(h[i:i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """rid, rank, text -> rid, rank, fp (the unsigned bits as a long)."""
    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for part in slices(batch) for t in part.column("text").to_pylist()],
                           dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("rank"), pa.array(fps)], ["rid", "rank", "fp"])

    schema = with_fields(rows.select("rid", "rank").schema, ("fp", "long"))
    return map_arrow(rows.select("rid", "rank", "text"), run, schema)


def _bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each pair of bits, in how many both are set (64 x 64)."""
    def run(batches):
        total = np.zeros((BITS, BITS))
        n = 0
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(v), _CHUNK):
                b = np.unpackbits(v[i:i + _CHUNK].copy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                total += (f := b.astype(np.float32)).T @ f
                n += len(f)
        cells = np.append(total.ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "n"])

    cells = map_arrow(fps.select("fp"), run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for r in cells:
        flat[r["cell"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def correlated_partitions(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the bits into ``parts`` groups of equal width, correlated bits together (greedy)."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        width = (len(left) + parts - k - 1) // (parts - k)
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        while len(group) < width:
            rest = [b for b in left if b not in group]
            group.append(max(rest, key=lambda b: (corr[b, group].mean(), -b)))
        out.append(sorted(group))
        left = [b for b in left if b not in group]
    return out


def masks(bits: list[int], radius: int) -> list[int]:
    """All flips of up to ``radius`` of the bits, as signed longs."""
    out = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(bits, r)]
    return [_signed(m) for m in out]


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def allot(cost: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum ``total`` of least cost; cost[i][t + 1] is partition i's at threshold t."""
    best = {0: (0.0, [])}
    for row in cost:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for j, add in enumerate(row):
                key = s + j - 1
                if key not in nxt or c + add < nxt[key][0]:
                    nxt[key] = (c + add, [*ts, j - 1])
        best = nxt
    return best[total]


def plan(fps: DataFrame, max_bits: int, part_counts=(2, 3, 4)) -> list[tuple[list[int], int]]:
    """Partitions of the bits with their thresholds: the cheapest allotment over a few partition counts."""
    n, both = _bit_counts(fps)
    p = np.diag(both) / max(n, 1)
    agree = np.clip(p * p + (1 - p) * (1 - p), 0.5, 1)
    layouts = {m: correlated_partitions(n, both, m) for m in part_counts if m <= max_bits + 2}
    keys = [F.struct(F.lit(m * 100 + i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits)))).alias("key"))
            for m, groups in layouts.items() for i, bits in enumerate(groups)]
    same = {r["part"]: float(r["pairs"]) for r in
            fps.select(F.explode(F.array(*keys)).alias("k")).select("k.*").groupBy("part", "key").count()
            .groupBy("part").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
    chosen = None
    for m, groups in layouts.items():
        cost = []
        for i, bits in enumerate(groups):
            row, pairs, probes, odds = [0.0], same.get(m * 100 + i, 0.0), 1.0, (1 - agree[bits]) / agree[bits]
            wider = 1.0
            for t in range(max_bits + 1):
                if t:
                    probes *= (len(bits) - t + 1) / t
                    wider *= odds.sum() / t  # how much likelier a distance of t is than one of t - 1
                row.append(row[-1] + n * probes + pairs * wider)
            cost.append(row)
        found = allot(cost, max_bits - m + 1)
        if chosen is None or found[0] < chosen[0]:
            chosen = (*found, groups)
    return list(zip(chosen[2], chosen[1]))


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET, layout=None) -> DataFrame:
    """``fps`` (fp, distinct) -> links a, b that join every two fingerprints within ``max_bits`` of each
    other into one component, and no others."""
    layout = layout or plan(fps, max_bits)
    data, probe = [], []
    for i, (bits, t) in enumerate(layout):
        if t >= 0:
            key = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))))
            data.append(F.struct(F.lit(i).alias("part"), key.alias("key")))
            probe += [F.struct(F.lit(i).alias("part"), key.bitwiseXOR(F.lit(m)).alias("key")) for m in masks(bits, t)]
    d = fps.select("fp", F.explode(F.array(*data)).alias("k")).select("fp", "k.*")
    p = fps.select("fp", F.explode(F.array(*probe)).alias("k")).select("fp", "k.*")
    hot = checkpointed(d.groupBy("part", "key").count().where(F.col("count") > bucket).select("part", "key"))
    crowded = checkpointed(p.join(hot, ["part", "key"], "left_semi").select("fp").distinct())
    d, p = (x.join(hot, ["part", "key"], "left_anti") for x in (d, p))
    pairs = (d.select("part", "key", F.col("fp").alias("a")).join(p.select("part", "key", F.col("fp").alias("b")), ["part", "key"])
             .where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    near, far = max_bits // 2, max_bits - max_bits // 2
    around = [F.struct(F.col("fp").bitwiseXOR(F.lit(m)).alias("at"),
                       F.lit(bin(m & (2**64 - 1)).count("1") <= near).alias("close")) for m in masks(list(range(BITS)), far)]
    met = crowded.select("fp", F.explode(F.array(*around)).alias("k")).select("fp", "k.*")
    if near == far:
        least = met.groupBy("at").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("at", "a")
        star = met.join(least, "at").where("fp != a").select("a", F.col("fp").alias("b"))
    else:  # an odd distance: one side within near of the meeting place, the other within far
        least = met.where("close").groupBy("at").agg(F.min("fp").alias("a"))
        star = met.join(least, "at").where("fp != a").select("a", F.col("fp").alias("b"))
    return pairs.unionAll(star).distinct()


def near_groups(rows: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """rid, rank, text -> rid, rank, fp, first (the least rank of the row's component)."""
    own = stored(fingerprints(rows, shingle))
    distinct = checkpointed(own.groupBy("fp").agg(F.min("rank").alias("first")))
    comp = checkpointed(connected_components(fingerprint_links(distinct.select("fp"), max_bits)))
    rooted = distinct.join(comp, distinct["fp"] == comp["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    labels = rooted.drop("first").join(least, "root").select("fp", "first")
    return own.join(labels, "fp")


def _rows(docs: DataFrame, rid: str, id_col: str, text_col: str) -> DataFrame:
    return docs.select(quoted(rid).alias("rid"), first_rank(id_col, rid).alias("rank"), quoted(text_col).alias("text"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row per document: its id, fingerprint (16 hex digits), component_id, kept."""
    (rid,) = fresh(docs, "_rid")
    # row numbers are used within this one pass only: the fingerprints are stored with them
    near = near_groups(_rows(docs.withColumn(rid, F.monotonically_increasing_id()), rid, id_col, text_col), **kw)
    return near.select(F.col("rank.id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                       F.col("first.id").alias("component_id"), (F.col("first.rid") == F.col("rid")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One document of each component (the smallest id), with the columns of ``docs``."""
    (rid,) = fresh(docs, "_rid")
    base = with_row_ids(docs, rid)
    gone = (near_groups(_rows(base, rid, id_col, text_col), **kw).where("first.rid != rid")
            .select(F.col("rid").alias(rid)))
    return base.join(gone, rid, "left_anti").select(*[quoted(c) for c in docs.columns])


def op5(spark, sf_dir):
    from .common import table
    return simhash_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
