"""Conversation prefix trie from padded matrices of turn ids.

A node is a distinct sequence of first turns; its members are the conversations that start with it. A turn is a
16-byte digest of (role, text). Conversations are cut into bands of ``WIDTH`` turns, keyed by the digest of all that precedes
the band (the key of the node at its top), so a long conversation is many rows. Band rows are range-sorted by (band, key, path,
conversation) and cut into shards of at most 2**``SHARD_BITS`` rows. In a shard numpy sorts the padded id matrix (lexsort) and
marks column changes between neighbouring rows; OR-accumulated from left to right, the marks are the starts of nodes at
every depth. Each shard is given its neighbours' border rows, so marks are exact across shards, and all that a node
reports is a sum over its rows, taken by ``reduceat`` at every depth:

* members: 1; children: starts one column to the right;
* leaves: rows that are the last of a path which no row extends;
* saved tokens: (members - 1) * bytes summed over a subtree is the bytes of every row's turns at that depth or
  below, without those that start their node: a sum along each row.

What a row has in later bands (its leaf and its saved tokens there) comes by a running sum per conversation. Nodes that lie
on several shards, or whose children are in the next band, are recombined by key; all others are complete in their shard.

Defined results: a null role or text is empty; rows with a null conversation id belong to no conversation; turns of one
number go by role, then by a digest of role and text; a conversation without turns is a member of the root alone. An empty table
has no nodes. Extra columns are ignored. Digests of 128 bits (of SHA-256) stand for texts."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydroflow.operators.blocked import attach, dense_position
from hydroflow.session import ship_package

from .common import CRC32_SQL, map_arrow, own_shuffle, quoted, stored, table, with_row_ids

WIDTH = 64
SHARD_BITS = 14
_PATHS = "conv long, band long, prefix binary, path binary, sizes array<long>, more boolean"
_ORDER = ["band", "prefix", "path", "more", "conv"]
_ARROW = {"conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(),
          "saved_tokens": pa.int64(), "ends_sha256": pa.string(), "ends": pa.list_(pa.int64()), "key": pa.binary(), "parent_key": pa.binary(), "shard": pa.int64()}
_SCHEMA = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
           "ends array<long>, key binary, parent_key binary, shard long")


def turns(df: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, digest, size): the turns of each conversation in order, positions counted from 0. A long conversation's rows
    are sorted and numbered on many tasks."""
    role, text = (F.coalesce(quoted(c).cast("string"), F.lit("")) for c in (role, text))
    same = F.concat_ws(":", F.octet_length(role), role, text)
    rows = df.where(quoted(conv).isNotNull()).select(
        quoted(conv).cast("long").alias("conv"), quoted(turn).alias("turn"), role.alias("role"), F.unhex(F.left(F.sha2(same, 256), F.lit(32))).alias("digest"),
        F.octet_length(text).cast("long").alias("size"), F.unhex(F.sha2(same, 256)).alias("tie"))
    keys = ["conv", "turn", "role", "tie", "rid"]
    lined = with_row_ids(rows, "rid").repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "digest", "size", F.monotonically_increasing_id().alias("at"))
    return dense_position(stored(lined), ["conv"], "at", F.shiftright("at", 16)).select("conv", "pos", "digest", "size")


def rebuilt(own: DataFrame, heads: DataFrame) -> DataFrame:
    """``own`` turns after the first ``cut`` of each conversation, behind the first ``cut`` turns of conversation ``base``:
    heads is (conv, base, cut) with small cuts, one row per conversation."""
    most = heads.agg(F.max("cut")).first()[0] or 0
    first = stored(own.where(F.col("pos") < most))
    known = first.groupBy(F.col("conv").alias("base")).agg(F.count(F.lit(1)).alias("known"))
    cuts = stored(heads.join(known, "base", "left").withColumn("kept", F.least("cut", F.coalesce("known", F.lit(0)))))
    begin = (cuts.where("kept > 0").select(F.col("conv").alias("c"), "base", "cut").join(first.withColumnRenamed("conv", "base"), "base")
             .where("pos < cut").select(F.col("c").alias("conv"), "pos", "digest", "size"))
    rest = (own.join(cuts.select(F.col("conv").alias("c"), "cut", "kept").withColumn("c", own_shuffle("c")), F.col("conv") == F.col("c"))
            .where("pos >= cut").select("conv", (F.col("pos") - F.col("cut") + F.col("kept")).alias("pos"), "digest", "size"))
    return begin.unionByName(rest)


def _chain(batches):
    """Key of the node above each band; a conversation's bands come in order."""
    now, key = None, b""
    for batch in batches:
        keys = []
        for c, band, path in zip(*(batch.column(k).to_pylist() for k in ("conv", "band", "path")), strict=True):
            if c != now or band == 0:
                now, key = c, b""
            keys.append(key)
            key = hashlib.md5(key + path, usedforsecurity=False).digest()
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keys, pa.binary()), *batch.columns[2:]], names=["conv", "band", "prefix", "path", "sizes", "more"])


def _bands(seq: DataFrame, convs: DataFrame, width: int) -> DataFrame:
    """One row per conversation and band, sorted into shards (column ``shard``)."""
    full = seq.groupBy("conv", F.floor(F.col("pos") / width).cast("long").alias("band")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "size"))).alias("t"))
    rows = full.select("conv", "band", F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["digest"])), "")).alias("path"), F.transform("t", lambda x: x["size"]).alias("sizes"))
    bare = convs.select("conv").join(full.where("band = 0").select("conv"), "conv", "left_anti")
    rows = rows.unionByName(bare.select("conv", F.lit(0).cast("long").alias("band"), F.lit("").cast("binary").alias("path"), F.array().cast("array<long>").alias("sizes")))
    rows = stored(rows.withColumn("more", F.max("band").over(Window.partitionBy("conv")) > F.col("band")))
    deep = F.col("more") | (F.col("band") > 0)
    chained = map_arrow(rows.where(deep).repartition("conv").sortWithinPartitions("conv", "band"), _chain, _PATHS)
    flat = rows.where(~deep).select("conv", "band", F.lit("").cast("binary").alias("prefix"), "path", "sizes", "more")
    return stored(flat.unionByName(chained))


def _shards(rows: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Band rows with their shard, and the border rows of each shard's neighbours."""
    lined = stored(rows.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).withColumn("at", F.monotonically_increasing_id())
                   .withColumn("shard", F.shiftright("at", bits)))
    row = F.struct("band", "prefix", "path")
    edges = lined.groupBy("shard").agg(F.min_by(row, "at").alias("first"), F.max_by(row, "at").alias("last")).withColumn("part", F.shiftright("shard", 33 - bits))
    parts = edges.groupBy("part").agg(F.min_by("first", "shard").alias("first"), F.max_by("last", "shard").alias("last"))
    ends = Window.orderBy("part")  # one row per partition of the sort
    parts = parts.select("part", F.lag("last").over(ends).alias("before"), F.lead("first").over(ends).alias("after"))
    here = Window.partitionBy("part").orderBy("shard")
    near = edges.withColumns({"lo": F.lag("last").over(here), "hi": F.lead("first").over(here)}).join(parts, "part")
    return lined.drop("at"), stored(near.select("shard", F.coalesce("lo", "before").alias("lo"), F.coalesce("hi", "after").alias("hi")))


class _Shard:
    """The padded matrix of a shard between its neighbours' border rows, and the marks in it."""

    def __init__(self, rows: pa.Table, near: pa.Table):
        lo, hi = (near.column(k)[0].as_py() for k in ("lo", "hi"))
        edge = [e for e in (lo, hi) if e]
        paths = rows.column("path").to_pylist() + [e["path"] for e in edge]
        prefixes = rows.column("prefix").to_pylist() + [e["prefix"] for e in edge]
        bands = np.array(rows.column("band").to_pylist() + [e["band"] for e in edge], np.int64)
        length = np.array([len(p) // 16 for p in paths], np.int64)
        n, m = rows.num_rows, len(paths)
        self.width = w = int(length.max(initial=0))
        inside = np.arange(w)[None, :] < length[:, None]
        _, ids = np.unique(np.frombuffer(b"".join(paths), ">u8").astype(np.uint64).reshape(-1, 2), axis=0, return_inverse=True)
        matrix = np.zeros((m, w), np.int64)
        matrix[inside] = ids.ravel() + 1
        order = {p: i for i, p in enumerate(sorted(set(prefixes)))}
        prefix = np.array([order[p] for p in prefixes], np.int64)
        conv = np.array(rows.column("conv").to_pylist(), np.int64)
        more = np.array(rows.column("more").to_pylist(), bool)
        sort = np.lexsort((conv, more, *matrix[:n, ::-1].T, prefix[:n], bands[:n]))
        line = np.concatenate((([n] if lo else []), sort, ([m - 1] if hi else []))).astype(np.int64)
        a = int(bool(lo))
        at = slice(a, a + n)
        # changed[i, j]: row i leaves the depth-j node of the row before it
        changed = np.ones((len(line), w + 1), bool)
        changed[1:, 0] = (bands[line][1:] != bands[line][:-1]) | (prefix[line][1:] != prefix[line][:-1])
        changed[1:, 1:] = matrix[line][1:] != matrix[line][:-1]
        np.logical_or.accumulate(changed, axis=1, out=changed)
        self.n, self.conv, self.more, self.length, self.band = n, conv[sort], more[sort], length[sort], bands[sort]
        self.paths, self.prefixes, self.sort = [paths[i] for i in sort], [prefixes[i] for i in sort], sort
        self.start = changed[at]
        after = np.ones((n, w + 1), bool)  # changed, of the row after
        after[:len(changed) - a - 1] = changed[a + 1:a + 1 + n]
        self.after = after
        self.last = after[np.arange(n), self.length] & ~self.more  # the last row of a leaf
        sizes = np.zeros((n, w), np.int64)
        sizes[inside[sort]] = np.concatenate([np.array(s, np.int64) for s in (rows.column("sizes")[int(i)].as_py() for i in sort)]) if n else 0
        self.saved = np.where(self.start[:, 1:], 0, sizes)

    def key(self, i: int, j: int) -> bytes:
        return hashlib.md5(self.prefixes[i] + self.paths[i][:16 * j], usedforsecurity=False).digest() if j else self.prefixes[i]


def _later(_, rows: pa.Table, near: pa.Table) -> pa.Table:
    """What each row below the first band adds to the bands above it."""
    s = _Shard(rows, near)
    deep = s.band > 0
    return pa.table({"conv": s.conv[deep], "band": s.band[deep], "leaf": s.last[deep].astype(np.int64), "saved": s.saved.sum(1)[deep]})


def _nodes(width: int):
    def run(key, rows: pa.Table, near: pa.Table) -> pa.Table:
        s = _Shard(rows, near)
        carry_leaf, carry_saved = (np.array(rows.column(k).to_pylist(), np.int64)[s.sort] for k in ("leaf", "later"))
        below = np.concatenate((np.cumsum(s.saved[:, ::-1], 1)[:, ::-1], np.zeros((s.n, 1), np.int64)), 1) + carry_saved[:, None]
        leaves = s.last + carry_leaf
        out = {k: [] for k in _ARROW}
        above = None
        for j in range(int(s.length.max()) + 1):
            idx = np.flatnonzero(s.length >= j)
            begin = s.start[idx, j].copy()
            begin[0] = True
            at = np.flatnonzero(begin)
            top, stop = idx[at], np.append(at[1:], len(idx))
            tail = idx[stop - 1]
            band = s.band[top]
            add = lambda v: np.add.reduceat(v, at)
            is_row = ~((band > 0) & (j == 0))  # the top of a later band reports its children only
            ends = (s.length[idx] == j) & ~s.more[idx]
            counts = [stop - at, add(s.start[idx, j + 1] & (s.length[idx] > j)) if j < s.width else np.zeros(len(at), int), add(leaves[idx]), add(below[idx, max(j - 1, 0)])]
            whole = s.start[top, j] & s.after[tail, j] & is_row & (add(s.more[idx]) == 0 if j == width else True)
            low = np.minimum.reduceat(s.conv[idx], at)
            n_ends = add(ends)
            if above is not None:
                up = np.searchsorted(above[0], top, "right") - 1
            for k in range(len(at)):
                i = int(top[k])
                done, row = bool(whole[k]), bool(is_row[k])
                mine = s.conv[idx[at[k]:stop[k]][ends[at[k]:stop[k]]]] if n_ends[k] and row else np.zeros(0, np.int64)
                inner = above is not None and bool(above[2][up[k]])
                out["conv_id"].append(int(low[k]))
                out["depth"].append(int(band[k]) * width + j)
                out["parent_conv_id"].append(int(above[1][up[k]]) if inner else None)
                for name, v in zip(("n_convs", "n_children", "n_leaves", "saved_tokens"), counts, strict=True):
                    out[name].append(int(v[k]) if row or name == "n_children" else 0)
                out["ends_sha256"].append(hashlib.sha256(",".join(map(str, mine.tolist())).encode()).hexdigest() if done else None)
                out["ends"].append(None if done else mine.tolist())
                out["key"].append(None if done else s.key(i, j))
                out["parent_key"].append(None if above is None or inner else s.key(i, j - 1))
                out["shard"].append(key[0].as_py())
            above = (top, low, whole)
        return pa.table({k: pa.array(v, _ARROW[k]) for k, v in out.items()})

    return run


def _ends(batches):
    """SHA-256 of each node's member ids; a node's parts come in order."""
    now, sha, some = None, None, False
    row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["key", "ends_sha256"])
    for batch in batches:
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if sha is None or k != now:
                if sha is not None:
                    yield row()
                now, sha, some = k, hashlib.sha256(), False
            if ids:
                sha.update(("," * some + ",".join(map(str, ids))).encode())
                some = True
    if sha is not None:
        yield row()


def trie(seq: DataFrame, convs: DataFrame, *, width: int = WIDTH, bits: int = SHARD_BITS) -> DataFrame:
    """One row per node of the trie of ``seq`` (conv, pos, digest, size); ``convs`` (conv) lists every conversation once."""
    ship_package(seq.sparkSession)
    rows, near = _shards(_bands(seq, convs, width), bits)
    deep = rows.where("band > 0").select("shard").distinct()
    later = (rows.join(deep, "shard").groupBy("shard").cogroup(near.join(deep, "shard").groupBy("shard"))
             .applyInArrow(_later, "conv long, band long, leaf long, saved long"))
    down = Window.partitionBy("conv").orderBy(F.desc("band"))
    carry = later.select("conv", (F.col("band") - 1).alias("band"), F.sum("leaf").over(down).alias("leaf"), F.sum("saved").over(down).alias("later"))
    first = rows.where("more").join(carry, ["conv", "band"]).select(*rows.columns, "leaf", "later")
    zero = F.lit(0).cast("long")
    weighed = first.unionByName(rows.where("not more").withColumns({"leaf": zero, "later": zero}))
    found = stored(weighed.groupBy("shard").cogroup(near.groupBy("shard")).applyInArrow(_nodes(width), _SCHEMA))
    split = found.where("key is not null")
    lists = split.where("n_convs > 0").select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard")
    sums = split.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.min("parent_conv_id").alias("parent_conv_id"),
                                    *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("parent_key").alias("parent_key"))
    joint = stored(sums.join(map_arrow(lists, _ends, "key binary, ends_sha256 string"), "key"))
    nodes = found.where("key is null").drop("ends", "shard", "key").unionByName(joint.drop("key"))
    orphans = attach(nodes.where("parent_key is not null").drop("parent_conv_id"), joint.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")), ["parent_key"])
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return nodes.where("parent_key is null").select(*out).unionByName(orphans.select(*out))


def op13(spark, sf_dir):
    """Trie of the conversations, each rebuilt behind the first turns of the conversation whose id is the multiple of five before it."""
    df = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    own = stored(turns(df))
    convs = own.select("conv").distinct()
    cut = F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    heads = stored(convs.withColumns({"base": F.col("conv") - F.col("conv") % 5, "cut": cut}))
    return trie(rebuilt(own, heads), heads.select("conv"))


SQL = f"""
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT c, count(*) AS n FROM own GROUP BY c),
ids AS (SELECT s.c, s.c - s.c % 5 AS base, {CRC32_SQL.format("s.c::VARCHAR")} % 9 AS h FROM sizes s),
cuts AS (SELECT ids.*, least(h, coalesce(sizes.n, 0)) AS kept FROM ids LEFT JOIN sizes ON sizes.c = ids.base),
seq AS (
  SELECT k.c, o.pos, o.r, o.x FROM cuts k JOIN own o ON o.c = k.base WHERE o.pos < k.h
  UNION ALL SELECT k.c, o.pos - k.h + k.kept, o.r, o.x FROM cuts k JOIN own o ON o.c = k.c WHERE o.pos >= k.h),
paths AS (
  SELECT ids.c, coalesce(list({{'r': seq.r, 'x': seq.x}} ORDER BY seq.pos) FILTER (WHERE seq.r IS NOT NULL), []) AS path
  FROM ids LEFT JOIN seq ON seq.c = ids.c GROUP BY ids.c),
steps AS (SELECT c, path, len(path) AS size, unnest(range(0, len(path) + 1)) AS depth FROM paths),
members AS (
  SELECT c, depth, size, coalesce(strlen(path[depth].x), 0) AS bytes, min(c) OVER (PARTITION BY depth, path[1:depth]) AS node FROM steps),
nodes AS (
  SELECT node, depth, count(*) AS n_convs, any_value(bytes) AS bytes, (max(size) = depth)::INT AS leaf,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE size = depth), '')) AS ends_sha256
  FROM members GROUP BY node, depth),
ups AS (SELECT n.node, n.depth, m.node AS parent FROM nodes n JOIN members m ON m.c = n.node AND m.depth = n.depth - 1),
kids AS (SELECT parent, depth - 1 AS depth, count(*) AS n FROM ups GROUP BY ALL),
sums AS (
  SELECT m.node, m.depth, sum(n.leaf) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved
  FROM nodes n JOIN members m ON m.c = n.node AND m.depth <= n.depth GROUP BY m.node, m.depth)
SELECT n.node AS conv_id, n.depth, u.parent AS parent_conv_id, n.n_convs, coalesce(k.n, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node AND s.depth = n.depth
LEFT JOIN ups u ON u.node = n.node AND u.depth = n.depth
LEFT JOIN kids k ON k.parent = n.node AND k.depth = n.depth
"""
