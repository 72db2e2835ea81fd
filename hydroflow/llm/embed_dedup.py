"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are normalised, so a cosine of c is a distance of sqrt(2 - 2c). Table t buckets a vector by ``hashes``
quantised Gaussian projections floor((a . x + b) / width), under its label. At the defaults two vectors at
exactly cosine 0.93 share a bucket in at least one of 24 tables with probability 0.98 (``recall_at``); closer ones nearly
always do. All that share a bucket are checked by their cosine in double precision.

Equal vectors of a label are one representative with a count. A bucket's members are cut into blocks of up to
``block``; a task holds two blocks at a time, so a hot bucket is spread over many tasks. Of each pair of blocks come
out, per vector, the number of its links (each from the first table that finds it) and the smallest vector that those links
reach within the pair: at most one row per row read, however many links a bucket holds. Degrees and components come from those.

Defined results: a null, empty, zero or non-finite vector, and a vector with a null label, links with nothing;
rows that repeat an id are vectors of their own; a null vec_id links like any other, component_id is
the smallest id of the component (nulls last, null if it has none), and such a row is kept if no id is in its component; an empty table gives an empty table.
Only the id and the four results are returned: other columns, clashing names among them, are not read."""
from __future__ import annotations

from math import erf, exp, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, quoted, stored
from .components import connected_components

COSINE = 0.93
HASHES = 12
TABLES = 24
WIDTH = 2.0
BLOCK = 256
SEED = 7


def recall_at(cosine: float, hashes: int = HASHES, tables: int = TABLES, width: float = WIDTH) -> float:
    """Chance that two vectors at this cosine meet in at least one table."""
    r = sqrt(max(2 - 2 * cosine, 1e-12))
    t = width / r
    p = erf(t / sqrt(2)) - 2 / (sqrt(2 * pi) * t) * (1 - exp(-t * t / 2))
    return 1 - (1 - p ** hashes) ** tables


def _hash_keys(x: np.ndarray, hashes: int, tables: int, width: float) -> np.ndarray:
    """n x tables bucket keys of the normalised rows of ``x``."""
    rng = np.random.default_rng(SEED)
    a = rng.standard_normal((x.shape[1], tables * hashes))
    b = rng.uniform(0, width, tables * hashes)
    q = np.floor((x @ a + b) / width).astype(np.int64).reshape(len(x), tables, hashes)
    mix = np.random.default_rng(SEED + 1).integers(1, 2**62, hashes, dtype=np.int64) | 1
    with np.errstate(over="ignore"):
        return (q * mix).sum(-1)


def _matrix(column) -> np.ndarray:
    """A list column of equal lengths as a matrix in double precision."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)  # first by the largest, so that squares neither overflow nor vanish
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def representatives(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """node, label, vec, n, first: one row per distinct usable vector of a label."""
    v = quoted(vec_col)
    usable = (quoted(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)
              & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
              & F.exists(v, lambda x: x != 0))
    groups = (vectors.where(usable).select(quoted(label_col).alias("label"), v.cast("array<double>").alias("vec"), quoted(id_col).alias("id"))
              .groupBy("label", "vec").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")))
    return stored(groups.withColumn("node", F.monotonically_increasing_id()))


def vector_links(reps: DataFrame, cosine: float = COSINE, hashes: int = HASHES, tables: int = TABLES,
                 width: float = WIDTH, block: int = BLOCK) -> DataFrame:
    """``reps`` -> node, root, links: for every two nodes of a label (and length) that meet in a table and reach the cosine,
    counted once. A node has one row per pair of blocks that links it: ``links`` vectors (copies counted) are linked to it
    there, and ``root`` is the smallest node they connect it with."""
    def keys(batches):
        for batch in batches:
            dims = np.diff(batch.column("vec").offsets.to_numpy())
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                k = _hash_keys(_unit(_matrix(part.column("vec"))), hashes, tables, width)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.column("node").to_numpy(), tables)), part.column("label").take(pa.array(np.repeat(np.arange(n), tables))),
                     pa.array(np.full(n * tables, d, dtype=np.int32)), pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(k.ravel())],
                    ["node", "label", "dim", "tab", "key"])

    label = reps.schema["label"].dataType.simpleString()
    bucket = ["label", "dim", "tab", "key"]
    hashed = stored(map_arrow(reps.select("node", "label", "vec"), keys, f"node long, label {label}, dim int, tab int, key long"))
    sizes = (hashed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
             .withColumn("blocks", F.ceil(F.col("size") / block).cast("int")))
    placed = hashed.join(sizes, bucket).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # block i meets every block j >= i of its bucket: a row goes to the cells (own, j) and (i, own)
    cells = (placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("node", F.xxhash64(*bucket, F.least("own", "other"), F.greatest("own", "other")).alias("cell"),
                     *bucket, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
    carried = cells.join(reps.select("node", "n", "vec"), "node")
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["cell", *bucket, "i", "j", "own", "node"]
    dealt = (carried.repartition(parts, "cell").sortWithinPartitions(*order)
             .select("node", "n", "vec", *bucket, "i", "j", "own"))

    def check(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            t = t.combine_chunks()
            cuts = _runs(t, [*bucket, "i", "j"])
            for lo, hi in zip(cuts[:-2], cuts[1:-1]):
                yield from _cell_links(t.slice(lo, hi - lo), cosine, hashes, tables, width)
            rest = t.slice(cuts[-2]) if len(cuts) > 1 else None
        if rest is not None and rest.num_rows:
            yield from _cell_links(rest, cosine, hashes, tables, width)

    return map_arrow(dealt, check, "node long, root long, links long")


def _runs(t: pa.Table, names: list[str]) -> np.ndarray:
    """Start rows of the runs of equal values, and the end."""
    n = t.num_rows
    if not n:
        return np.array([0])
    change = np.zeros(n, dtype=bool)
    change[0] = True
    for c in names:
        v = t.column(c).combine_chunks().dictionary_encode() if not pa.types.is_integer(t.schema.field(c).type) else t.column(c).combine_chunks()
        v = (v.chunk(0) if isinstance(v, pa.ChunkedArray) else v)
        v = v.indices.to_numpy(zero_copy_only=False) if pa.types.is_dictionary(v.type) else v.to_numpy(zero_copy_only=False)
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), n)


def _cell_links(t: pa.Table, cosine: float, hashes: int, tables: int, width: float):
    if t.num_rows < 2:
        return
    col = t.column("vec").combine_chunks()
    x = _unit(_matrix(col.chunk(0) if isinstance(col, pa.ChunkedArray) else col))
    node, own = t.column("node").to_numpy(), t.column("own").to_numpy()
    i, j, tab = (t.column(c)[0].as_py() for c in ("i", "j", "tab"))
    if i == j:
        left = right = np.arange(len(node))
    else:
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    r, c = np.nonzero(x[left] @ x[right].T >= cosine - 1e-9)
    r, c = left[r], right[c]
    if i == j:
        r, c = r[r < c], c[r < c]
    if not len(r):
        return
    sure = np.array([x[p] @ x[q] for p, q in zip(r, c)]) >= cosine if len(r) < 64 else np.einsum("ij,ij->i", x[r], x[c]) >= cosine
    r, c = r[sure], c[sure]
    used, where = np.unique(np.concatenate([r, c]), return_inverse=True)
    k = _hash_keys(x[used], hashes, tables, width)[:, :tab]
    new = ~(k[where[:len(r)]] == k[where[len(r):]]).any(1)  # not found by an earlier table
    if new.any():
        yield _linked_nodes(node, t.column("n").to_numpy(), r[new], c[new])


def _linked_nodes(node: np.ndarray, copies: np.ndarray, r: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    """node, root, links of the rows that the links (r, c) touch."""
    at, where = np.unique(np.concatenate([r, c]), return_inverse=True)
    left, right = where[:len(r)], where[len(r):]
    links = (np.bincount(left, weights=copies[c], minlength=len(at)) + np.bincount(right, weights=copies[r], minlength=len(at))).astype(np.int64)
    ids = node[at]
    root = ids.copy()
    while True:  # the smallest node spreads along links, and from each root to those that point to it
        before = root.copy()
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        order = np.argsort(ids)
        root = np.minimum(root, root[order[np.searchsorted(ids, root, sorter=order)]])
        if (root == before).all():
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(root), pa.array(links)], ["node", "root", "links"])


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    **kw) -> DataFrame:
    """One row per vector: its id, n_links, component_id, kept."""
    reps = representatives(vectors, id_col, vec_col, label_col)
    linked = stored(vector_links(reps, **kw))
    degree = linked.groupBy("node").agg(F.sum("links").alias("links"))
    comp = connected_components(linked, "node", "root")
    rooted = (reps.select("node", "label", "vec", "n", "first").join(degree, "node", "left").join(comp, "node", "left")
              .withColumn("root", F.coalesce("root", "node")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    found = rooted.join(least, "root").select(
        F.col("label").alias("l"), "vec", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    own = vectors.select(quoted(id_col).alias("id"), quoted(label_col).alias("label"), quoted(vec_col).cast("array<double>").alias("v"))
    out = own.join(found, (own["label"] == found["l"]) & (own["v"] == found["vec"]), "left")
    single = F.col("vec").isNull()
    comp_id = F.when(single, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.when(single, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
                      comp_id.cast("long").alias("component_id"), F.col("id").eqNullSafe(comp_id).alias("kept"))


def op6(spark, sf_dir):
    from .common import table
    return embedding_dedup(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
