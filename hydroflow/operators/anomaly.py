"""Q13: isolation-forest anomaly scores (the data-profile report's anomalous rows).

* sample: every tree has a sample of its own, the 256 rows (all, if the table has fewer) with the smallest hashes of (row key, tree), so
  samples are independent draws without replacement and neither arrival order nor partitioning plays a part. Each Arrow batch
  hashes its rows for all trees in numpy and sends on those below 4 * 256 / n only, about 1,024 rows a tree at any size;
* fit: ``applyInPandas`` per tree grows an isolation tree of its 256 rows to depth ceil(log2 n) and returns its nodes as rows;
* score: the node table (trees x <= 511 rows, bounded) is broadcast; all trees step down together, one numpy step per
  level: score = 2^(-E[h(x) / c(n)]) with each tree's own n, higher = more anomalous."""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .keyed_trees import uniform

SAMPLE = 256
#: Rows scored at once.
STEP = 2000

NODE_SCHEMA = T.StructType([T.StructField("tree", T.LongType()), T.StructField("node", T.LongType()),
                            T.StructField("feature", T.LongType()), T.StructField("threshold", T.DoubleType()),
                            T.StructField("left", T.LongType()), T.StructField("right", T.LongType()),
                            T.StructField("size", T.LongType())])


def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(tree: int, X: np.ndarray, seed: int) -> list:
    rng = np.random.default_rng(seed + tree)
    limit = math.ceil(math.log2(max(len(X), 2)))
    nodes: list = []

    def build(idx, depth):
        me = len(nodes)
        nodes.append(None)
        sub = X[idx]
        if depth >= limit or len(idx) <= 1:
            nodes[me] = (tree, me, -1, 0.0, -1, -1, len(idx))
            return me
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.where(hi > lo)[0]
        if len(cand) == 0:
            nodes[me] = (tree, me, -1, 0.0, -1, -1, len(idx))
            return me
        f = int(rng.choice(cand))
        t = float(rng.uniform(lo[f], hi[f]))
        left = build(idx[sub[:, f] < t], depth + 1)
        right = build(idx[sub[:, f] >= t], depth + 1)
        nodes[me] = (tree, me, f, t, left, right, len(idx))
        return me

    build(np.arange(len(X)), 0)
    return nodes


def _sampled(feats, trees, below, seed):
    def run(batches):
        for batch in batches:
            h = batch.column("_h").to_numpy()
            for t in range(trees):
                u = uniform(h, t, seed)
                at = np.flatnonzero(u < below)
                if len(at):
                    part = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t)), pa.array(u[at]), *[part.column(c) for c in feats]], names=["tree", "_u", *feats])

    return run


def fit_isolation_forest(df: DataFrame, features: Sequence[str], key: str, trees: int = 100, seed: int = 42) -> DataFrame:
    """Nodes of ``trees`` isolation trees; ``key`` identifies a row. An empty table has no trees."""
    feats = list(features)
    n = df.count()
    vals = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in feats]
    rows = df.select(F.xxhash64(key).alias("_h"), *vals)
    ship_package(df.sparkSession)
    drawn = rows.mapInArrow(_sampled(feats, trees, 4.0 * SAMPLE / max(n, 1), seed), ", ".join(["tree long", "_u double", *[f"`{c}` double" for c in feats]]))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        X = pdf.sort_values(["_u", *feats], kind="stable")[feats].to_numpy(dtype=float)[:SAMPLE]
        return pd.DataFrame(_grow(t, X, seed), columns=[f.name for f in NODE_SCHEMA.fields])

    return drawn.groupBy("tree").applyInPandas(fit, NODE_SCHEMA)


class _Forest:
    """All trees as (trees, nodes) arrays; a leaf's children are itself, and its ``adj`` is the path length its rows would still have."""

    def __init__(self, nodes: pd.DataFrame):
        groups = [g.sort_values("node") for _, g in nodes.groupby("tree")]
        wide = max((len(g) for g in groups), default=1)
        shape = (len(groups), wide)
        self.feature, self.cut, self.adj = np.zeros(shape, int), np.zeros(shape), np.zeros(shape)
        self.inner = np.zeros(shape, bool)
        self.left = self.right = None
        left, right = (np.tile(np.arange(wide), (len(groups), 1)) for _ in range(2))
        self.norm = np.ones(len(groups))
        for i, g in enumerate(groups):
            m = len(g)
            inner = g["feature"].to_numpy() >= 0
            self.inner[i, :m] = inner
            self.feature[i, :m] = np.maximum(g["feature"], 0)
            self.cut[i, :m] = g["threshold"]
            left[i, :m] = np.where(inner, g["left"], left[i, :m])
            right[i, :m] = np.where(inner, g["right"], right[i, :m])
            self.adj[i, :m] = [_c(v) for v in g["size"]]
            self.norm[i] = max(_c(float(g["size"].iloc[0])), 1e-9)
        self.left, self.right = left, right
        self.levels = int(np.ceil(np.log2(SAMPLE)))

    def score(self, x: np.ndarray) -> np.ndarray:
        trees, rows = np.arange(len(self.norm)), np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(trees)), int)
        depth = np.zeros((len(x), len(trees)))
        for _ in range(self.levels):
            depth += self.inner[trees, node]
            low = x[rows, self.feature[trees, node]] < self.cut[trees, node]
            node = np.where(low, self.left[trees, node], self.right[trees, node])
        path = (depth + self.adj[trees, node]) / self.norm
        return np.power(2.0, -path.mean(1)) if len(trees) else np.ones(len(x))


def score(df: DataFrame, forest: DataFrame, features: Sequence[str], out: str = "anomaly_score") -> DataFrame:
    """``df`` with its anomaly scores, spread over all cores of the cluster."""
    feats = list(features)
    bc = df.sparkSession.sparkContext.broadcast(_Forest(forest.toPandas()))  # bounded: trees x <= 511 rows
    cores = df.sparkSession.sparkContext.defaultParallelism
    spread = df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)

    def run(batches):
        trees = bc.value
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                x = np.column_stack([np.nan_to_num(part.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)) for c in feats])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(trees.score(x))], names=[*part.schema.names, out])

    schema = T.StructType(df.schema.fields + [T.StructField(out, T.DoubleType())])
    ship_package(df.sparkSession)
    return spread.mapInArrow(run, schema)
