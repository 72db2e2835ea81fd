"""Tree ensembles of many series and many configurations in one set of Spark jobs.

The reference fits every learner per site and scenario, file by file. Here the series key is a column: all series and all
configurations ("models") grow level by level together, so the number of jobs depends on rounds and depth alone and no
loop runs over keys.

* Rows are packed into blocks of one series (at most 2**``BLOCK_BITS`` rows: values, label, row hash, and bin codes where a learner
  uses them) by one range shuffle, so a long series spreads over as many tasks as it has blocks. No later step moves the rows again.
* One level: each block meets the nodes of its series (broadcast while their bound allows, else joined on salted keys), sends its rows
  down, and emits one table of partial sums per (model, tree, node). The partial tables of a node meet in a sorted stream that adds
  them up and picks the split. A chain of levels is one job; the finished trees are stored.
* ``extra``: fully random thresholds. A first pass takes each node's minimum and maximum per feature, a threshold is drawn
  uniformly between them from a hash of (series, model, tree, node, feature), a second pass takes the sums left of it.
* ``forest``, ``boost``: histograms over at most ``BINS`` quantile bins per series and feature; gain
  GL^2/(HL + l2) + GR^2/(HR + l2) - G^2/(H + l2) - gamma with both children's hessians at least ``min_child``, Newton leaves G/(H + l2).
  A forest's rows weigh Poisson(1) draws (the bootstrap) and its leaves are means; boosting sums gradients y - F of the squared loss.
* ``symmetric``: one (feature, bin) for all nodes of a level, that of the largest summed gain. Its training rows are updated in
  ordered fashion: a hash deals rows to ``FOLDS`` places of a permutation, and a row's leaf value counts only the rows at earlier places, so that no
  row's gradient has seen its own label; the model keeps the leaf values of all rows.

NULL or NaN features count as 0, rows with a NULL label are not learned from. Ties of gain go to the first feature and bin."""
from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .blocked import BROADCAST_MAX_BYTES, SALTS, materialize

BLOCK_BITS = 15
BINS = 32
FOLDS = 16
#: Rounds between two updates of the stored margins of boosting.
REFRESH = 10
#: Nodes of one series that grow in one chain at most (independent trees beyond that grow in further chains).
NODES = 1 << 17
#: Numbers of partial sums that a task holds before it sends them.
COMBINE = 1 << 20
_PART = "_key string, m int, t int, node int, kind int, blob array<double>"
#: Kinds of rows: a node, the drawn cuts of a node, partial sums, leaf values by place of the permutation.
_NODE, _DRAW, _SUMS, _PREFIX = range(4)


@dataclass(frozen=True)
class Learner:
    """One configuration. ``features``: indices of the packed features (all if empty). ``fold``: rows of that fold of ``folds`` are left
    out of training."""

    name: str
    kind: str = "boost"
    trees: int = 50
    depth: int = 6
    rate: float = 0.3
    l2: float = 1.0
    gamma: float = 0.0
    min_child: float = 1.0
    seed: int = 42
    features: tuple[int, ...] = ()
    fold: int = -1
    folds: int = 5

    @property
    def rounds(self) -> int:
        """Trees that must grow one after another."""
        return self.trees if self.kind in ("boost", "symmetric") else 1

    def columns(self, n_features: int) -> np.ndarray:
        """Its features among all that are packed."""
        return np.array(self.features if self.features else range(n_features), np.int64)

    @property
    def binned(self) -> bool:
        """Whether it reads bin codes."""
        return self.kind not in ("extra", "linear")

    def steps(self) -> list[tuple[str, int]]:
        """Passes over the rows for one round."""
        if self.kind == "linear":
            return [("linear", 0)]
        levels = range(self.depth)
        if self.kind == "extra":
            return [(s, d) for d in levels for s in ("draw", "sums")]
        return [("sums", d) for d in levels] + ([("prefix", self.depth)] if self.kind == "symmetric" else [])


#: The learners of the benchmark and their settings.
LEARNERS = {
    "XGBoost": Learner("XGBoost", "boost", 50, 6, 0.3, 1.0, 0.0, 1.0),
    "GradientBoosting": Learner("GradientBoosting", "boost", 50, 3, 0.1, 0.0, 0.0, 1.0),
    "CatBoost": Learner("CatBoost", "symmetric", 50, 6, 0.2, 3.0, 0.0, 1.0),
    "RandomForest": Learner("RandomForest", "forest", 50, 6, 1.0, 0.0, 0.0, 1.0),
    "ExtraTrees": Learner("ExtraTrees", "extra", 50, 8, 1.0, 0.0, 0.0, 1.0),
    "LinearRegression": Learner("LinearRegression", "linear", 1, 0),
}
SHORT = {"XGB": "XGBoost", "GB": "GradientBoosting", "CB": "CatBoost", "RF": "RandomForest", "ET": "ExtraTrees", "LR": "LinearRegression"}


def learner(name: str, **changes) -> Learner:
    """A benchmark learner by its long or short name, with changed settings."""
    return replace(LEARNERS[SHORT.get(name, name)], name=name, **changes)


# ---------------------------------------------------------------- packing

def _value(c: str):
    v = F.col(f"`{c}`").cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(0.0)).otherwise(v)


def _key_column(keys: Sequence[str]):
    return F.to_json(F.struct(*[F.col(f"`{k}`") for k in keys])) if keys else F.lit("{}")


def _order(df: DataFrame, keys: Sequence[str]) -> tuple[list, bool]:
    """Columns that tell the series apart: the keys as they are (plain) where equal JSON means equal keys and the reverse, so that JSON is
    written once a block and not once a row; else the JSON."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    plain = bool(keys) and all(isinstance(kinds.get(k), (T.StringType, T.IntegralType, T.BooleanType)) for k in keys)
    return [F.col(f"`{k}`") for k in keys] if plain else [_key_column(keys)], plain


def _key_of(names: Sequence[str], keys: Sequence[str], plain: bool):
    """_key from the columns that the rows went by."""
    return F.to_json(F.struct(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)])) if plain else F.col(names[0])


def _changes(column) -> np.ndarray:
    """Rows that differ from the row before (nulls are alike); the first row does not count."""
    a, b = column.slice(0, max(len(column) - 1, 0)), column.slice(1)
    other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
    return np.concatenate(([False], other.to_numpy(zero_copy_only=False)))


def _blocks(n_keys: int, width: int, keep: bool):
    """Sorted rows (key columns, blk, x, y, h, k) to blocks; ``first`` marks a series' first block in the task."""
    def cut(rows, starts, first):
        ends = np.append(starts, rows.num_rows).astype(np.int32)
        x, y, h = rows.column("x").flatten().to_numpy(), *(rows.column(c).to_numpy(zero_copy_only=False) for c in "yh")
        data = [_bytes([v[a * k:b * k] for a, b in zip(ends[:-1], ends[1:])]) for v, k in ((x, width), (y, 1), (h, 1))]
        kept = [pa.ListArray.from_arrays(pa.array(ends), rows.column("k"))] if keep else []
        at = pa.array(starts)
        return pa.RecordBatch.from_arrays([*[rows.column(i).take(at) for i in range(n_keys + 1)], pa.array(first), *data, *kept],
                                          names=[*rows.schema.names[:n_keys + 1], "first", "x", "y", "h", *(["keep"] if keep else [])])

    def run(batches):
        held, lead = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            series = np.logical_or.reduce([_changes(rows.column(i)) for i in range(n_keys)])
            starts = np.concatenate(([0], np.flatnonzero(series | _changes(rows.column(n_keys)))))
            first = np.concatenate(([lead], series[starts[1:]]))
            if len(starts) > 1:
                yield cut(rows.slice(0, starts[-1]), starts[:-1], first[:-1])
            held, lead = rows.slice(starts[-1]), bool(first[-1])
        if held is not None:
            yield cut(held, np.zeros(1, np.int64), np.array([lead]))

    return run


def pack(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str | None, ids: Sequence[str] = (), keep: Sequence[str] = (),
         bits: int = BLOCK_BITS) -> DataFrame:
    """Blocks of rows: _key, blk, first (the series' first block in its partition), the numbers of x (values row by row), y and h (hash of the
    values and ``ids``, which deals rows to folds and bootstraps) as bytes, and keep (array of structs of the columns ``keep``).

    Rows go by one number, half of it the hash of the series and half that of the row: it sorts by digits, and the order does not depend
    on the table's files. Series whose halves agree by chance only get shorter blocks: blocks are cut where the series itself changes."""
    vals = F.array(*[_value(f) for f in features])
    y = F.col(f"`{label}`").cast("double") if label else F.lit(0.0)
    h = F.xxhash64(vals, *[F.col(f"`{k}`") for k in ids])
    order, plain = _order(df, keys)
    names = [f"_k{i}" for i in range(len(order))]
    rows = df.select(*[c.alias(n) for c, n in zip(order, names, strict=True)], vals.alias("x"), y.alias("y"), h.alias("h"),
                     *([F.struct(*[F.col(f"`{k}`") for k in keep]).alias("k")] if keep else []))
    place = F.shiftleft(F.shiftright(F.xxhash64(*names), 32), 32).bitwiseOR(F.shiftrightunsigned("h", 32))
    rows = (rows.withColumn("_place", place).repartitionByRange("_place").sortWithinPartitions("_place")
            .withColumn("blk", F.shiftright(F.monotonically_increasing_id(), bits)))
    kinds = [*[T.StructField(n, rows.schema[n].dataType) for n in names], T.StructField("blk", T.LongType()), T.StructField("first", T.BooleanType()),
             *[T.StructField(c, T.BinaryType()) for c in "xyh"], *([T.StructField("keep", T.ArrayType(rows.schema["k"].dataType))] if keep else [])]
    ship_package(df.sparkSession)
    out = rows.select(*names, "blk", "x", "y", "h", *(["k"] if keep else [])).mapInArrow(_blocks(len(names), len(features), bool(keep)), T.StructType(kinds))
    return out.select(_key_of(names, keys, plain).alias("_key"), *out.columns[len(names):])


def _cuts(features: Sequence[str]):
    """Quantile cuts of all features end to end, BINS - 1 of each, repeated cuts included (one mergeable sketch a feature)."""
    probs = [i / BINS for i in range(1, BINS)]
    return F.flatten(F.array(*[F.percentile_approx(_value(f), probs, 10_000) for f in features]))


def _code(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bin codes: x > edges[b] means code > b."""
    out = np.empty(x.shape, np.uint8)
    for j in range(x.shape[1]):
        out[:, j] = np.searchsorted(edges[j], x[:, j], "left")
    return out


def with_codes(blocks: DataFrame, cuts: DataFrame, n_features: int, margins: int = 0, binned: bool = True, bound: int | None = None) -> DataFrame:
    """Blocks with their bin codes (empty if nobody reads them: not ``binned``) and ``margins`` rows of starting margins (the series' mean label)."""
    if not binned:
        return blocks.withColumns({"code": F.lit(b""), "margin": F.lit(b"")})
    names = blocks.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema.fields)

    def run(batches):
        for batch in batches:
            codes, starts = [], []
            for i in range(batch.num_rows):
                x, e = _numbers(batch, "x", i).reshape(-1, n_features), _floats(batch, "edges", i).reshape(n_features, -1)
                codes.append(_code(x, e))
                starts.append(np.full(margins * len(x), batch.column("base")[i].as_py() or 0.0))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], _bytes(codes), _bytes(starts)], names=[*names, "code", "margin"])

    if bound is None or bound > BROADCAST_MAX_BYTES:
        blocks = materialize(blocks)  # the salted join reads them twice
    return join_by_key(blocks, cuts, bound).mapInArrow(run, f"{kinds}, code binary, margin binary")


def join_by_key(blocks: DataFrame, small: DataFrame, bound: int | None = None) -> DataFrame:
    """Blocks with the one row of their series from ``small``: broadcast if ``bound`` (bytes) allows, else on salted keys."""
    if bound is not None and bound <= BROADCAST_MAX_BYTES:
        return blocks.join(F.broadcast(small), "_key", "left")
    salted = blocks.withColumn("_salt", F.pmod(F.col("blk"), F.lit(SALTS)))
    copies = small.join(salted.select("_key", "_salt").distinct(), "_key")  # at most one per block of the series
    return salted.join(copies, ["_key", "_salt"], "left").drop("_salt")


def _lists(arrays) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0), pa.float64()))


def _floats(batch, column: str, i: int) -> np.ndarray:
    v = batch.column(column)[i].values
    return np.zeros(0) if v is None else v.to_numpy(zero_copy_only=False)


def _bytes(arrays) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def _numbers(batch, column: str, i: int, kind=np.float64) -> np.ndarray:
    """The numbers that ``_bytes`` wrote."""
    return np.frombuffer(batch.column(column)[i].as_py(), kind)


# ---------------------------------------------------------------- inside a block

def uniform(*parts) -> np.ndarray:
    """Numbers in [0, 1) from integers, alike on every machine: multiply and shift, once a part."""
    z = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            z = (np.asarray(p, np.int64).view(np.uint64) ^ z) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            z = z ^ (z >> np.uint64(29))
    return (z >> np.uint64(11)).astype(np.float64) / 2.0**53


#: Poisson(1) distribution function.
_POISSON = np.cumsum(np.exp(-1) / np.cumprod(np.concatenate(([1.0], np.arange(1, 18)))))


def fold_of(h, folds: int) -> np.ndarray:
    """Fold of rows by their hash."""
    return (uniform(h, 5) * folds).astype(np.int64)


def _place(h) -> np.ndarray:
    """Place of a row in the hash permutation of ordered boosting."""
    return (uniform(h, 11) * FOLDS).astype(np.int64)


class _Model:
    """What is known of one series: nodes in heap order by (model, tree) with feature -1 at leaves, drawn cuts, ordered leaf
    values, coefficients."""

    def __init__(self, rows, learners):
        self.trees, self.draws, self.prefix, self.linear, self.rows, self.paths = {}, {}, {}, {}, [], {}
        if rows is None:
            return
        m, t, node, kind = (rows.field(k).to_numpy() for k in ("m", "t", "node", "kind"))
        blobs = rows.field("blob")
        at, flat = blobs.offsets.to_numpy(), blobs.values.to_numpy()
        by: dict = {}
        for i in range(len(m)):
            key, v = (int(m[i]), int(t[i])), flat[at[i]:at[i + 1]]
            self.rows.append((*key, int(node[i]), int(kind[i]), v))
            if kind[i] == _DRAW:
                self.draws[(*key, int(node[i]))] = v
            elif kind[i] == _PREFIX:
                self.prefix.setdefault(key, {})[int(node[i])] = v
            elif learners[key[0]].kind == "linear":
                self.linear[key[0]] = v
            else:
                by.setdefault(key, []).append((int(node[i]), v))
        for key, nodes in by.items():
            size = max(n for n, _ in nodes) * 2 + 3
            f, cut, val = np.full(size, -1), np.zeros(size), np.zeros(size)
            for n, v in nodes:
                f[n], cut[n], val[n] = int(v[0]), v[1], v[2]
            self.trees[key] = (f, cut, val)

    def _path(self, key):
        """Feature and cut of each node, and where its rows go: entry 2 * node to the left, the next to the right, a leaf to itself."""
        if key not in self.paths:
            f, cut, _ = self.trees[key]
            at = np.arange(len(f))
            go = np.where(f < 0, at, 2 * at + 1)
            self.paths[key] = np.maximum(f, 0), cut, np.stack((go, go + (f >= 0)), 1).ravel()
        return self.paths[key]

    def descend(self, key, x, depth):
        """Node of each row ``depth`` levels down, or the leaf it stops at."""
        node = np.zeros(len(x), np.int64)
        if key in self.trees:
            f, cut, go = self._path(key)
            flat, rows = x.ravel(), np.arange(len(x)) * x.shape[1]
            for _ in range(depth):
                node = go.take(2 * node + (flat.take(f.take(node) + rows) > cut.take(node)))
        return node

    def value(self, key, x, depth):
        return self.trees[key][2][self.descend(key, x, depth)]

    def train_value(self, key, x, depth, h):
        """Leaf values for training rows: in ordered boosting, from rows at earlier places alone."""
        node = self.descend(key, x, depth)
        if key not in self.prefix:
            return self.trees[key][2][node]
        table = np.zeros((int(node.max(initial=0)) + 1, FOLDS))
        for n, v in self.prefix[key].items():
            if n < len(table):
                table[n] = v
        return table[node, _place(h)]


def _numbered(node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that occur, in order, and each row's place among them."""
    seen = np.bincount(node) > 0
    return np.flatnonzero(seen), (np.cumsum(seen) - 1).take(node)


def _ranges(flat, rows, columns, at, n) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value of each column in each of ``n`` groups ``at`` of the rows that start at ``rows`` in ``flat``."""
    if n > 1:
        order = np.argsort(at.astype(np.uint16) if n <= 1 << 16 else at, kind="stable")  # short integers sort by digits
        rows, start = rows.take(order), np.searchsorted(at.take(order), np.arange(n))
    else:
        start = np.zeros(1, np.int64)
    values = [flat.take(rows + c) for c in columns]
    return tuple(np.stack([f.reduceat(v, start) for v in values], 1) for f in (np.minimum, np.maximum))


def _left_sums(flat, rows, columns, at, n, cuts, g) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``g`` and numbers of rows at or below each column's cut of the row's group."""
    sums, counts = np.empty((n, len(columns))), np.empty((n, len(columns)))
    for j, c in enumerate(columns):
        cell = 2 * at + (flat.take(rows + c) <= cuts[:, j].take(at))
        sums[:, j] = np.bincount(cell, g, 2 * n)[1::2]
        counts[:, j] = np.bincount(cell, minlength=2 * n)[1::2]
    return sums, counts


def _model_of(batch, i, learners):
    return _Model(batch.column("model")[i].values if "model" in batch.schema.names else None, learners)


def _out(rows):
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, pa.int32()) for c in cols[1:5]], _lists(list(cols[5]))],
                                      names=["_key", "m", "t", "node", "kind", "blob"])


def _partials(learners, members, n_features, step):
    """Partial sums of every block for the ``step``-th pass of a round."""
    def one(batch, i, models):
        key = batch.column("_key")[i].as_py()
        x, y, h = _numbers(batch, "x", i).reshape(-1, n_features), _numbers(batch, "y", i), _numbers(batch, "h", i, np.int64)
        code = _numbers(batch, "code", i, np.uint8).reshape(-1, n_features)
        margins = _numbers(batch, "margin", i).reshape(-1, len(y))
        known = ~np.isnan(y)
        if key not in models:  # one model at a time: a task's blocks come by series
            models.clear()
            models[key] = _model_of(batch, i, learners)
        model = models[key]
        if batch.column("first")[i].as_py():
            yield from ((key, *r) for r in model.rows)
        for m, t in members:
            a = learners[m]
            if step >= len(a.steps()):
                continue
            what, level = a.steps()[step]
            live = known & (fold_of(h, a.folds) != a.fold) if a.fold >= 0 else known.copy()
            if what == "linear":
                cols = np.column_stack((np.ones(len(y)), x[:, a.columns(n_features)], y))[live]
                yield key, m, t, 0, _SUMS, (cols.T @ cols).ravel()
                continue
            node = model.descend((m, t), x if a.kind == "extra" else code, level)
            live &= node >= (0 if what == "prefix" else (1 << level) - 1)
            w = np.ones(len(y))
            if a.kind in ("boost", "symmetric"):
                g = y - margins[m]
                for s in sorted(k[1] for k in model.trees if k[0] == m and k[1] < t):
                    g = g - model.train_value((m, s), code, a.depth, h)
            else:
                if a.kind == "forest":
                    w = np.searchsorted(_POISSON, uniform(h, m, t, a.seed), "right").astype(float)
                    live &= w > 0
                g = y * w
            if not live.any():
                continue
            rows = np.flatnonzero(live)
            nodes, at = _numbered(node.take(rows))
            g, w, n = g.take(rows), w.take(rows), len(nodes)
            if what == "prefix":
                cell = at * FOLDS + _place(h[live])
                table = np.stack([np.bincount(cell, v, n * FOLDS).reshape(n, FOLDS) for v in (g, w)], 2)
                yield from ((key, m, t, int(k), _SUMS, table[j].ravel()) for j, k in enumerate(nodes))
            elif a.kind == "extra":
                flat, rows, own = x.ravel(), rows * n_features, a.columns(n_features)
                if what == "draw":
                    lo, hi = _ranges(flat, rows, own, at, n)
                    yield from ((key, m, t, int(k), _SUMS, np.concatenate((lo[j], hi[j]))) for j, k in enumerate(nodes))
                else:
                    gl, hl = _left_sums(flat, rows, own, at, n, np.stack([model.draws[m, t, int(k)] for k in nodes]), g)
                    whole = np.stack((np.bincount(at, g, n), np.bincount(at, minlength=n)), 1)
                    yield from ((key, m, t, int(k), _SUMS, np.concatenate((gl[j], hl[j], whole[j]))) for j, k in enumerate(nodes))
            else:
                own = a.columns(n_features)
                cell = ((at[:, None] * len(own) + np.arange(len(own))) * BINS + code[live][:, own]).ravel()
                table = np.stack([np.bincount(cell, np.repeat(v, len(own)), n * len(own) * BINS).reshape(n, -1) for v in (g, w)], 1)
                yield from ((key, m, t, int(k), _SUMS, table[j].ravel()) for j, k in enumerate(nodes))

    def run(batches):
        # blocks of one task add up before they are sent, up to COMBINE numbers
        sums, size, models = {}, 0, {}
        for batch in batches:
            for i in range(batch.num_rows):
                rest = []
                for r in one(batch, i, models):
                    if r[4] != _SUMS:
                        rest.append(r)
                    elif r[:4] in sums:
                        sums[r[:4]] = _added(learners[r[1]], step, sums[r[:4]], r[5])
                    else:
                        sums[r[:4]], size = r[5], size + len(r[5])
                    if size > COMBINE:
                        yield _out([(*k, _SUMS, v) for k, v in sums.items()])
                        sums, size = {}, 0
                yield _out(rest)
        yield _out([(*k, _SUMS, v) for k, v in sums.items()])

    return run


def _added(a, step, u, v):
    """Two partial tables of a node as one: ranges widen, sums add."""
    if a.kind == "extra" and a.steps()[step][0] == "draw":
        half = len(v) // 2
        return np.concatenate((np.minimum(u[:half], v[:half]), np.maximum(u[half:], v[half:])))
    return u + v


# ---------------------------------------------------------------- splits

def _gain(a, gl, hl, g, h):
    """Gain of cuts from the sums left of them; -inf where a child is too light."""
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gl**2 / (hl + a.l2) + (g - gl) ** 2 / (h - hl + a.l2) - g**2 / (h + a.l2) - a.gamma
    least = max(a.min_child, 1e-9)
    return np.where((hl >= least) & (h - hl >= least) & ~np.isnan(gain), gain, -np.inf)


def _leaf(a, g, h):
    scale = a.rate if a.kind in ("boost", "symmetric") else 1.0
    return scale * g / (h + a.l2) if h + a.l2 > 0 else 0.0


def _split_rows(a, ident, f, cut, gl, hl, g, h, gain):
    key, m, t, node = ident
    leaf = lambda gg, hh: np.array([-1.0, 0.0, _leaf(a, gg, hh), hh, 0.0])
    return [(key, m, t, node, _NODE, np.array([f, cut, _leaf(a, g, h), h, gain])),
            (key, m, t, 2 * node + 1, _NODE, leaf(gl, hl)), (key, m, t, 2 * node + 2, _NODE, leaf(g - gl, h - hl))]


def _histogram(a, sums):
    """Cumulated histogram and gains of one node, (features, bins - 1)."""
    g, h = np.cumsum(sums.reshape(2, -1, BINS), 2)
    total = g[0, -1], h[0, -1]
    return g, h, total, _gain(a, g[:, :-1], h[:, :-1], *total)


def _finish(learners, n_features, step, ident, old, draw, sums):
    """Rows of a node once all its partial sums are in."""
    key, m, t, node = ident
    a = learners[m]
    what = a.steps()[step][0]
    if what == "linear":
        k = int(round(len(sums) ** 0.5))
        gram = sums.reshape(k, k)
        coef = np.linalg.lstsq(gram[:-1, :-1], gram[:-1, -1], rcond=1e-12)[0]
        full = np.zeros(n_features + 1)
        full[np.concatenate(([0], 1 + a.columns(n_features)))] = coef
        return [(*ident, _NODE, full)]
    if what == "prefix":
        g, h = np.cumsum(sums.reshape(FOLDS, 2), 0).T
        before = np.concatenate(([0.0], (a.rate * g / (h + a.l2))[:-1]))
        return old + [(*ident, _PREFIX, before)]
    if what == "draw":
        lo, hi = sums.reshape(2, -1)
        u = uniform(zlib.crc32(key.encode()), m, t, node, a.columns(n_features), a.seed)
        cut = np.where(hi > lo, lo + u * (hi - lo), np.inf)
        return old + [(*ident, _DRAW, cut)]
    if a.kind == "extra":
        (gl, hl), (g, h) = sums[:-2].reshape(2, -1), sums[-2:]
        gain = np.where(np.isfinite(draw), _gain(a, gl, hl, g, h), -np.inf)
        f = int(np.argmax(gain))
        if gain[f] > 1e-12:
            return _split_rows(a, ident, a.columns(n_features)[f], draw[f], gl[f], hl[f], g, h, gain[f])
    else:
        gc, hc, (g, h), gain = _histogram(a, sums)
        f, b = divmod(int(np.argmax(gain)), BINS - 1)
        if gain[f, b] > 1e-12:
            return _split_rows(a, ident, a.columns(n_features)[f], b, gc[f, b], hc[f, b], g, h, gain[f, b])
    return old or [(*ident, _NODE, np.array([-1.0, 0.0, _leaf(a, g, h), h, 0.0]))]


def _same_split(a, nodes, n_features):
    """Rows of a level of a symmetric tree: one cut for all its nodes (ident, old rows, sums)."""
    parts = [(ident, *_histogram(a, sums)) for ident, _, sums in nodes]
    # a node that the cut leaves whole adds nothing; a root must be cut in two
    gain = sum(p[4] if len(parts) == 1 else np.where(np.isfinite(p[4]), p[4], 0.0) for p in parts)
    f, b = divmod(int(np.argmax(gain)), BINS - 1)
    if not gain[f, b] > 1e-12:
        return [r for (ident, old, _), p in zip(nodes, parts, strict=True) for r in old or [(*ident, _NODE, np.array([-1.0, 0.0, _leaf(a, *p[3]), p[3][1], 0.0]))]]
    return [r for ident, gc, hc, (g, h), _ in parts for r in _split_rows(a, ident, a.columns(n_features)[f], b, gc[f, b], hc[f, b], g, h, gain[f, b] / len(parts))]


def _merge(learners, n_features, step):
    """Adds up the partial sums of each node (rows come sorted by node, then kind) and finishes it; a tree's rows come together."""
    def run(batches):
        now, old, draw, sums, level = None, [], None, None, []

        def node_done():
            if now is None or sums is None:
                return old  # drawn cuts of a node without rows go
            if learners[now[1]].kind == "symmetric" and step < learners[now[1]].depth:
                level.append((now, old, sums))
                return []
            return _finish(learners, n_features, step, now, old, draw, sums)

        def tree_done():
            return _same_split(learners[level[0][0][1]], level, n_features) if level else []

        for batch in batches:
            rows = []
            keys, m, t, node, kind = (batch.column(c).to_pylist() for c in ("_key", "m", "t", "node", "kind"))
            blob = batch.column("blob")
            at, flat = blob.offsets.to_numpy(), blob.values.to_numpy()
            for i in range(batch.num_rows):
                ident, v = (keys[i], m[i], t[i], node[i]), flat[at[i]:at[i + 1]]
                if ident != now:
                    rows += node_done()
                    if now is not None and ident[:3] != now[:3]:
                        rows += tree_done()
                        level = []
                    now, old, draw, sums = ident, [], None, None
                if kind[i] == _DRAW:
                    draw = v.copy()
                elif kind[i] != _SUMS:
                    if all(r[4] != kind[i] for r in old):  # every partition that has the series sends them
                        old.append((*ident, kind[i], v.copy()))
                else:
                    sums = v.copy() if sums is None else _added(learners[m[i]], step, sums, v)
            yield _out(rows)
        yield _out(node_done() + tree_done())

    return run


# ---------------------------------------------------------------- growing

def _packed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_key").agg(F.collect_list(F.struct("m", "t", "node", "kind", "blob")).alias("model"))


def grow(blocks: DataFrame, learners: Sequence[Learner], members: Sequence[tuple[int, int]], n_features: int, n_series: int, before: DataFrame | None = None) -> DataFrame:
    """Node rows of ``before`` and of the trees ``members`` = (model, tree), grown together: one chain of levels, one job when run."""
    learners = list(learners)
    rows = before
    nodes = sum(1 << (learners[m].depth + 1) for m, _ in members)
    bound = n_series * (nodes + REFRESH * sum(1 << (a.depth + 1) for a in learners if a.rounds > 1)) * (96 + 8 * n_features)
    for step in range(max(len(learners[m].steps()) for m, _ in members)):
        source = blocks if rows is None else join_by_key(blocks, _packed(rows), bound)
        parts = source.drop("keep").mapInArrow(_partials(learners, members, n_features, step), _PART)
        tree = ["_key", "m", "t"]
        rows = parts.repartition(*tree).sortWithinPartitions(*tree, "node", "kind").mapInArrow(_merge(learners, n_features, step), _PART)
    return rows


def _refreshed(blocks: DataFrame, rows: DataFrame, learners, n_features: int, bound: int) -> DataFrame:
    """Blocks whose margins include the trees of ``rows``."""
    names = blocks.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema.fields)

    def run(batches):
        for batch in batches:
            margins = []
            for i in range(batch.num_rows):
                model = _model_of(batch, i, learners)
                code = _numbers(batch, "code", i, np.uint8).reshape(-1, n_features)
                h = _numbers(batch, "h", i, np.int64)
                old = _numbers(batch, "margin", i).reshape(len(learners), -1).copy()
                for m, t in sorted(model.trees):
                    old[m] += model.train_value((m, t), code, learners[m].depth, h)
                margins.append(old.ravel())
            cols = [batch.column(c) if c != "margin" else _bytes(margins) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return join_by_key(blocks, _packed(rows), bound).mapInArrow(run, schema)


def fit(train: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, learners: Sequence[Learner], ids: Sequence[str] = (),
        edges: Sequence[Sequence[float]] | None = None) -> dict:
    """Fit every learner on every series. Returns the model: ``nodes`` (_key, m, t, node, kind, blob), ``cuts`` (bin edges and
    mean label per series) and what belongs to them. ``ids`` names columns that tell equal rows apart;
    ``edges`` gives each feature's cuts (at most BINS - 1) instead of quantiles."""
    features, learners = list(features), list(learners)
    ship_package(train.sparkSession)
    known = train.where(F.col(f"`{label}`").isNotNull())
    binned, width = any(a.binned for a in learners), len(features)
    if not binned:
        cuts = F.first(F.array().cast("array<double>"))
    elif edges is None:
        cuts = _cuts(features)
    else:
        cuts = F.first(F.lit([float(v) for e in edges for v in (*e, *[float("inf")] * (BINS - 1 - len(e)))]))
    order, plain = _order(known, keys)
    names = [f"_k{i}" for i in range(len(order))]
    means = known.groupBy(*[c.alias(n) for c, n in zip(order, names, strict=True)]).agg(cuts.alias("edges"), F.avg(F.col(f"`{label}`").cast("double")).alias("base"))
    cuts = materialize(means.select(_key_of(names, keys, plain).alias("_key"), "edges", "base"))
    n_series = cuts.count()
    margins = len(learners) if any(a.kind in ("boost", "symmetric") for a in learners) else 0
    blocks = materialize(with_codes(pack(known, keys, features, label, ids), cuts, width, margins, binned, n_series * (8 * BINS * width + 128)))
    bound = n_series * REFRESH * sum(1 << (a.depth + 1) for a in learners) * (96 + 8 * FOLDS)
    done = None
    at_once = [(m, t) for m, a in enumerate(learners) if a.rounds == 1 for t in range(a.trees)]
    chain, nodes = [], 0
    for i, (m, t) in enumerate(at_once):
        chain, nodes = [*chain, (m, t)], nodes + (2 << learners[m].depth)
        if nodes >= NODES or i == len(at_once) - 1:
            part = materialize(grow(blocks, learners, chain, width, n_series))
            done = part if done is None else done.unionByName(part)
            chain, nodes = [], 0
    rows, fresh = None, []
    for t in range(max((a.rounds for a in learners if a.rounds > 1), default=0)):
        now = [(m, t) for m, a in enumerate(learners) if 1 < a.rounds and t < a.rounds]
        rows = materialize(grow(blocks, learners, now, width, n_series, rows))
        if t % REFRESH == REFRESH - 1:
            blocks = materialize(_refreshed(blocks, rows, learners, width, bound))
            fresh.append(rows)
            rows = None
    for part in [*fresh, rows]:
        if part is not None:
            part = part.where(F.col("kind") == _NODE)
            done = part if done is None else done.unionByName(part)
    return {"nodes": done, "cuts": cuts, "keys": list(keys), "features": features, "learners": learners, "ids": list(ids), "n_series": n_series}


def predict(model: dict, table: DataFrame, keep: Sequence[str], out_of_fold: bool = False) -> DataFrame:
    """The columns ``keep`` (keys included if named) and one column of predictions per learner; NULL for a series that was not learned. With
    ``out_of_fold``, learners with a fold predict only the rows of that fold (NULL elsewhere)."""
    learners, width, keys = model["learners"], len(model["features"]), model["keys"]
    names = [f"p{m}" for m in range(len(learners))]
    size = model["n_series"] * sum(a.trees << (a.depth + 1) for a in learners) * 64
    packed = _packed(model["nodes"].where(F.col("kind") == _NODE)).join(model["cuts"], "_key")
    blocks = join_by_key(pack(table, keys, model["features"], None, model["ids"], list(dict.fromkeys([*keys, *keep]))), packed, size)
    kept = blocks.schema["keep"].dataType.elementType.fields
    columns = [f"c{i}" for i in range(len(kept))]

    def one(batch, i):
        x = _numbers(batch, "x", i).reshape(-1, width)
        if batch.column("base")[i].as_py() is None:
            return [np.full(len(x), np.nan)] * len(learners)
        trees = _model_of(batch, i, learners)
        code = _code(x, _floats(batch, "edges", i).reshape(width, -1)) if any(a.binned for a in learners) else None
        out = []
        for m, a in enumerate(learners):
            if a.kind == "linear":
                p = trees.linear[m][0] + x @ trees.linear[m][1:]
            else:
                mine = [trees.value(k, x if a.kind == "extra" else code, a.depth) for k in sorted(trees.trees) if k[0] == m]
                p = sum(mine) + batch.column("base")[i].as_py() if a.rounds > 1 else sum(mine) / len(mine)
            if out_of_fold and a.fold >= 0:
                p = np.where(fold_of(_numbers(batch, "h", i, np.int64), a.folds) == a.fold, p, np.nan)
            out.append(p)
        return out

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cols = [np.concatenate(c) for c in zip(*[one(batch, i) for i in range(batch.num_rows)], strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.column("keep").flatten().flatten(), *map(pa.array, cols)], names=[*columns, *names])

    scored = blocks.mapInArrow(run, T.StructType([*[T.StructField(c, f.dataType) for c, f in zip(columns, kept, strict=True)],
                                                  *[T.StructField(n, T.DoubleType()) for n in names]]))
    at = {f.name: c for c, f in zip(columns, kept, strict=True)}
    return scored.select(*[F.col(at[c]).alias(c) for c in keep],
                         *[F.when(~F.isnan(n), F.col(n)).alias(a.name) for n, a in zip(names, learners, strict=True)])


def importance(model: dict) -> DataFrame:
    """Share of each feature in the summed gain per series and learner (features never split on: 0)."""
    names, learners = model["features"], model["learners"]
    trees = [m for m, a in enumerate(learners) if a.kind != "linear"]
    splits = model["nodes"].where((F.col("kind") == _NODE) & F.col("m").isin(trees) & (F.col("blob")[0] >= 0))
    # gains of a tree count by their share in it, as averages over trees do
    gains = splits.groupBy("_key", "m", F.col("blob")[0].cast("int").alias("f")).agg(F.sum(F.col("blob")[4]).alias("g"))
    every = model["cuts"].select("_key", F.explode(F.array(*[F.lit(m) for m in trees])).alias("m")).withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))))
    j = every.join(gains, ["_key", "m", "f"], "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
    whole = F.sum("g").over(Window.partitionBy("_key", "m"))
    return _with_keys(j.withColumn("importance", F.when(whole > 0, F.col("g") / whole).otherwise(F.lit(0.0))), model).select(
        *model["keys"], F.element_at(F.array(*[F.lit(a.name) for a in learners]), F.col("m") + 1).alias("algorithm"),
        F.element_at(F.array(*[F.lit(n) for n in names]), F.col("f") + 1).alias("feature"), "importance")


def _with_keys(df: DataFrame, model: dict) -> DataFrame:
    """Key columns (as text) from ``_key``."""
    return df.withColumns({k: F.get_json_object("_key", f"$['{k}']") for k in model["keys"]})
