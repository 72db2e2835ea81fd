"""Linear regression with ARMA(p, q) errors and exogenous columns, per series, with multi-step forecasts.

All series go through each step together:

1. least squares of y on [1, X] from one Gramian per series; u are the residuals;
2. innovations from a long autoregression of u (``long_ar`` lags, one Gramian of lagged columns);
3. regression of u on its own lags and on lagged innovations (Hannan and Rissanen 1982): every order p <= ``max_p``, q <= ``max_q`` is a block of
   one Gramian, the least BIC wins;
4. innovations of the chosen model and forecasts are both recurrences of order q or p, x_t = b_t + sum_j c_j x_{t-j}, run by
   ``recurrence``: a matrix-affine scan over blocks of rows, so no series is walked from end to end in one task.

The seasonal order search of the reference is not built. A series without a test row has no forecast; a constant label has u = 0 and is
predicted by its regression alone. Test positions may have gaps; training positions are dense per series."""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .blocked import DEFAULT_BLOCK, attach, materialize, with_series_windows
from .tsstats import _gram_matrix, _gramians


def _run(b: np.ndarray, c: np.ndarray, state: np.ndarray) -> np.ndarray:
    """x_t = b_t + sum_j c_j x_{t-1-j} for rows of blocks in lockstep; ``state`` holds the values before the block, latest first."""
    x, s = np.empty_like(b), state.copy()
    for t in range(b.shape[1]):
        x[:, t] = b[:, t] + (c * s).sum(1)
        s = np.column_stack((x[:, t], s[:, :-1]))
    return x


def _padded(batch, width):
    rows = batch.column("_vals").to_pylist()
    n = np.array([len(r) for r in rows], int)
    b = np.zeros((len(rows), int(n.max(initial=0))))
    for i, r in enumerate(rows):
        b[i, :n[i]] = r
    c = np.zeros((len(rows), width))
    for i, r in enumerate(batch.column("_coef").to_pylist()):
        c[i, :len(r)] = r
    return b, c, n


def _latest(x, n, state, width):
    """The last ``width`` values up to place n of each row, latest first, with what was before the block."""
    line = np.concatenate((state[:, ::-1], x), 1)
    return line[np.arange(len(x))[:, None], (n + width - 1)[:, None] - np.arange(width)]


def recurrence(df: DataFrame, keys: Sequence[str], pos: str, offset: str, coefs: DataFrame, out: str, width: int, block: int = DEFAULT_BLOCK) -> DataFrame:
    """(keys, pos, ``out``): ``out``_t = ``offset``_t + sum_j c_j ``out``_{t-1-j}, values before the first row being 0. ``coefs`` has
    (keys, c: array of at most ``width`` doubles); ``pos`` is dense. NULL offsets count as 0.

    A block of rows maps the state before it to the state after it by x -> M^n x + r; r and the powers of the companion matrix M come
    from running the block from zero and from unit states, blocks are chained per series on width + width^2 numbers each, and
    every block is run again from its true state."""
    k = list(keys)
    ship_package(df.sparkSession)
    rows = df.select(*k, F.col(pos).cast("long").alias("_at"), F.coalesce(F.col(offset), F.lit(0.0)).alias("_vals"))
    packed = (attach(rows, coefs.select(*k, F.col("c").alias("_coef")), k).groupBy(*k, F.floor(F.col("_at") / block).cast("long").alias("_blk"))
              .agg(F.sort_array(F.collect_list(F.struct("_at", "_vals"))).alias("_r"), F.first("_coef").alias("_coef")))
    packed = materialize(packed.select(*k, "_blk", F.col("_r._at").alias("_at"), F.col("_r._vals").alias("_vals"), "_coef"))
    key_ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in k)
    numbers = pa.list_(pa.float64())

    def ends(batches):
        for batch in batches:
            b, c, n = _padded(batch, width)
            zero = np.zeros((len(b), width))
            cols = [_latest(_run(b, c, zero), n, zero, width)]
            for j in range(width):
                unit = np.tile(np.eye(width)[j], (len(b), 1))
                cols.append(_latest(_run(np.zeros_like(b), c, unit), n, unit, width))
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in (*k, "_blk")], pa.array(np.concatenate(cols, 1).tolist(), numbers)], names=[*k, "_blk", "_map"])

    summary = packed.mapInArrow(ends, f"{key_ddl}, _blk long, _map array<double>")

    def chain(pdf):
        pdf = pdf.sort_values("_blk")
        s, states = np.zeros(width), []
        for m in pdf["_map"]:
            states.append(s.tolist())
            m = np.asarray(m, float).reshape(width + 1, width)
            s = m[0] + s @ m[1:]
        got = pdf[[*k, "_blk"]].copy()
        got["_state"] = states
        return got

    carry = summary.groupBy(*k).applyInPandas(chain, f"{key_ddl}, _blk long, _state array<double>")

    def again(batches):
        for batch in batches:
            b, c, n = _padded(batch, width)
            x = _run(b, c, np.array(batch.column("_state").to_pylist(), float).reshape(len(b), width))
            vals = [x[i, :n[i]].tolist() for i in range(len(b))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*k, "_at")], pa.array(vals, numbers)], names=[*k, "_at", "_x"])

    done = packed.join(carry, [*k, "_blk"]).mapInArrow(again, f"{key_ddl}, _at array<long>, _x array<double>")
    z = done.select(*k, F.explode(F.arrays_zip("_at", "_x")).alias("_z"))
    return z.select(*k, F.col("_z._at").alias(pos), F.col("_z._x").alias(out))


def _solved(grams: DataFrame, keys: Sequence[str], solve, ddl: str) -> DataFrame:
    """One small solve per series: ``solve(row) -> tuple`` in the order of ``ddl``."""
    k = list(keys)
    names = [f.strip().split(" ")[0] for f in ddl.split(", ")]

    def run(it):
        import pandas as pd
        for pdf in it:
            rows = [solve(r) for r in pdf.to_dict("records")]
            out = pdf[k].copy()
            for i, c in enumerate(names):
                out[c] = pd.Series([r[i] for r in rows], index=out.index, dtype=object)
            yield out

    ship_package(grams.sparkSession)
    extra = T.StructType.fromDDL(ddl).fields
    return materialize(grams.mapInPandas(run, T.StructType([*[grams.schema[c] for c in k], *extra])))


def _least_squares(gram, columns):
    """Coefficients of the last column of a Gramian on ``columns``, and the squared error."""
    full, _, yy = _gram_matrix(gram, 0)
    whole = np.asarray(list(gram), float).reshape(math.isqrt(len(gram)), -1)
    a, b = whole[np.ix_(columns, columns)], whole[columns, -1]
    beta = np.linalg.lstsq(a, b, rcond=1e-12)[0] if len(columns) else np.zeros(0)
    return beta, max(yy - 2 * beta @ b + beta @ a @ beta, 0.0)


def arma_orders(gram, n: int, max_p: int, max_q: int):
    """(p, q, phi, theta) of least BIC from the Gramian of [u lags, innovation lags, u]; ties to the smaller order."""
    best = None
    for p in range(max_p + 1):
        for q in range(max_q + 1):
            cols = [*range(p), *range(max_p, max_p + q)]
            beta, ssr = _least_squares(gram, cols)
            bic = n * math.log(max(ssr, 1e-300) / n) + (p + q) * math.log(n) if n > p + q else math.inf
            if best is None or bic < best[0] - 1e-9:
                best = (bic, p, q, beta[:p], beta[p:])
    return best[1:]


def arma_error_regression(train: DataFrame, test: DataFrame, keys: Sequence[str], pos: str, label: str, features: Sequence[str],
                          max_p: int = 3, max_q: int = 2, long_ar: int = 20, block: int = DEFAULT_BLOCK) -> DataFrame:
    """The test rows with ``prediction`` (regression + forecast of the ARMA error), ``ar_p`` and ``ma_q``."""
    k, xs = list(keys), ["_one", *features]
    lags = max(long_ar, max_p, max_q)
    value = lambda c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0))
    tr = train.where(F.col(label).isNotNull()).select(*k, F.col(pos).cast("long").alias("_pos"), F.lit(1.0).alias("_one"), *[value(f).alias(f) for f in features],
                                                      F.col(label).cast("double").alias("_y"))
    tr = materialize(tr)
    betas = _solved(_gramians(tr, k, [*xs, "_y"]), k, lambda r: (_least_squares(r["_g"], list(range(len(xs))))[0].tolist(),), "_beta array<double>")
    fitted = sum(F.col(c) * F.col("_beta")[i] for i, c in enumerate(xs))
    u = attach(tr, betas, k).select(*k, "_pos", (F.col("_y") - fitted).alias("_u"))
    u = materialize(with_series_windows(u, k, "_pos", lambda w: {f"_u{i}": F.lag("_u", i).over(w) for i in range(1, lags + 1)}, halo=lags, block=max(block, lags)).drop("_blk"))
    names = [f"_u{i}" for i in range(1, long_ar + 1)]
    longer = _solved(_gramians(u.where(F.col(f"_u{long_ar}").isNotNull()), k, [*names, "_u"]), k,
                     lambda r: (_least_squares(r["_g"], list(range(long_ar)))[0].tolist(),), "_long array<double>")
    e = attach(u, longer, k).withColumn("_e", F.col("_u") - sum(F.col(c) * F.col("_long")[i] for i, c in enumerate(names))).select(*k, "_pos", "_u", "_e", *names[:max_p])
    e = with_series_windows(e, k, "_pos", lambda w: {f"_e{j}": F.lag("_e", j).over(w) for j in range(1, max_q + 1)}, halo=max_q, block=max(block, max_q))
    cols = [*names[:max_p], *[f"_e{j}" for j in range(1, max_q + 1)]]
    rows = materialize(e.where(F.col(cols[-1]).isNotNull()).select(*k, *cols, "_u"))
    grams = _gramians(rows, k, [*cols, "_u"]).join(rows.groupBy(*k).agg(F.count(F.lit(1)).alias("_n")), k)

    def pick(r):
        p, q, phi, theta = arma_orders(r["_g"], int(r["_n"]), max_p, max_q)
        return p, q, [*map(float, phi), *[0.0] * (max_p - p)], [*map(float, theta), *[0.0] * (max_q - q)]

    # series too short for the long autoregression have no error model
    short = u.select(*k).distinct()
    fits = _solved(grams, k, pick, "ar_p long, ma_q long, phi array<double>, theta array<double>")
    zeros = lambda n: F.array(*[F.lit(0.0)] * n)
    fits = materialize(short.join(fits, k, "left").select(*k, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("ar_p", "ma_q")],
                                                          F.coalesce("phi", zeros(max_p)).alias("phi"), F.coalesce("theta", zeros(max_q)).alias("theta")))
    base = attach(u.select(*k, "_pos", "_u", *names[:max_p]), fits.select(*k, "phi"), k)
    base = base.withColumn("_b", F.col("_u") - sum(F.coalesce(F.col(c), F.lit(0.0)) * F.col("phi")[i] for i, c in enumerate(names[:max_p])))
    minus = fits.select(*k, F.transform("theta", lambda v: -v).alias("c"))
    innovations = recurrence(base, k, "_pos", "_b", minus, "_e", max_q, block)
    last = base.groupBy(*k).agg(F.max("_pos").alias("_T"))
    tail = attach(base.select(*k, "_pos", "_u").join(innovations, [*k, "_pos"]), last, k).where(F.col("_pos") > F.col("_T") - max(max_p, max_q))
    ends = tail.groupBy(*k).agg(F.first("_T").alias("_T"), F.map_from_entries(F.collect_list(F.struct((F.col("_T") - F.col("_pos")).cast("int"), F.struct("_u", "_e")))).alias("_last"))
    ends = materialize(ends.join(fits, k))
    te = attach(test, ends.select(*k, "_T", "ar_p", "ma_q"), k, "left").withColumn("_h", F.col(pos).cast("long") - F.col("_T"))
    te = materialize(te)
    reach = te.where("_h >= 1").groupBy(*k).agg(F.max("_h").alias("_H")).join(ends, k)
    grid = reach.select(*k, "phi", "theta", "_last", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_H"))).alias("_h"))
    known = lambda c, i, f: F.when(F.col("_h") <= i, F.coalesce(F.col(c)[i - 1] * F.try_element_at("_last", (F.lit(i) - F.col("_h")).cast("int"))[f], F.lit(0.0))).otherwise(0.0)
    start = sum([known("phi", i, "_u") for i in range(1, max_p + 1)] + [known("theta", j, "_e") for j in range(1, max_q + 1)])
    ahead = recurrence(grid.select(*k, (F.col("_h") - 1).alias("_at"), start.alias("_b")), k, "_at", "_b", ends.select(*k, F.col("phi").alias("c")), "_ahead", max_p, block)
    te = te.join(ahead.select(*k, (F.col("_at") + 1).alias("_h"), "_ahead"), [*k, "_h"], "left")
    line = sum(value(c) * F.col("_beta")[i + 1] for i, c in enumerate(features)) + F.col("_beta")[0]
    out = attach(te, betas, k, "left").withColumn("prediction", line + F.coalesce(F.col("_ahead"), F.lit(0.0)))
    return out.select(*test.columns, "prediction", "ar_p", "ma_q")
