"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from the UTF-8 bytes of whole texts, for a batch of documents at once: byte classes by a lookup
table and ``reduceat``, words as spans with polynomial hashes modulo 2**64 (distinct words, the commonest word, words that follow
themselves), lines as spans. They are stored once; training and scoring read them from there.

Training takes a bounded sample of labelled rows (``TRAIN_ROWS`` ids in hash order; a documented bound, all other work
covers every row). Values are put into at most ``BINS`` quantile bins; each level of a tree is grown from one histogram of
gradients and hessians over (node, statistic, bin). A fitted model is a set of arrays, one row per tree in heap order, so
that a batch descends all trees with one numpy step per level.

Defined results: null text counts as empty (all statistics 0) and gets the model's score for it. Several labels of one id
are averaged; null labels and labels of ids without a document teach nothing; without any label every score is 0.5.
Rows whose ids repeat are scored one by one; a null id counts as the empty text in the split. Extra columns are kept;
those named like an output are replaced."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_arrow, quoted, remainder, slices, stored, table, with_fields, without

TRAIN_ROWS = 20_000
BINS = 32
TREES = 80
DEPTH = 4
RATE = 0.15
L2 = 1.0
MIN_HESSIAN = 2.0
THRESHOLD = 0.3

#: Byte classes.
_SPACE, _LOWER, _UPPER, _DIGIT, _STOP, _MARK, _SYMBOL, _HIGH = range(8)
_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[128:] = _HIGH
for _set, _kind in ((b"\x20\x09\x0a\x0b\x0c\x0d", _SPACE), (b"abcdefghijklmnopqrstuvwxyz", _LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER),
                    (b"0123456789", _DIGIT), (b".?!", _STOP), (b",;:'\"()-", _MARK)):
    _CLASS[list(_set)] = _kind
_BASE = np.uint64(0x9E3779B97F4A7C15)

STATISTICS = ["log_bytes", "log_words", "word_bytes", "longest_word", "letters", "upper", "digits", "stops", "marks", "symbols", "high", "blanks",
              "stop_words", "symbol_words", "upper_words", "one_letter_words", "distinct_words", "followed_by_itself", "top_word",
              "log_lines", "line_words", "short_lines", "stop_lines", "line_spread"]


def _sums(values, starts, stops):
    """Sums over [start, stop), empty spans included."""
    c = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return c[stops] - c[starts]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, statistics) of texts laid end to end in ``data``."""
    n = len(offsets) - 1
    base = int(offsets[0])
    data, offsets = data[base:int(offsets[-1])], (offsets - base).astype(np.int64)
    out = np.zeros((n, len(STATISTICS)), np.float32)
    if not len(data):
        return out
    lo, hi = offsets[:-1], offsets[1:]
    size = np.maximum(hi - lo, 1).astype(np.float64)
    kind = _CLASS[data]
    count = {k: _sums(kind == k, lo, hi) for k in range(8)}
    letters = count[_LOWER] + count[_UPPER] + count[_HIGH]
    # words: runs without blanks, cut where a document ends
    solid = kind != _SPACE
    first = np.zeros(len(data), bool)
    first[lo[lo < len(data)]] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:]
    ws, we = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(offsets, ws, "right") - 1
    words = np.bincount(doc, minlength=n).astype(np.float64)
    some = np.maximum(words, 1)
    length = (we - ws).astype(np.float64)
    last = kind[we - 1] if len(we) else np.zeros(0, np.uint8)
    symbols, upper, lower = (_sums(kind == k, ws, we) for k in (_SYMBOL, _UPPER, _LOWER))
    per_doc = lambda x: np.bincount(doc, weights=x, minlength=n)
    with np.errstate(over="ignore"):  # hash of a word: its bytes times powers of _BASE by place, modulo 2**64
        place = np.flatnonzero(solid) - np.repeat(ws, we - ws)
        power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(length.max(initial=1)), _BASE))))
        word = np.add.reduceat((data[solid] + np.uint64(1)) * power[place], np.cumsum(we - ws) - (we - ws)) if len(ws) else np.zeros(0, np.uint64)
    again = np.zeros(len(ws))
    again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((word, doc))
    new = np.ones(len(ws), bool)
    new[1:] = (word[order][1:] != word[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    at = np.flatnonzero(new)
    repeats = np.diff(np.append(at, len(ws)))
    distinct = np.bincount(doc[order][at], minlength=n)
    top, longest = np.zeros(n), np.zeros(n)
    np.maximum.at(top, doc[order][at], repeats)
    np.maximum.at(longest, doc, length)
    # lines: each holds the words up to the next line feed
    feeds = np.flatnonzero(data == 10)
    line = np.searchsorted(feeds, ws)
    opens = np.ones(len(ws), bool)
    opens[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    la = np.flatnonzero(opens)
    lz = np.append(la[1:], len(ws)) - 1
    per_line, line_doc = (lz - la + 1).astype(np.float64), doc[la]
    lines = np.bincount(line_doc, minlength=n).astype(np.float64)
    full = np.maximum(lines, 1)
    by_line = lambda x: np.bincount(line_doc, weights=x, minlength=n)
    mean_line = by_line(per_line) / full
    columns = [
        np.log1p(hi - lo), np.log1p(words), per_doc(length) / some, np.log1p(longest), letters / size, count[_UPPER] / np.maximum(letters, 1),
        count[_DIGIT] / size, count[_STOP] / size, count[_MARK] / size, count[_SYMBOL] / size, count[_HIGH] / size, count[_SPACE] / size,
        per_doc(last == _STOP) / some, per_doc(symbols > 0) / some, per_doc((upper > 1) & (lower == 0)) / some, per_doc(length == 1) / some,
        distinct / some, per_doc(again) / some, top / some,
        np.log1p(lines), np.log1p(mean_line), by_line(per_line < 4) / full, by_line(last[lz] == _STOP) / full,
        np.sqrt(np.maximum(by_line(per_line * per_line) / full - mean_line**2, 0)) / np.maximum(mean_line, 1),
    ]
    for j, c in enumerate(columns):
        out[:, j] = c
    return out


def _text_arrays(column: pa.Array):
    """Bytes and offsets of a string column, nulls as empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), o


def with_statistics(docs: DataFrame, out: str, text: str = "text") -> DataFrame:
    """``docs`` without its text but with an array of statistics of the whole text."""
    keep = without(docs, text, out)
    src = docs.select(*keep, quoted(text).cast("string").alias(fresh(docs, "_t")[0]))
    schema = with_fields(T.StructType(src.schema.fields[:-1]), (out, "array<float>"))
    arrow = pa.list_(pa.field("element", pa.float32()))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2000, 4 << 20):
                values = statistics(*_text_arrays(part.column(part.num_columns - 1)))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.ravel())).cast(arrow)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], flat], names=[*part.schema.names[:-1], out])

    return map_arrow(src, run, schema)


class Trees:
    """Boosted trees in heap order: ``feature`` and ``cut`` of inner nodes, ``leaf`` values of the last level."""

    def __init__(self, prior, feature, cut, leaf):
        self.prior, self.feature, self.cut, self.leaf = prior, feature, cut, leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of rows: all trees step down one level at a time."""
        n, trees = len(x), len(self.leaf)
        total = np.full(n, self.prior)
        if not trees or not n:
            return total
        t, rows = np.arange(trees), np.arange(n)[:, None]
        depth = int(np.log2(self.leaf.shape[1]))
        node = np.zeros((n, trees), np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.cut[t, node])
        return total + self.leaf[t, node - (2**depth - 1)].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Trees:
    """Second-order boosting of the logistic loss on histograms. ``y`` may be fractions."""
    if not len(y):
        return Trees(0.0, np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 1)))
    x = np.asarray(x, np.float32)
    n, k = x.shape
    cuts = np.full((k, bins - 1), np.inf, np.float32)
    for j in range(k):
        q = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
        cuts[j, :len(q)] = q
    code = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(k)], 1)  # x > cut[b] means code > b
    p0 = min(max(float(np.mean(y)), 1e-3), 1 - 1e-3)
    prior = float(np.log(p0 / (1 - p0)))
    margin = np.full(n, prior)
    inner = 2**depth - 1
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, 2**depth))
    column = np.arange(k) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            cell = ((node - first)[:, None] * (k * bins) + column + code).ravel()
            hist = [np.bincount(cell, weights=np.repeat(v, k), minlength=width * k * bins).reshape(width, k, bins) for v in (g, h)]
            left = [np.cumsum(v, 2)[:, :, :-1] for v in hist]
            whole = [v[:, :1, :].sum(2, keepdims=True) for v in hist]
            right = [w - v for w, v in zip(whole, left, strict=True)]
            gain = left[0]**2 / (left[1] + L2) + right[0]**2 / (right[1] + L2) - whole[0]**2 / (whole[1] + L2)
            gain[(left[1] < MIN_HESSIAN) | (right[1] < MIN_HESSIAN) | ~np.isfinite(cuts)[None]] = -np.inf
            flat = gain.reshape(width, -1)
            best = flat.argmax(1)
            good = flat[np.arange(width), best] > 1e-9
            f, b = best // (bins - 1), best % (bins - 1)
            feature[t, first:first + width] = np.where(good, f, 0)
            cut[t, first:first + width] = np.where(good, cuts[f, b], np.inf)
            at = node - first
            node = 2 * node + 1 + (good[at] & (code[np.arange(n), f[at]] > b[at]))
        at = node - inner
        leaf[t] = rate * np.bincount(at, weights=g, minlength=2**depth) / (np.bincount(at, weights=h, minlength=2**depth) + L2)
        margin += leaf[t][at]
    return Trees(prior, feature, cut, leaf)


def learn(stats: DataFrame, labels: DataFrame, column: str, train: Column | None = None, *, id_col: str = "doc_id", label: str = "quality",
          max_rows: int = TRAIN_ROWS) -> Trees:
    """Fit on the statistics of at most ``max_rows`` labelled ids (in hash order) whose rows fulfil ``train``."""
    marks = (labels.where(quoted(label).isNotNull() & quoted(id_col).isNotNull()).groupBy(quoted(id_col).alias("_id"))
             .agg(F.avg(quoted(label).cast("double")).alias("_y")))
    rows = stats.where(train) if train is not None else stats
    # about twice the sample by hash, so that the exact cut sorts no more; one row of an id whose rows repeat
    share = min(1.0, 2.0 * max_rows / max(marks.count(), 1))
    marks = marks.where(F.pmod(F.xxhash64("_id", F.lit("share")), F.lit(1 << 20)) < int(share * (1 << 20)))
    joined = rows.select(quoted(id_col).alias("_id"), quoted(column).alias("_x")).join(marks, "_id").groupBy("_id").agg(F.min("_x").alias("_x"), F.first("_y").alias("_y"))
    sample = joined.orderBy(F.xxhash64(F.col("_id")), "_id").limit(max_rows).select("_x", "_y").collect()
    return fit(np.array([r[0] for r in sample], np.float32).reshape(len(sample), len(STATISTICS)), np.array([r[1] for r in sample], float))


def score(stats: DataFrame, model: Trees, column: str, threshold: float = THRESHOLD) -> DataFrame:
    """``stats`` without the statistics but with ``score`` and ``predicted``."""
    src = stats.select(*without(stats, column, "score", "predicted"), quoted(column))
    schema = with_fields(T.StructType(src.schema.fields[:-1]), ("score", "double"), ("predicted", "int"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 4000):
                x = part.column(part.num_columns - 1)
                s = model.score(x.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*part.schema.names[:-1], "score", "predicted"])

    return map_arrow(src, run, schema)


def op11(spark, sf_dir):
    """Every document's quality score; labels of documents whose crc32(doc_id) mod 5 is 0 are never learned from."""
    held_out = remainder(F.col("doc_id"), 5) == 0
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    stats = stored(with_statistics(docs, "stats")).withColumn("held_out", held_out)
    model = learn(stats, table(spark, sf_dir, "labels", "doc_id", "quality"), "stats", ~F.col("held_out"))
    return score(stats, model, "stats").select("doc_id", "held_out", "score", "predicted")
