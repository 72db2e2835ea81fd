"""A small causal self-attention model in numpy: forward, gradients and Adam on windows of symbols.

Symbols are ``CLASSES * WITHIN`` subwords (the rest share one). The next symbol is predicted as its class, then
its place in the class. Both are softmaxes over attention features plus the smoothed corpus bigram's log
probabilities, so an untrained model is the bigram and training adds what a longer context tells."""
from __future__ import annotations

import numpy as np

CLASSES, WITHIN = 32, 32
SYMBOLS = CLASSES * WITHIN
DIM, HIDDEN = 16, 32
CONTEXT, STEP = 32, 32
PAD = SYMBOLS  # input only: before the start of a text
_NEVER = np.float32(-1e9)
_DISTANCE = (CONTEXT + np.arange(STEP))[:, None] - np.arange(CONTEXT + STEP)[None, :]


def initial(vectors: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    """Parameters; ``vectors`` (SYMBOLS x DIM) start the embedding, output weights start at zero."""
    rng = np.random.default_rng(seed)
    f = lambda *s, scale=1.0: (rng.standard_normal(s) * scale).astype(np.float32)
    emb = np.zeros((SYMBOLS + 1, DIM), dtype=np.float32)
    emb[:SYMBOLS] = vectors
    return {"emb": emb, "wq": f(DIM, DIM, scale=0.1), "wk": f(DIM, DIM, scale=0.1), "wv": f(DIM, DIM, scale=0.25),
            "rel": np.zeros(CONTEXT + STEP, dtype=np.float32), "w1": f(DIM, HIDDEN, scale=0.25), "w2": f(DIM, HIDDEN, scale=0.25),
            "b": np.zeros(HIDDEN, dtype=np.float32), "wc": np.zeros((HIDDEN, CLASSES), dtype=np.float32), "bc": np.zeros(CLASSES, dtype=np.float32),
            "wt": np.zeros((CLASSES, HIDDEN, WITHIN), dtype=np.float32), "bt": np.zeros((CLASSES, WITHIN), dtype=np.float32)}


def windows(texts: list[np.ndarray], start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows of all texts (each ends with ``start``, the end symbol, which also precedes it).

    Inputs (n x (CONTEXT + STEP)), targets (n x STEP, -1: none), and each window's text. A window
    reads CONTEXT symbols before its STEP targets' inputs; every symbol is a target once."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    count = -(-sizes // STEP)
    room = CONTEXT + count * STEP
    base = np.concatenate([[0], np.cumsum(room)])
    inputs = np.full(base[-1] + 1, PAD, dtype=np.int32)
    targets = np.full(base[-1] + 1, -1, dtype=np.int32)
    for t, b in zip(texts, base):
        inputs[b + CONTEXT] = start
        inputs[b + CONTEXT + 1:b + CONTEXT + len(t)] = t[:-1]
        targets[b + CONTEXT:b + CONTEXT + len(t)] = t
    of = np.repeat(np.arange(len(texts)), count)
    first = np.repeat(base[:-1], count) + STEP * (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
    at = first[:, None] + np.arange(CONTEXT + STEP)
    return inputs[at], targets[at[:, CONTEXT:]], of


def line_windows(lines: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Windows (inputs, targets) of lines cut from texts: CONTEXT symbols, then each target's input, then the
    last target, so that a line of CONTEXT + 1 + n symbols has n targets."""
    sizes = np.array([len(x) - CONTEXT - 1 for x in lines], dtype=np.int64)
    count = -(-sizes // STEP)
    room = CONTEXT + count * STEP
    base = np.concatenate([[0], np.cumsum(room)])
    inputs = np.full(base[-1] + 1, PAD, dtype=np.int32)
    targets = np.full(base[-1] + 1, -1, dtype=np.int32)
    for x, b, n in zip(lines, base, sizes):
        inputs[b:b + CONTEXT + n] = x[:-1]
        targets[b + CONTEXT:b + CONTEXT + n] = x[CONTEXT + 1:]
    first = np.repeat(base[:-1], count) + STEP * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    at = first[:, None] + np.arange(CONTEXT + STEP)
    return inputs[at], targets[at[:, CONTEXT:]]


def prepared(p, bigram) -> dict[str, np.ndarray]:
    """Tables for scoring: what depends on one symbol only is taken per symbol, not per position; the
    biases are added to the bigram tables. PAD has no weight because its row of (values, 1) is zero."""
    by_class, by_place = bigram
    emb = p["emb"]
    value = np.concatenate([emb @ p["wv"], np.ones((len(emb), 1), dtype=emb.dtype)], axis=1)
    value[PAD] = 0
    t = {"q": emb @ p["wq"] * np.float32(DIM ** -0.5), "k": emb @ p["wk"], "v": value, "h": emb @ p["w1"] + p["b"], "w2": p["w2"], "wc": p["wc"],
         "wt": p["wt"], "rel": np.where(_DISTANCE >= 0, p["rel"][np.maximum(_DISTANCE, 0)], _NEVER),
         "class": by_class + p["bc"], "place": np.ascontiguousarray((by_place + p["bt"]).transpose(1, 0, 2))}
    largest = np.linalg.norm(t["q"], axis=1).max() * np.linalg.norm(t["k"], axis=1).max() + p["rel"].max()
    return t | {"large": np.array(largest > 80)}


def score(t, inputs, targets) -> np.ndarray:
    """Natural log probability of every target (0 where there is none), from ``prepared`` tables."""
    own = np.ascontiguousarray(inputs[:, CONTEXT:])
    s = np.matmul(np.take(t["q"], own, axis=0), np.take(t["k"], inputs, axis=0).transpose(0, 2, 1))
    s += t["rel"]
    if t["large"]:  # only then could the exponentials overflow
        s -= s.max(-1, keepdims=True)
    np.exp(s, out=s)
    o = np.matmul(s, np.take(t["v"], inputs, axis=0)).reshape(-1, DIM + 1)
    real = np.flatnonzero(targets >= 0)
    y, prev = targets.ravel()[real], own.ravel()[real]
    order = np.argsort((y // WITHIN).astype(np.int16), kind="stable")  # by class, so that each is one product
    real, y, prev = real[order], y[order], prev[order]
    c, w = y // WITHIN, y % WITHIN
    o = np.take(o, real, axis=0)
    hv = (o[:, :DIM] / o[:, DIM:]) @ t["w2"]
    hv += np.take(t["h"], prev, axis=0)
    np.maximum(hv, 0, out=hv)
    rows = np.arange(len(y))
    z = hv @ t["wc"]
    z += np.take(t["class"], prev, axis=0)
    out = z[rows, c].astype(np.float64)
    out -= np.log(np.exp(z, out=z).sum(-1))
    cuts = np.searchsorted(c, np.arange(CLASSES + 1))
    for k in range(CLASSES):
        a, b = cuts[k], cuts[k + 1]
        if a < b:
            np.matmul(hv[a:b], t["wt"][k], out=z[a:b])
    z += np.take(t["place"].reshape(-1, WITHIN), c * (SYMBOLS + 1) + prev, axis=0)
    out += z[rows, w]
    out -= np.log(np.exp(z, out=z).sum(-1))
    full = np.zeros(targets.size, dtype=np.float64)
    full[real] = out
    return full.reshape(targets.shape)


def log_probs(p, bigram, inputs, targets) -> np.ndarray:
    return score(prepared(p, bigram), inputs, targets)


def _by_symbol(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of ``rows`` per symbol ``at``."""
    pairs = np.ascontiguousarray(rows).view(np.result_type(rows, np.complex64))  # two numbers are added at once
    width = pairs.shape[1]
    out = np.zeros((SYMBOLS + 1) * width, dtype=pairs.dtype)
    np.add.at(out, (at.astype(np.intp)[:, None] * width + np.arange(width)).ravel(), pairs.ravel())  # one dimension: numpy's fast path
    return out.view(rows.dtype).reshape(-1, rows.shape[1])


def gradients(p, bigram, inputs, targets) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log probability of the targets and its gradients.

    As in ``score``, projections are taken per symbol and exponentials divided after the sum, and the targets are
    sorted by class; gradients of the projections are summed per symbol before they meet the weights."""
    by_class, by_place = bigram
    emb, scale = p["emb"], np.float32(DIM ** -0.5)
    q_of, k_of, h_of = emb @ p["wq"] * scale, emb @ p["wk"], emb @ p["w1"] + p["b"]
    v_of = np.concatenate([emb @ p["wv"], np.ones((len(emb), 1), dtype=emb.dtype)], axis=1)
    v_of[PAD] = 0
    own = np.ascontiguousarray(inputs[:, CONTEXT:])
    q, k, v = np.take(q_of, own, axis=0), np.take(k_of, inputs, axis=0), np.take(v_of, inputs, axis=0)
    e = np.matmul(q, k.transpose(0, 2, 1))
    e += np.where(_DISTANCE >= 0, p["rel"][np.maximum(_DISTANCE, 0)], _NEVER).astype(emb.dtype)
    if (np.einsum("ij,ij->i", q_of, q_of).max() * np.einsum("ij,ij->i", k_of, k_of).max()) ** 0.5 + p["rel"].max() > 80:
        e -= e.max(-1, keepdims=True)  # only then could the exponentials overflow
    np.exp(e, out=e)
    real = np.flatnonzero(targets >= 0)
    y, prev = targets.ravel()[real], own.ravel()[real]
    order = np.argsort((y // WITHIN).astype(np.int16), kind="stable")  # by class, so that each is one product
    real, y, prev = real[order], y[order], prev[order]
    c, w, rows, n = y // WITHIN, y % WITHIN, np.arange(len(y)), max(len(y), 1)
    o = np.take(np.matmul(e, v).reshape(-1, DIM + 1), real, axis=0)
    total = o[:, DIM:]
    o = o[:, :DIM] / total
    hv = o @ p["w2"]
    hv += np.take(h_of, prev, axis=0)
    np.maximum(hv, 0, out=hv)
    one = np.ones((len(y), HIDDEN + 1), dtype=o.dtype)  # the last column meets the biases
    one[:, :HIDDEN] = hv
    cuts = np.searchsorted(c, np.arange(CLASSES + 1))

    def errors(z, at):  # of the softmax, in place
        at = rows * z.shape[1] + at
        mine = np.take(z, at)
        np.exp(z, out=z)
        sums = z @ np.ones((z.shape[1], 1), dtype=z.dtype)
        z /= sums * z.dtype.type(n)
        z.reshape(-1)[at] -= z.dtype.type(1 / n)
        return float((np.log(sums[:, 0]) - mine).sum(dtype=np.float64))

    z = one @ np.concatenate([p["wc"], p["bc"][None]])
    z += np.take(by_class, prev, axis=0)
    wt = np.concatenate([p["wt"], p["bt"][:, None]], axis=1)
    t = np.empty((len(y), WITHIN), dtype=z.dtype)
    for j in range(CLASSES):
        lo, hi = cuts[j], cuts[j + 1]
        if lo < hi:
            np.matmul(one[lo:hi], wt[j], out=t[lo:hi])
    t += np.take(by_place.reshape(-1, WITHIN), prev * CLASSES + c, axis=0)
    loss = errors(z, c) + errors(t, w)
    dh, more = z @ p["wc"].T, np.empty_like(hv)
    g_c, g_t = one.T @ z, np.zeros_like(wt)
    for j in range(CLASSES):
        lo, hi = cuts[j], cuts[j + 1]
        if lo < hi:
            np.matmul(one[lo:hi].T, t[lo:hi], out=g_t[j])
            np.matmul(t[lo:hi], p["wt"][j].T, out=more[lo:hi])
    dh += more
    dh *= hv > 0
    g = {"wc": g_c[:HIDDEN], "bc": g_c[HIDDEN], "wt": g_t[:, :HIDDEN], "bt": g_t[:, HIDDEN], "w2": o.T @ dh, "b": dh.sum(0)}
    do = dh @ p["w2"].T
    d_sum = np.zeros((len(y) + 1, DIM + 1), dtype=do.dtype)  # of the weighted values and of the weights' sum
    d_sum[:-1, :DIM] = do
    d_sum[:-1, DIM] = -(do * o).sum(-1)
    d_sum[:-1] /= total
    place = np.full(targets.size, len(y))  # of each position among the sorted targets; without target: the row of zeros
    place[real] = rows
    d_sum = np.take(d_sum, place, axis=0).reshape(*targets.shape, DIM + 1)
    dv = np.matmul(e.transpose(0, 2, 1), d_sum)
    e *= np.matmul(d_sum, v.transpose(0, 2, 1))
    g["rel"] = np.bincount(np.maximum(_DISTANCE, 0).ravel(), weights=np.where(_DISTANCE >= 0, e.sum(0), 0).ravel(),
                           minlength=CONTEXT + STEP).astype(emb.dtype)
    dq, dk = np.matmul(e, k), np.matmul(e.transpose(0, 2, 1), q)
    all_in = _by_symbol(inputs.ravel(), np.concatenate([dk, dv[:, :, :DIM]], axis=2).reshape(-1, 2 * DIM))
    dk_of, dv_of = all_in[:, :DIM], all_in[:, DIM:].copy()
    dv_of[PAD] = 0
    dq_of = _by_symbol(own.ravel(), dq.reshape(-1, DIM)) * scale
    dh_of = _by_symbol(prev, dh)
    g["wq"], g["wk"], g["wv"], g["w1"] = emb.T @ dq_of, emb.T @ dk_of, emb.T @ dv_of, emb.T @ dh_of
    g["emb"] = dq_of @ p["wq"].T + dk_of @ p["wk"].T + dv_of @ p["wv"].T + dh_of @ p["w1"].T
    return loss / n, g


class Adam:
    """Updates of all parameters as one vector; ``p``'s arrays become views of it."""

    def __init__(self, p, rate=3e-3):
        self.names = list(p)
        self.all = np.concatenate([p[k].ravel() for k in self.names])
        cuts = np.cumsum([0] + [p[k].size for k in self.names])
        for k, a, b in zip(self.names, cuts[:-1], cuts[1:]):
            p[k] = self.all[a:b].reshape(p[k].shape)
        self.m, self.v, self.work = (np.zeros_like(self.all) for _ in range(3))
        self.t, self.rate = 0, rate

    def step(self, g):
        self.t += 1
        f, work = self.all.dtype.type, self.work
        c1, c2 = 1 - 0.9 ** self.t, 1 - 0.98 ** self.t
        flat = np.concatenate([g[k].ravel() for k in self.names])
        np.subtract(flat, self.m, out=work)
        work *= f(0.1)
        self.m += work
        flat *= flat
        flat -= self.v
        flat *= f(0.02)
        self.v += flat
        np.multiply(self.v, f(1 / c2), out=work)
        np.sqrt(work, out=work)
        work += f(1e-8)
        np.multiply(self.m, f(self.rate / c1), out=flat)
        flat /= work
        self.all -= flat


def classes_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the symbols that puts those used alike into the same class of WITHIN, and their vectors.

    ``counts``: SYMBOLS x SYMBOLS bigram counts. Left and right contexts give each symbol a vector
    (singular vectors of the square-root counts); halving along the main direction, five times, makes the classes."""
    root = np.sqrt(counts + 0.0)
    left = root / np.maximum(np.linalg.norm(root, axis=1, keepdims=True), 1e-9)
    right = (root.T / np.maximum(np.linalg.norm(root.T, axis=1, keepdims=True), 1e-9))
    u, s, _ = np.linalg.svd(np.concatenate([left, right], axis=1), full_matrices=False)
    vec = (u[:, :DIM] * s[:DIM]).astype(np.float32)
    groups = [np.arange(SYMBOLS)]
    while len(groups[0]) > WITHIN:
        nxt = []
        for g in groups:
            z = vec[g] - vec[g].mean(0)
            axis = np.linalg.svd(z, full_matrices=False)[2][0]
            o = g[np.argsort(z @ axis, kind="stable")]
            nxt += [o[:len(o) // 2], o[len(o) // 2:]]
        groups = nxt
    order = np.concatenate(groups)
    scale = np.sqrt((vec ** 2).mean()) or 1.0
    return order, vec[order] / scale * 0.5


def bigram_tables(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log P(class | previous) and log P(place | class, previous); one more row for PAD.

    Witten-Bell: a previous symbol with T different followers gives T / (n + T) to the symbol's own share."""
    uni = (counts.sum(0) + 0.5) / (counts.sum() + 0.5 * SYMBOLS)
    n = counts.sum(1, keepdims=True)
    kinds = np.maximum((counts > 0).sum(1, keepdims=True), 1)
    prob = (counts + kinds * uni) / (n + kinds)
    prob = np.concatenate([prob, uni[None]]).reshape(SYMBOLS + 1, CLASSES, WITHIN)
    by_class = prob.sum(2)
    return np.log(by_class).astype(np.float32), np.log(prob / by_class[:, :, None]).astype(np.float32)
