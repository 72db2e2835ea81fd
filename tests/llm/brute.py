"""Plain versions of the operators for small inputs."""
import hashlib
import re

SPACE = re.compile(r"[\x20\x09-\x0D]+")


class UnionFind(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def union(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self[b] = a


def words(text):
    return (text or "").encode().lower().split()


def fingerprint(text, k=3):
    import xxhash
    w = words(text)
    if not w:
        return 0
    sh = [b" ".join(w)] if len(w) < k else [b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)]
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def id_order(i):
    return (i is None, i if i is not None else 0)


def targets(sizes, weights=(5, 2, 1), cap=3):
    """source -> target by resharing the excess round after round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: float(cap * sizes[s]) for s in over}


def copies(doc_id, rate, seed="mix"):
    h = int(hashlib.md5(f"{'' if doc_id is None else doc_id}|{seed}".encode()).hexdigest()[:8], 16) / 2**32
    return int(rate) + (h < rate - int(rate))
