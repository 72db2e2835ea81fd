"""Plain versions of the conversation operators."""
import hashlib
import re
import zlib
from collections import defaultdict


def last_visible(text):
    m = re.findall(r"[^\x20\x09-\x0D]", text)
    return m[-1] if m else None


def turn_order(row):
    turn, role, text = row
    same = f"{len(role.encode())}:{role}:{text}"
    return (turn is not None, turn or 0, role.encode(), hashlib.sha256(same.encode()).digest())


def damaged(rows):
    """rows: (conv, turn, role, text) -> the same after damage, in order."""
    out = []
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if h == 0:
            continue
        x = "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x
        out += [(c, t, "user" if h == 4 else r, x)] * (2 if h == 3 else 1)
    return out


def best_audit(rows):
    """rows: (initial, fault) with fault 0 sound, 1 truncated, 2 to delete -> least (cost, audit), by all states with their strings."""
    nxt = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserts(best):
        for _ in range(4):
            for q, (c, a) in list(best.items()):
                best[nxt[q]] = min(best.get(nxt[q], (10**9, "")), (c + 2, a + "I"))
        return best

    best = {"": (0, "")}
    for initial, fault in rows:
        new = {}
        for q, (c, a) in inserts(best).items():
            moves = [(q, 3, "D")]
            if fault < 2:
                moves.append((nxt[q], 2 + fault, "R"))
                if initial == nxt[q] or initial == "s" and q == "":
                    moves.append((initial, fault, "K"))
            for p, d, e in moves:
                new[p] = min(new.get(p, (10**9, "")), (c + d, a + e))
        best = new
    return min(v for q, v in inserts(best).items() if q in ("", "a"))


def repair(rows):
    """rows: (turn, role, text) of one conversation after damage."""
    rows = sorted(rows, key=turn_order)
    seen, marks, n = set(), [], [0, 0, 0]
    for _, role, text in rows:
        end = last_visible(text)
        fault = 2 if end is None or (role, text) in seen else int(end not in ".!?")
        if end is None:
            n[0] += 1
        elif fault == 2:
            n[1] += 1
        elif fault:
            n[2] += 1
        seen.add((role, text))
        marks.append((role[:1], fault))
    cost, audit = best_audit(marks)
    left, state, out = iter(rows), "", []
    for e in audit:
        row = next(left) if e != "I" else None
        if e == "D":
            continue
        state = "s" if e == "K" and row[1][0] == "s" else "a" if state == "u" else "u"
        out.append(f"{row[1]}:{row[2]}" if e == "K" else f"{'user' if state == 'u' else 'assistant'}:{row[2] if row else ''}")
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[0] + b[0] for a, b in zip(marks, marks[1:], strict=False)]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *n, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def op12(rows):
    convs = defaultdict(list)
    for c, t, r, x in damaged(rows):
        convs[c].append((t, r, x))
    return {c: repair(convs[c]) for c in {r[0] for r in rows}}


def op13(rows):
    """-> {(conv_id, depth): (parent, n_convs, n_children, n_leaves, saved, ends)}"""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t, r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v, key=turn_order)] for c, v in own.items()}
    trie = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            trie.setdefault(seq[:d], [[], []])[0].append(c)
        trie[seq][1].append(c)
    kids = defaultdict(list)
    for seq in trie:
        if seq:
            kids[seq[:-1]].append(seq)
    sums = {}
    for seq in sorted(trie, key=len, reverse=True):
        own_saved = (len(trie[seq][0]) - 1) * len(seq[-1][1].encode()) if seq else 0
        sums[seq] = (sum(sums[k][0] for k in kids[seq]) or 1, own_saved + sum(sums[k][1] for k in kids[seq]))
    return {(min(m), len(seq)): (min(trie[seq[:-1]][0]) if seq else None, len(m), len(kids[seq]), *sums[seq],
                                 hashlib.sha256(",".join(map(str, sorted(e))).encode()).hexdigest()) for seq, (m, e) in trie.items()}
