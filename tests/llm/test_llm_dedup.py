import hashlib
import random
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from hydroflow.llm import components, embed_dedup, exact_dedup, line_dedup, simhash, substring

SF = "/root/testdata/sf0.001"


def norm(t):
    return brute.SPACE.sub(" ", t or "")


def test_exact_edges(edge_docs, edge_rows, no_docs):
    out = exact_dedup.exact_dedup(edge_docs)
    assert set(out.columns) == set(edge_docs.columns) | {"keep_id", "group_size", "kept"}
    groups = defaultdict(list)
    for r in edge_rows:
        groups[norm(r[1])].append(r[0])
    kept = Counter()
    for r in out.collect():
        g = groups[norm(r.text)]
        assert r.group_size == len(g)
        assert r.keep_id == min(g, key=brute.id_order)
        kept[norm(r.text)] += r.kept
    assert set(kept.values()) == {1}
    survivors = exact_dedup.drop_exact_duplicates(edge_docs)
    assert survivors.columns == edge_docs.columns
    assert sorted(norm(r.text) for r in survivors.collect()) == sorted(groups)
    assert exact_dedup.exact_dedup(no_docs).count() == 0


@pytest.mark.parametrize("digit", [(1, 1, 1), (2, 2, 4), (64, 8, 1 << 20)])
def test_radix_digits_agree(spark, digit):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(200)]
    rows = spark.createDataFrame([(i, (False, i, i), bytearray(t.encode())) for i, t in enumerate(texts)],
                                 "rid long, rank struct<no_id: boolean, id: long, rid: long>, bytes binary")
    got = {r.rid: (r.size, r.first.rid) for r in exact_dedup.equal_groups(rows, *digit).collect()}
    n = Counter(texts)
    assert got == {i: (n[t], texts.index(t)) for i, t in enumerate(texts) if n[t] > 1}


def test_op10_digests(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in exact_dedup.op10(spark, SF).collect():
        assert r.text_sha256 == hashlib.sha256(norm(docs[r.doc_id]).encode()).hexdigest()
        assert r.keep_id == min(i for i, t in docs.items() if norm(t) == norm(docs[r.doc_id]))


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 200)], [(199, i) for i in range(199)],
                                   [(random.Random(i).randint(0, 300), random.Random(i + 999).randint(0, 300)) for i in range(150)], [(5, 5)], []])
def test_components(spark, edges):
    uf = brute.UnionFind()
    for a, b in edges:
        if a != b:
            uf.union(a, b)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.root for r in got} == {n: uf.find(n) for n in list(uf)}


def test_fingerprints_match_the_definition(edge_rows):
    for r in edge_rows:
        if len(r[1] or "") < 1000:
            assert simhash.fingerprint(r[1]) == brute.fingerprint(r[1])


def brute_components(fps, bits):
    uf = brute.UnionFind()
    for i, a in enumerate(fps):
        uf.find(a)
        for b in fps[:i]:
            if (a ^ b).bit_count() <= bits:
                uf.union(a, b)
    return {f: uf.find(f) for f in fps}


def planted(seed, n=60, bits=64):
    rng = random.Random(seed)
    out = {0}
    for _ in range(n):
        f = rng.getrandbits(bits)
        out.add(f)
        for _ in range(rng.choice([0, 0, 1, 5])):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            out.add(f)
    return sorted(out)


@pytest.mark.parametrize("bits,bucket,layout", [
    (2, 64, None), (2, 1, None), (1, 64, None), (3, 2, None), (3, 64, None),
    (2, 3, [(list(range(32)), 1), (list(range(32, 64)), 0)]), (2, 64, [(list(range(16 * i, 16 * i + 16)), t) for i, t in enumerate((0, -1, 0, 0))])])
def test_links_are_whole(spark, bits, bucket, layout):
    fps = planted(bits * 10 + bucket)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = simhash.fingerprint_links(df, bits, bucket, layout).collect()
    u64 = lambda v: v % (1 << 64)
    uf = brute.UnionFind()
    for r in links:
        assert (u64(r.a) ^ u64(r.b)).bit_count() <= bits
        uf.union(u64(r.a), u64(r.b))
    want = brute_components(fps, bits)
    assert {f: uf.find(f) for f in fps} == want


def test_allotment_meets_the_general_pigeonhole_sum(spark):
    fps = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in planted(3, 200)], "fp long")
    layout = simhash.plan(fps, 2)
    assert sum(t for _, t in layout) == 2 - len(layout) + 1
    assert sorted(b for bits, _ in layout for b in bits) == list(range(64))
    assert simhash.allot([[0, 5, 9], [0, 1, 2], [0, 7, 9]], 0) == (7, [0, 1, -1])


def check_simhash(rows, got):
    fps = [brute.fingerprint(r[1]) for r in rows]
    comp = brute_components(sorted(set(fps)), 2)
    least = {}
    for r, f in zip(rows, fps):
        least[comp[f]] = min([least.get(comp[f], r[0]), r[0]], key=brute.id_order)
    want = Counter((r[0], f"{f:016x}", least[comp[f]]) for r, f in zip(rows, fps))
    assert Counter((g.doc_id, g.fingerprint, g.component_id) for g in got) == want
    assert sum(g.kept for g in got) == len(least)


def test_simhash_edges(edge_docs, edge_rows, no_docs):
    check_simhash(edge_rows, simhash.simhash_dedup(edge_docs).collect())
    kept = simhash.drop_near_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns
    assert simhash.simhash_dedup(no_docs).count() == 0
    assert simhash.drop_near_duplicates(no_docs).count() == 0


def test_op5(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_simhash(rows, simhash.op5(spark, SF).collect())


def brute_vectors(rows, cosine=0.93):
    ok = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    uf, n = brute.UnionFind(), Counter()
    for i in range(len(rows)):
        uf.find(i)
    for k, i in enumerate(ok):
        for j in ok[:k]:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                n[i] += 1
                n[j] += 1
                uf.union(i, j)
    least = {}
    for i, r in enumerate(rows):
        c = uf.find(i)
        least[c] = min([least.get(c, r[0]), r[0]], key=brute.id_order)
    return Counter((r[0], n[i], least[uf.find(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize("block", [4, 256])
def test_embeddings(spark, block):
    rng = np.random.default_rng(0)
    rows = [(None, [1.0, 0.0], 1), (900, None, 1), (901, [0.0, 0.0], 1), (902, [float("nan"), 1.0], 1), (903, [1.0, 2.0], None),
            (904, [], 1), (905, [1.0, None], 1), (906, [float("inf"), 1.0], 1), (907, [2.0, 0.0], 1), (907, [2.0, 0.0], 1), (908, [1e30, 0.0], 1)]
    for c in range(8):
        mid = rng.standard_normal(16)
        for k in range(12):
            v = mid + rng.standard_normal(16) * 0.02 * (k % 4)
            rows.append((len(rows), [float(np.float32(x)) for x in v], c % 2))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    got = embed_dedup.embedding_dedup(df, block=block).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == brute_vectors(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert embed_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_op6_against_all_pairs(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = embed_dedup.op6(spark, SF).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == brute_vectors(rows)
    assert embed_dedup.recall_at(0.93) > 0.95


def test_hot_bucket_rows_stay_linear(spark):
    """400 linked vectors have 79,800 links, but a row comes out per vector and pair of blocks only."""
    rng = np.random.default_rng(3)
    mid = rng.standard_normal(32)
    rows = [(i, (mid + 0.01 * rng.standard_normal(32)).tolist(), 0, f"x{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links string").repartition(4)
    linked = embed_dedup.vector_links(embed_dedup.representatives(df, "vec_id", "embedding", "label"), block=100)
    assert sum(r.links for r in linked.collect()) == 400 * 399
    assert linked.count() <= 24 * 400 * 5
    got = embed_dedup.embedding_dedup(df, block=100)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]      # clashing extra columns are not read
    assert {(r.n_links, r.component_id) for r in got.collect()} == {(399, 0)}


def test_pairs_at_the_limit_meet(spark):
    """Pairs at exactly the least cosine share a bucket as often as the theory says."""
    rng = np.random.default_rng(5)
    a = embed_dedup._unit(rng.standard_normal((2000, 32)))
    w = rng.standard_normal((2000, 32))
    w = embed_dedup._unit(w - (w * a).sum(1, keepdims=True) * a)
    b = 0.93 * a + np.sqrt(1 - 0.93 ** 2) * w
    keys = [embed_dedup._hash_keys(x, embed_dedup.HASHES, embed_dedup.TABLES, embed_dedup.WIDTH) for x in (a, b)]
    met = (keys[0] == keys[1]).any(1).mean()
    assert abs(met - embed_dedup.recall_at(0.93)) < 0.02 and met > 0.95


def brute_spans(rows, unit="sentence", min_words=25):
    """rows (order, text) in rank order -> {order: [(start, end)]}."""
    seen, out = set(), {}
    pattern = substring._UNITS[unit]
    for key, text in rows:
        spans, run = [], []
        for m in list(pattern.finditer(text or "")) + [None]:
            u = m and b" ".join(m.group().encode().lower().split())
            if m and not u:
                continue
            if m and u in seen:
                run.append((m.start(), m.end(), len(u.split())))
                continue
            if run and sum(n for *_, n in run if n > 1) >= min_words:
                spans.append((run[0][0], run[-1][1]))
            run = []
            if m:
                seen.add(u)
        out[key] = spans
    return out


def union(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def test_substring(spark, edge_docs, no_docs):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    wants = {unit: brute_spans(sorted(docs.items()), unit, least) for unit, least in (("paragraph", 0), ("sentence", 25))}
    got = {unit: defaultdict(list) for unit in wants}
    for r in substring.op2(spark, SF).collect():
        got[r.unit][r.doc_id].append((r.start, r.end))
        assert r.keep_doc_id <= r.doc_id
    for unit, want in wants.items():
        assert {k: sorted(v) for k, v in got[unit].items()} == {k: v for k, v in want.items() if v} != {}
    clean = substring.substring_dedup(spark.read.parquet(f"{SF}/documents.parquet"))
    for r in clean.collect():
        t, at, left = docs[r.doc_id], 0, []
        spans = union(wants["paragraph"][r.doc_id] + wants["sentence"][r.doc_id])
        for a, b in spans:
            left.append(t[at:a])
            at = b
        assert r.text == "".join(left) + t[at:]
        assert [(s.start, s.end) for s in r.removed] == spans
    out = substring.substring_dedup(edge_docs, min_words=2)
    assert out.count() == edge_docs.count() and set(out.columns) == set(edge_docs.columns) | {"removed"}
    assert out.where("doc_id = 1").first().text is None
    assert substring.substring_dedup(no_docs).count() == 0


def test_repeats_of_any_length(spark):
    """Whole repeated paragraphs go at any length, repeated lines where asked for; the earliest stays."""
    rows = [(3, "One\n\nshort text."), (1, "short  text.\nmore here"), (2, "Short text."), (5, "one"), (4, "more here\n\nSHORT text.\n\n one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    by = lambda **kw: {r.doc_id: r.text for r in substring.substring_dedup(df, **kw).collect()}
    assert by() == {1: "short  text.\nmore here", 2: "Short text.", 3: "One\n\n", 4: "more here\n\n", 5: ""}  # consecutive repeats are one span
    for least in (0, 1, 2):
        want = brute_spans(sorted(rows), "line", least)
        got = {r.doc_id: [(s.start, s.end) for s in r.removed] for r in substring.substring_dedup(df, unit="line", min_words=least).collect()}
        assert got == want


def test_passage_inside_a_line(spark):
    p = "one two three four five six. " + "seven eight nine ten eleven twelve thirteen fourteen. " + "w " * 15 + "end. "
    rows = [(1, "Start of it " + p + "Tail one."), (2, "Quite another head\n and " + p + "Other tail."), (3, "nothing shared at all here. none.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in substring.substring_dedup(df, min_words=20).collect()}
    assert out[1].text == rows[0][1] and out[3].text == rows[2][1]
    assert "seven" not in out[2].text and out[2].text.endswith("Other tail.")
    for unit in ("line", "paragraph"):
        same = spark.createDataFrame([(1, "a b c\nd e"), (2, "A  b c\nd f"), (3, "a b c\nd e")], "doc_id long, text string")
        got = {r.doc_id: r.text for r in substring.substring_dedup(same, unit=unit, min_words=2).collect()}
        assert got[1] == "a b c\nd e"
        assert got[2] == ("\nd f" if unit == "line" else "A  b c\nd f")
        assert got[3] == ""


def test_scripts_without_blanks_count_characters(spark):
    han = "\n".join(f"第{chr(0x4e00 + i)}行在这里写了十个字以上" for i in range(4))
    thai = "ภาษาไทยเขียนติดกันโดยไม่มีช่องว่างระหว่างคำ"
    df = spark.createDataFrame([(i, t) for i, t in enumerate([han, thai, "短い行"] * 2)], "doc_id long, text string")
    for unit, last in (("sentence", "短い行"), (None, "")):  # a whole paragraph goes at any length
        out = {r.doc_id: r.text for r in substring.substring_dedup(df, unit=unit).collect()}
        assert [out[i] for i in range(6)] == [han, thai, "短い行", "", "", last]


def brute_lines(rows):
    seen, out = set(), {}
    for key, text in rows:
        raw = (text or "").split("\n")
        lines = [brute.re.sub(r"[\x20\x09\x0B-\x0D]+", " ", x).strip(" ") for x in raw]
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i:i + 3])
            if any(w):
                if w in seen:
                    gone |= {i, i + 1, i + 2}
                seen.add(w)
        out[key] = "\n".join(x for i, x in enumerate(raw) if i not in gone)
    return out


def test_line_dedup(spark, edge_docs, no_docs):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice("abc") + " " * rng.randint(0, 1) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(df).collect()}
    assert got == brute_lines(rows)
    out = line_dedup.line_dedup(edge_docs)
    assert out.count() == edge_docs.count()
    assert {r.doc_id: r.text for r in out.where("doc_id in (13, 14)").collect()} == {13: "a\nb\nc\nd", 14: "x\n"}
    assert out.where(F.col("text").isNull()).count() == 1
    assert line_dedup.line_dedup(no_docs).count() == 0
