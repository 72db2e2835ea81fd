import hashlib
import math
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hydroflow.llm import attention, langid, lm_scoring, mixing
from hydroflow.llm.bpe import default_path
from hydroflow.llm.common import fresh, own_shuffle, remainder, slices

SF = "/root/testdata/sf0.001"


def n_words(t):
    return len(brute.words(t))


def check_mix(rows, got):
    sizes = Counter()
    for i, t, s in rows:
        sizes[s] += n_words(t)
    target = brute.targets(sizes)
    want = Counter((i, n_words(t), sizes[s], round(target[s], 3),
                    n_words(t) * brute.copies(i, target[s] / sizes[s] if sizes[s] else 0)) for i, t, s in rows)
    assert Counter((r[0], r[1], r[2], round(r[3], 3), r[4]) for r in got) == want


@pytest.mark.parametrize("bound", [mixing.BROADCAST_BYTES, -1])
def test_mixing_edges(edge_docs, edge_rows, no_docs, monkeypatch, bound):
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", bound)
    docs = edge_docs.withColumn("Source_Size", F.lit(-1)).withColumn("copies", F.lit("x"))  # replaced, like "size"
    assert "size" in docs.columns
    out = mixing.mix_counts(docs).select("doc_id", "size", "source_size", "target", F.col("size") * F.col("copies")).collect()
    check_mix([(r[0], r[1], r[3]) for r in edge_rows], out)
    mixed = mixing.mix(edge_docs)
    assert mixed.columns == edge_docs.columns
    again = mixing.mix(edge_docs.repartition(5))
    assert Counter(r.asDict()["doc_id"] for r in mixed.collect()) == Counter(r.doc_id for r in again.collect())
    assert mixing.mix(no_docs).count() == 0


def test_op4_targets(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = mixing.op4(spark, SF).collect()
    check_mix(rows, [tuple(r) for r in got])
    assert all(r.taken <= 3 * r.size for r in got)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10, "d": 1000}, {"a": 0, "b": 5, None: 7}, {"a": 1}, {"a": 0}, {f"{i:03}": i * i for i in range(40)}])
def test_water_filling(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = brute.targets(sizes)
    for r in mixing.source_targets(df).collect():
        assert r.target == pytest.approx(want[r.source])


def setup():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 3, (attention.SYMBOLS, attention.SYMBOLS)).astype(float)
    order, vec = attention.classes_of(counts)
    assert sorted(order) == list(range(attention.SYMBOLS))
    p = {k: v + rng.standard_normal(v.shape) * 0.1 for k, v in attention.initial(vec).items()}
    return rng, p, attention.bigram_tables(counts[np.ix_(order, order)])


def test_windows_score_each_symbol_once():
    texts = [np.arange(n) for n in (1, 31, 32, 33, 100)]
    inputs, targets, of = attention.windows(texts, 7)
    for k, t in enumerate(texts):
        mine = targets[of == k].ravel()
        assert list(mine[mine >= 0]) == list(t)
        assert list(inputs[of == k][0][:attention.CONTEXT]) == [attention.PAD] * attention.CONTEXT
        assert inputs[of == k][0][attention.CONTEXT] == 7
    second = np.flatnonzero(of == 4)[1]
    before = attention.STEP - attention.CONTEXT
    assert list(inputs[second]) == [7, *range(99)][before:before + attention.CONTEXT + attention.STEP]


def test_gradients_and_paths_agree():
    rng, p, bigram = setup()
    inputs, targets, _ = attention.windows([rng.integers(0, attention.SYMBOLS, n) for n in (3, 40)], 3)
    loss, g = attention.gradients(p, bigram, inputs, targets)
    assert loss == pytest.approx(-attention.log_probs(p, bigram, inputs, targets).sum() / (targets >= 0).sum())
    for k in p:
        j = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        keep, e = p[k][j], 1e-5
        p[k][j] = keep + e
        up = attention.gradients(p, bigram, inputs, targets)[0]
        p[k][j] = keep - e
        down = attention.gradients(p, bigram, inputs, targets)[0]
        p[k][j] = keep
        assert (up - down) / (2 * e) == pytest.approx(g[k][j], rel=1e-3, abs=1e-8)


def test_probabilities_sum_to_one_and_look_back_only():
    rng, p, bigram = setup()
    inputs, targets, _ = attention.windows([rng.integers(0, attention.SYMBOLS, 40)], 3)
    many_in = np.repeat(inputs[1:2], attention.SYMBOLS, 0)
    many_out = np.repeat(targets[1:2], attention.SYMBOLS, 0)
    many_out[:, 2] = np.arange(attention.SYMBOLS)
    lp = attention.log_probs(p, bigram, many_in, many_out)[:, 2]
    assert np.exp(lp).sum() == pytest.approx(1, abs=1e-4)
    later = many_in[:1].copy()
    later[0, attention.CONTEXT + 3:] = 5
    assert attention.log_probs(p, bigram, later, many_out[:1])[0, 2] == pytest.approx(lp[0], abs=1e-6)


def test_every_symbol_sees_at_least_33_symbols_back():
    rng, p, bigram = setup()
    text = rng.integers(0, attention.SYMBOLS, 120)
    other = text.copy()
    other[64 - 33] = (text[64 - 33] + 1) % attention.SYMBOLS
    got = []
    for t in (text, other):
        inputs, targets, _ = attention.windows([t], 3)
        got.append(attention.log_probs(p, bigram, inputs, targets).ravel()[64])
    assert got[0] != got[1]


def brute_base(rows, folds=5, held=1):
    c = Counter()
    out = lambda i: zlib.crc32(str("" if i is None else i).encode()) % folds == held
    for i, t in rows:
        if not out(i):
            c.update(brute.words(t))
            c[None] += 1
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in rows:
        w = brute.words(t) + [None]
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want[(i, out(i), len(w), sum(c[x] > 0 for x in w), n, round(base, 3))] += 1
    return want


def test_lm_edges(edge_docs, edge_rows, no_docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "TOP_WORDS", 2)
    got = lm_scoring.lm_score(edge_docs, rounds=1).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == \
        brute_base([(r[0], r[1]) for r in edge_rows])
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm_scoring.lm_score(no_docs, rounds=1).count() == 0


@pytest.mark.parametrize("rounds", [1, 4])
def test_every_training_document_is_trained_on_once(spark, monkeypatch, rounds):
    docs = spark.createDataFrame([(i, f"text {i // 2} of many") for i in range(60)], "id long, text string")
    seen = []
    monkeypatch.setattr(lm_scoring, "LINE", 4)
    monkeypatch.setattr(lm_scoring, "_train_round", lambda dealt, model: seen.extend((r.h, r.line) for r in dealt.collect()))
    model = lm_scoring.fit(docs, lm_scoring.word_counts(docs), lm_scoring.ranks_path(), rounds=rounds)
    sub = lm_scoring.Subwords(lm_scoring.ranks_path())
    want = Counter()
    for r in docs.select(F.xxhash64("id", "text").alias("h"), "text").collect():
        n = len(sub.encode(brute.words(r.text))[0]) + 1
        want.update((r.h, j) for j in range(-(-n // 4)))
    assert Counter(seen) == want and model.ends == 60


def test_texts_are_split_twice(spark):
    """Once for the word counts, once into the symbols that training and scoring read."""
    docs = spark.createDataFrame([(i, f"text {i // 2} of many") for i in range(60)], "doc_id long, text string").cache()
    n, train = docs.count(), docs.where(remainder(F.col("doc_id"), 5) != 1).count()
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        read.add(1)
        return text

    lm_scoring.lm_score(docs.select("doc_id", told("text").alias("text")), rounds=2).collect()
    assert read.value == n + train


def test_split_words_equal_the_definition():
    odd = [b"  A\x00b \xff\xfe Z\x1c\x1d\x85q \xc2\xa0x", b"", b"   ", "ÀB c\x0b\x0cd".encode(), b"a A b\n", b"x" * 5000]
    for texts in (pa.array(odd, pa.binary()), pa.array([b"x", *odd], pa.binary()).slice(1), pa.array(["", ""]), pa.array([], pa.string()),
                  pa.array(["q  W"], pa.large_string())):
        cuts, at, words = lm_scoring.split_words(texts)
        words = words.to_pylist()
        assert len(set(words)) == len(words)
        assert [[words[i] for i in at[a:b]] for a, b in zip(cuts, cuts[1:])] == [lm_scoring.words_of(t) for t in texts.cast(pa.binary()).to_pylist()]


def test_lines_give_the_windows_of_whole_texts():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, attention.SYMBOLS, n).astype(np.int32) for n in (1, 64, 65, 200)]
    inputs, targets, _ = attention.windows(texts, 7)
    lines = []
    for t in texts:
        whole = np.concatenate([np.full(attention.CONTEXT, attention.PAD), [7], t])
        lines += [whole[i:i + 64 + attention.CONTEXT + 1] for i in range(0, len(t), 64)]
    got = attention.line_windows(lines)
    real = lambda i, t: Counter((*a[:attention.CONTEXT + (b >= 0).sum()], *b) for a, b in zip(i, t))
    assert real(*got) == real(inputs, targets)


def test_model_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD_TARGETS", 256)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    a, b = ({r.doc_id: r.score for r in lm_scoring.lm_score(docs.repartition(n), rounds=2).collect()} for n in (1, 7))
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], rel=1e-4) for i in a)


def brute_score(model, sub, text):
    """log10 probability by the definition: one symbol at a time, sums over plain loops."""
    p, (by_class, by_place) = {k: v.astype(float) for k, v in model.params.items()}, model.bigram
    t = [model.symbol[i] for w in brute.words(text) for i in sub.encode([w])[0]] + [model.end]
    out = sum(model.rest[i] for w in brute.words(text) for i in sub.encode([w])[0])
    before = [model.end, *t]
    for n, y in enumerate(t):
        seen = before[max(0, n // attention.STEP * attention.STEP - attention.CONTEXT):n + 1]
        x = p["emb"][seen]
        a = np.array([x[-1] @ p["wq"] @ (z @ p["wk"]) / attention.DIM ** 0.5 + p["rel"][len(seen) - 1 - i] for i, z in enumerate(x)])
        a = np.exp(a - a.max())
        h = np.maximum(x[-1] @ p["w1"] + (a / a.sum()) @ (x @ p["wv"]) @ p["w2"] + p["b"], 0)
        c, w = divmod(int(y), attention.WITHIN)
        for z, at in ((h @ p["wc"] + p["bc"] + by_class[seen[-1]], c), (h @ p["wt"][c] + p["bt"][c] + by_place[seen[-1], c], w)):
            out += z[at] - np.log(np.exp(z - z.max()).sum()) - z.max()
    return out / np.log(10)


def test_scores_equal_the_definition(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), "text").limit(40)
    model = lm_scoring.fit(docs, lm_scoring.word_counts(docs), lm_scoring.ranks_path(), rounds=1)
    sub = lm_scoring.Subwords(lm_scoring.ranks_path())
    texts = sorted((r.text for r in docs.collect()), key=len)[::5]
    got = lm_scoring.score_texts(model, sub, [lm_scoring.words_of(t) for t in texts]) / np.log(10)
    for t, s in zip(texts, got):
        assert s == pytest.approx(brute_score(model, sub, t), rel=1e-4)


def test_op1_beats_the_base(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = lm_scoring.op1(spark, "/root/testdata/sf0.01").collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == brute_base(docs)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_score_is_the_sum_over_the_text():
    sub = lm_scoring.Subwords(lm_scoring.ranks_path())
    counts = np.ones(sub.size, dtype=np.int64)
    model = lm_scoring.Model(counts)
    model.order(np.ones((attention.SYMBOLS, attention.SYMBOLS)))
    docs = [brute.words(t) for t in ("the cat sat", "", "a much longer text of many words " * 20)]
    together = lm_scoring.score_texts(model, sub, docs)
    for d, s in zip(docs, together):
        assert lm_scoring.score_texts(model, sub, [d])[0] == pytest.approx(s, abs=1e-3)


def test_subwords_equal_the_tokenizer_per_word():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(default_path())
    sub = lm_scoring.Subwords(lm_scoring.ranks_path())
    words = [w.encode() for w in ("the", "thntblere", "of,", "it's", "1234", "数字", "😀", "a\u00a0b", "\u00a0", "x\u3000", "é", "\x1c")] * 3
    ids, n = sub.ids(sub.numbers(words))
    want = [tok.encode(" " + w.decode(), add_special_tokens=False).ids for w in words]
    assert list(n) == [len(t) for t in want] and list(ids) == [x for t in want for x in t]
    sub.use({b"the": 7})
    assert list(sub.frequency[sub.numbers([b"the", b"of,"])]) == [7, -1]


def test_helpers(spark, edge_docs):
    assert fresh(edge_docs, "SIZE", "new", "new") == ["_SIZE", "new", "_new"]
    row = spark.createDataFrame([(5,), (None,)], "k long").select(own_shuffle("k").alias("k"), remainder(F.col("k"), 5).alias("m")).collect()
    assert [(r.k, r.m) for r in row] == [(5, zlib.crc32(b"5") % 5), (None, 0)]
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 100] * 100)], ["t"])
    assert sum(p.num_rows for p in slices(batch, 7, 1000)) == 100


def test_pipeline_against_brute_force(spark):
    from tokenizers import Tokenizer
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [(r.doc_id, r.text, r.source) for r in table.collect()]
    parser = langid.CrossParser(langid.sample_of(table))
    docs = [d for d, n, s in zip(docs, *parser.predict([d[1] or "" for d in docs])) if n != "und" and s >= 0.01]
    first = {}
    for d in sorted(docs):
        first.setdefault(brute.SPACE.sub(" ", d[1] or ""), d)
    docs = sorted(first.values())
    fps = [brute.fingerprint(d[1]) for d in docs]
    uf = brute.UnionFind()
    for i, a in enumerate(fps):
        uf.find(i)
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 2:
                uf.union(i, j)
    docs = [d for i, d in enumerate(docs) if uf.find(i) == i]
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += n_words(t)
    target = brute.targets(sizes)
    tok = Tokenizer.from_file(default_path())
    want = Counter()
    for i, t, s in docs:
        ids = tok.encode(t, add_special_tokens=False).ids
        row = (i, s, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        want[row] += brute.copies(i, target[s] / sizes[s])
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == +want


def test_pipeline_edges(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        out = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, SF)
            assert out.columns == docs.columns, name
        out = corpus_pipeline.STAGES[-1][1](spark, out, SF)
        assert "doc_id" in out.columns and (out.count() > 0) == (docs is edge_docs)
