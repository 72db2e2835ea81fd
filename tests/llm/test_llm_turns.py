import random

import brute_turns
import numpy as np
import pytest
from pyspark.sql import functions as F

from hydroflow.llm import prefix_trie, quality, turn_repair
from hydroflow.llm.common import stored

SF = "/root/testdata/sf0.01"
LONG = "wort " * 30_000 + "."
TURNS = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes?"), (1, 1, "assistant", "Yes?"), (1, 2, None, "x."), (1, 3, "user", None), (1, 4, "User", "cut"), (1, None, "system", "s."),
    (2, None, None, None), (2, None, None, None), (3, 5, "", ""), (3, 9, "assistant", LONG), (None, 1, "user", "a."), (None, 2, "assistant", "b!"), (None, 0, "user", "a."),
    (4, 0, "system", "Be.\n"), (4, 1, "system", "Be.\n"), (4, 2, "user", "q? \t"), (6, 0, "user", "Hi."), (6, 1, "assistant", "Yes?"), (7, 3, "user", "é 😀."), (-3, 0, "user", "Hi."),
    (0, 0, "user", "Hi."), (0, 1, "assistant", "Yes?"), (5, 0, "user", "Hi."), (5, 0, "user", "Hi."), (5, 1, "assistant", "No"),
]
CLASH = ["conv", "step", "digest", "block", "key"]


@pytest.fixture(scope="module")
def edge_turns(spark):
    schema = "conv_id long, turn long, role string, text string, " + ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame([r + tuple(CLASH) for r in TURNS], schema).repartition(3)


def repairs(df, bits):
    blocks = turn_repair.audited(df, bits=bits)
    hashes = {r.conv: r.repaired_sha256 for r in turn_repair.digests(turn_repair.repaired(df, blocks)).collect()}
    none = brute_turns.hashlib.sha256(b"").hexdigest()
    return {r.conv: (*tuple(r)[1:], hashes.get(r.conv, none)) for r in turn_repair.report(blocks).collect()}


def by_conv(rows):
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    return out


def test_audit_codes_against_all_states():
    rng = random.Random(5)
    cases = [[(rng.randrange(4), rng.choice([0, 0, 1, 2])) for _ in range(rng.randrange(30))] for _ in range(800)]
    audits, costs = turn_repair.audit_codes(["".join(chr(65 + 3 * i + f) for i, f in c) for c in cases])
    for c, a, n in zip(cases, audits, costs, strict=True):
        assert (n, a) == brute_turns.best_audit([("sua "[i], f) for i, f in c])


@pytest.mark.parametrize("bits", [16, 1, 0])
def test_repair_edges(edge_turns, bits):
    got = repairs(edge_turns, bits)
    assert got == {c: brute_turns.repair(rows) for c, rows in by_conv(TURNS).items()}


def test_repair_of_one_long_conversation(spark):
    rng = random.Random(8)
    rows = [(7, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "", "c!", f"{t}.", f"{t}"])) for t in range(400)]
    got = repairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4), 4)
    assert got == {7: brute_turns.repair([r[1:] for r in rows])}


def test_repaired_rows_read_as_they_should(edge_turns):
    blocks = turn_repair.audited(edge_turns)
    convs = {}
    for r in turn_repair.repaired(edge_turns, blocks).collect():
        convs.setdefault(r.conv, []).append(r)
    for rows in convs.values():
        assert [r.step for r in rows] == list(range(len(rows)))
        assert brute_turns.re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in rows))


def test_repair_of_nothing(edge_turns):
    none = edge_turns.limit(0)
    blocks = turn_repair.audited(none)
    assert blocks.count() == 0 and turn_repair.repaired(none, blocks).count() == 0


def test_op12(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r)[1:] for r in turn_repair.op12(spark, SF).collect()} == brute_turns.op12(rows)


def nodes(df, width, bits):
    own = stored(prefix_trie.turns(df))
    cut = F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    heads = stored(own.select("conv").distinct().withColumns({"base": F.col("conv") - F.col("conv") % 5, "cut": cut}))
    got = prefix_trie.trie(prefix_trie.rebuilt(own, heads), heads.select("conv"), width=width, bits=bits).collect()
    assert len(got) == len({(r.conv_id, r.depth) for r in got})
    return {(r.conv_id, r.depth): tuple(r)[2:] for r in got}


def python_remainder(rows):
    """The brute-force version's % for negative ids as in SQL."""
    return [r for r in rows if r[0] is None or r[0] >= 0]


@pytest.mark.parametrize("width,bits", [(64, 14), (2, 1), (3, 0)])
def test_trie_edges(spark, edge_turns, width, bits):
    df = edge_turns.where("conv_id is null or conv_id >= 0")
    assert nodes(df, width, bits) == brute_turns.op13(python_remainder(TURNS))


@pytest.mark.parametrize("width,bits", [(64, 14), (2, 2), (4, 1), (1, 3)])
def test_trie_across_bands_and_shards(spark, width, bits):
    rng = random.Random(3)
    rows = [(c, t, rng.choice("ua"), rng.choice(["x", "yy"]) if t > 6 or rng.random() < 0.1 else "z") for c in range(50) for t in range(rng.choice([0, 1, 3, 9, 20]))]
    rows += [(1000 + c, t, "u", "z") for c in range(40) for t in range(5)]  # many copies of one conversation
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert nodes(df, width, bits) == brute_turns.op13(rows)


def test_trie_negative_ids_and_nothing(edge_turns):
    assert (-3, 0) in nodes(edge_turns, 64, 14)
    assert nodes(edge_turns.limit(0), 64, 14) == {}


def test_op13(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {(r.conv_id, r.depth): tuple(r)[2:] for r in prefix_trie.op13(spark, SF).collect()} == brute_turns.op13(rows)


# quality classifier

def plain_statistics(text):
    """A few statistics by their definitions."""
    data = (text or "").encode()
    words = data.split()
    letters = sum(chr(b).isascii() and chr(b).isalpha() or b > 127 for b in data)
    lines = [x.split() for x in data.split(b"\n") if x.split()]
    return {
        "log_bytes": np.log1p(len(data)), "log_words": np.log1p(len(words)), "letters": letters / max(len(data), 1),
        "upper": sum(65 <= b <= 90 for b in data) / max(letters, 1), "distinct_words": len(set(words)) / max(len(words), 1),
        "followed_by_itself": sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(len(words), 1),
        "top_word": max(map(words.count, set(words)), default=0) / max(len(words), 1), "log_lines": np.log1p(len(lines)),
        "short_lines": sum(len(x) < 4 for x in lines) / max(len(lines), 1), "word_bytes": sum(map(len, words)) / max(len(words), 1),
        "longest_word": np.log1p(max(map(len, words), default=0)), "stop_words": sum(w[-1:] in b".!?" for w in words) / max(len(words), 1)}


def test_statistics(spark):
    texts = ["", "a b b  b c\n\nABC d!. é", "x" * 5000 + " y", None, "  \n ", "one\ntwo three. FOUR!", "数字 数字\x0b字", "a", LONG, "b b", "b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").coalesce(1)
    for r in quality.with_statistics(df, "s").collect():
        for k, v in plain_statistics(texts[r.doc_id]).items():
            assert dict(zip(quality.STATISTICS, r.s, strict=True))[k] == pytest.approx(v, rel=1e-5), (k, texts[r.doc_id])


def walk(model, row):
    total = model.prior
    for feature, cut, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + 1 + bool(row[feature[node]] > cut[node])
        total += leaf[node - len(feature)]
    return total


def test_trees_learn_and_descend():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    s = model.score(x[2000:])
    assert ((s > 0.5) == y[2000:]).mean() > 0.95
    assert np.allclose(model.margin(x[:50]), [walk(model, r) for r in x[:50]])


def test_first_tree_is_the_best_single_cut():
    x = np.array([[0.0], [1], [2], [3], [4], [5]] * 20, np.float32)
    y = (x[:, 0] >= 3).astype(float)
    model = quality.fit(x, y, trees=1, depth=1)
    assert model.cut[0, 0] == 2 and model.prior == 0
    assert np.allclose(model.leaf[0], np.array([-30, 30]) / (15 + quality.L2) * quality.RATE)


def test_quality_edges(spark, edge_docs, no_docs):
    stats = stored(quality.with_statistics(edge_docs, "s"))
    labels = spark.createDataFrame([(7, 1), (7, 0), (3, 1), (None, 1), (99, 0), (2, None), (4, 0)], "doc_id long, quality int")
    out = quality.score(stats, quality.learn(stats, labels, "s"), "s")
    assert out.count() == edge_docs.count() and out.where("not score between 0 and 1").count() == 0
    unlearned = quality.score(stats, quality.learn(stats, labels.limit(0), "s"), "s")
    assert {(r.score, r.predicted) for r in unlearned.collect()} == {(0.5, 1)}
    empty = quality.with_statistics(no_docs, "s")
    assert quality.score(empty, quality.learn(empty, labels, "s"), "s").count() == 0


def test_op11_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = quality.op11(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(got) > 500
    assert (got.predicted == got.quality).mean() > 0.97
    assert got[got.quality == 0].predicted.mean() < 0.1
