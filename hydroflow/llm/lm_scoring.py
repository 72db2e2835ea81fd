"""Language-model scoring: a causal self-attention model on subword ids, next to a word unigram base.

Statistics, all over every training document and summed by Spark:
* word counts (the base, and through each distinct word's subwords the subword counts);
* counts of neighbouring symbols, where the symbols are the most frequent subwords, one for all others, and the end.
  They give the classes, the first embedding and the bigram that the model starts from.
Texts are split into words twice, in Arrow: for the word counts, then every text is stored as its symbols, with all that
its score needs beside the model, so that training and scoring read symbols only.
Training: the training documents are cut into lines of symbols, which are dealt by hash over ``ROUNDS`` rounds and
the shards of a round (``shards_of``), so that each is trained on once, at every size of the corpus, and the model does not
depend on how the table is split. In a round each shard trains a copy of the current model in numpy, then the copies are
averaged, weighted by symbols. The model and the bigram table have a fixed size; that is all that is sent to the tasks, with the ``TOP_WORDS`` most frequent words' counts (words of up to ``TOP_BYTES`` bytes).
Scoring: whole texts; overlapping windows score each symbol once with batched masked attention. Words that are not
among the top ones meet their count in a join.

A subword outside the symbols costs the shared symbol's probability times its smoothed share among the others, so
probabilities sum to one over all subword sequences.

Defined results: null text counts as empty (its only token is the end); a null id counts as the empty text in the split and
rows that repeat an id are scored each; with no training document every count is 0; an empty table gives an empty table; extra
columns are not carried."""
from __future__ import annotations

import math
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention as A
from .common import map_arrow, quoted, remainder, slices, stored, with_fields

TOP_WORDS = 100_000
TOP_BYTES = 64
ROUNDS = 4
BATCH_WINDOWS = 64
LINE = 4096  # targets of a line, the unit that is dealt
SHARD_TARGETS = 1 << 18  # fewer would leave a copy of a small corpus too few steps
SCORE_WINDOWS = 512
MEMO_WORDS = 300_000  # more would save few encodings: most words beyond are rare
REST, END = 0, 1  # symbols before they are ordered by class
_FLUSH = 500_000


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words after lower-casing A-Z (bytes: other letters and blanks beyond ASCII stay as they are)."""
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"").lower().split()


def ranks_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Subwords:
    """Distinct words met by this worker, each encoded once, with their numbers; ``path``: a file of ranks."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokenizer = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.begins = np.zeros(self.size, dtype=bool)  # a word's first subword holds the blank before it
        self.begins[[i for b, i in ranks.items() if b.startswith(b" ")]] = True
        self.top: dict[bytes, int] = {}
        self.clear()

    def clear(self):
        self.number: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.int32)  # all words' subwords in a row, with room to grow
        self.start = np.zeros(1 << 14, dtype=np.int64)
        self.count = np.zeros(1 << 14, dtype=np.int64)
        self.frequency = np.zeros(1 << 14, dtype=np.int64)  # in ``top``, -1: not there
        self.used = 0

    def use(self, top: dict[bytes, int]):
        """Frequencies to give with the words' numbers."""
        if self.top is not top:
            self.top = top
            self.clear()

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Subwords of the words in a row, and how many each has: many words are encoded as one text and cut
        at the subwords that begin with a blank (word by word if a word has such a one inside)."""
        flat, sizes = [], []
        for i in range(0, len(words), 5_000):
            some = [w.decode("utf-8", "replace") for w in words[i:i + 5_000]]
            ids = np.array(self.tokenizer.encode_ordinary(" " + " ".join(some)), dtype=np.int32)
            at = np.flatnonzero(self.begins[ids])
            if len(at) != len(some):
                each = [self.tokenizer.encode_ordinary(" " + w) for w in some]
                ids, n = np.array([x for t in each for x in t], dtype=np.int32), np.array([len(t) for t in each])
            else:
                n = np.diff(np.append(at, len(ids)))
            flat.append(ids)
            sizes.append(n)
        return (np.concatenate(flat), np.concatenate(sizes).astype(np.int64)) if flat else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """A number for every word; ``ids`` gives their subwords."""
        if len(self.number) > MEMO_WORDS:
            self.clear()
        number = self.number
        new = list({w for w in words if w not in number})
        if new:
            ids, sizes = self.encode(new)
            n, end = len(number), len(number) + len(new)
            self.flat = _room(self.flat, self.used + len(ids))
            self.start, self.count, self.frequency = (_room(x, end) for x in (self.start, self.count, self.frequency))
            self.flat[self.used:self.used + len(ids)] = ids
            self.start[n:end] = self.used + np.cumsum(sizes) - sizes
            self.count[n:end] = sizes
            self.frequency[n:end] = [self.top.get(w, -1) for w in new]
            self.used += len(ids)
            number.update(zip(new, range(n, end)))
        return np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Subwords of a run of words, and how many each has."""
        n = self.count[numbers]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.start[numbers] - (ends - n), n) + np.arange(int(n.sum()))], n


def _room(a: np.ndarray, size: int) -> np.ndarray:
    return a if size <= len(a) else np.concatenate([a, np.zeros(max(size - len(a), len(a)), dtype=a.dtype)])


_subwords: dict[str, Subwords] = {}


def _worker(path: str) -> Subwords:
    if path not in _subwords:
        _subwords[path] = Subwords(path)
    return _subwords[path]


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of the texts as ``words_of`` gives them: where each text's begin (and the last one's end), the number of
    every word among the distinct ones, and those (binary)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.binary()).view(pa.string())))
    offsets, words = lists.offsets.to_numpy(), lists.values
    real = pc.binary_length(words).to_numpy() > 0  # blanks at an end of a text leave an empty one
    cuts = np.concatenate([[0], np.cumsum(real)])[offsets]
    coded = (words if real.all() else words.filter(pa.array(real))).dictionary_encode()
    return cuts, coded.indices.to_numpy(), coded.dictionary.view(pa.binary())


def word_counts(train: DataFrame) -> DataFrame:
    """word, c over all training texts; counted within a task first."""
    def merged(parts):
        got = pa.Table.from_batches(parts).group_by("word", use_threads=False).aggregate([("c", "sum")])
        return pa.table({"word": got["word"], "c": got["c_sum"]}).to_batches(max_chunksize=100_000)

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            for part in slices(batch, max_rows=2_000, max_bytes=4 << 20):
                _, at, words = split_words(part.column("text"))
                held.append(pa.RecordBatch.from_arrays([words, pa.array(np.bincount(at, minlength=len(words)), pa.int64())], ["word", "c"]))
                rows += len(words)
                if rows > 2 * _FLUSH:
                    held = merged(held)
                    rows = sum(x.num_rows for x in held)
                    if rows > _FLUSH:
                        yield from held
                        held, rows = [], 0
        if held:
            yield from merged(held)
        held.clear()
        pa.default_memory_pool().release_unused()  # the worker lives on

    return map_arrow(train.select("text"), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def subword_counts(words: DataFrame, path: str) -> np.ndarray:
    """Occurrences of every subword id, from the distinct words (at most one row per id comes back)."""
    def run(batches):
        sub = _worker(path)
        total = np.zeros(sub.size, dtype=np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 50_000):
                part = batch.slice(i, 50_000)
                flat, n = sub.encode(part.column("word").to_pylist())
                total += np.bincount(flat, weights=np.repeat(part.column("c").to_numpy(), n), minlength=sub.size).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "c"])

    out = np.zeros(_worker(path).size, dtype=np.int64)
    for r in map_arrow(words, run, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).collect():
        out[r["id"]] = r["c"]
    return out


def encoded(rows: DataFrame, model: Model, top: dict[bytes, int], path: str) -> DataFrame:
    """``rows`` (id, text and more) without the text, and: its hash; n_tokens; of its words in ``top``, their number (known)
    and the sum of log10(c + 0.5) (base); its other words (tail); the natural log of the shares of its subwords outside
    the symbols (rest); its symbols with the end, after ``CONTEXT`` PADs and the end as a line has them (int16)."""
    shared = rows.sparkSession.sparkContext.broadcast((model.symbol, model.rest, top))
    first = np.array([A.PAD] * A.CONTEXT + [END], dtype=np.int16)
    last = np.array([END], dtype=np.int16)

    def run(batches):
        symbol, rest, top = shared.value
        symbol = symbol.astype(np.int16)
        sub = _worker(path)
        sub.use(top)
        for batch in batches:
            for part in slices(batch, max_rows=1_000, max_bytes=2 << 20):
                cuts, at, words = split_words(part.column("text"))
                words = words.to_pylist()
                numbers = sub.numbers(words)
                c = sub.frequency[numbers]
                log = np.where(c >= 0, np.log10(np.maximum(c, 0) + 0.5), 0.0)
                rare = np.flatnonzero((c < 0)[at])
                of = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
                tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, cuts).astype(np.int32)),
                                                pa.array(words, pa.binary()).take(pa.array(at[rare])))
                ids, n = sub.ids(numbers[at])
                sym, ends = symbol[ids], np.concatenate([[0], np.cumsum(n)])[cuts]
                shares = rest[ids]
                more = {"n_tokens": pa.array(np.diff(cuts) + 1, pa.int64()),
                        "known": pa.array(np.bincount(of, weights=(c >= 0)[at], minlength=len(cuts) - 1).astype(np.int64)),
                        "base": pa.array(np.bincount(of, weights=log[at], minlength=len(cuts) - 1)), "tail": tail,
                        "rest": pa.array([shares[a:b].sum() for a, b in zip(ends, ends[1:])], pa.float64()),
                        "symbols": pa.array([np.concatenate((first, sym[a:b], last)).tobytes() for a, b in zip(ends, ends[1:])], pa.binary())}
                kept = [x for x in part.schema.names if x != "text"]
                yield pa.RecordBatch.from_arrays([part.column(x) for x in kept] + list(more.values()), kept + list(more))
        sub.use({})  # training and scoring, which come next in this worker, need no words
        pa.default_memory_pool().release_unused()

    rows = rows.select(*[x for x in rows.columns if x != "text"], F.xxhash64("id", "text").alias("h"), "text")
    return map_arrow(rows, run, with_fields(rows.drop("text").schema, ("n_tokens", "long"), ("known", "long"), ("base", "double"),
                                            ("tail", "array<binary>"), ("rest", "double"), ("symbols", "binary")))


def bigram_counts(texts: DataFrame) -> np.ndarray:
    """SYMBOLS x SYMBOLS counts of neighbours (the end also comes before a text's first symbol)."""
    def run(batches):
        total = np.zeros(A.SYMBOLS * A.SYMBOLS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, max_rows=5_000):
                some = [np.frombuffer(x, dtype=np.int16)[A.CONTEXT:].astype(np.int32) for x in part.column("symbols").to_pylist()]
                total += np.bincount(np.concatenate([x[:-1] * A.SYMBOLS + x[1:] for x in some]), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "c"])

    pairs = map_arrow(texts.select("symbols"), run, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toPandas()
    out = np.zeros(A.SYMBOLS * A.SYMBOLS)
    out[pairs["pair"].to_numpy(dtype=np.int64)] = pairs["c"].to_numpy()
    return out.reshape(A.SYMBOLS, A.SYMBOLS)


class Model:
    """All that a task needs: symbols, bigram tables, parameters, shares of the subwords outside the symbols."""

    def __init__(self, counts: np.ndarray):
        kept = np.argsort(-counts, kind="stable")[:A.SYMBOLS - 2]
        self.symbol = np.full(len(counts), REST, dtype=np.int32)
        self.symbol[kept] = 2 + np.arange(len(kept))
        others = self.symbol == REST
        share = (counts + 0.5) / (counts[others].sum() + 0.5 * max(others.sum(), 1))
        self.rest = np.where(others, np.log(share), 0.0)
        self.end = END

    def order(self, bigrams: np.ndarray):
        """Renumber the symbols by class and set up the tables and the first parameters."""
        order, vectors = A.classes_of(bigrams)
        place = np.empty(A.SYMBOLS, dtype=np.int32)
        place[order] = np.arange(A.SYMBOLS)
        self.place = np.append(place, A.PAD)
        self.symbol, self.end = place[self.symbol], int(place[END])
        self.bigram = A.bigram_tables(bigrams[np.ix_(order, order)])
        self.params = A.initial(vectors)

    def tables(self) -> dict[str, np.ndarray]:
        """Scoring tables, made once where the finished model is used."""
        if "prepared" not in self.__dict__:
            self.prepared = A.prepared(self.params, self.bigram)
        return self.prepared


def _train_round(dealt: DataFrame, model: Model) -> dict[str, np.ndarray] | None:
    """One round over rows (shard, key, line, symbols), each partition sorted by them: every shard trains a copy
    of the model on its own lines; the copies' average, weighted by targets."""
    names = sorted(model.params)

    def train(lines):
        p, weight, waiting, held = {k: v.copy() for k, v in model.params.items()}, 0, [], 0
        adam = A.Adam(p)

        def learn():
            inputs, targets = A.line_windows(waiting)
            mixed = np.random.default_rng(1).permutation(len(inputs))
            for i in range(0, len(mixed), BATCH_WINDOWS):
                at = mixed[i:i + BATCH_WINDOWS]
                adam.step(A.gradients(p, model.bigram, inputs[at], targets[at])[1])

        for x in lines:
            waiting.append(model.place[np.frombuffer(x, dtype=np.int16)])
            held += len(waiting[-1]) - A.CONTEXT - 1
            if held > 200_000:
                learn()
                weight, waiting, held = weight + held, [], 0
        if held:
            learn()
        flat = np.concatenate([p[k].ravel() for k in names]).astype(np.float64)
        weight = float(weight + held)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * weight), pa.array(np.full(len(flat), weight))], ["i", "p", "w"])

    def run(batches):
        rows = (r for b in batches for part in slices(b) for r in zip(part.column("shard").to_pylist(), part.column("symbols").to_pylist()))
        for _, mine in groupby(rows, key=lambda r: r[0]):
            yield train(x for _, x in mine)

    mean = (map_arrow(dealt.select("shard", "symbols"), run, "i long, p double, w double").groupBy("i")
            .agg((F.sum("p") / F.sum("w")).alias("p")).toPandas())
    if not len(mean):
        return None
    flat = np.zeros(len(mean), dtype=np.float32)
    flat[mean["i"].to_numpy(dtype=np.int64)] = mean["p"].to_numpy()
    out, at = {}, 0
    for k in names:
        size = model.params[k].size
        out[k] = flat[at:at + size].reshape(model.params[k].shape)
        at += size
    return out


def shards_of(targets: float, rounds: int) -> int:
    """Shards of one round: their number and the targets of each grow alike, with the square root of the corpus."""
    return max(1, math.ceil(math.sqrt(targets / rounds / SHARD_TARGETS)))


def lines_of(texts: DataFrame) -> DataFrame:
    """Lines of at most ``LINE`` targets (``attention.line_windows``) of texts (h, symbols): h, the line's number in the
    text, the symbols."""
    before = A.CONTEXT + 1
    last = F.floor((F.octet_length("symbols") / 2 - before - 1) / LINE).cast("long")
    return (texts.select("h", "symbols", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("line"))
            .select("h", "line", F.substr("symbols", (F.col("line") * (2 * LINE) + 1).cast("int"), F.lit(2 * (LINE + before))).alias("symbols")))


def learn(model: Model, texts: DataFrame, rounds: int) -> Model:
    """Bigrams and parameters of ``model`` from the training texts (h, symbols). Rounds and shards go by the hash of
    id, text and line number, so that the model is the same however the table is split into files or partitions."""
    bigrams = bigram_counts(texts)
    model.ends = int(bigrams[:, END].sum())
    model.order(bigrams)
    shards = shards_of(bigrams.sum(), rounds)
    key = F.xxhash64("h", "line")
    rows = lines_of(texts).select(F.pmod(key, F.lit(rounds)).alias("round"),
                                  F.pmod(F.xxhash64(key, F.lit(1)), F.lit(shards)).cast("int").alias("shard"), "h", "line", "symbols")
    for r in range(rounds):
        dealt = rows.where(F.col("round") == r).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "h", "line")
        model.params = _train_round(dealt, model) or model.params
    return model


def fit(train: DataFrame, words: DataFrame, path: str, rounds: int = ROUNDS) -> Model:
    """``train`` (id, text) and its word counts -> the model."""
    model = Model(subword_counts(words, path))
    return learn(model, stored(encoded(train, model, {}, path).select("h", "symbols")), rounds)


def score_symbols(model: Model, texts: list[np.ndarray], rest: np.ndarray) -> np.ndarray:
    """Natural log probability of each text (its symbols with the end), added to ``rest``."""
    total = rest + 0.0
    inputs, targets, of = A.windows(texts, model.end)
    tables = model.tables()
    for i in range(0, len(inputs), SCORE_WINDOWS):
        part = slice(i, i + SCORE_WINDOWS)
        total += np.bincount(of[part], weights=A.score(tables, inputs[part], targets[part]).sum(1), minlength=len(texts))
    return total


def score_texts(model: Model, sub: Subwords, docs: list[list[bytes]]) -> np.ndarray:
    """Natural log probability of each text (its words) with its end."""
    each = [sub.encode(d)[0] for d in docs]
    return score_symbols(model, [np.append(model.symbol[x], model.end) for x in each], np.array([model.rest[x].sum() for x in each]))


def top_words(words: DataFrame, most: int | None = None) -> dict[bytes, int]:
    """The words whose count reaches a bound, chosen by a histogram of the counts' logarithms so that they are
    at most ``most``; only those come to the driver. Any choice gives the same scores."""
    most = TOP_WORDS if most is None else most
    short = words.where(F.octet_length("word") <= TOP_BYTES).withColumn("size", F.floor(F.log2("c") * 16).cast("int"))
    bound = total = 0
    for r in sorted(short.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["size"]):
        total += r["n"]
        if total > most:
            bound = r["size"] + 1
            break
    return {bytes(r["word"]): r["c"] for r in short.where(F.col("size") >= bound).collect()}


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1,
             path: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    path = path or ranks_path()
    rows = docs.select(quoted(id_col).alias("id"), (remainder(quoted(id_col), folds) == held).alias("held_out"),
                       F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    train = rows.where(~F.col("held_out"))
    words = stored(word_counts(train))
    model = Model(subword_counts(words, path))
    texts = stored(encoded(rows, model, top_words(words), path).withColumn("rid", F.monotonically_increasing_id()))
    learn(model, texts.where(~F.col("held_out")), rounds)
    ends = model.ends
    n_words, kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n_train, distinct = n_words + ends, kinds + (ends > 0)
    denominator = n_train + 0.5 * (distinct + 1)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch, max_rows=400, max_bytes=2 << 20):
                symbols = [model.place[np.frombuffer(x, dtype=np.int16)[A.CONTEXT + 1:]] for x in part.column("symbols").to_pylist()]
                score = score_symbols(model, symbols, part.column("rest").to_numpy()) / np.log(10)
                kept = [x for x in part.schema.names if x not in ("rest", "symbols")]
                yield pa.RecordBatch.from_arrays([part.column(x) for x in kept] + [pa.array(score)], [*kept, "score"])

    scored = texts.select("rid", "id", "held_out", "n_tokens", "known", "base", "rest", "symbols")
    scored = stored(map_arrow(scored, run, with_fields(scored.drop("rest", "symbols").schema, ("score", "double"))))
    rare = (texts.select("rid", F.explode("tail").alias("word")).join(words, "word", "left")
            .groupBy("rid").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.count("c").alias("found")))
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) + F.lit(float(np.log10(ends + 0.5))) - F.col("n_tokens") * F.lit(float(np.log10(denominator)))
    return scored.join(rare, "rid", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op1(spark, sf_dir):
    from .common import table
    return lm_score(table(spark, sf_dir, "documents", "doc_id", "text"))
