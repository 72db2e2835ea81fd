"""Language identification by cross-parsing entropy.

A suffix automaton of each language's sample recognises every substring of it. A text is cut, left to right,
into the longest phrases that occur in the sample; ``phrases * log2(sample length) / text length`` estimates
the cross-entropy in bits a letter, and the language with the least wins (ties: first by name). The
automaton's forward links lie in a hash table of (state, symbol), whose size follows the links and not the alphabet (4 MB a
language, Han as well as Latin), with a restart at the root where a phrase ends. A batch of texts is parsed in lockstep: whole
texts are cut into segments of ``SEGMENT`` symbols (a phrase ends where a segment does, alike for all languages), one look-up
per symbol for all segments at once.

Learning: a bounded sample of the labelled rows. Every language gives up to ``SAMPLE_DOCS`` documents in hash order,
of each the first ``EXCERPT`` characters, cut at ``SAMPLE_SYMBOLS`` symbols in all; the number of languages is
taken to be small (names of natural languages). Prediction reads whole texts.

Symbols are lower-cased letters; everything else between letters is one blank.

Defined results: a null text or one without a letter is ``und`` with score 0; so is every text if
nothing was learned. Letters that no sample has cost a phrase each. score = 1 - least / second least, 1 if one
language is learned. A null id counts as the empty text in the split. Extra columns are kept; those
named like an output are replaced."""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_arrow, quoted, remainder, slices, with_fields, without

SAMPLE_DOCS = 96
EXCERPT = 600
SAMPLE_SYMBOLS = 24_000
SEGMENT = 512
UND = "und"
_BLANK, _UNKNOWN, _PAD = 0, 1, 2
#: Room for a state beside state * alphabet + symbol in 63 bits: 2 ** 21 states and 2 ** 21 symbols.
_STATE_BITS = 21


class SuffixAutomaton:
    """Forward links of the suffix automaton of a symbol sequence."""

    def __init__(self, symbols):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        nxt = self.next
        for c in symbols:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """from, symbol, to of all forward links."""
        n = np.fromiter(map(len, self.next), dtype=np.int64, count=len(self.next))
        symbol = np.fromiter((c for row in self.next for c in row), dtype=np.int64, count=int(n.sum()))
        to = np.fromiter((t for row in self.next for t in row.values()), dtype=np.int64, count=int(n.sum()))
        return np.repeat(np.arange(len(n)), n), symbol, to


class LinkTable:
    """Forward links of one automaton for whole arrays of states: open addressing, at most an eighth full, the
    next state in the low bits of its link."""

    def __init__(self, automaton: SuffixAutomaton, alphabet: int):
        state, symbol, to = automaton.links()
        self.alphabet = alphabet
        self.start = np.zeros(alphabet, dtype=np.int64)  # from the root a phrase begins; an unknown symbol is one by itself
        self.start[symbol[state == 0]] = to[state == 0]
        inner = state != 0
        bits = max(int(8 * inner.sum()).bit_length(), 4)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.links = np.full(1 << bits, -1, dtype=np.int64)
        keys, to = state[inner] * alphabet + symbol[inner], to[inner]
        slot = self._slots(keys)
        while len(keys):  # of those that want a free slot the first takes it, the others go on
            free = np.flatnonzero(self.links[slot] < 0)
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.links[slot[first]] = (keys[first] << _STATE_BITS) | to[first]
            left = np.ones(len(keys), dtype=bool)
            left[first] = False
            keys, to, slot = keys[left], to[left], (slot[left] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    @property
    def nbytes(self) -> int:
        return self.links.nbytes + self.start.nbytes

    def follow(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and where a phrase begins."""
        want = state * self.alphabet + symbol
        slot = self._slots(want)
        link = self.links[slot]
        key = link >> _STATE_BITS
        begins = key != want
        open_ = np.flatnonzero(begins & (key >= 0))
        while len(open_):
            at = (slot[open_] + 1) & self.mask
            slot[open_] = at
            here = self.links[at]
            key = here >> _STATE_BITS
            hit = key == want[open_]
            link[open_[hit]] = here[hit]
            begins[open_[hit]] = False
            open_ = open_[~hit & (key >= 0)]
        to = link & ((1 << _STATE_BITS) - 1)
        np.copyto(to, self.start[symbol], where=begins)
        return to, begins


_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _letters


def symbols_of(texts: list[str], code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts in a row, their number and the number of letters per text."""
    texts = [t.lower() for t in texts]
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    sym = code[raw]
    of = np.repeat(np.arange(len(texts)), sizes)
    first = np.ones(len(sym), dtype=bool)
    first[1:] = (sym[1:] != _BLANK) | (sym[:-1] != _BLANK) | (of[1:] != of[:-1])
    letters = np.bincount(of[sym != _BLANK], minlength=len(texts))
    return sym[first], np.bincount(of[first], minlength=len(texts)), letters


class CrossParser:
    """Automata of all languages, built from the samples (small enough to travel with a task)."""

    def __init__(self, samples: dict[str, list[str]], sample_symbols: int = SAMPLE_SYMBOLS):
        self.languages = sorted(samples)
        letters = _letter_table()
        code = np.where(letters, _UNKNOWN, _BLANK).astype(np.int32)
        seen = sorted({ord(c) for ts in samples.values() for t in ts for c in t.lower() if letters[ord(c)]})
        code[np.array(seen, dtype=np.int64)] = np.arange(3, 3 + len(seen))
        self.code, self.alphabet = code, 3 + len(seen)
        self.tables, self.bits = [], []
        for name in self.languages:
            sym = symbols_of([" ".join(samples[name])], code)[0][:sample_symbols]
            self.tables.append(LinkTable(SuffixAutomaton(sym.tolist()), self.alphabet))
            self.bits.append(math.log2(max(len(sym), 2)))

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """texts x languages cross-entropies (bits a symbol), and letters per text."""
        sym, n, letters = symbols_of(texts, self.code)
        lanes = -(-n // SEGMENT)
        first_lane = np.concatenate([[0], np.cumsum(lanes)])
        flat = np.full(first_lane[-1] * SEGMENT, _PAD, dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(n)])[:-1]
        flat[np.arange(len(sym)) + np.repeat(first_lane[:-1] * SEGMENT - starts, n)] = sym
        steps = np.ascontiguousarray(flat.reshape(-1, SEGMENT).T)
        of = np.repeat(np.arange(len(texts)), lanes)
        lanes_padding = (steps == _PAD).sum(0)  # has no link, so each counts as a phrase of its own
        out = np.zeros((len(texts), len(self.languages)))
        for k, table in enumerate(self.tables):
            state = np.zeros(steps.shape[1], dtype=np.int64)
            count = -lanes_padding
            for row in steps:
                state, begins = table.follow(state, row)
                count += begins
            out[:, k] = np.bincount(of, weights=count, minlength=len(texts)) * self.bits[k]
        return out / np.maximum(n, 1)[:, None], letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, scores = [UND] * len(texts), np.zeros(len(texts))
        if not self.languages or not texts:
            return names, scores
        h, letters = self.entropies(texts)
        order = np.argsort(h, axis=1, kind="stable")
        best = np.take_along_axis(h, order, 1)
        score = 1 - best[:, 0] / np.maximum(best[:, 1], 1e-12) if h.shape[1] > 1 else np.ones(len(texts))
        for i in np.flatnonzero(letters):
            names[i], scores[i] = self.languages[order[i, 0]], min(max(score[i], 0.0), 1.0)
        return names, scores


def learn(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, docs_per_language: int = SAMPLE_DOCS) -> dict[str, list[str]]:
    """The bounded sample: up to ``docs_per_language`` excerpts per language in hash order."""
    text, lang = quoted(text_col), quoted(lang_col)
    rows = labelled.where(lang.isNotNull() & text.rlike(r"\p{L}")).select(
        lang.alias("lang"), F.xxhash64(quoted(id_col), F.substring(text, 1, EXCERPT)).alias("h"), F.substring(text, 1, EXCERPT).alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2 * docs_per_language / n))])
    unit = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    picked = rows.where(unit < share[F.col("lang")]).distinct().collect()
    out: dict[str, list[str]] = {}
    for r in sorted(picked, key=lambda r: (r["lang"], r["h"], r["text"])):
        if len(out.setdefault(r["lang"], [])) < docs_per_language:
            out[r["lang"]].append(r["text"])
    return out


_parsers: dict[int, CrossParser] = {}


def _parser(samples: dict[str, list[str]]) -> CrossParser:
    """One parser per Python worker and sample."""
    key = hash(tuple((k, tuple(v)) for k, v in sorted(samples.items())))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = CrossParser(samples)
    return _parsers[key]


def identify(docs: DataFrame, samples: dict[str, list[str]], text_col: str = "text",
             keep: list[Column] | None = None) -> DataFrame:
    """``keep`` (default: all columns of ``docs``) with lang_pred and score."""
    kept = docs.select(*(keep if keep is not None else without(docs, "lang_pred", "score")))
    (work,) = fresh(kept, "_text")
    rows = docs.select(*(keep if keep is not None else without(docs, "lang_pred", "score")), quoted(text_col).alias(work))
    columns = kept.columns
    n = len(columns)

    def run(batches):
        parser = _parser(samples)
        for batch in batches:
            names, scores = [], []
            for part in slices(batch, max_rows=2000, max_bytes=4 << 20):
                a, b = parser.predict([t or "" for t in part.column(n).to_pylist()])
                names += a
                scores.append(b)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())],
                [*columns, "lang_pred", "score"])

    return map_arrow(rows, run, with_fields(kept.schema, ("lang_pred", "string"), ("score", "double")))


def held_out(id_col: str) -> Column:
    return remainder(quoted(id_col), 4) == 2


def sample_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    return learn(docs.where(~held_out(id_col)), id_col, text_col, lang_col)


def drop_unidentified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *,
                      languages: Sequence[str] | None = None, min_score: float = 0.0) -> DataFrame:
    """The documents in which a language is found, with the columns of ``docs``. Rejected: documents without a letter, those
    predicted to be in a language that is not among ``languages`` (default: every learned one), and those whose score is below
    ``min_score`` (0: two languages fit equally well, 1: only one fits)."""
    samples = sample_of(docs, id_col, text_col, lang_col)
    at = docs.columns.index(text_col)
    wanted = None if languages is None else frozenset(languages)

    def run(batches):
        parser = _parser(samples)
        for batch in batches:
            for part in slices(batch, max_rows=2000, max_bytes=4 << 20):
                names, scores = parser.predict([t or "" for t in part.column(at).to_pylist()])
                keep = [n != UND and (wanted is None or n in wanted) and s >= min_score for n, s in zip(names, scores, strict=True)]
                yield part.filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def rejections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *,
               languages: Sequence[str] | None = None, min_score: float = 0.0) -> DataFrame:
    """What ``drop_unidentified`` does, counted: lang_pred, kept, n."""
    out = identify(docs, sample_of(docs, id_col, text_col, lang_col), text_col, keep=[])
    known = F.col("lang_pred") != UND
    listed = F.lit(True) if languages is None else F.col("lang_pred").isin(*languages)
    return out.groupBy("lang_pred", (known & listed & (F.col("score") >= min_score)).alias("kept")).agg(F.count(F.lit(1)).alias("n"))


def op7(spark, sf_dir):
    from .common import table
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return identify(docs, sample_of(docs), keep=[F.col("doc_id"), held_out("doc_id").alias("held_out")])
