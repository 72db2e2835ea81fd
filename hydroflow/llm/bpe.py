"""BPE encoding and decoding through distinct-word tables.

Spark splits each text into words with the tokenizer's own pattern (special tokens first, as the tokenizer
does). Within a task the words of a batch are reduced to their distinct ones, a word not met before is
encoded once, and the ids go back to every position by index; decoding looks up the piece of each id in the
id-to-piece table and joins the pieces. The tables are per task, so a text's words never leave it: there is
no shuffle, a lost executor costs its own tasks only, and memory is bounded by ``MEMO_WORDS`` words (past it
the table starts anew, which costs time, never results). A table over the whole corpus, joined by
(document, position), would shuffle several times the input (README).

Defined results: null counts as the empty text, which has no ids; an empty table gives an empty table;
columns named like an output are replaced."""
from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_arrow, quoted, with_fields, without

MEMO_WORDS = 400_000
#: The byte-level pattern of the public tokenizer files (fixed values), blanks as in Unicode.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def special_tokens(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def _java_quote(s: str) -> str:
    return r"\Q" + s + r"\E"


def words(text: Column, special: list[str]) -> Column:
    """The words of a text, special tokens as words of their own."""
    text = F.coalesce(text, F.lit(""))
    plain = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    if not special:
        return plain
    any_of = "|".join(_java_quote(s) for s in sorted(special, key=len, reverse=True))
    segments = F.split(text, f"(?={any_of})|(?<={any_of})")
    cut = F.flatten(F.transform(segments, lambda s: F.when(s.isin(special), F.array(s))
                                .otherwise(F.regexp_extract_all(s, F.lit(PATTERN), F.lit(0)))))
    return F.when(text.rlike(any_of), cut).otherwise(plain)


class WordTable:
    """Distinct words with their ids, and ids with their pieces."""

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = False
        back = {c: b for b, c in byte_alphabet().items()}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.pieces: list[bytes] = []
        for i in range(size):
            p = self.tokenizer.id_to_token(i) or ""
            self.pieces.append(p.encode() if p in special else bytes(back[c] for c in p))
        self.memo: dict[str, tuple[int, ...]] = {}

    def ids_of(self, distinct: list[str]) -> list[tuple[int, ...]]:
        """Ids of each distinct word; a word is encoded once."""
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        new = [w for w in distinct if w not in memo]
        for i in range(0, len(new), 50_000):
            some = new[i:i + 50_000]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                memo[w] = tuple(e.ids)
        return [memo[w] for w in distinct]

    def decode_bytes(self, ids) -> bytes:
        p = self.pieces
        return b"".join([p[i] for i in ids])


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_tables: dict[str, WordTable] = {}


def _table(path: str) -> WordTable:
    if path not in _tables:
        _tables[path] = WordTable(path)
    return _tables[path]


def _positions(column) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Offsets of a list-of-words column, the distinct-word number at every position, the distinct words."""
    offsets = column.offsets.to_numpy()
    coded = column.flatten().dictionary_encode()
    return offsets - offsets[0], coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def _word_slices(batch, name: str, at_once: int = 1_000_000):
    """Pieces of a batch with about ``at_once`` words."""
    offsets = batch.column(name).offsets.to_numpy()
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + at_once, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def _encode_map(docs: DataFrame, keep: list[Column], text_col: str, path: str, outputs: list[tuple[str, str]], make) -> DataFrame:
    kept = docs.select(*keep)
    columns = kept.columns
    n = len(columns)
    names = [*columns, *[o for o, _ in outputs]]
    (work,) = fresh(kept, "_words")
    rows = docs.select(*keep, words(quoted(text_col), special_tokens(path)).alias(work))

    def run(batches):
        table = _table(path)
        for batch in batches:
            for part in _word_slices(batch, work):
                offsets, at, distinct = _positions(part.column(n))
                made = make(table, offsets, at, distinct)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *made], names)

    return map_arrow(rows, run, with_fields(kept.schema, *outputs))


def _flat_ids(table: WordTable, offsets, at, distinct) -> tuple[np.ndarray, np.ndarray]:
    """All ids in text order, and each text's offset in them."""
    ids = table.ids_of(distinct)
    sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    flat = np.fromiter((i for t in ids for i in t), dtype=np.int32, count=int(sizes.sum()))
    n = sizes[at]
    ends = np.concatenate([[0], np.cumsum(n)])
    out = flat[np.repeat(starts[at] - ends[:-1], n) + np.arange(ends[-1])] if len(at) else flat[:0]
    return out, ends[offsets]


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, out: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each whole text."""
    def make(table, offsets, at, distinct):
        flat, ends = _flat_ids(table, offsets, at, distinct)
        return [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))]

    return _encode_map(docs, without(docs, out), text_col, path or default_path(), [(out, "array<int>")], make)


def decode(encoded: DataFrame, ids_col: str = "ids", path: str | None = None, out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids (null: empty), bytes that are not UTF-8 replaced."""
    path = path or default_path()
    kept = encoded.select(*without(encoded, out))
    columns = kept.columns
    n = len(columns)
    rows = encoded.select(*without(encoded, out), quoted(ids_col).alias(fresh(kept, "_ids")[0]))

    def run(batches):
        table = _table(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                texts = [table.decode_bytes(x or ()).decode("utf-8", "replace") for x in part.column(n).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(texts, pa.string())], [*columns, out])

    return map_arrow(rows, run, with_fields(kept.schema, (out, "string")))


def digests(docs: DataFrame, text_col: str = "text", keep: list[Column] | None = None, path: str | None = None) -> DataFrame:
    """``keep`` with n_tokens and the SHA-256 of the ids and of the decoded text, made in one pass: ids are
    encoded and decoded per distinct word, then joined by position."""
    def make(table, offsets, at, distinct):
        ids = table.ids_of(distinct)
        number = [",".join(map(str, t)) for t in ids]
        piece = [table.decode_bytes(t) for t in ids]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        ends = np.concatenate([[0], np.cumsum(sizes[at])])[offsets]
        a, b = [], []
        for lo, hi in zip(offsets[:-1], offsets[1:]):
            here = at[lo:hi].tolist()
            a.append(hashlib.sha256(",".join([number[i] for i in here]).encode()).hexdigest())
            text = b"".join([piece[i] for i in here]).decode("utf-8", "replace")
            b.append(hashlib.sha256(text.encode()).hexdigest())
        return [pa.array(np.diff(ends)), pa.array(a, pa.string()), pa.array(b, pa.string())]

    outputs = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    keep = keep if keep is not None else without(docs, *[o for o, _ in outputs])
    return _encode_map(docs, keep, text_col, path or default_path(), outputs, make)


def op9(spark, sf_dir):
    from .common import table
    return digests(table(spark, sf_dir, "documents", "doc_id", "text"), keep=[F.col("doc_id")])
