"""The corpus pipeline: documents in, token digests of the deduplicated and mixed corpus out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's ``docs``. All stages but the last return the columns of ``documents``; each works on every row that
its predecessor kept:

1. language_id: documents without a language go: no letters, no text, or two languages that fit equally well (a score below ``MIN_SCORE``); ``LANGUAGES``
   restricts the languages kept (None: all that are learned);
2. exact_dedup: of equal texts (runs of blanks folded) the smallest id stays;
3. simhash_near_dedup: of each group of texts whose SimHash fingerprints (3-word shingles) link at 2 bits or fewer,
   the smallest id stays;
4. mix_sources: sources are thinned or repeated to their target sizes (a repeated document is a repeated row);
5. bpe: token count and digests of ids and decoded text, one row per row of the mix.

Null ids, null texts, repeated rows and empty tables are handled as the operators state."""
from __future__ import annotations

from pyspark.sql import functions as F

from hydroflow.llm import bpe, exact_dedup, langid, mixing, simhash
from hydroflow.llm.common import stored, table


LANGUAGES = None
MIN_SCORE = 0.01


def language_id(spark, docs, sf_dir):
    return langid.drop_unidentified(docs, languages=LANGUAGES, min_score=MIN_SCORE)


def exact(spark, docs, sf_dir):
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark, docs, sf_dir):
    return simhash.drop_near_duplicates(docs, shingle=3, max_bits=2)


def mix(spark, docs, sf_dir):
    return mixing.mix(docs)


def tokens(spark, docs, sf_dir):
    return bpe.digests(docs, keep=[F.col("doc_id"), F.col("source")])


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("mix_sources", mix),
    ("bpe", tokens),
]

#: Language ID and SimHash are not expressible in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
