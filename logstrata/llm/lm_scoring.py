"""Stupid-backoff scores from n-gram count tables.

1. Each order's n-grams are counted over all texts in a table that is
   partitioned by their hash. A slice of texts sends its distinct n-grams with
   their counts to the partitions that own them, packed in one message each
   (``slices``), so a word that is everywhere is one entry a slice.
2. The count table meets the exploded n-grams: each partition answers every
   message with the sums, and a slice's answers come back to its texts.
3. Scores of words are summed per document. A document's own occurrences are
   taken out of the counts first, else every n-gram would have been seen.

A seen n-gram scores its count over that of its first n-1 words; an unseen one
``BACKOFF`` times the score with one word less of context; an unseen word counts
as one half. A text's first words have what context there is. One order is
counted at a time and its shuffle freed; nothing is broadcast, and the driver
sees sums only.

n-grams are told apart by 16 bits of hash more than the corpus has bytes. Null
and empty texts have no words and score 0. Very long texts are slices of their
own, hashed in pieces. Repeated rows are documents of their own and support each
other; null and repeated ids are rows like any other. An empty table gives an
empty result. Only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logstrata.llm import hashing, slices
from logstrata.plans.durable import dropped, written

ORDER = 3
BACKOFF = 0.4


def _words(texts: list[bytes]) -> list:
    return [w for _, found in hashing.word_hashes(texts, True) for w in found]


def _grams(words: list, order: int) -> list:
    """The hashes of each text's n-grams; a shorter text has none."""
    return [hashing.ngram_hashes(w, order) if order > 1 and len(w) >= order else w if order == 1 else w[:0] for w in words]


def _others(grams: list, told, plan: slices.Plan):
    """Counts of every n-gram of every text of a slice, less the text's own."""
    keys = plan.keys(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)
    distinct, places = np.unique(keys, return_inverse=True)
    if len(distinct) != len(told):
        raise ValueError("a slice's answers don't fit its questions")
    at = 0
    for g in grams:
        own = places[at : at + len(g)]
        at += len(g)
        _, inner, times = np.unique(own, return_inverse=True, return_counts=True)
        yield told[own] - times[inner] if len(g) else np.zeros(0, np.int64)


def scored(counts: list, rest: int, backoff: float = BACKOFF) -> float:
    """The summed logarithms of a text's words. ``counts[k]`` are those of its runs of k + 1 words, ``rest`` the words of the other texts."""
    if not len(counts[0]):
        return 0.0
    value = np.log(np.maximum(counts[0], 0.5) / max(1, rest))
    for k in range(1, len(counts)):
        seen, context = counts[k], counts[k - 1][: len(counts[k])]
        if len(seen):
            value[k:] = np.where(seen > 0, np.log(np.maximum(seen, 1) / np.maximum(context, 1)), np.log(backoff) + value[k:])
    return float(value.sum())


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, n_words, log_score (natural logarithm, summed), score (a word's mean; 0 without words)."""
    cut = slices.sliced(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")))
    plan = slices.Plan(cut, spare=16)

    def count(k: int) -> DataFrame:
        def tokens(texts):
            found = np.concatenate(_grams(_words(texts), k))
            if len(found):
                yield k, found

        return written(slices.counted(slices.requests(cut, plan, tokens), plan), "counts", **slices.ONE)

    tables = [count(k) for k in range(1, order + 1)]
    total = tables[0].agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0]

    def make(ids, texts, told):
        import pyarrow as pa

        words = _words(texts)
        found = [list(_others(_grams(words, k), told.get(k, np.zeros(0, np.int64)), plan)) for k in range(1, order + 1)]
        sums = [scored([x[i] for x in found], total - len(w), backoff) for i, w in enumerate(words)]
        return pa.table({"doc_id": ids, "n_words": pa.array([len(w) for w in words], pa.int64()), "log_score": pa.array(sums, pa.float64())})

    kind = cut.schema["ids"].dataType.elementType.simpleString()
    answers = tables[0]
    for table in tables[1:]:
        answers = answers.unionByName(table)
    rows = written(slices.answered(cut, answers, make, f"doc_id {kind}, n_words bigint, log_score double"), "scores", **slices.ONE)
    dropped(cut, *tables)
    return rows.withColumn("score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(0.0))
