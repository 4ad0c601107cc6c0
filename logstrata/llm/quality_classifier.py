"""Quality classifier from weak labels.

1. Heuristic labellers vote good, bad or nothing on each document.
2. Documents are counted by their pattern of votes (at most 3 to the number of
   labellers rows): these counts, over all documents, are all that
   expectation-maximisation needs for the labellers' accuracies in good documents
   and in each kind of bad ones, the kinds' shares, and each pattern's posterior.
   Kinds of their own keep labellers that never agree from being outvoted.
3. Posteriors label a bounded sample of distinct texts (``FITTED_ROWS`` or so, by a
   hash of the text), and a linear scorer over hashed byte trigrams is trained on
   it. What reaches the driver of a text are its trigrams' counts in ``BINS`` bins.
4. Every whole text is scored; ``kept`` means a score of one half or more.

Both passes over the texts are maps; only pattern counts are shuffled, after
partial aggregation. Null and empty texts get the labellers' votes on nothing
and the scorer's bias. Very long texts are hashed in pieces. With no documents
nothing is fitted and the result is empty. Repeated rows score alike and count
once in the sample; null and repeated ids are rows like any other; a score of
one half is kept. Only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logstrata.llm import hashing
from logstrata.llm.arrow import with_columns
from logstrata.llm.quality_rules import measure
from logstrata.llm.sampling import drawn

FITTED_ROWS = 6_000
BINS = 2048
GOOD, BAD = 1, -1

#: name: (bad if, good if), over the measurements of quality_rules.
LABELLERS = {
    "length": ("n_words < 8", "n_words >= 20"),
    "symbols": ("10 * n_symbols > n_words", "n_symbols = 0"),
    "lines": ("100 * n_dup_lines > 40 * n_lines", "n_dup_lines = 0"),
    "letters": ("100 * n_letters < 60 * word_chars", "100 * n_letters > 85 * word_chars"),
    "shouting": ("100 * n_upper > 50 * n_letters", "100 * n_upper < 15 * n_letters"),
    "stutter": ("100 * n_stutter > 20 * n_words", "100 * n_stutter < 2 * n_words"),
}


def votes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, pattern): the votes as digits to the base 3, bad 0, none 1, good 2."""
    digit = lambda i, bad, good: F.when(F.expr(bad), 0).when(F.expr(good), 2).otherwise(1) * 3**i
    code = sum((digit(i, *x) for i, x in enumerate(LABELLERS.values())), F.lit(0))
    return measure(docs, id_col, text_col, repeats=False).select("doc_id", code.cast("int").alias("pattern"))


def posteriors(counts: dict[int, int], rounds: int = 200) -> dict[int, float]:
    """The chance of a good document by pattern. Class 0 is good, class 1 + i starts from what labeller i calls bad."""
    m = len(LABELLERS)
    codes = sorted(counts)
    v = np.array([[code // 3**i % 3 for i in range(m)] for code in codes])
    c = np.array([counts[code] for code in codes], float)
    bad = (v == 0).astype(float)
    held = np.c_[np.where(bad.any(1), 0.05, 1.0), bad + 1e-3]
    held /= held.sum(1, keepdims=True)
    for _ in range(rounds):
        before = held
        share = np.maximum((c[:, None] * held).sum(0) / c.sum(), 1e-6)
        chance = np.stack([((v == k)[:, None, :] * (c[:, None] * held)[:, :, None]).sum(0) + 0.5 for k in range(3)], -1)
        chance /= chance.sum(-1, keepdims=True)
        odds = np.log(share) + sum(np.log(chance[:, i, :])[:, v[:, i]].T for i in range(m))
        held = np.exp(odds - odds.max(1, keepdims=True))
        held /= held.sum(1, keepdims=True)
        if abs(held - before).max() < 1e-9:
            break
    return dict(zip(codes, held[:, 0].tolist()))


def bins(text: bytes):
    """Hashed byte trigrams of a text, in pieces."""
    for piece in hashing._pieces(text):
        raw = np.frombuffer(b" " + piece + b" ", np.uint8).astype(np.uint32)
        if len(raw) >= 3:
            yield ((raw[:-2] * 2654435761 + raw[1:-1] * 40503 + raw[2:] * 2246822519) & 0xFFFFFFFF) >> 21


def counted(text: bytes):
    """How often each bin occurs in a text."""
    held = np.zeros(BINS)
    for found in bins(text):
        held += np.bincount(found, minlength=BINS)
    return held


class Scorer:
    def __init__(self, x, y, rounds: int = 150, rate: float = 0.5):
        """``x`` has a row of bins' counts for each text."""
        x = np.sqrt(x / np.maximum(1, x.sum(1, keepdims=True)), dtype=np.float32)
        y = np.asarray(y, np.float32)
        weight = np.where(y >= 0.5, 0.5 / max(y.mean(), 0.05), 0.5 / max(1 - y.mean(), 0.05))
        self.w, self.b, m, s = np.zeros(BINS, np.float32), 0.0, np.zeros(BINS + 1), np.zeros(BINS + 1)
        for t in range(1, rounds + 1):  # Adam on the whole sample
            p = 1 / (1 + np.exp(-np.clip(x @ self.w + self.b, -30, 30)))
            e = ((p - y) * weight / len(y)).astype(np.float32)
            g = np.append(x.T @ e + 1e-6 * self.w, e.sum())
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
            self.w, self.b = (self.w - step[:-1]).astype(np.float32), self.b - step[-1]

    def score(self, text: bytes) -> float:
        held = counted(text)
        z = np.sqrt(held / max(1, held.sum())) @ self.w + self.b
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _sample(docs: DataFrame, share: float):
    """(patterns, counts of bins, a row a text) of the distinct texts that a hash of them draws. A text comes as BINS numbers, however long it is."""
    few = docs.filter(drawn(F.col("text"), share, 3)).groupBy("text").agg(F.lit(1))
    few = votes(few.withColumn("doc_id", F.col("text")), "doc_id", "text").select(F.col("doc_id").alias("text"), "pattern")
    few = few.withColumn("mark", F.xxhash64("text"))
    few = with_columns(few, "bins array<float>", lambda batch: [[counted(t).astype(np.float32) for t in hashing.texts_of(batch.column("text"))]], drop=("text",))
    rows = few.select("pattern", "bins", "mark").toArrow().sort_by("mark")  # the fit doesn't depend on the order of arrival
    x = rows.column("bins").combine_chunks()
    return rows.column("pattern").to_pylist(), x.flatten().to_numpy(zero_copy_only=False).reshape(-1, BINS)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = FITTED_ROWS) -> DataFrame:
    """doc_id, posterior (of the labellers), score (the scorer's), kept."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = {r["pattern"]: r["count"] for r in votes(docs, "doc_id", "text").groupBy("pattern").count().collect()}  # 3 to the number of labellers at most
    total = sum(counts.values())
    if not total:
        return docs.select("doc_id", F.lit(0.0).alias("posterior"), F.lit(0.0).alias("score"), F.lit(False).alias("kept"))
    good = posteriors(counts)
    patterns, x = _sample(docs, most / total)
    scorer = Scorer(x, [good[p] for p in patterns]) if len(patterns) else None
    table = docs.sparkSession.createDataFrame(sorted(good.items()), "pattern int, posterior double")
    voted = votes(docs.withColumn("doc_id", F.struct("doc_id", "text")), "doc_id", "text").select("doc_id.doc_id", "doc_id.text", "pattern")
    scored = with_columns(voted, "score double", lambda batch: [[scorer.score(t) if scorer else 0.0 for t in hashing.texts_of(batch.column("text"))]], drop=("text",))
    return scored.join(F.broadcast(table), "pattern").select("doc_id", "posterior", "score", (F.col("score") >= 0.5).alias("kept"))
