"""Quality rules as a bitmask ledger.

Each rule is evaluated once a document; its failure is a bit of one bigint,
stored beside the measurements. Policies are versioned masks over these bits,
so a new policy or an ablation reads the ledger and never the texts again.

Nulls and empty texts measure 0 everywhere and fail ``few_words``. Texts of any
length are measured whole, in one task's row. Rows are independent: repeated
rows, ties and an empty table need no care, no shuffle happens, and no group
of rows ever meets. Columns of the input other than the id and the text are
not carried, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.llm.text import SPACE, let, window_hashes, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    name: str
    failed: Callable[[], Column]


def _c(name: str) -> Column:
    return F.col(name)


#: A rule's place is its bit; append only, so that stored ledgers stay readable.
RULES = (
    Rule("few_words", lambda: _c("n_words") < 20),
    Rule("repeated_words", lambda: 100 * _c("n_repeat_words") > 30 * _c("n_words")),
    Rule("symbols", lambda: 10 * _c("n_symbols") > _c("n_words")),
    Rule("word_length", lambda: (_c("word_chars") < 2 * _c("n_words")) | (_c("word_chars") > 20 * _c("n_words"))),
    Rule("repeated_lines", lambda: 100 * _c("n_dup_lines") > 40 * _c("n_lines")),
    Rule("few_letters", lambda: 100 * _c("n_letters") < 60 * _c("word_chars")),
    Rule("shouting", lambda: 100 * _c("n_upper") > 50 * _c("n_letters")),
    Rule("stutter", lambda: 100 * _c("n_stutter") > 20 * _c("n_words")),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}

#: Versions are never edited; a change is a new version.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "strict-1": tuple(BIT),
}


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def _repeats(hashes: Column) -> Column:
    """Positions covered by windows that occur twice or more, the first included. Windows are compared by 64-bit hash within one document."""
    def covered(starts: Column) -> Column:
        return F.aggregate(
            F.transform(starts, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - p, F.lit(WINDOW)))),
            F.lit(0).cast("bigint"), lambda total, x: total + x)

    def starts(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda s, k: (s["h"] == F.get(ordered, k - 1)["h"]) | (s["h"] == F.get(ordered, k + 1)["h"]))
        return F.sort_array(F.transform(twice, lambda s: s["i"]))

    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct(hashes)) < F.size(hashes)  # a text without repeats isn't sorted
    return F.when(some, let(let(placed, starts), covered)).otherwise(F.lit(0).cast("bigint"))


def _chars(text: Column, without: Column) -> Column:
    return (F.length(text) - F.length(without)).cast("bigint")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: bool = True) -> DataFrame:
    """The measurements; without ``repeats``, which cost as much as the rest, n_repeat_words is null."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    counted = let(words(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), (let(window_hashes(w, WINDOW), _repeats) if repeats else F.lit(None).cast("bigint")).alias("r"),
        F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).cast("bigint").alias("s")))
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
                lambda x: F.struct(F.size(x).cast("bigint").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("d")))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).select(
        "doc_id", counted.alias("_w"), lines.alias("_l"),
        F.length(F.translate(text, "\x20\t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        _chars(text, F.translate(text, SYMBOLS, "")).alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("bigint").alias("n_letters"),
        _chars(text, F.regexp_replace(text, r"\p{Lu}+", "")).alias("n_upper"),
    ).select(
        "doc_id", F.col("_w.n").alias("n_words"), "word_chars", "n_symbols", F.col("_l.d").alias("n_dup_lines"), F.col("_w.r").alias("n_repeat_words"),
        F.col("_l.n").alias("n_lines"), F.col("_w.s").alias("n_stutter"), "n_letters", "n_upper")


def evaluate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger: doc_id, measurements and fail_bits."""
    bits = F.lit(0).cast("bigint")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(rule.failed(), F.lit(BIT[rule.name])).otherwise(0).cast("bigint"))
    return measure(docs, id_col, text_col).withColumn("fail_bits", bits)


def fails(policy: str) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("bigint")) != 0


def apply_policy(ledger: DataFrame, policy: str) -> DataFrame:
    return ledger.withColumn("kept", ~fails(policy))


def ablations(ledger: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail nothing else, and that a policy without it would keep.

    The ledger shrinks to one row per combination of bits (2 to the number of
    rules at most) before the rules look at it.
    """
    whole = mask(policy)
    held = F.col("fail_bits").bitwiseAND(F.lit(whole).cast("bigint"))
    by_bits = ledger.groupBy(held.alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("bigint").alias("bit")) for name in POLICIES[policy]])
    rows = by_bits.select("bits", "n", F.explode(rules).alias("r"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    bit = F.col("r.bit")
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(
        total(F.col("bits").bitwiseAND(bit) != 0).alias("failed"),
        total(F.col("bits") == bit).alias("failed_alone"),
        total(F.col("bits").bitwiseAND(F.bitwise_not(bit)) == 0).alias("kept_without"))
