"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

Rows are told apart by their place in the files that a stage reads, not by
doc_id: null and repeated ids are judged row by row, and nothing is copied for it.
Every stage keeps null and empty texts unless it says otherwise, and gives an
empty table for one. ``labels`` and ``benchmark`` may be empty.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from logstrata.llm import catalogue, decontaminate, jaccard_join, mixing, sharding, toxicity
from logstrata.llm.text import SPACE
from logstrata.plans.durable import dropped, small, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs):
    """``docs`` with a key of each row's own (_key): its file and place; rows that aren't read from files are written first."""
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return docs.select(*COLUMNS, place.alias("_key"))
    except AnalysisException:
        return written(docs.select(*COLUMNS), "rows").select(*COLUMNS, place.alias("_key"))


def _without(keyed, gone):
    """The rows less those of the written keys ``gone`` (column _gone), broadcast where their size allows it."""
    return keyed.join(small(gone), F.col("_key") == F.col("_gone"), "left_anti").select(*COLUMNS)


def drop_toxic(spark, docs, sf_dir):
    """Documents whose score reaches the threshold go. The model learns from labelled rows of ``documents`` outside the held-out fold.

    Without labels, or with one class only, every text scores that class's share. Null and empty texts have no toxic windows.
    """
    whole, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(whole, labels.filter(~toxicity.held_out()))
    return toxicity.score(docs, model).filter(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_copies(spark, docs, sf_dir):
    """One row of each group of near copies (five words, 0.8) stays: that of the least id, of several the first; one without an id only where no row has any.

    Texts without words are copies only where the id and the text are the same; those without an id stay.
    """
    keyed = _keyed(docs)
    groups = written(jaccard_join.join(keyed.select(F.col("_key").alias("doc_id"), "text"), n=5, percent=80), "groups")
    blank = F.col("doc_id").isNotNull() & F.coalesce("text", F.lit("")).rlike(f"^{SPACE}*$")
    rows = written(keyed.select("_key", "doc_id", blank.alias("blank"), F.when(blank, F.col("text")).alias("blank_text")).join(
        groups.select(F.col("doc_id").alias("_key"), "component_id"), "_key"), "copies")
    group = [F.when(~F.col("blank"), F.col("component_id")), F.when(F.col("blank"), F.col("doc_id")), "blank_text"]
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key"))["_key"]
    kept = rows.groupBy(*group).agg(first.alias("_key")).select("_key")
    gone = written(rows.join(kept, "_key", "left_anti").select(F.col("_key").alias("_gone")), "gone")
    dropped(groups, rows)
    return _without(keyed, gone)


def drop_leaks(spark, docs, sf_dir):
    """Rows with any occurrence of a benchmark window go; without benchmark texts none does."""
    keyed = _keyed(docs)
    found = decontaminate.report(decontaminate.Matches(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, doc_id="_key"))
    return _without(keyed, written(found.filter("contaminated").select(F.col("doc_id").alias("_gone")), "gone"))


def mix_sources(spark, docs, sf_dir):
    """A row for each copy that the mix takes; a cut run of words is a row with its part of the text, and n_chars its characters.

    Texts without words are never taken. Only ids and sizes are dealt and ranked; texts meet what is taken of them by their key.
    """
    keyed = _keyed(docs)
    mixed = mixing.mix(keyed, mixing.cycled((3, 1, 2)), share=1.5, repeats=2.0, key_col="_key").filter("taken > 0")
    mixed = written(mixed.select(F.col("key").alias("_taken"), "size", "passes", "first_word", "tail_words", "head_words", "taken"), "mixed")
    taken = keyed.join(small(mixed), F.col("_key") == F.col("_taken")).withColumn("kept", F.struct(*COLUMNS))
    return mixing.emitted(taken).select("kept.doc_id", F.col("mixed_text").alias("text"), "kept.lang", "kept.source", F.length("mixed_text").cast("bigint").alias("n_chars"))


def place_in_shards(spark, docs, sf_dir):
    """Each row with the slot and shard of its doc_id; equal ids share a shard, and a null id has one too."""
    return sharding.place(docs, catalogue.SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_copies),
    ("benchmark_decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", place_in_shards),
]

#: Fitting dictionaries and a logistic scorer isn't SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
            if before is not None:
                dropped(before)
            before = docs
    return docs
