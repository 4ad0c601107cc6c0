"""Benchmark decontamination by a distributed positional inverted index.

1. Index: one pass over the texts stores a posting (row, term, position) for
   every training token whose term the test set uses, as a Parquet table in the
   shared folder. A sentinel posting for each row holds its word count, so the
   texts are never read again.
2. Anchors: corpus counts of the test terms name the two rarest places of every
   test window. Every occurrence of a window holds both.
3. Intersection: the anchors' postings, less their offsets in the item, meet in
   the alignments (row, item, diagonal) to try. The lists of all the item's
   terms, adjusted by their offsets, are intersected along those diagonals only.
   Where proximity is asked for, an item's rarest places are anchors too, two
   more than the words that may be missing; a band that holds two is tried.
4. Runs of consecutive matches as long as a window are exact phrases. Along a
   band of ``slop`` diagonals, items of which a share of the words matched
   without an exact phrase are proximity matches.

Rows are told apart by an id given while the index is written, so null or
repeated doc_ids and exact copies are separate rows and spread over all tasks.
The test set is broadcast where its rows and bytes allow it (``durable.small``);
beyond that the same joins shuffle. So for candidate rows.

Null and empty texts have no words and no hits. Items without words match
nothing; items shorter than the window are one window. An item_id that repeats
counts once a text, under one name; a null one counts, but isn't in the list of
names. Very long texts are indexed whole. An empty table on either side gives no
matches. Only ids and texts are taken from the inputs, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logstrata.llm.text import terms
from logstrata.plans.durable import small, written

SENTINEL = "\x00"  # can't be a term


def item_words(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, ipos, term, n) of the test texts; ``item`` is one row of the test set, item_id may be null or repeat."""
    rows = benchmark.select(F.col(id_col).alias("item_id"), terms(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    rows = rows.groupBy("item_id", "w").agg(F.lit(1)).select("item_id", "w", F.xxhash64("item_id", "w").alias("item"))
    return rows.select("item", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("ipos", "term"))


def build_index(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (rid, doc_id, term, pos). A row's sentinel posting has its doc_id and, as pos, its word count."""
    w = terms(F.col("_text"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", w.alias("w"))
    tokens = rows.select("rid", "doc_id", F.posexplode(F.concat("w", F.array(F.lit(SENTINEL)))).alias("pos", "term"))
    known = written(vocabulary.select("term").unionByName(docs.sparkSession.range(1).select(F.lit(SENTINEL).alias("term"))), "terms")
    held = tokens.join(small(known), "term", "left_semi")
    return written(held.select("rid", F.when(F.col("term") == SENTINEL, F.col("doc_id")).alias("doc_id"), "term", "pos"), "postings")


def near_anchors(items: DataFrame, counts: DataFrame, share: float) -> DataFrame:
    """An item's rarest places, two more than a proximity match may miss, so each match holds ``need`` of them: (item, ipos, term, need).

    A term that no text has is a place missed.
    """
    rarest = Window.partitionBy("item").orderBy("count", "term", "ipos")
    ranked = items.join(counts, "term", "left").withColumn("count", F.coalesce("count", F.lit(0))).withColumn("rank", F.row_number().over(rarest))
    held = F.ceil(F.lit(share) * F.col("n"))
    return ranked.filter(F.col("rank") <= F.col("n") - held + 2).select("item", "ipos", "term", F.least(held, F.lit(2)).alias("need"))


def anchors(items: DataFrame, counts: DataFrame, window: int, depth: int) -> DataFrame:
    """The ``depth`` rarest places of every window, one row a place: (item, places, ipos, term). Windows with a term that no text has are dropped."""
    length = F.least("n", F.lit(window))
    starts = items.join(counts, "term", "left").withColumn("count", F.coalesce("count", F.lit(0))).withColumn(
        "start", F.explode(F.sequence(F.greatest(F.col("ipos") - length + 1, F.lit(0)), F.least("ipos", F.col("n") - length))))
    rarest = Window.partitionBy("item", "start").orderBy("count", "term", "ipos")
    chosen = starts.withColumn("rank", F.row_number().over(rarest)).filter(F.col("rank") <= depth)
    places = chosen.groupBy("item", "start").agg(F.sort_array(F.collect_list(F.struct("ipos", "term"))).alias("at"), F.min("count").alias("least"))
    places = places.filter("least > 0").select("item", "at").distinct()
    return places.select("item", F.col("at.ipos").alias("places"), F.explode("at").alias("p")).select("item", "places", "p.ipos", "p.term")


class Matches:
    """The stages' tables: ``postings`` (the index), ``phrases`` and, through near(), proximity matches."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 0, doc_id: str = "doc_id", doc_text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", share: float = 0.8):
        self.window, self.slop, self.share = window, slop, share
        self.items = written(item_words(benchmark, item_id, item_text), "items")
        self.postings = build_index(docs, self.items.select("term").distinct(), doc_id, doc_text)
        tokens = self.postings.filter(F.col("term") != SENTINEL).select("rid", "term", "pos")
        counts = tokens.groupBy("term").agg(F.count("*").alias("count"))
        places = written(anchors(self.items, counts, window, depth=2), "anchors")
        lists = tokens.join(small(places), "term").select("rid", "item", "places", (F.col("pos") - F.col("ipos")).alias("diagonal"))
        met = lists.groupBy("rid", "item", "places", "diagonal").agg(F.count("*").alias("n"))  # a place of a row is one posting
        tried = met.filter(F.col("n") == F.size("places")).select("rid", "item", "diagonal")
        if slop:
            spots = written(near_anchors(self.items, counts, share), "near-anchors")
            hits = tokens.join(small(spots), "term").withColumn("diagonal", F.col("pos") - F.col("ipos"))
            bands = hits.withColumn("band", F.explode(F.sequence(F.col("diagonal") - slop, F.col("diagonal")))).groupBy("rid", "item", "need", "band").agg(
                F.min("ipos").alias("first"), F.max("ipos").alias("last"))
            bands = bands.filter("need < 2 or first < last")
            tried = tried.unionByName(bands.select("rid", "item", F.explode(F.sequence(F.col("band"), F.col("band") + slop)).alias("diagonal")))
        tried = written(tried.distinct(), "alignments")
        rows = written(tried.select("rid").distinct(), "candidates")
        near = tokens.join(small(rows), "rid", "left_semi")
        expected = tried.join(small(self.items), "item").select(
            "rid", "item", "n", "diagonal", "ipos", "term", (F.col("ipos") + F.col("diagonal")).alias("pos")).filter("pos >= 0")
        self.matched = written(expected.join(near, ["rid", "pos", "term"]).select("rid", "item", "n", "diagonal", "ipos"), "matched")

    def phrases(self) -> DataFrame:
        """Exact windows in place: (rid, item, start, length), start being a word position of the row."""
        length = F.least("n", F.lit(self.window))
        lines = self.matched.groupBy("rid", "item", "diagonal", "n").agg(F.sort_array(F.collect_list("ipos")).alias("p"))  # at most an item's words
        full = F.filter("p", lambda x, k: F.get(F.col("p"), k + length - 1) - x == length - 1)
        return lines.select("rid", "item", "diagonal", length.alias("length"), F.explode(full).alias("ipos")).select(
            "rid", "item", (F.col("ipos") + F.col("diagonal")).alias("start"), "length")

    def near(self, share: float | None = None) -> DataFrame:
        """Proximity matches (rid, item, words): ``share`` of an item's words in place within a band of ``slop`` alignments, no exact phrase.

        The share is that of the tables, or a greater one.
        """
        share = self.share if share is None else share
        if share < self.share:
            raise ValueError(f"alignments were made for a share of {self.share}")
        bands = self.matched.withColumn("band", F.explode(F.sequence(F.col("diagonal") - self.slop, F.col("diagonal"))))
        held = bands.groupBy("rid", "item", "n", "band").agg(F.count_distinct("ipos").alias("words"))
        found = held.filter(F.col("words") >= share * F.col("n")).groupBy("rid", "item").agg(F.max("words").alias("words"))
        return found.join(self.phrases().select("rid", "item").distinct(), ["rid", "item"], "left_anti")

    def rows(self) -> DataFrame:
        """Every row of the documents: rid, doc_id, n_words."""
        return self.postings.filter(F.col("term") == SENTINEL).select("rid", "doc_id", F.col("pos").cast("bigint").alias("n_words"))


def report(matches: Matches) -> DataFrame:
    """One row a document: n_words, n_hit, n_items, items_sha256, contaminated (of exact phrases); with slop n_near, near_sha256 (of proximity matches)."""
    phrases = written(matches.phrases(), "phrases")
    hit = phrases.select("rid", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos")).distinct().groupBy("rid").agg(F.count("*").alias("n_hit"))
    names = matches.items.select("item", F.col("item_id").cast("string").alias("name")).distinct()
    names = small(written(names, "names"))
    by_row = phrases.select("rid", "item").distinct().join(names, "item").select("rid", "name").distinct().groupBy("rid").agg(
        F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("name")), ",").alias("ids"))
    found = hit.join(by_row, "rid")
    near = []
    if matches.slop:
        by_near = matches.near().select("rid", "item").join(names, "item").select("rid", "name").distinct().groupBy("rid").agg(
            F.count("*").alias("n_near"), F.array_join(F.sort_array(F.collect_list("name")), ",").alias("near_ids"))
        found = found.join(by_near, "rid", "full_outer")
        near = [F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.sha2(F.coalesce("near_ids", F.lit("")), 256).alias("near_sha256")]
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return matches.rows().join(found, "rid", "left").select(
        "doc_id", "n_words", zero("n_hit"), zero("n_items"), F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), (zero("n_hit") > 0).alias("contaminated"), *near)
