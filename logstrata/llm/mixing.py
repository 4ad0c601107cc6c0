"""Mixing sources to target weights by Sainte-Laguë apportionment.

1. Targets: ``share`` of all words is dealt to sources by weight; a target stops
   at ``repeats`` times its source's size and the excess is dealt again by
   weight until none is above.
2. Blocks of equal word counts are apportioned to sources by highest quotients
   votes / (2 k + 1), the targets being the votes, and again within each source
   to its shards by their sizes: integer quotas a shard.
3. A shard is a seeded slice of one source's documents in seeded order, its
   words one ring of blocks. A quota above the ring's length takes whole
   passes; the rest is a run of blocks from a seeded start.

No seat is enumerated beyond O(shards): the common divisor bounds each quota to
a few candidates, and only those are ranked. Documents are shuffled once, as
ids and sizes, by (source, shard); a shard holds about ``shard_words`` words, so
a source with a third of all rows is many shards. Ranking a source's shards is
one task's work on a row per shard. Raise ``shard_words`` with the data.

A block has ``block_words`` words, or a thousandth of the smallest target where
that is less, so that a small source's share isn't lost in rounding; 1 at least.
It decides where runs of words are cut, not how many are taken.

Null and empty texts have size 0: they are never taken and stay in the result.
A null source is a source, ordered last. Sources without words have target 0.
Repeated rows and repeated or null ids are rows like any other: the seeded order
is by id and text, so ties are between equal rows; rows without an id spread over
the shards too (where columns are kept, by their texts only). Very long texts count whole. An empty table gives an empty
result. Only the id, text, source and key columns are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logstrata.llm.text import n_words
from logstrata.plans.durable import written

SHARD_WORDS = 200_000
BLOCK_WORDS = 64
SEED = 20
SPACES = "\x20\t\n\x0b\x0c\r"


def cycled(weights: tuple[float, ...]) -> Callable[[DataFrame], DataFrame]:
    """Weights that repeat over the sources by code point, null last."""
    def of(sources: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # a row a source
        return sources.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights)).cast("int")))
    return of


def targets(sources: DataFrame, share: float = 1.5, repeats: float = 2.0) -> DataFrame:
    """``sources`` (source, source_size, weight) with target. The level of a filling: targets are weight times one level, or full.

    Sources fill in the order of size / weight. The level is what is left after
    the full ones, by the weights of the others; the first source that it
    doesn't fill settles it. A row a source, ranked in one task.
    """
    cap = repeats * F.col("source_size")
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier, rest, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    whole = F.least(F.lit(share), F.lit(repeats)) * F.sum("source_size").over(all_rows)
    left = whole - F.coalesce(F.sum(cap).over(earlier), F.lit(0.0))
    ranked = sources.filter("weight > 0").withColumn("_level", left / F.sum("weight").over(rest))
    level = F.first(F.when(F.col("_level") * F.col("weight") <= cap, F.col("_level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    filled = ranked.withColumn("target", F.least(cap, F.coalesce(level * F.col("weight"), cap)).cast("double")).drop("_level")
    return filled.unionByName(sources.filter("not (weight > 0)").withColumn("target", F.lit(0.0)))


def apportion(parties: DataFrame, votes: str, seats: Column, by: list[str], name: list[str], out: str) -> DataFrame:
    """``parties`` with ``out``, their seats by highest quotients within each group ``by``. ``seats`` is a group's number; ties go by ``name``.

    With V votes, N seats and k parties the final divisor is within N / (N ± k/2)
    of V / N, so a party's seats lie within 1 + votes/V * k/2 of votes * N / V:
    each party gets the lower end outright and ranks the few quotients above it.
    """
    group = Window.partitionBy(*by)
    total, k = F.sum(votes).over(group), F.count("*").over(group)
    base = parties.withColumn("_seats", seats).withColumn("_share", F.when(total > 0, F.col(votes) / total).otherwise(0.0)).withColumn("_slack", F.ceil(F.col("_share") * k / 2) + 1)
    base = base.withColumn("_least", F.greatest(F.floor(F.col("_share") * F.col("_seats")) - F.col("_slack"), F.lit(0)).cast("bigint"))
    base = base.withColumn("_open", F.col("_seats") - F.sum("_least").over(group))
    places = base.withColumn("_j", F.explode(F.sequence(F.col("_least"), F.col("_least") + 2 * F.col("_slack") + 2)))
    quotient = F.col(votes) / (2 * F.col("_j") + 1)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(quotient.desc(), *[F.col(c).asc_nulls_last() for c in name], "_j"))
    won = (rank <= F.col("_open")) & (F.col(votes) > 0)
    counted = places.withColumn("_won", won.cast("bigint")).groupBy(*parties.columns, "_least")
    return counted.agg((F.sum("_won") + F.col("_least")).alias(out)).drop("_least")


def mix(docs: DataFrame, weights: Callable[[DataFrame], DataFrame], share: float = 1.5, repeats: float = 2.0, block_words: int = BLOCK_WORDS,
        shard_words: int = SHARD_WORDS, seed: int = SEED, keep: tuple[str, ...] = (), key_col: str | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, shard, quota (the shard's blocks), passes, first_word, tail_words, head_words, taken, and ``keep``.

    taken = passes * size + tail_words + head_words: whole copies, a run of words
    from ``first_word`` on, and one from the start. Kept columns travel in
    ``kept``, a struct, through the shuffle; a caller with a key of each row's own
    names it as ``key_col``, gets it as ``key``, and joins what it needs.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col), F.lit(seed)).alias("_text"),
                        *([F.col(key_col).alias("key")] if key_col else []), *([F.struct(*keep).alias("kept")] if keep else []))
    # Rows without an id that are equal are told apart by their place in this table, so that they spread over shards.
    place = F.lit(None).cast("bigint") if keep else F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    sized = sized.withColumn("_place", place)
    small = written(sized.drop("kept"), "sizes")
    rows = sized if keep else small
    sources = written(small.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    aimed = written(targets(weights(sources), share, repeats), "targets")
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(Window.partitionBy())
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.coalesce(least, F.lit(1.0)) / 1000))).cast("bigint")
    aimed = aimed.withColumn("block", block)
    seats = F.round(F.sum("target").over(Window.partitionBy()) / F.col("block")).cast("bigint")
    by_source = written(apportion(aimed, "target", seats, [], ["source"], "source_blocks").withColumn(
        "n_shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1))), "quotas")

    def dealt(df: DataFrame) -> DataFrame:
        """Each row with its shard, by what it is, so that every reading of the rows deals alike."""
        joined = df.join(by_source, df["source"].eqNullSafe(by_source["source"])).drop(by_source["source"])
        joined = joined.withColumn("order", F.xxhash64("doc_id", "_text", "_place"))
        return joined.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), F.col("order")), F.col("n_shards")).cast("bigint"))

    shards = dealt(small).groupBy("source", "shard", "block", "source_blocks").agg(F.sum("size").alias("shard_size"))
    shards = written(apportion(shards, "shard_size", F.col("source_blocks"), ["source"], ["shard"], "quota"), "shards")
    ring = F.ceil(F.col("shard_size") / F.col("block"))
    shards = shards.withColumn("ring", ring).withColumn("quota", F.least(F.col("quota"), (F.lit(repeats) * ring).cast("bigint")))
    shards = shards.withColumn("passes", F.when(ring > 0, F.floor(F.col("quota") / ring)).otherwise(0))
    shards = shards.withColumn("start", F.when(ring > 0, F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), ring)).otherwise(0))
    # The run of blocks in words: [lo, hi) and, where it wraps, [0, wrapped).
    end = F.col("start") + F.col("quota") - F.col("passes") * F.col("ring")
    shards = shards.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "quota", "passes", (F.col("start") * F.col("block")).alias("lo"),
                           (F.least(end, F.col("ring")) * F.col("block")).alias("hi"), (F.greatest(end - F.col("ring"), F.lit(0)) * F.col("block")).alias("wrapped"))
    placed = dealt(rows)
    joined = placed.join(shards, placed["source"].eqNullSafe(shards["_source"]) & (placed["shard"] == shards["_shard"])).drop("_source", "_shard")
    own = Window.partitionBy("source", "shard").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = joined.withColumn("b", F.sum("size").over(own)).withColumn("a", F.col("b") - F.col("size"))
    tail = F.greatest(F.least("b", "hi") - F.greatest("a", "lo"), F.lit(0))
    head = F.greatest(F.least("b", "wrapped") - F.col("a"), F.lit(0))
    taken = F.col("passes") * F.col("size") + tail + head
    return at.select("doc_id", "source", "size", "source_size", "target", "shard", "quota", "passes", F.greatest(F.col("lo") - F.col("a"), F.lit(0)).alias("first_word"),
                     tail.alias("tail_words"), head.alias("head_words"), taken.cast("bigint").alias("taken"), *(["key"] if key_col else []), *(["kept"] if keep else []))


def words_from(text: Column, first: Column, count: Column) -> Column:
    """``count`` words of a text from word ``first`` (0 is the first) on, with the white space between them."""
    pieces = F.split(F.ltrim(text, F.lit(SPACES)), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, first.cast("int") + 1, count.cast("int")), "")


def emitted(mixed: DataFrame) -> DataFrame:
    """The mix itself, from mix(keep=(..., "text")): a row a copy, its text in ``mixed_text``; runs that are cut carry their words only."""
    part = lambda first, count: F.struct(first.cast("bigint").alias("first"), count.cast("bigint").alias("count"))
    none = F.expr("cast(array() as array<struct<first:bigint,count:bigint>>)")
    cut = F.col("tail_words") + F.col("head_words") < F.col("size")
    whole = F.array_repeat(part(F.lit(0), F.col("size")), (F.col("passes") + F.when(cut, 0).otherwise(1)).cast("int"))
    tail = F.when(cut & (F.col("tail_words") > 0), F.array(part(F.col("first_word"), F.col("tail_words")))).otherwise(none)
    head = F.when(cut & (F.col("head_words") > 0), F.array(part(F.lit(0), F.col("head_words")))).otherwise(none)
    rows = mixed.filter("taken > 0").withColumn("part", F.explode(F.concat(whole, tail, head)))
    text = F.col("kept.text")
    return rows.withColumn("mixed_text", F.when(F.col("part.count") < F.col("size"), words_from(text, F.col("part.first"), F.col("part.count"))).otherwise(text))
