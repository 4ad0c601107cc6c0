"""N-gram Jaccard join: a grouped prefix join over whole texts.

1. Every distinct shingle's number of texts is counted, exactly but for rare
   hash collisions (``slices``). The global order of shingles is by that number,
   rarest first, then by hash.
2. Shingles of one text only can't be shared: they fill places of a prefix, but
   go no further. A text whose prefix has no others links with nothing. What is
   left of the other texts (*nodes*: texts with equal sets are one) is a table
   of their shared shingles, a small part of the corpus.
3. Nodes with identical prefixes and size are one group; prefix lists hold groups.
4. First, each group's likeliest neighbours by size and likeliest hub, and the
   members of a group with its head, are verified; then, where much is left,
   each that is still outside with the nearest bitmap of a list. This is linear in the lists, and
   enough to make large families of copies one component. Then every pair of a
   list that lies in two components, and fits by size, position and bitmaps of
   the members' shingles, is expanded to its members and verified. Pairs within
   one component can't change the result and are never made.

A link between different texts is therefore never lost, and no list is paired
with itself as a whole: what a list emits is its entries times those outside of
its largest component, and few of these pass the bitmaps.

Null and empty texts have no shingles and link with nothing, so they are their
own component. Repeated rows link as equal sets do; a component's id is its
least doc_id, null only where all its ids are null. Very long texts are hashed
in pieces. An empty table gives an empty result. Only the id and the text are
read, so other columns can't clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logstrata.llm import hashing, slices
from logstrata.llm.components import components
from logstrata.plans.durable import dropped, written

COARSE, FINE = 8, 32  # longs of the two bitmaps of a set
LIST = 512  # entries of a prefix list among which neighbours are sought together
WORTH = 32  # pairs for each entry of the lists from which on a round of nearest bitmaps spares more work than it makes; the result is the same
FAN = 256  # partners of a node that are verified in one task


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def bitmap(s):
    """Which of 64 * COARSE buckets of hashes a set has, then which of 64 * FINE. Two sets differ in one member at least for each bucket of a size that only one of them has."""
    made = []
    for longs in (COARSE, FINE):
        bits = np.zeros(64 * longs, np.uint8)
        bits[(s % np.uint64(64 * longs)).astype(np.int64)] = 1
        made.append(np.packbits(bits).view(np.int64))
    return np.concatenate(made)


def _placed(cut: DataFrame, answers: DataFrame, plan: slices.Plan, n: int, percent: int) -> DataFrame:
    """(doc_id, fp, n, g, prefix, shared, bits) of every row; g names a prefix with its size. Null after n where nothing can link, or where the slice has the set already."""
    def make(ids, texts, counts):
        import pyarrow as pa

        sets, prints, first = _sets(texts, n)
        own = [sets[i] for i in first.values()]
        flat = np.concatenate(own) if own else np.zeros(0, np.uint64)
        asked, places = np.unique(plan.keys(flat), return_inverse=True)
        told = counts.get(1, np.zeros(0, np.int64))
        if len(asked) != len(told):
            raise ValueError("a slice's answers don't fit its questions")
        uses, at = told[places], 0
        groups, prefixes, kept, maps = ([None] * len(sets) for _ in range(4))
        for i in first.values():
            s, df = sets[i], uses[at : at + len(sets[i])]
            at += len(s)
            shared = df > 1
            room = prefix_length(len(s), percent) - len(s) + int(shared.sum())
            if room > 0 and shared.any():
                kept[i] = s[shared]
                prefixes[i] = kept[i][np.lexsort((kept[i], df[shared]))[:room]]
                groups[i] = int(np.frombuffer(hashing.fingerprint(np.append(prefixes[i], np.uint64(len(s)))), np.int64)[0])
                maps[i] = bitmap(s)
        lists = lambda found: pa.array([None if x is None else x.view(np.int64) for x in found], pa.list_(pa.int64()))
        return pa.table({"doc_id": ids, "fp": pa.array(prints, pa.binary()), "n": pa.array([len(s) for s in sets], pa.int64()), "g": pa.array(groups, pa.int64()),
                         "prefix": lists(prefixes), "shared": pa.array([None if x is None else x.tobytes() for x in kept], pa.binary()), "bits": lists(maps)})

    kind = cut.schema["ids"].dataType.elementType.simpleString()
    return slices.answered(cut, answers, make, f"doc_id {kind}, fp binary, n bigint, g bigint, prefix array<bigint>, shared binary, bits array<bigint>")


def _sets(texts: list[bytes], n: int):
    """(sets, their fingerprints, the first place of each distinct one that isn't empty) of the texts of a slice."""
    sets = [s for _, s in hashing.shingle_sets(texts, n)]
    prints, first = hashing.fingerprints(sets), {}
    for i, fp in enumerate(prints):
        if fp is not None:
            first.setdefault(fp, i)
    return sets, prints, first


def verified(nodes: DataFrame, percent: int, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) of fingerprints whose sets reach ``percent``, on all their shared shingles.

    A pair carries the set of its end with fewer partners to a part of those of
    the other; an end's set goes to each ``FAN`` of its partners once.
    """
    ends = pairs.select(F.explode(F.array("u", "v")).alias("fp")).groupBy("fp").agg(F.count("*").alias("k"))
    ends = written(ends, "ends")
    degrees = lambda end: ends.select(F.col("fp").alias(end), F.col("k").alias(f"k{end}"))
    swap = F.col("ku") > F.col("kv")
    turned = pairs.join(degrees("u"), "u").join(degrees("v"), "v").select(
        *[F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("u", "v"), ("v", "u"))], F.greatest("ku", "kv").alias("k"))
    parts = lambda k: F.ceil(k / FAN).cast("int")
    sets = written(nodes.select("fp", "n", "shared").join(ends, "fp"), "sets")
    left = turned.join(sets.select(F.col("fp").alias("u"), F.col("n").alias("nu"), F.col("shared").alias("a")), "u").withColumn("part", F.pmod(F.hash("u"), parts(F.col("k"))))
    right = sets.select(F.col("fp").alias("v"), F.col("n").alias("nv"), F.col("shared").alias("b"), F.explode(F.sequence(F.lit(0), parts(F.col("k")) - 1)).alias("part"))
    both = left.join(right, ["v", "part"]).select("u", "v", "nu", "nv", "a", "b")

    def judge(batches):
        import pyarrow as pa

        for batch in batches:
            sizes = batch.column("nu").to_numpy() + batch.column("nv").to_numpy()
            good = []
            for size, a, b in zip(sizes, batch.column("a"), batch.column("b")):
                common = len(np.intersect1d(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), assume_unique=True))
                good.append(100 * common >= percent * (int(size) - common))
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    found = written(both.mapInArrow(judge, "u binary, v binary"), "links", **slices.SMALL)
    dropped(ends, sets)
    return found


def _fits(n1, n2, percent: int):
    return 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)


def _met(n1, n2, percent: int):
    """How many prefix shingles two sets of these sizes share at least, if they link: the overlap less what can lie behind either prefix."""
    rest = lambda n: F.ceil(F.lit(percent) * n / 100) - 1
    return F.ceil(F.lit(percent) * (n1 + n2) / (100 + percent)) - F.greatest(rest(n1), rest(n2))


def _may_differ(n1, n2, percent: int):
    return n1 + n2 - 2 * F.ceil(F.lit(percent) * (n1 + n2) / (100 + percent))


def _sum(numbers):
    return F.aggregate(numbers, F.lit(0), lambda x, y: x + y)


def _fine(bits: str):
    return F.slice(bits, COARSE + 1, FINE)


def _apart(bits: str, others: str):
    """Buckets that only one of two sets has."""
    return _sum(F.zip_with(_fine(bits), _fine(others), lambda a, b: F.bit_count(a.bitwiseXOR(b))))


def _likely(groups: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of nodes to be tried first: of each group its likeliest neighbour by size and its likeliest hub, and each node with its group's head.

    Neighbours are sought among ``LIST`` entries of a list or so. A hub is the group of a list whose own lists are
    longest, which is what copies with edits were made from. What this misses, the second step finds.
    """
    entries = groups.select("g", "n", F.explode("prefix").alias("token"))
    lengths = entries.groupBy("token").agg(F.count("*").alias("length")).filter("length > 1")
    lists = written(entries.join(lengths, "token"), "lists")
    dealt = lists.withColumn("salt", F.pmod(F.hash("g"), F.ceil(F.col("length") / LIST)))
    beside = dealt.withColumn("o", F.lag(F.struct("g", "n")).over(Window.partitionBy("token", "salt").orderBy("n", "g"))).select("g", "n", F.col("o.g").alias("g0"), F.col("o.n").alias("n0"))
    scores = lists.groupBy("g").agg(F.sum("length").alias("score"))
    hubs = lists.join(scores, "g").groupBy("token").agg(F.max_by(F.struct("g", "n"), F.struct("score", "g")).alias("hub"))
    to_hub = lists.join(hubs, "token").select("g", "n", F.col("hub.g").alias("g0"), F.col("hub.n").alias("n0"))

    def likeliest(tried: DataFrame) -> DataFrame:
        tried = tried.filter("g0 != g").filter(_fits(F.col("n"), F.col("n0"), percent)).groupBy("g", "n", "g0", "n0").agg(F.count("*").alias("k"))
        return tried.filter(F.col("k") >= _met(F.col("n"), F.col("n0"), percent) / 2).groupBy("g").agg(F.max_by("g0", F.struct("k", "g0")).alias("g0"))

    heads = nodes.groupBy("g").agg(F.min_by(F.struct("fp", "bits", "n"), "fp").alias("h")).select("g", "h.*")
    steps = likeliest(beside.filter("g0 is not null")).unionByName(likeliest(to_hub)).distinct()
    head = lambda g, x: heads.select(F.col("g").alias(g), F.col("fp").alias(x), F.col("bits").alias(f"bits{x}"), F.col("n").alias(f"n{x}"))
    across = steps.join(head("g", "u"), "g").join(head("g0", "v"), "g0").filter(_apart("bitsu", "bitsv") <= _may_differ(F.col("nu"), F.col("nv"), percent)).select("u", "v")
    inside = nodes.select("g", F.col("fp").alias("u")).join(heads.select("g", F.col("fp").alias("v")), "g").select("u", "v")
    pairs = across.unionByName(inside).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u != v").distinct()
    return lists, written(pairs, "pairs")


def _parted(nodes: DataFrame, lists: DataFrame, labels: DataFrame):
    """Written tables of what components leave to be tried.

    ``placed``: nodes with their component c. ``maps``: the parts of groups, members of one component, whose bitmaps
    meet in "all" and "any". ``open``: the parts in each list that lies in several components, with its largest one.
    """
    placed = written(nodes.select("fp", "n", "g", "bits").join(labels, F.col("fp") == F.col("node"), "left").select("fp", "n", "g", "bits", F.coalesce("component", "fp").alias("c")), "placed")
    each = range(COARSE + FINE)
    maps = written(placed.groupBy("g", "c").agg(
        F.array(*[F.bit_and(F.get("bits", F.lit(i))) for i in each]).alias("all"), F.array(*[F.bit_or(F.get("bits", F.lit(i))) for i in each]).alias("any"),
        F.max("n").alias("n"), F.min("fp").alias("head")), "maps")
    parts = lists.select("token", "length", "g").join(maps.select("g", "c"), "g")
    sizes = parts.groupBy("token", "c").agg(F.count("*").alias("k"))
    mixed = sizes.groupBy("token").agg(F.max_by("c", F.struct("k", "c")).alias("largest"), F.count("*").alias("n_parts")).filter("n_parts > 1").drop("n_parts")
    return placed, maps, written(parts.join(mixed, "token").join(maps, ["g", "c"]), "open")


def _side(x: str) -> list:
    return [F.col(c).alias(f"{c}{x}") for c in ("g", "c", "n", "all", "any", "head")]


def _outside():
    """Buckets that all members of one part have and none of the other's, both ways."""
    one = lambda x, y: _sum(F.zip_with(_fine(f"all{x}"), _fine(f"any{y}"), lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))))
    return one("a", "b") + one("b", "a")


def _near(percent: int):
    """Whether two parts may link by their sizes and bitmaps; the coarse ones, in compiled code, spare most pairs the fine."""
    one = lambda x, y, i: F.bit_count(F.get(f"all{x}", F.lit(i)).bitwiseAND(F.bitwise_not(F.get(f"any{y}", F.lit(i)))))
    coarse = sum((one(x, y, i) for i in range(COARSE) for x, y in ("ab", "ba")), F.lit(0))
    most = _may_differ(F.col("na"), F.col("nb"), percent)
    return _fits(F.col("na"), F.col("nb"), percent) & (coarse <= most) & (_outside() <= most)


def _nearest(open_lists: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of nodes: each part outside the largest component of its longest, or its shortest, list with the part there whose bitmap is nearest."""
    outer = open_lists.filter("c != largest")
    ends = outer.groupBy("g", "c").agg(F.max_by("token", F.struct("length", "token")).alias("longest"), F.min_by("token", F.struct("length", "token")).alias("shortest"))
    asked = ends.select("g", "c", F.explode(F.array_distinct(F.array("longest", "shortest"))).alias("token"))
    a = outer.join(asked, ["token", "g", "c"]).select("token", *_side("a"))
    b = open_lists.select("token", *_side("b"))
    met = a.join(b, (a["token"] == b["token"]) & (F.col("ca") != F.col("cb")) & _near(percent)).select(
        a["token"], "heada", F.least("heada", "headb").alias("u"), F.greatest("heada", "headb").alias("v"), _outside().alias("apart"))
    best = met.join(tried, ["u", "v"], "left_anti").groupBy("heada", "token").agg(F.min_by(F.struct("u", "v"), F.struct("apart", "u", "v")).alias("p"))
    return best.select("p.u", "p.v").distinct()


def _left(open_lists: DataFrame) -> float:
    """How many pairs the exact step has to look at for each entry of the lists."""
    lists = open_lists.groupBy("token").agg(F.count("*").alias("k"), F.count_if(F.col("c") != F.col("largest")).alias("outer"))
    return lists.agg(F.coalesce(F.sum(F.col("k").cast("double") * F.col("outer")) / F.sum("k"), F.lit(0.0))).first()[0]


def linked(rows: DataFrame, percent: int) -> DataFrame:
    """(node, component) of every node that a link joins to another; ``rows`` are those of _placed."""
    nodes = written(rows.filter("g is not null").select("fp", "n", "g", "prefix", "shared", "bits").dropDuplicates(["fp"]), "nodes")
    groups = nodes.select("g", "n", "prefix").dropDuplicates(["g"])
    lists, tried = _likely(groups, nodes, percent)
    found = verified(nodes, percent, tried)
    labels = written(components(found), "labels")
    tables = _parted(nodes, lists, labels)

    def joined(more: DataFrame) -> DataFrame:
        """The components so far are stars, which new links join."""
        return written(components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)), "labels")

    if _left(tables[2]) > WORTH:
        nearest = written(_nearest(tables[2], tried, percent), "pairs")
        more = verified(nodes, percent, nearest)
        if not more.isEmpty():
            labels = joined(more)
            dropped(*tables)
            tables = _parted(nodes, lists, labels)
        tried = tried.unionByName(nearest)
    placed, maps, open_lists = tables

    a = open_lists.filter("c != largest").select("token", *_side("a"))
    b = open_lists.select("token", *_side("b"), "largest")
    once = (F.col("cb") == F.col("largest")) | (F.col("ga") < F.col("gb")) | ((F.col("ga") == F.col("gb")) & (F.col("ca") < F.col("cb")))
    met = a.join(b, (a["token"] == b["token"]) & (F.col("ca") != F.col("cb")) & once & _near(percent))
    # A pair's side depends on the list's largest component, so both directions count as one.
    swap = F.struct("ga", "ca") > F.struct("gb", "cb")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x)
    met = met.select(pick("ga", "gb"), pick("ca", "cb"), pick("na", "nb"), pick("gb", "ga"), pick("cb", "ca"), pick("nb", "na"))
    met = met.groupBy("ga", "ca", "na", "gb", "cb", "nb").agg(F.count("*").alias("k")).filter(F.col("k") >= _met(F.col("na"), F.col("nb"), percent)).select("ga", "ca", "gb", "cb")
    same = maps.select(*_side("a")).join(maps.select(*_side("b")), (F.col("ga") == F.col("gb")) & (F.col("ca") < F.col("cb")) & _near(percent)).select("ga", "ca", "gb", "cb")
    pairs = written(met.unionByName(same).distinct(), "parts")
    own = lambda x, y: placed.select(F.col("g").alias(f"g{x}"), F.col("c").alias(f"c{x}"), F.col("fp").alias(y), F.col("n").alias(f"n{y}"), F.col("bits").alias(f"bits{y}"))
    members = pairs.join(own("a", "u"), ["ga", "ca"])
    others = own("b", "v").withColumnsRenamed({"gb": "_g", "cb": "_c"})
    close = _apart("bitsu", "bitsv") <= _may_differ(F.col("nu"), F.col("nv"), percent)
    second = members.join(others, (F.col("gb") == F.col("_g")) & (F.col("cb") == F.col("_c")) & close).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    second = written(second.distinct().join(tried, ["u", "v"], "left_anti"), "pairs")
    more = verified(nodes, percent, second)
    if not more.isEmpty():
        labels = joined(more)
    dropped(nodes, lists, placed, maps, open_lists, pairs, second)
    return labels


def join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id."""
    cut = slices.sliced(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")))
    plan = slices.Plan(cut, spare=8)  # a rare collision only costs work

    def tokens(texts):
        sets, _, first = _sets(texts, n)
        if first:
            yield 1, np.concatenate([sets[i] for i in first.values()])

    answers = written(slices.counted(slices.requests(cut, plan, tokens), plan), "answers", **slices.ONE)
    rows = written(_placed(cut, answers, plan, n, percent), "rows", **slices.SMALL)
    dropped(cut, answers)
    nodes = written(rows.filter("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("least")), "least")
    labels = linked(rows, percent)
    named = nodes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    ids = named.groupBy("c").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "c").select("fp", "component_id")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "fp").join(named, "fp", "left").select(
        "doc_id", "n_shingles", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
