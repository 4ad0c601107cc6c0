"""URL filtering by rules and, where none fits, by a ratio of character language models.

Rules allow or block a host with its subdomains and a beginning of the path;
the longest that fits wins. URLs that a rule judges teach two smoothed
variable-order Markov models of characters, one of accepted and one of rejected
URLs. Other URLs are judged by the difference of the log-likelihoods over the
length, against a threshold calibrated on judged URLs that the models had not
learned from.

All distinct judged URLs teach and calibrate. Every second of them, in their
order, teaches the models that the threshold is found with, the others are
measured by these; all teach the models that judge. Counts and questions go by
slice (``slices``) to the partitions that own their contexts: a slice sends its
distinct n-grams once, so a host that is everywhere is a few entries a slice.
Contexts and n-grams are 64-bit hashes. The threshold is found in the order of
the differences, partition by partition; the driver sees totals of partitions.
``Model`` is the same over lists in memory. Null urls and urls without
``://`` have an empty host and path, fit no rule, and are allowed, as is
everything where one side has no examples. Rules of equal length that fit are
settled for block. Long urls are judged whole. Repeated rows are judged alike; an empty table gives an
empty result; columns named like an added one are replaced.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.llm import hashing, slices
from logstrata.llm.text import ascii_lower
from logstrata.plans.durable import dropped, written

ORDER = 5
OWNED = 1 << 20  # bytes of URLs for each partition that owns contexts


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)"))
    host = F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))
    return ascii_lower(host), path


def rule(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name = verdict = None
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[1] != "block", r[0])):
        domain, _, start = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        name = F.when(fits, text) if name is None else name.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (name, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


class Markov:
    """Character probabilities interpolated over all orders up to ``order``, each by the number of followers its context has had."""

    def __init__(self, texts: Sequence[str], order: int = ORDER):
        self.order = order
        self.counts = defaultdict(lambda: defaultdict(int))
        for text in texts:
            marked = "\x02" * order + text + "\x03"
            for i in range(order, len(marked)):
                for k in range(order + 1):
                    self.counts[marked[i - k : i]][marked[i]] += 1
        self.counts = {c: (sum(f.values()), len(f), dict(f)) for c, f in self.counts.items()}

    def rate(self, text: str) -> float:
        """Log-likelihood over length."""
        marked = "\x02" * self.order + text + "\x03"
        total = 0.0
        for i in range(self.order, len(marked)):
            p = 1 / 65_536
            for k in range(self.order + 1):
                found = self.counts.get(marked[i - k : i])
                if found is None:
                    break
                p = (found[2].get(marked[i], 0) + found[1] * p) / (found[0] + found[1])
            total += math.log(p)
        return total / (len(text) + 1)


class Model:
    def __init__(self, accepted: Sequence[str], rejected: Sequence[str]):
        self.sides = None
        if not accepted or not rejected:
            return
        part = [(x[0::2], x[1::2] or x) for x in (sorted(accepted), sorted(rejected))]
        self.sides = Markov(part[0][0]), Markov(part[1][0])
        seen = sorted([(self.difference(t), 1) for t in part[0][1]] + [(self.difference(t), 0) for t in part[1][1]])
        n1, n0 = len(part[0][1]), len(part[1][1])
        best, self.threshold, below1, below0 = -1.0, 0.0, 0, 0
        for i, (d, good) in enumerate(seen):  # the cut with the best mean of both sides' hits
            if i and d > seen[i - 1][0] and (hits := below0 / n0 + 1 - below1 / n1) > best:
                best, self.threshold = hits, (d + seen[i - 1][0]) / 2
            below1, below0 = below1 + good, below0 + 1 - good
        self.sides = Markov(accepted), Markov(rejected)

    def difference(self, text: str) -> float:
        return self.sides[0].rate(text) - self.sides[1].rate(text)

    def judge(self, text: str) -> tuple[float, str]:
        if self.sides is None or not text:
            return 0.0, "allow"
        d = self.difference(text)
        return d, "allow" if d >= self.threshold else "block"


def parsed(pages: DataFrame, rules, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule(rules, F.col("host"), F.col("path"))
    return rows.withColumns({"rule": name, "_says": verdict})


def _marked(texts: Sequence[bytes]):
    """The characters of all texts, each with its marks, and the text of each."""
    whole = [("\x02" * ORDER + t.decode("utf-8", "replace") + "\x03") for t in texts]
    chars = np.frombuffer("".join(whole).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return chars, np.repeat(np.arange(len(whole)), [len(x) for x in whole]), np.array([len(x) for x in whole], np.int64)


def _grams(texts: Sequence[bytes]):
    """Yields (order, n-grams, contexts) of every character and end mark of the texts, in order, and last (None, the text of each, lengths)."""
    chars, owner, sizes = _marked(texts)
    starts = np.cumsum(sizes) - sizes
    at = np.flatnonzero(np.arange(len(chars)) - starts[owner] >= ORDER) if len(chars) else np.zeros(0, np.int64)
    context = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ORDER + 1):
            if k:
                context = hashing.mixed(context * np.uint64(0x9E3779B97F4A7C15) + chars[at - k] + np.uint64(1))
            yield k, hashing.mixed(hashing.mixed(context + np.uint64(k + 1)) + (chars[at] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)), hashing.mixed(context + np.uint64(k + 1))
    yield None, owner[at], sizes - ORDER


def _messages(grams, contexts, bits: int):
    """(distinct n-grams, their contexts, their place for each gram, (part, first, last) of each message), by the part that owns the context."""
    keys, first, places = np.unique(grams, return_index=True, return_inverse=True)
    part = (contexts[first] >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
    return keys[order], contexts[first][order], back[places], [(int(part[order[a]]), int(a), int(b)) for a, b in zip(cuts, [*cuts[1:], len(order)])]


#: What a slice's texts are: the side they teach (None: none), whether they teach the first models, and which models are asked about them.
ROLES = {"allow even": (0, True, None), "allow odd": (0, False, 0), "block even": (1, True, None), "block odd": (1, False, 0), "allow only": (0, True, 0), "block only": (1, True, 0), "other": (None, False, 1)}
ASKED = "slice bigint, role string, kind int, part bigint, keys binary, contexts binary, counts binary"


def _requests(cut: DataFrame, role: str, bits: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, sizes, blob in zip(*(batch.column(c).to_pylist() for c in ("slice", "sizes", "blob"))):
                for k, grams, contexts in _grams(slices.texts(sizes, blob)):
                    if k is None or not len(grams):
                        continue
                    keys, owners, places, messages = _messages(grams, contexts, bits)
                    counts = np.bincount(places, minlength=len(keys))
                    rows = [(name, role, k, part, keys[a:b].tobytes(), owners[a:b].tobytes(), slices.packed(counts[a:b])) for part, a, b in messages]
                    for i in range(0, len(rows), 64):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64]), (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                                                         ["slice", "role", "kind", "part", "keys", "contexts", "counts"])

    return cut.select("slice", "sizes", "blob").mapInArrow(run, ASKED)


def _told(table):
    """The answers of one part of one order: of each n-gram asked for, by side, its count, its context's, and how many followers that has had."""
    import pyarrow as pa

    column = lambda c: table.column(c).to_pylist()
    rows = list(zip(column("slice"), column("role"), column("kind"), column("part"), *([np.frombuffer(x, np.uint64) for x in column(c)] for c in ("keys", "contexts")), column("counts")))
    taught = [r for r in rows if ROLES[r[1]][0] is not None]
    none = np.zeros(0, np.uint64)
    keys, first, places = np.unique(np.concatenate([none, *(r[4] for r in taught)]), return_index=True, return_inverse=True)
    contexts, context_of = np.unique(np.concatenate([none, *(r[5] for r in taught)])[first], return_inverse=True)
    seen = np.zeros((2, 2, len(keys)), np.int64)  # models (first, all), sides
    at = 0
    for r in taught:
        side, early, _ = ROLES[r[1]]
        own = places[at : at + len(r[4])]
        at += len(own)
        for model in (0, 1) if early else (1,):
            seen[model, side][own] += slices.unpacked(r[6])  # a message names an n-gram once
    whole = np.array([[np.bincount(context_of, x, len(contexts)) for x in side] for side in seen]).astype(np.int64)
    followers = np.array([[np.bincount(context_of, x > 0, len(contexts)) for x in side] for side in seen]).astype(np.int64)
    out = []
    for r in rows:
        model = ROLES[r[1]][2]
        if model is None:
            continue
        answer = np.zeros((2, 3, len(r[4])), np.int64)
        for known, asked, where, values in ((keys, r[4], (0,), (seen,)), (contexts, r[5], (1, 2), (whole, followers))):
            if len(known):
                place = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                hit = known[place] == asked
                for w, v in zip(where, values):
                    answer[:, w] = np.where(hit, v[model][:, place], 0)
        out.append((r[0], r[1], r[2], r[3], slices.packed(answer.ravel())))
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary())
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["slice", "role", "kind", "part", "counts"])


def _differences(texts: Sequence[bytes], answers: dict[int, list], bits: int):
    """The difference of each text; ``answers`` are those of its slice, by order."""
    chance, sizes, owner = None, None, None
    for k, grams, contexts in _grams(texts):
        if k is None:
            owner, sizes = grams, contexts
            break
        if chance is None:
            chance = np.full((2, len(grams)), 1 / 65_536)
        if not len(grams):
            continue
        keys, _, places, _ = _messages(grams, contexts, bits)
        told = np.concatenate([slices.unpacked(x).reshape(2, 3, -1) for _, x in sorted(answers[k])], axis=2)
        if told.shape[2] != len(keys):
            raise ValueError("a slice's answers don't fit its questions")
        n, whole, followers = (told[:, i][:, places] for i in range(3))
        chance = np.where(whole > 0, (n + followers * chance) / np.maximum(whole + followers, 1), chance)
    rate = [np.bincount(owner, np.log(p), len(texts)) / np.maximum(sizes, 1) for p in chance]
    return np.where(sizes > 1, rate[0] - rate[1], 0.0)  # an empty text is its end mark


def _judged(rows: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(role, text) of the distinct judged URLs, each side's in turns by their order, and how many each side has."""
    judged = rows.filter("_says is not null").select("_says", F.concat("host", "path").alias("text")).distinct()
    placed = written(judged.repartitionByRange("_says", "text").sortWithinPartitions("_says", "text").withColumn("_at", F.monotonically_increasing_id()), "judged")
    part = F.shiftright("_at", 33)
    runs = placed.groupBy(part.alias("part"), "_says").agg(F.min("_at").alias("first"), F.count("*").alias("n")).orderBy("part", "_says").collect()  # two a partition at most
    before, n = [], {}
    for r in runs:
        before.append((r.part, r._says, n.get(r._says, 0) - r.first))
        n[r._says] = n.get(r._says, 0) + r.n
    known = rows.sparkSession.createDataFrame(before, "part bigint, _says string, _more bigint")
    turn = placed.withColumn("part", part).join(F.broadcast(known), ["part", "_says"])  # two rows a partition at most
    one = F.lit(False)
    for says, k in n.items():
        one = one | ((F.col("_says") == says) & F.lit(k == 1))
    role = F.concat_ws(" ", "_says", F.when(one, "only").when(F.pmod(F.col("_at") + F.col("_more"), F.lit(2)) == 0, "even").otherwise("odd"))
    return turn.select(role.alias("role"), "text"), n


def _threshold(measured: DataFrame, n1: int, n0: int) -> float:
    """The cut with the best mean of both sides' hits, the least of equal ones. ``measured``: good (1 or 0) and difference of each URL, written."""
    from pyspark.sql import Window

    steps = measured.groupBy("difference").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    placed = written(steps.repartitionByRange("difference").sortWithinPartitions("difference").withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33)), "steps")
    runs = placed.groupBy("part").agg(F.max("difference").alias("last"), F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy("part").collect()  # one a partition
    before, last, good, bad = [], None, 0, 0
    for r in runs:
        before.append((r.part, last, good, bad))
        last, good, bad = r.last, good + r.good, bad + r.bad
    known = measured.sparkSession.createDataFrame(before, "part bigint, _last double, _good bigint, _bad bigint")
    order = Window.partitionBy("part").orderBy("difference")
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.join(F.broadcast(known), "part").select(
        "difference", F.coalesce(F.lag("difference").over(order), "_last").alias("under"),
        (F.col("_good") + F.coalesce(F.sum("good").over(above), F.lit(0))).alias("below1"), (F.col("_bad") + F.coalesce(F.sum("bad").over(above), F.lit(0))).alias("below0"))
    hits = F.col("below0") / F.lit(float(n0)) + 1 - F.col("below1") / F.lit(float(n1))
    best = sums.filter("under is not null").select(hits.alias("hits"), ((F.col("difference") + F.col("under")) / 2).alias("cut")).orderBy(F.desc("hits"), "cut").limit(1).collect()
    dropped(placed)
    return best[0].cut if best else 0.0


def differences(rows: DataFrame) -> tuple[DataFrame | None, float]:
    """Rows that no rule judges with their difference, written, and the threshold; None where one side has no examples."""
    taught, n = _judged(rows)
    if len(n) < 2:
        return None, 0.0
    taught = written(taught, "taught")
    roles = [r.role for r in taught.select("role").distinct().collect()]  # six at most
    text = F.concat("host", "path")
    cuts = {role: slices.sliced(taught.filter(F.col("role") == role).select(F.lit(0).alias("doc_id"), F.col("text").alias("_text"))) for role in roles}
    cuts["other"] = slices.sliced(rows.filter("_says is null").select(F.struct("page_id", "host", "path").alias("doc_id"), text.alias("_text")))
    size = sum(cut.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0] for cut in cuts.values())
    bits = max(4, int(np.ceil(np.log2(max(1, size / OWNED)))))
    asked = None
    for role, cut in cuts.items():
        one = _requests(cut, role, bits)
        asked = one if asked is None else asked.unionByName(one)
    told = written(asked.groupBy("kind", "part").applyInArrow(_told, "slice bigint, role string, kind int, part bigint, counts binary"), "told", **slices.ONE)

    def answered(role: str) -> DataFrame:
        cut, kind = cuts[role], cuts[role].schema["ids"].dataType.elementType

        def make(own, answers):
            import pyarrow as pa

            if not own.num_rows:
                raise ValueError("answers to a slice that isn't there")
            found = defaultdict(list)
            for k, part, counts in zip(*(answers.column(c).to_pylist() for c in ("kind", "part", "counts"))):
                found[k].append((part, counts))
            made = _differences(slices.texts(own.column("sizes")[0].as_py(), own.column("blob")[0].as_py()), found, bits)
            return pa.table({"id": pa.concat_arrays([c.values for c in own.column("ids").chunks]), "difference": pa.array(made, pa.float64())})

        return cut.groupBy("slice").cogroup(told.filter(F.col("role") == role).groupBy("slice")).applyInArrow(make, f"id {kind.simpleString()}, difference double")

    measured = None
    for role in roles:
        if ROLES[role][2] is not None:
            one = answered(role).select(F.lit(1 - ROLES[role][0]).alias("good"), "difference")
            measured = one if measured is None else measured.unionByName(one)
    measured = written(measured, "measured", **slices.ONE)
    tested = lambda k: k // 2 or 1
    threshold = _threshold(measured, tested(n["allow"]), tested(n["block"]))
    others = written(answered("other").select("id.*", "difference"), "differences", **slices.ONE)
    dropped(*cuts.values(), told, measured, taught)
    return others, threshold


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and difference (the models', where no rule fits)."""
    rows = parsed(pages, rules, id_col, url_col)
    others, threshold = differences(rows)
    if others is None:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("_says", F.lit("allow")).alias("verdict"), F.when(F.col("_says").isNull(), 0.0).alias("difference"))
    empty = (F.col("host") == "") & (F.col("path") == "")
    guess = F.when(empty | (F.col("difference") >= threshold), "allow").otherwise("block")
    ruled = rows.filter("_says is not null").select("page_id", "host", "path", "rule", F.col("_says").alias("verdict"), F.lit(None).cast("double").alias("difference"))
    return ruled.unionByName(others.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), guess.alias("verdict"), "difference"))
