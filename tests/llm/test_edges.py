"""Nulls, empty and repeated rows, ties, empty tables and clashing columns; brute force where SQL has no say."""

import base64
import hashlib
import math
import re
from collections import Counter

import pytest

from logstrata.llm import (components, decontaminate, hashing, jaccard_join, lm_scoring, mixing, quality_classifier, quality_rules, secret_scan, sharding, toxicity,
                           url_filter)
from logstrata.plans import durable

BASE = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, BASE, "a"), (2, BASE + " more", "a"), (3, BASE, None), (4, "", "b"), (5, None, "b"), (None, "one two three four five six", "c"), (6, " \n\t ", "c"),
    (7, "other text entirely " * 3, "a"), (7, "other text entirely " * 3, "a"), (8, "Token = \"ab12cd34ef56ab12cd34ef56ab12cd34ef56ab12\" end", "b"), (9, "x " * 3000, "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, 1.0, 2, "s") for r in ROWS]  # score, size and shard clash with what operators add
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, score double, size int, shard string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(text, fold=True):
    w = (text or "").encode().split()
    return [x.lower() for x in w] if fold else w


def brute_components(rows, n, percent):
    sets = []
    for _, text, _ in rows:
        w = words(text)
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    label = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    out = []
    for i, (doc, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_jaccard_join(docs, empty, n, percent):
    got = sorted((tuple(r) for r in jaccard_join.join(docs, n, percent).collect()), key=repr)
    assert got == brute_components(ROWS, n, percent)
    assert jaccard_join.join(empty).count() == 0


@pytest.mark.parametrize("worth", [-1, 10**9])
def test_jaccard_join_of_many_copies(spark, monkeypatch, worth):
    monkeypatch.setattr(jaccard_join, "WORTH", worth)  # with the round of nearest bitmaps, and without
    rows = []
    for i in range(160):  # a hub and its edits: edits of edits don't link, but all link to the hub
        w = BASE.split()
        for k in range(i % 3):
            w[(7 * i + 13 * k) % 60] = f"new{i}x{k}"
        rows.append((i, " ".join(w), "s"))
    got = sorted((tuple(r) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), 2, 85).collect()), key=repr)
    assert got == brute_components(rows, 2, 85)


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(path, "u bigint, v bigint")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_mixing(docs, empty):
    rows = mixing.mix(docs, mixing.cycled((3, 1, 2))).collect()
    again = mixing.mix(docs, mixing.cycled((3, 1, 2))).collect()
    assert sorted(rows, key=repr) == sorted(again, key=repr)
    assert sorted(((r.doc_id, r.size) for r in rows), key=repr) == sorted(((d, len(words(t))) for d, t, _ in ROWS), key=repr)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    sizes = Counter()
    for _, t, s in ROWS:
        sizes[s] += len(words(t))
    names = sorted((s for s in sizes if s), key=str) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full = set()
    while True:
        level = (1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)) / max(1e-9, sum(weight[s] for s in names if s not in full))
        over = {s for s in names if s not in full and level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    for s in names:
        want = 2 * sizes[s] if s in full else level * weight[s]
        mine = [r for r in rows if r.source == s]
        assert all(math.isclose(r.target, want) for r in mine)
        assert abs(sum(r.taken for r in mine) - want) <= 2
    assert mixing.mix(empty, mixing.cycled((3, 1, 2))).count() == 0
    whole = mixing.emitted(mixing.mix(docs, mixing.cycled((3, 1, 2)), keep=("doc_id", "text")))
    assert sum(len(words(r.mixed_text)) for r in whole.collect()) == sum(r.taken for r in rows)


def test_sharding(docs, empty):
    names = [f"s{i}" for i in range(7)]
    table = sharding.fill(names, 101)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.fill(names[:-1], 101)
    moved = sum(names[a] != names[b] for a, b in zip(table, fewer) if a != 6)
    assert moved < 101 // 3
    placed = sharding.place(docs, names, slots=101).collect()
    assert len(placed) == len(ROWS) and len({r.shard for r in placed if r.doc_id == 7}) == 1
    assert sharding.place(empty, names).count() == 0
    with pytest.raises(ValueError):
        sharding.fill(names, 100)


def test_sharding_table_by_turns(spark, tmp_path):
    """The table, filled once more from whole permutations."""
    names, slots = [f"node {i}" for i in (3, 1, 2, 0)], 97
    order = {}
    for name in names:
        start, step = sharding._number(name, "offset") % slots, 1 + sharding._number(name, "skip") % (slots - 1)
        order[name] = [(start + step * k) % slots for k in range(slots)]
        assert sorted(order[name]) == list(range(slots))
    owner = {}
    while len(owner) < slots:
        for name in sorted(names):
            if len(owner) < slots:
                owner[next(slot for slot in order[name] if slot not in owner)] = name
    assert [names[i] for i in sharding.fill(names, slots)] == [owner[slot] for slot in range(slots)]
    rows = spark.createDataFrame([(None, "n"), (0, "x"), (1, "y"), (1, "y"), (None, "m")], "doc_id bigint, text string")
    placed = sharding.place(rows, names, slots=slots)
    sharding.write(placed, str(tmp_path / "shards"), files_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(back.select("doc_id", "text", "slot", "shard").collect(), key=repr) == sorted(placed.collect(), key=repr)
    assert len({r.shard for r in placed.collect() if r.doc_id is None}) == 1


def test_quality_rules(spark, docs, empty):
    ledger = quality_rules.evaluate(docs)
    assert ledger.count() == len(ROWS) and quality_rules.evaluate(empty).count() == 0
    kept = quality_rules.apply_policy(ledger, "strict-1").collect()
    for rule in quality_rules.ablations(ledger, "strict-1").collect():
        bit = quality_rules.BIT[rule.rule]
        assert rule.failed == sum(bool(r.fail_bits & bit) for r in kept)
        assert rule.kept_without == sum(not r.fail_bits & ~bit for r in kept)


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(1, BASE[:120]), (2, None), (3, "six"), (4, ""), (None, "one two"), (5, "absent words of nothing")], "item_id bigint, text string")
    rows = decontaminate.report(decontaminate.Matches(docs, bench)).collect()
    hits = {(r.doc_id, r.n_hit, r.n_items) for r in rows if r.contaminated}
    n = len(BASE[:120].split())
    assert len(rows) == len(ROWS)
    assert {(1, 1), (2, 1), (3, 1)} == {(d, k) for d, _, k in hits if d in (1, 2, 3)} and all(h in (n, n - 1) for d, h, _ in hits if d == 1)
    assert next(r for r in rows if r.doc_id is None).n_hit == 3
    assert decontaminate.report(decontaminate.Matches(empty, bench)).count() == 0
    assert not any(r.contaminated for r in decontaminate.report(decontaminate.Matches(docs, bench.limit(0))).collect())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a1 b2 c3 d4 e5 xx f6 g7 h8 i9 j10"), (2, "j10 nothing here")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "a1 b2 c3 d4 e5 f6 g7 h8 i9 j10")], "item_id bigint, text string")
    m = decontaminate.Matches(docs, bench, slop=1)
    assert m.phrases().count() == 0 and [r.words for r in m.near().collect()] == [10]


def test_proximity_by_brute_force(spark):
    item = [f"w{i}" for i in range(10)]
    texts = [item[:4] + ["zz"] + item[5:], item[:9] + ["zz"], ["zz"] + item[1:8] + ["yy", "w9"], item[:5] + ["zz"] + item[5:], item, item[:6] + ["zz", "yy", "xx"] + item[9:],
             ["w0", "w1"] * 8, item[5:] + item[:5], ["aa"] * 20 + item[:3] + ["zz"] + item[4:] + ["aa"], ["solo", "twin"], ["solo", "more", "twin"]]
    items = [item, item + ["never"], ["solo", "twin"], item[:3] + ["never", "w4"], [f"w{i % 10}" for i in range(25)]]
    slop, share = 1, 0.8
    want = set()
    for d, text in enumerate(texts):
        for b, it in enumerate(items):
            size = min(10, len(it))
            if any(text[k : k + size] == it[j : j + size] for j in range(len(it) - size + 1) for k in range(len(text) - size + 1)):
                continue
            band = lambda e: sum(any(0 <= i + e + s < len(text) and text[i + e + s] == w for s in range(slop + 1)) for i, w in enumerate(it))
            words = max(band(e) for e in range(-len(it) - slop, len(text) + 1))
            if words >= share * len(it):
                want.add((d, b, words))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string")
    m = decontaminate.Matches(docs, bench, slop=slop, share=share)
    rows, names = m.rows().select("rid", "doc_id"), m.items.select("item", "item_id").distinct()
    got = {(r.doc_id, r.item_id, r.words) for r in m.near().join(rows, "rid").join(names, "item").collect()}
    assert got == want and {(0, 0, 9), (1, 0, 9)} <= got
    counted = {r.doc_id: (r.n_items, r.n_near) for r in decontaminate.report(m).collect()}
    exact = {r.doc_id: r.n_items for r in decontaminate.report(decontaminate.Matches(docs, bench)).collect()}
    assert counted == {d: (exact[d], sum(x == d for x, _, _ in want)) for d in range(len(texts))}


def test_lm_scoring_of_nothing(empty):
    assert lm_scoring.score(empty).count() == 0


def test_secret_scan(docs, empty):
    found = secret_scan.scan(docs).collect()
    assert [(r.doc_id, r.position, r.secret) for r in found] == [(8, 2, True)]
    assert secret_scan.scan(empty).count() == 0


def test_secret_candidates_by_brute_force(spark):
    """Pieces, their neighbours and their features, made again in Python."""
    texts = ['{"api_key":"abcd1234efgh5678"}', "password = hunter see 12345", "Password: letmeinplease end", "see src/lib/module07/index.html now", "https://x.io/a?token=Zz9Yy8Xx7Ww6Vv5Uu4&u=1",
             "mail some.body77@mail7.example.com. thanks", "a AUTH 'ab-CD_12.34' b", "plain words only", "", None, "x" * 300_000 + "1 token"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = set()
    for d, text in enumerate(texts):
        w = (text or "").split()
        for i, raw in enumerate(w):
            pieces = re.findall(secret_scan.PIECE, raw)
            seen = w[max(0, i - 2) : i] + pieces
            skip = len(w[max(0, i - 2) : i])
            for k, piece in enumerate(pieces):
                c = re.sub(r"^[.\-/_~]+|[.\-/_~]+$", "", piece)
                before = seen[skip + k - 1] if skip + k >= 1 else None
                before2 = seen[skip + k - 2] if skip + k >= 2 else None
                told = any(re.search(secret_scan.ANNOUNCING, x) for x in (before, before2) if x)
                if len(c) >= 16 and re.search("[0-9]", c) or len(c) >= 6 and told and not re.search(secret_scan.ANNOUNCING, c):
                    want.add((d, i, c, before, before2))
    found = secret_scan.candidates(docs)
    rows = found.collect()
    assert {(r.doc_id, r.position, r.candidate, r.before, r.before2) for r in rows} == want
    assert {"abcd1234efgh5678", "hunter", "letmeinplease", "Zz9Yy8Xx7Ww6Vv5Uu4", "ab-CD_12.34"} <= {c for _, _, c, _, _ in want}
    known = secret_scan.Words(spark.createDataFrame([(i, "water under bridge waters") for i in range(3)] + [(9, None)], "doc_id bigint, text string"))
    assert set(known.parts) == {"wate", "unde", "brid", "ater", "nder", "idge", "ters"}
    pairs = Counter(a + b for part, n in (("wate", 6), ("unde", 3), ("brid", 3), ("ater", 3), ("nder", 3), ("idge", 3), ("ters", 3)) for a, b in zip(part, part[1:]) for _ in range(n))
    rate = lambda a, b: math.log2(sum(pairs[a + x] + 1 for x in "abcdefghijklmnopqrstuvwxyz") / (pairs[a + b] + 1))
    assert math.isclose(known.surprise["wa"], rate("w", "a")) and math.isclose(known.surprise["qz"], rate("q", "z"))
    for r in secret_scan.with_features(found, known).collect():
        c, size = r.candidate, len(r.candidate)
        if size > 1000:
            continue
        steps = [rate(a, b) if (a + b).isascii() and (a + b).isalpha() else math.log2(26) for a, b in zip(c.lower(), c.lower()[1:])]
        kind = lambda x: "0" if x.isdigit() else "A" if x.isupper() else "a" if x.islower() else "."
        changes = sum(kind(a) != kind(b) and "." not in kind(a) + kind(b) for a, b in zip(c, c[1:]))
        want_features = {"length": size, "digits": sum(map(str.isdigit, c)) / size, "uppers": sum(map(str.isupper, c)) / size, "lowers": sum(map(str.islower, c)) / size, "changes": changes / size,
                         "surprise": sum(steps) / (size - 1), "distinct": len(set(c)) / min(size, 64), "covered": (size - len(re.sub("|".join(known.parts), "", c.lower()))) / size,
                         "hexadecimal": bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", c)), "dots": c.count(".") / size, "slashes": c.count("/") / size, "dashes": sum(x in "-_" for x in c) / size, "at": "@" in c,
                         "announced": any(re.search(secret_scan.ANNOUNCING, x) for x in (r.before, r.before2) if x)}
        for name, value in want_features.items():
            assert math.isclose(r[name], float(value), abs_tol=1e-9), (name, c)


def test_words_are_counted_at_every_position(spark, monkeypatch):
    """Middles, repeats, short and long words, words with letters beyond ASCII; runs beside digits are no words."""
    texts = ["Extraordinary EXTRAORDINARY it on", "a" * 30 + "bcqz" + "d" * 30, "d\u00e9veloppement an", "9_zzzz zzzz9 9zzzz 1zzzz", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    said = [w for t in texts for w in re.findall(r"[^\W\d_]{2,}", (t or "").lower()) if "zzzz" not in w]
    runs = lambda size: Counter(w[i : i + size] for w in said for i in range(len(w) - size + 1) if re.fullmatch("[a-z]+", w[i : i + size]))
    used = []
    monkeypatch.setattr(secret_scan, "train", lambda rows, known, *a: used.append(known) or 1 / 0)
    labelled = secret_scan.candidates(spark.createDataFrame([(1, "token = abc123def456ghi789 and src/lib/module07/index.html")], "doc_id bigint, text string")).withColumn("label", (secret_scan.F.col("position") == 2).cast("double"))
    with pytest.raises(ZeroDivisionError):  # what the scan itself learns from
        secret_scan.scan(docs, labelled)
    known, pairs, fours = used[0], runs(2), runs(4)
    assert set(known.parts) == set(fours) and {"aord", "bcqz", "velo"} <= set(fours) and known.parts[0] == fours.most_common(1)[0][0]
    for a in "abcdefghijklmnopqrstuvwxyz":
        for b in "abcdefghijklmnopqrstuvwxyz":
            whole = sum(pairs[a + x] + 1 for x in "abcdefghijklmnopqrstuvwxyz")
            assert math.isclose(known.surprise[a + b], math.log2(whole / (pairs[a + b] + 1))), a + b


def test_secrets_of_formats_that_were_not_learned(spark):
    """Findings of held-out formats and contexts against look-alikes that the corpus holds: precision and recall."""
    d = "/root/testdata/sf0.01"
    corpus = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    digest = lambda i, n: hashlib.sha512(f"held out {i}".encode()).hexdigest()[:n]
    mixed = lambda i, n: base64.b64encode(hashlib.sha512(f"held {i}".encode()).digest()).decode().replace("+", "A").replace("/", "b")[:n]
    made = [f"config glpat-{mixed(i, 20)} stays" for i in range(20)] + [f"the secret: '{mixed(i, 18)}' of it" for i in range(20)] + [f"auth = npm_{mixed(i, 36)};" for i in range(20)] + [f"token={digest(i, 48)}" for i in range(20)]
    rows = corpus.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(made)], "doc_id bigint, text string"))
    labelled = secret_scan.findings(corpus, secret_scan.candidates(corpus))  # made before the planted ones are seen
    found = secret_scan.scan(rows, labelled).collect()
    caught = {r.doc_id for r in found if r.secret and r.doc_id >= 10**6}
    own = [r for r in found if r.doc_id < 10**6]
    planted = {r.doc_id for r in corpus.filter("text rlike '(?i)token = .[0-9a-f]{40}'").collect()}
    assert len(caught) >= 0.9 * len(made)
    assert planted and len(planted & {r.doc_id for r in own if r.secret}) >= 0.9 * len(planted)
    wrong = [r for r in own if r.secret and not re.fullmatch("(?i)[0-9a-f]{40}", r.candidate)]
    assert len(wrong) <= 0.1 * len(planted)
    twice = rows.filter(f"doc_id = {10**6 + 20}")
    assert secret_scan.candidates(twice.unionByName(twice)).count() == 2  # repeated rows, repeated findings


def test_toxicity(spark, docs, empty):
    ordinary = [f"the plain text number {i} says little of note today" for i in range(60)]
    toxic = [f"you are a worthless idiot number {i} and a clown" for i in range(30)]
    rows = [(i, t) for i, t in enumerate(ordinary + toxic)]
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(90) if i % 3] + [(None, 1)], "doc_id bigint, toxic int")
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.fit(table, labels)
    scores = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    assert all((scores[i] >= toxicity.THRESHOLD) == (i >= 60) for i in range(0, 90, 3))  # none of these was learned from
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(empty, model).count() == 0
    assert [r.score for r in toxicity.score(docs, toxicity.fit(table, labels.limit(0))).collect()] == [0.0] * len(ROWS)


def test_the_driver_gives_memory_back(spark, monkeypatch):
    """Garbage of finished steps goes with their tables, where the heap is full enough; a fit's freed memory goes back to the system."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    count = lambda: sum(beans().get(i).getCollectionCount() for i in range(beans().size()) if "Young" not in beans().get(i).getName())
    monkeypatch.setattr(durable, "FULL", 0.0)
    table, before = durable.written(spark.range(3)), count()
    durable.dropped(table)
    assert count() > before
    called = []
    monkeypatch.setattr(toxicity, "trimmed", lambda: called.append(1))
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id bigint, text string")
    toxicity.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int"))
    assert called


def test_toxic_words_of_a_small_language():
    large = [(f"the plain text number {i} says little of note today", 0) for i in range(900)] + [(f"you are a worthless idiot number {i} and a clown", 1) for i in range(300)]
    small = [(f"una frase {i} sin nada" + " bomentera" * (i < 12), 0) for i in range(200)] + [(f"una frase {i} bomentera y bomentoso", 1) for i in range(20)]
    texts, marks = [t.encode() for t, _ in large + small], [m for _, m in large + small]
    sides = [[toxicity.plain(t) for t, m in zip(texts, marks) if m == side] for side in (0, 1)]
    found = toxicity.covering(sides[1], sides[0])
    assert b"omente" in found and b"idiot" in found and b"frase" not in found and b"number" not in found
    toxic, plain = toxicity.Model(texts, marks).score([b"una frase 99 bomentera y bomentoso", b"una frase 99 sin nada"])
    assert toxic >= toxicity.THRESHOLD > plain


def test_covering_by_brute_force():
    """Every run of bytes that is worth it is in the dictionary, and each segment holds one."""
    toxic = [f" some {w} text and {w} again {i} ".encode() for i in range(12) for w in ("grubby", "snarl")]
    plain = [f" some other text and more again {i} ".encode() for i in range(80)]
    grams = lambda t: {t[i : i + toxicity.GRAM] for i in range(len(t) - toxicity.GRAM + 1)}
    worth = set()
    for g in set().union(*map(grams, toxic)):
        f, b = sum(g in t for t in toxic), sum(g in t for t in plain)
        if f - toxicity.BACKGROUND * (b + 1) * len(toxic) / len(plain) - toxicity.LEAST > 0:
            worth.add(g)
    found = toxicity.covering(toxic, plain)
    assert worth and all(g in found for g in worth) and b"grubby" in found and b"snarl" in found
    assert toxicity.covering(toxic, plain, size=20) and len(toxicity.covering(toxic, plain, size=20)) < 40
    assert toxicity.covering([], plain) == toxicity.covering([b"x"], plain) == b""


def test_distance_is_that_of_the_compressors():
    import zstandard

    ordinary, toxic = b" the plain text says little of note " * 4, b" you worthless idiot clown "
    distance = toxicity.Distance(ordinary, toxic)
    assert distance(b"idiot") >= 3 and distance(b"worthless clown") >= 4 and distance(b"plain") <= 1 and distance(b"") == 0
    for window in (b"idiot", b"plain text", b"zzqx"):
        sizes = []
        for content in (ordinary, ordinary + toxic):
            held = zstandard.ZstdCompressionDict(content + toxicity.CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY2, min_match=5, hash_log=16, chain_log=16, search_log=6, window_log=18, write_content_size=0, write_checksum=0, write_dict_id=0)
            made = zstandard.ZstdCompressor(dict_data=held, compression_params=params)
            sizes.append(len(made.compress(b" " + window + b" " + toxicity.CARRIER)) - len(made.compress(b"  " + toxicity.CARRIER)))
        assert abs(distance(window) - (sizes[0] - sizes[1])) <= 1  # a precomputed dictionary may match a byte otherwise
    assert list(toxicity.windows(b"One, two.  three four", 2)) == [b"one two", b"three four"] and list(toxicity.windows(b"", 3)) == []


def test_one_class_and_repeated_labels(spark):
    table = spark.createDataFrame([(1, "a b"), (2, "c d"), (2, "c d"), (None, "x")], "doc_id bigint, text string")
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id bigint, toxic int")
    assert [r.score for r in toxicity.score(table, toxicity.fit(table, one)).collect()] == [1.0] * 4
    both = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, None), (None, 1)], "doc_id bigint, toxic int")
    from logstrata.llm.sampling import labelled

    texts, marks = labelled(table, both, "toxic", 100)
    assert sorted(zip(texts, marks)) == [(b"a b", 1), (b"c d", 0), (b"c d", 0)]
    texts, _ = labelled(table, both, "toxic", 100, most_bytes=1)
    assert len(texts) <= 3


LONG = " ".join(f"w{i % 977}x{i % 131}" for i in range(70_000))  # more than two hashing pieces


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_texts_longer_than_a_hashing_piece(spark, n, percent):
    assert len(LONG) > 2 * hashing.PIECE
    cut = LONG.rsplit(" ", 200)[0]
    rows = [(1, LONG, "a"), (2, cut, "a"), (3, "x" * (hashing.PIECE + 5) + " one two three four five", "a"), (4, BASE, "a"), (5, LONG.replace("w1x", "q1x"), "a")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = sorted((tuple(r) for r in jaccard_join.join(table, n, percent).collect()), key=repr)
    sets = [{tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (words(t) for _, t, _ in rows)]
    want = [(d, len(s), min(rows[j][0] for j, o in enumerate(sets) if 100 * len(s & o) >= percent * len(s | o))) for (d, _, _), s in zip(rows, sets)]
    assert got == want
    scored = {r.doc_id: r for r in lm_scoring.score(table).collect()}
    assert [scored[d].n_words for d, _, _ in rows] == [len(words(t)) for _, t, _ in rows] and scored[1].score > scored[4].score
    model = toxicity.Model([b"plain words here"] * 8 + [b"some idiot here"] * 8, [0] * 8 + [1] * 8)
    whole, last = toxicity.score(table, model).filter("doc_id = 1").first().score, toxicity.score(spark.createDataFrame([(1, LONG + " idiot" * 9000)], "doc_id bigint, text string"), model).first().score
    assert last >= whole  # what stands behind the first pieces counts
    assert list(toxicity.words(LONG.encode())) == [w for w in LONG.lower().encode().split()]
    assert sum(x.sum() for x in [quality_classifier.counted(LONG.encode())]) >= len(LONG)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_scoring_of_any_order_and_input(spark, docs, tmp_path, order):
    texts = [(d, words(t)) for d, t, _ in ROWS]
    grams = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    tables = [Counter(g for _, w in texts for g in grams(w, k)) for k in range(1, order + 1)]
    want = []
    for d, w in texts:
        mine, total = [Counter(grams(w, k)) for k in range(1, order + 1)], 0.0
        rest = max(1, sum(tables[0].values()) - len(w))
        count = lambda g: tables[len(g) - 1][g] - mine[len(g) - 1][g]  # noqa: E731, B023
        for i in range(len(w)):
            penalty = 0.0
            for k in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - k + 1 : i + 1])
                if k == 1:
                    total += penalty + math.log(max(count(g), 0.5) / rest)
                elif count(g) > 0:
                    total += penalty + math.log(count(g) / count(g[:-1]))
                    break
                else:
                    penalty += math.log(lm_scoring.BACKOFF)
        want.append((d, len(w), round(total, 6)))
    docs.write.parquet(str(tmp_path / "docs"))
    files = spark.read.parquet(str(tmp_path / "docs"))
    inputs = [docs, files, files.repartition(4, "doc_id"), files.orderBy("text")] if order == 3 else [files]
    for table in inputs:
        out = lm_scoring.score(table, order=order)
        with durable.settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": "4096", "spark.sql.execution.arrow.maxRecordsPerBatch": "3"}):
            got = [(r.doc_id, r.n_words, round(r.log_score, 6)) for r in out.collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_posteriors_by_brute_force():
    """Expectation-maximisation over the documents one by one, against that over counts of patterns."""
    import random

    import numpy as np

    draw, m = random.Random(4), len(quality_classifier.LABELLERS)
    docs_ = []
    for _ in range(400):
        good = draw.random() < 0.8
        docs_.append([draw.choices((0, 1, 2), (1, 2, 20) if good else (10, 4, 3))[0] for _ in range(m)])
    codes = [sum(v * 3**i for i, v in enumerate(votes)) for votes in docs_]
    held = []
    for votes in docs_:
        row = [1.0 if 0 not in votes else 0.05] + [float(v == 0) + 1e-3 for v in votes]
        held.append([x / sum(row) for x in row])
    for _ in range(200):
        share = [max(sum(h[c] for h in held) / len(held), 1e-6) for c in range(m + 1)]
        table = [[[sum(h[c] for h, v in zip(held, docs_) if v[i] == k) + 0.5 for k in range(3)] for i in range(m)] for c in range(m + 1)]
        table = [[[x / sum(row) for x in row] for row in rows] for rows in table]
        new = []
        for votes in docs_:
            row = [share[c] * math.prod(table[c][i][v] for i, v in enumerate(votes)) for c in range(m + 1)]
            new.append([x / sum(row) for x in row])
        moved = max(abs(a - b) for x, y in zip(held, new) for a, b in zip(x, y))
        held = new
        if moved < 1e-9:
            break
    got = quality_classifier.posteriors(Counter(codes))
    assert all(np.isclose(got[code], h[0], atol=1e-5) for code, h in zip(codes, held))


def test_quality_classifier(spark, docs, empty):
    rows = quality_classifier.classify(docs).collect()
    assert len(rows) == len(ROWS) and sorted((r.doc_id for r in rows), key=repr) == sorted((r[0] for r in ROWS), key=repr)
    scores = {}
    for r in rows:
        scores.setdefault(r.doc_id, set()).add((r.posterior, r.score, r.kept))
        assert r.kept == (r.score >= 0.5) and 0 <= r.posterior <= 1
    assert len(scores[7]) == 1 and scores[4] == scores[5] and scores[1] == scores[3]  # repeated rows; null is as empty
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    kept = {r.doc_id: r.kept for r in quality_classifier.classify(spark.read.parquet(f"{d}/documents.parquet")).collect()}
    good, bad = [i for i, q in labels.items() if q], [i for i, q in labels.items() if not q]
    assert sum(kept[i] for i in good) >= 0.97 * len(good) and sum(not kept[i] for i in bad) >= 0.8 * len(bad)
    assert quality_classifier.classify(empty).count() == 0


def test_url_filter(spark):
    rules = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
    urls = ["http://A.Example.org/es/x?q#f", "http://b.org", "http://b.org/", "https://x.com/fr/1#a", "x.com/de/1", None, "http://x.com/de/?a", "http://example.org/en/12", "http://notexample.org/es/", ""]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(rows, rules).collect()}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[1][:3] == ("b.org", "", None) and got[2] == ("b.org", "/", "org/", "allow")
    assert got[3][2:] == ("com/fr/", "allow") and got[4] == ("", "", None, "allow") and got[5] == ("", "", None, "allow")
    assert got[6][2:] == ("com/de/", "block") and got[7][2:] == ("example.org/en/1", "block") and got[8][2:] == ("org/", "allow")
    assert url_filter.judge(rows.limit(0), rules).count() == 0


def test_markov_models_by_brute_force():
    accepted, rejected = ["a.org/en/1", "a.org/en/2", "b.org/x"], ["c.com/de/1", "c.com/de/2"]
    model = url_filter.Model(accepted, rejected)

    def rate(texts, text, order):
        marked, total = "\x02" * order + text + "\x03", 0.0
        for i in range(order, len(marked)):
            p = 1 / 65_536
            for k in range(order + 1):
                context = marked[i - k : i]
                follow = Counter(t[j + k] for t in ("\x02" * order + x + "\x03" for x in texts) for j in range(order - k, len(t) - k) if t[j : j + k] == context)
                if not follow:
                    break
                p = (follow[marked[i]] + len(follow) * p) / (sum(follow.values()) + len(follow))
            total += math.log(p)
        return total / (len(text) + 1)

    for text in ("a.org/en/3", "c.com/de/3", "zz", "é"):
        want = rate(accepted, text, url_filter.ORDER) - rate(rejected, text, url_filter.ORDER)
        assert math.isclose(model.difference(text), want, rel_tol=1e-9)
    assert model.judge("a.org/en/77")[1] == "allow" and model.judge("c.com/de/77")[1] == "block" and url_filter.Model(accepted, []).judge("c.com")[1] == "allow"


def test_url_models_learn_from_every_judged_url(spark):
    """More judged URLs than any sample held; differences and verdicts against the models over lists."""
    rules = (("org/", "allow"), ("com/de/", "block"))
    urls = [f"http://s{i % 97}.org/en/{i * 7919 % 100_003}" for i in range(12_000)] + [f"http://t{i % 89}.com/de/{i * 31}" for i in range(3001)]
    asked = ["http://s5.net/en/42", "http://t5.com/fr/31", "http://t5.com/de2/31", "http://\u00e9.net/\x02x", "", None, "http://s1.net/en/1", "http://s1.net/en/1", "http://q.net/" + "z" * 3000]
    rows = spark.createDataFrame(list(enumerate(asked + urls + urls[:50])), "page_id bigint, url string").repartition(5)
    text = lambda u: u.split("://")[1]
    model = url_filter.Model(sorted({text(u) for u in urls if ".org" in u}), sorted({text(u) for u in urls if ".com" in u}))
    got = {r.page_id: (r.verdict, r.difference) for r in url_filter.judge(rows, rules).collect()}
    assert len(got) == len(asked) + len(urls) + 50
    for i, u in enumerate(asked):
        d, verdict = model.judge(text(u) if u else "")
        assert got[i][0] == verdict and math.isclose(got[i][1], d, rel_tol=1e-9, abs_tol=1e-12), u
    assert all(got[len(asked) + i] == ("allow" if ".org" in u else "block", None) for i, u in enumerate(urls))
    one = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://b.com/de/y"), (3, "http://c.net/x")], "page_id bigint, url string")  # one of a side teaches and is measured
    d, verdict = url_filter.Model(["a.org/x"], ["b.com/de/y"]).judge("c.net/x")
    found = [r for r in url_filter.judge(one, rules).collect() if r.page_id == 3]
    assert found[0].verdict == verdict and math.isclose(found[0].difference, d, rel_tol=1e-9)


def test_urls_that_repeat_clash_or_tie(spark):
    rules = (("org/a", "allow"), ("org/b", "allow"), ("x.org/a", "block"), ("org/a", "block"))
    rows = spark.createDataFrame([(1, "http://x.org/a", "h"), (1, "http://x.org/a", "h"), (2, "http://y.org/a1", "h"), (None, "http://y.org/b", "h"), (3, "http://z.net/" + "p" * 5000, "h")], "page_id bigint, url string, host string")
    found = [(r.page_id, r.host, r.rule, r.verdict) for r in url_filter.judge(rows, rules).collect()]
    assert found[:4] == [(1, "x.org", "x.org/a", "block")] * 2 + [(2, "y.org", "org/a", "block"), (None, "y.org", "org/b", "allow")] and found[4][:3] == (3, "z.net", None)


def test_repeated_items(spark):
    docs = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (None, "zzz")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(5, "two three"), (5, "two three"), (5, "one two"), (None, "one")], "item_id bigint, text string")
    rows = [tuple(r) for r in decontaminate.report(decontaminate.Matches(docs, bench)).select("doc_id", "n_hit", "n_items", "items_sha256").collect()]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert sorted(rows, key=repr) == sorted([(1, 3, 2, sha("5")), (1, 3, 2, sha("5")), (None, 0, 0, sha(""))], key=repr)


def test_mixing_over_many_shards(spark):
    """Quotas of shards by highest quotients, seat by seat, and rings of blocks that wrap."""
    rows = [(i if i % 5 else None, " ".join(["w"] * (i % 40)), "abc"[i % 7 % 3]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix(docs, mixing.cycled((3, 1, 2)), block_words=8, shard_words=300).collect()
    assert len(out) == len(rows) and len({(r.source, r.shard) for r in out}) > 10
    assert max(Counter((r.source, r.shard) for r in out if r.doc_id is None).values()) < 30  # rows without an id spread
    targets = {r.source: r.target for r in out}
    block = max(1, min(8, int(min(t for t in targets.values() if t) / 1000)))
    seats = Counter()
    for _ in range(round(sum(targets.values()) / block)):
        best = max(targets, key=lambda s: (targets[s] / (2 * seats[s] + 1), -ord(s)))
        seats[best] += 1
    for source in targets:
        shards = {}
        for r in out:
            if r.source == source:
                shards.setdefault(r.shard, []).append(r)
        sizes, quota = {k: sum(r.size for r in v) for k, v in shards.items()}, Counter()
        for _ in range(seats[source]):
            best = max(sizes, key=lambda k: (sizes[k] / (2 * quota[k] + 1), -k))  # noqa: B023
            quota[best] += 1
        for k, members in shards.items():
            ring = -(-sizes[k] // block)
            assert {r.quota for r in members} == {min(quota[k], 2 * ring)}
            whole, rest = divmod(min(quota[k], 2 * ring), max(ring, 1))
            taken = sum(r.taken for r in members)
            assert whole * sizes[k] + max(0, rest * block - block) <= taken <= whole * sizes[k] + rest * block
        assert all(0 <= r.tail_words + r.head_words <= r.size and r.taken <= 2 * r.size for v in shards.values() for r in v)
