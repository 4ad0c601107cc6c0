"""The pipeline's stages against brute force, on texts with copies, leaks, toxic words, repeated and null ids."""

import corpus_pipeline
import pytest

from logstrata.llm import catalogue, mixing, sharding
from test_edges import brute_components, words

BASE = [f"word{i}" for i in range(40)]
LEAK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
TEXTS = (
    [(i, " ".join(BASE[: 20 + i]), "en", "web") for i in range(3)]  # near each other, but not copies
    + [(10, " ".join(BASE), "en", "web"), (11, " ".join(BASE), "en", "book"), (None, " ".join(BASE + ["more"]), "de", "book")]  # copies
    + [(7, "quite another text with words of its own and then some", "en", None), (7, " ".join(BASE), "en", "web")]  # one id, one of them a copy
    + [(20, f"before {LEAK} after", "fr", "web"), (21, "clean words only " * 4, "fr", "code"), (20, "clean text that shares its id with a leak", "fr", "web"), (None, f"x {LEAK}", "fr", "web")]
    + [(30, "you are a worthless idiot number 300 and a clown", "en", "web"), (31, "", "en", "web"), (31, "", "en", "web"), (32, None, "en", None), (33, " \n", "en", "web"), (None, None, None, None)]
)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    ordinary = [f"the plain text number {i} says little of note today" for i in range(60)]
    toxic = [f"you are a worthless idiot number {i} and a clown" for i in range(30)]
    rows = TEXTS + [(1000 + i, t, "en", "web") for i, t in enumerate(ordinary + toxic)]
    schema = "doc_id bigint, text string, lang string, source string"
    spark.createDataFrame(rows, schema).selectExpr("*", "cast(length(text) as bigint) as n_chars", "1 as score", "'s' as shard").repartition(5).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1000 + i, 1, int(i >= 60)) for i in range(90)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, LEAK), (2, None), (None, "never there")], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").selectExpr("*", "cast(length(text) as bigint) as n_chars")


def plain(rows):
    return sorted(((r[0], r[1]) for r in rows), key=repr)


def test_toxic_texts_go(spark, sf):
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()}
    assert not any(i in kept for i in range(1060, 1090)) and 30 not in kept
    assert {None, 7, 10, 20, 21, 31, 32, 33, *range(1000, 1060)} <= kept


@pytest.mark.parametrize("from_files", [True, False])
def test_one_of_each_group_of_copies_stays(spark, sf, tmp_path, from_files):
    docs = table(spark, TEXTS)
    if from_files:
        docs.repartition(3).write.parquet(str(tmp_path / "d"))
        docs = spark.read.parquet(str(tmp_path / "d"))
    kept = plain(corpus_pipeline.drop_copies(spark, docs, sf).collect())
    groups = {}
    for i, _, component in brute_components([(i, t, s) for i, (_, t, _, s) in enumerate(TEXTS)], 5, 80):
        doc, text = TEXTS[i][:2]
        groups.setdefault(("group", component) if words(text) else ("row", i) if doc is None else ("blank", doc, text), []).append(doc)
    least = lambda ids: min((x for x in ids if x is not None), default=None)
    assert sorted((d for d, _ in kept), key=repr) == sorted((least(g) for g in groups.values()), key=repr)
    ids = [d for d, _ in kept]
    assert ("quite another text with words of its own and then some") in [t for _, t in kept]  # it shares an id with a copy
    assert sum(t in (" ".join(BASE), " ".join(BASE + ["more"])) for _, t in kept) == 1
    assert ids.count(31) == 1 and (None, None) in kept and (32, None) in kept and (33, " \n") in kept


def test_leaks_go_row_by_row(spark, sf):
    kept = plain(corpus_pipeline.drop_leaks(spark, table(spark, TEXTS), sf).collect())
    assert kept == plain([r for r in TEXTS if LEAK not in (r[1] or "")])


def test_mix_takes_what_the_operator_says(spark, sf):
    docs = table(spark, TEXTS)
    rows = corpus_pipeline.mix_sources(spark, docs, sf).collect()
    numbers = mixing.mix(docs, mixing.cycled((3, 1, 2)), share=1.5, repeats=2.0).collect()
    for source in {r.source for r in numbers}:
        mine = [r for r in numbers if r.source == source]
        taken = sum(len(words(r.text)) for r in rows if r.source == source)
        assert taken == sum(r.taken for r in mine) and abs(taken - mine[0].target) <= 2
    texts = {}
    for r in TEXTS:
        texts.setdefault(r[0], []).append(r[1] or "")
    assert all(any(r.text in t for t in texts[r.doc_id]) and r.n_chars == len(r.text) for r in rows)


def test_shards_are_those_of_the_table(spark, sf):
    filled = sharding.fill(catalogue.SHARDS)
    rows = corpus_pipeline.place_in_shards(spark, table(spark, TEXTS), sf).collect()
    assert len(rows) == len(TEXTS) and all(r.shard == catalogue.SHARDS[filled[r.slot]] for r in rows)


def test_whole_run_and_empty_tables(spark, sf, tmp_path):
    rows = corpus_pipeline.run(spark, sf).collect()
    kept = {r.doc_id for r in rows}
    assert rows and not any(LEAK in r.text or "idiot" in r.text for r in rows) and kept & {7, 21} == {7, 21}
    for name, schema in (("documents", "doc_id bigint, text string, lang string, source string, n_chars bigint"), ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
