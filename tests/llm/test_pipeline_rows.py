"""The pipeline's dropping stages judge rows, not ids."""

import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_repeated_and_null_ids(spark, tmp_path):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    table = lambda *rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    docs = table((1, a), (2, a + " more"), (2, b), (None, b), (None, c), (None, c), (3, d), (3, d + " x"), (4, ""), (4, ""), (5, ""), (None, ""))
    assert left(corpus_pipeline.drop_copies(spark, docs, None)) == sorted([(1, a), (2, b), (None, c), (3, d), (4, ""), (5, ""), (None, "")], key=repr)
    spark.createDataFrame([(1, a[:80])], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = table((1, a), (1, b), (None, a), (None, c))
    assert left(corpus_pipeline.drop_leaks(spark, docs, str(tmp_path))) == sorted([(1, b), (None, c)], key=repr)
