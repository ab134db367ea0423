"""Tables whose other columns have the names that operators use themselves."""

from tessella.llm import decontaminate, jaccard, lm

TEXT = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def test_one_of_each_keeps_all_columns(spark):
    rows = [(1, TEXT, "b", 2, 3), (1, TEXT, "a", 2, 3), (2, TEXT, "c", 2, 3), (3, "else", "d", 2, 3), (None, "no id", "e", 2, 3), (None, "no id", "f", 2, 3), (4, None, "g", 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __text string, __kept long, __hash long")
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["__text"] for r in kept.collect()) == ["a", "d", "e", "g"]


def test_clean_keeps_all_columns(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "WHOLE_BYTES", 10)
    docs = spark.createDataFrame([(1, TEXT, 5, 6), (2, "clean", 5, 6), (None, None, 5, 6)], "doc_id long, text string, __doc_id long, __text_hash long")
    benchmark = spark.createDataFrame([("a", TEXT), ("b", "another item of the benchmark that is nowhere in any of the documents here")], "item_id string, text string")
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, None}


def test_learning_goes_by_tokens_not_by_tasks(spark):
    """A net of a table in many parts is about as good as one of a table in one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    means = []
    for parts in (1, 48):
        r = lm.held_out_scores(docs.repartition(parts)).where("held_out").selectExpr("sum(score) / sum(n_tokens)", "sum(base_score) / sum(n_tokens)").first()
        means.append(r[0])
        assert r[0] > r[1] + 0.02
    assert abs(means[0] - means[1]) < 0.05
