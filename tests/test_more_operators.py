"""Ranks, query sets, judging, files, caches, providers and windows, by hand."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import judging, merge, metrics, providers, queryset, ranks
from tessella.sources import files
from tessella.streaming import events


@pytest.mark.parametrize("values", [[5.0], [1.0, 1.0, 1.0], [3.0, -2.5, 7.0, 7.0, 1e300, -1e308, 1e308], [0.0, 5e-324, 1e-323, 5e-324], list(map(float, range(5000)))])
def test_value_at(spark, values):
    rows = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
    for position in {1, len(values) // 2 + 1, len(values)}:
        assert ranks.value_at(rows, "v", position) == sorted(values)[position - 1]


def test_value_at_of_nothing(spark):
    assert ranks.value_at(spark.createDataFrame([], "v double"), "v", 1) is None
    assert metrics.nearest_rank(spark.createDataFrame([], "v double"), "v", {"p": 0.5}).first().p is None


def test_numbered(spark):
    rows = [("b", 2), ("abcd", 2), ("abc", 2), ("ab", 2), ("z", 9), ("é", 1), ("a", 1)]
    found = ranks.numbered(spark.createDataFrame(rows, "term string, df long"), "df", "term", "at").collect()
    assert [r.term for r in sorted(found, key=lambda r: r["at"])] == ["z", "ab", "abc", "abcd", "b", "a", "é"]
    assert sorted(r["at"] for r in found) == list(range(1, 8))


def test_worksheet_and_versions(spark):
    sheet = spark.createDataFrame([("a", "1"), ("b", " 0 "), ("c", "x"), ("d", "2"), ("e", None)], "pair_id string, human_grade string")
    labels = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("e", 1)], "key string, grade int")
    r = judging.calibration(sheet, labels).first()
    assert (r.n_graded, r.n_skipped, r.agreement, r.passed) == (2, 3, 0.5, False)
    runs = spark.createDataFrame([("a", 1), ("b", 1)], "run string, queries int")
    assert judging.one_version(runs, "queries").count() == 2
    with pytest.raises(ValueError):
        judging.one_version(runs, "queries", "run")


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "q", b'), (2, None)], "b int, a string")
    files.write_lines(rows, f"{tmp_path}/lines")
    lines = sorted(r.value for r in spark.read.text(f"{tmp_path}/lines").collect())
    assert lines == ['{"a":"a \\"q\\", b","b":1}', '{"b":2}']
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(f"{tmp_path}/lines")
    back = files.read_lines(spark, f"{tmp_path}/lines", "a string, b int", {"a": ""}).orderBy("b").collect()
    assert [tuple(r) for r in back] == [('a "q", b', 1), ("", 2)]
    files.write_csv(rows.where("b = 1"), f"{tmp_path}/csv")
    assert files.read_csv(spark, f"{tmp_path}/csv").first().a == 'a "q", b'
    merge.write_version(rows, f"{tmp_path}/v1")
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        merge.write_version(rows, f"{tmp_path}/v1")


def test_providers(spark):
    docs = spark.createDataFrame([(1, "red cat"), (2, None), (3, "blue dog")], "doc_id long, text string")
    queries = spark.createDataFrame([(9, "cat")], "qid long, text string")
    for name in ("bm25-query", "bm25-both", "hash-dense"):
        assert providers.strategy(name).hits(queries, docs, 1).first().doc_id == 1
    assert providers.strategy("rrf", providers.hash_provider(64)).hits(queries, docs, 1).first().doc_id == 1
    wrong = providers.Provider("m", 3, lambda texts: [[0.0]] * len(texts))
    with pytest.raises(Exception, match="not of 3"):
        providers.embed(docs, wrong).collect()
    for bad in ("none", "dense"):
        with pytest.raises(ValueError):
            providers.strategy(bad)
    with pytest.raises(ValueError):
        providers.Provider("m", 3, providers.hash_vectors, distance="far")


def test_caption_and_media(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    parts = lambda *p: F.array(*[F.lit(x) for x in p])
    assert one(text.caption(parts("TASK: a\r\nSetting: b", "c"))) == "Setting: b c"
    assert one(text.caption(parts("Format: a\n b "))) == "b"
    assert one(text.caption(F.array().cast("array<string>"))) == ""
    row = text.media_rows(spark.range(1).select(F.lit('{"id":"5","tags":null,"width":"a","video":7}').alias("record")), "feed").first()
    assert (row.item_id, row.tags, row.orientation, row.video_files, row.thumbnail_url, len(row)) == (5, [], None, "[]", None, 19)


def test_choose_skips_junk(spark):
    terms = spark.createDataFrame([("red cat",), ("123",), ("the of",), ("red cat",), (None,)], "term string")
    frequency = spark.createDataFrame([("red", 5), ("cat", 150)], "term string, df long")
    assert [tuple(r) for r in queryset.choose(terms, frequency, F.md5("term")).collect()] == [("red cat", 150, "torso")]


def test_marker_and_single_flight(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "ts int")
    assert events.after_marker(rows, spark.createDataFrame([(2,)], "marker int")).count() == 1
    assert events.after_marker(rows, spark.createDataFrame([], "marker int")).count() == 3
    cache = spark.createDataFrame([(1, 0.5)], "id int, v double")
    hit, owed = merge.cached_and_owed(spark.createDataFrame([(1,), (2,), (2,)], "id int"), cache, ["id"])
    assert hit.count() == 1 and [r.id for r in owed.collect()] == [2]


def test_counts_of_batches_survive_a_restart(spark, tmp_path):
    path = f"{tmp_path}/in"
    spark.createDataFrame([(1, "a"), (2, "b")], "event_id long, event_type string").withColumn("ts", F.current_timestamp()).write.parquet(path)
    schema = spark.read.parquet(path).schema
    for _ in range(2):
        events.count_batches(events.read(spark, path, schema), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert spark.read.parquet(f"{tmp_path}/out").groupBy().sum("n").first()[0] == 2
