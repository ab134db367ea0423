"""Feeds that stop and go on, broken shards, table functions, values with a lifetime, kept vectors, percentiles of groups."""

import gzip
import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import tables, text
from tessella.operators import coverage, providers, ranks
from tessella.operators.vector_cache import VectorCache
from tessella.plans import feeds
from tessella.sources import feed, shards
from tessella.streaming import events, lifetime


def put(folder, cursor, *items):
    page = folder / f"cursor={cursor}"
    page.mkdir(parents=True)
    (page / "part-0.json").write_text("\n".join(items) + "\n\n", encoding="utf-8")
    (page / "_SUCCESS").write_text("")


def test_a_feed_goes_on_where_it_ended(spark, tmp_path):
    path, out, checkpoint = tmp_path / "feed", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    put(path, "01", "a", "b")
    put(path, "02", "c é")
    got = lambda: sorted(r.item for r in spark.read.parquet(out).collect())
    events.drain(feed.read_stream(spark, str(path)), out, checkpoint)
    assert got() == ["a", "b", "c é"]
    put(path, "03", "d")
    put(path, "00", "late")  # below the cursor: not seen
    for _ in range(2):
        events.drain(feed.read_stream(spark, str(path)), out, checkpoint)
        assert got() == ["a", "b", "c é", "d"]
    assert sorted(map(tuple, feed.read(spark, f"file://{path}", "01").collect())) == [("02", "c é"), ("03", "d")]
    assert feed.read(spark, f"{tmp_path}/none").count() == 0


def test_a_feed_that_fails_in_a_batch(spark, tmp_path):
    path, out = tmp_path / "feed", f"{tmp_path}/out"
    put(path, "01", "a")
    put(path, "02", "b")
    failures = ["once"]

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if failures:
            failures.pop()
            raise RuntimeError("stopped")

    start = lambda: feed.read_stream(spark, str(path)).writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    with pytest.raises(Exception, match="stopped"):
        start()
    put(path, "03", "c")
    start()  # does the batch again
    start()
    assert sorted(r.item for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_a_broken_shard_among_ten(spark, tmp_path):
    whole = "<urlset><url><loc>https://x.org/video/a-%d/</loc></url></urlset>"
    for k in range(10):
        data = (whole % k).encode()
        (tmp_path / f"s{k}.xml").write_bytes(gzip.compress(data)[:-9] if k == 4 else gzip.compress(data[:20]) + gzip.compress(data[20:]) if k % 2 else data)
    rows, failures = shards.split(shards.sitemap_shards(shards.binaries(spark, str(tmp_path))))
    assert rows.count() == 9 and [(r.name.rpartition("/")[2], r.reason) for r in failures.collect()] == [("s4.xml", "cut short")]
    empty = spark.createDataFrame([], "name string, data binary")
    assert [x.count() for x in shards.split(shards.sitemap_shards(empty))] == [0, 0]


def test_table_functions_stay_in_the_row(spark):
    tables.register(spark)
    spark.createDataFrame([(1, "b a B"), (2, None), (3, ""), (4, "--")], "id int, text string").createOrReplaceTempView("__rows")
    found = spark.sql("SELECT id, p.term, p.tf FROM __rows, LATERAL postings(text) p")
    assert sorted(map(tuple, found.collect())) == [(1, "a", 1), (1, "b", 2)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert [tuple(r) for r in spark.sql("SELECT id, p.term, p.nth FROM __rows, LATERAL positions(text) p").collect()] == [(1, "b", 0), (1, "a", 1), (1, "b", 2)]


def test_values_are_held_across_batches(spark, tmp_path):
    rows = [(1, 10, 0), (1, 11, 5), (1, 12, 10), (2, 13, 3), (1, 14, 19), (1, 15, 20), (None, 16, 1), (2, 17, None), (2, 18, 40)]
    schema = "user_id long, event_id long, seconds long"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", feeds.ROCKS)
    try:
        for part in (rows[:4], rows[4:]):
            df = spark.createDataFrame(part, schema).select("user_id", "event_id", F.timestamp_seconds(F.col("seconds") + 1_000_000_000).alias("ts"))
            df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            events.drain(lifetime.held(events.read(spark, f"{tmp_path}/in", df.schema), 10_000), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {r.event_id: r.fresh for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {10: True, 11: False, 12: True, 13: True, 14: False, 15: True, 18: True}


def test_kept_vectors_are_made_once(spark, tmp_path):
    provider = providers.hash_provider(16)
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "a b"), (4, None), (5, "")], "doc_id long, text string")
    cache = VectorCache(spark, str(tmp_path), provider, 8)
    assert (cache.fill(docs.where("doc_id < 3")), cache.fill(docs), cache.fill(docs)) == (2, 1, 0)
    expected = {r.doc_id: list(r.embedding) for r in providers.embed(docs, provider).collect()}
    spark.sql(f"DROP TABLE {cache.table}")  # as in a new session: the folder stays
    again = VectorCache(spark, str(tmp_path), provider, 8)
    assert again.fill(docs) == 0 and {r.doc_id: list(r.embedding) for r in again.get(docs).collect()} == expected
    assert VectorCache(spark, str(tmp_path), providers.hash_provider(32), 8).fill(docs) == 3
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = again.owed(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = next(k for k, line in enumerate(plan.splitlines()) if "Bucketed: true" in line)
    assert "Exchange" not in "".join(line for line in plan.splitlines()[scan - 3 : scan])


def test_percentiles_of_groups(spark):
    draw = random.Random(3)
    groups = {"a": [draw.random() for _ in range(501)], "b": [1.0] * 30 + [2.0], "c": [5e-324, 0.0, -1e308, 1e308, 1.5], None: [3.0, 1.0], "hot": [float(draw.randrange(10**9)) ** 3 for _ in range(20_000)], "inf": [math.inf, -math.inf, 0.0, 1.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("a", math.nan), ("none", None)]
    df = spark.createDataFrame(rows, "__k0 string, v double")
    got = {r["__k0"]: (r.n, r.p0, r.p50, r.p95) for r in ranks.ranked_values(df, "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95}, "__k0").collect()}
    at = lambda vs, f: sorted(vs)[max(1, min(len(vs), round(f * len(vs)))) - 1]
    assert got == {k: (len(vs), at(vs, 0.0), at(vs, 0.5), at(vs, 0.95)) for k, vs in groups.items()}
    assert [tuple(r) for r in ranks.ranked_values(df.where("v = 1.5"), "v", {"p": 0.5}).collect()] == [(1, 1.5)]
    assert ranks.ranked_values(df.limit(0), "v", {"p": 0.5}, "__k0").count() == 0


def test_media_with_odd_fields(spark):
    records = ['{"id":"5","tags":null,"width":"a","video":7}', '{"id":6,"tags":{"a":1},"user":"x","video":{"thumbnail":{"x":"","y":"z"},"preview_src":"p"}}', "no json", None, '{"id":7,"tags":["a",{"name":"b"},{"search_term":" c "},4,null],"video":{"thumbnail":"t","video_files":[{"width":1}]}}']
    rows = text.media_rows(spark.createDataFrame([(r,) for r in records], "record string"), "feed")
    got = [(r.item_id, r.tags, r.thumbnail_url, r.video_files) for r in rows.collect()]
    assert got == [(5, [], None, "[]"), (6, [], "z", "[]"), (None, [], None, "[]"), (None, [], None, "[]"), (7, ["a", "b", "c", "4"], "t", '[{"width":1}]')]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1 and len(rows.columns) == 19


def test_coverage_and_counters(spark):
    have = spark.createDataFrame([(1,), (1,), (None,), (9,)], "id int")
    want = spark.createDataFrame([(1, "x"), (2, "x"), (None, "y"), (2, None)], "id int, kind string")
    assert tuple(coverage.coverage(want, have, "id").first()) == (4, 1, 25.0)
    assert tuple(coverage.coverage(want.limit(0), have, "id").first()) == (0, 0, None)
    assert tuple(coverage.counters(want, x=F.col("kind") == "x").first()) == (4, 2)
    assert sorted(map(tuple, coverage.kinds(want, "kind", "id").collect()), key=str) == [("x", 2, 2), ("y", 1, 0), (None, 1, 1)]
    assert [r.id for r in coverage.resume(want, have, "id").collect()] == [2]
    terms = spark.createDataFrame([("a",), ("b",)], "term string")
    done = spark.createDataFrame([("a", 1)], "term string, page long")
    assert sorted(map(tuple, coverage.targets(terms, 2, done).collect())) == [("a", 2), ("b", 1), ("b", 2)]
    sizes = spark.createDataFrame([([1],), ([1, 2, 3],), ([],), (None,)], "tags array<int>")
    assert tuple(coverage.list_sizes(sizes, "tags").first()) == (1.0, 1, 3, 0.5)
    assert coverage.list_sizes(sizes.limit(0), "tags").first()["mean"] is None
