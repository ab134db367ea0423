"""Cases worked out by hand."""

import datetime as dt

from pyspark.sql import functions as F

from tessella.operators import merge, metrics, sampling, search
from tessella.operators.bm25 import top


def test_quotas():
    key = lambda d: {(k,): n for k, n in d.items()}
    assert sampling.quotas(key({"a": 600, "b": 300, "c": 100}), 1000) == key({"a": 600, "b": 300, "c": 100})
    assert sampling.quotas(key({"big": 9000, "rare": 40}), 1000) == key({"big": 960, "rare": 40})
    assert sampling.quotas(key({"a": 5, "b": 5}), 1) == key({"a": 1, "b": 0})
    assert sampling.quotas({}, 5) == {}
    assert sampling.quotas(key({"a": 5}), 0) == key({"a": 0})


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 3.0), (1, 11, 2.0)], "qid long, doc_id long, score double")
    b = spark.createDataFrame([(1, 11, 0.9)], "qid long, doc_id long, score double")
    rows = search.fuse({"a": a, "b": b}, 10).orderBy("rank").collect()
    assert [(r.doc_id, round(r.score, 6)) for r in rows] == [(11, round(1 / 62 + 1 / 61, 6)), (10, round(1 / 61, 6))]


def test_ties_go_by_id(spark):
    rows = spark.createDataFrame([(1, 201, 1.0), (1, 200, 1.0)], "qid long, doc_id long, score double")
    assert [r.doc_id for r in top(rows, 2).orderBy("rank").collect()] == [200, 201]


def test_metrics(spark):
    run = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 9, 3)], "qid long, doc_id long, rank long")
    labels = spark.createDataFrame([(1, 1, 0), (1, 2, 3), (1, 3, 2), (1, 4, None)], "qid long, doc_id long, grade int")
    r = metrics.per_query(run, labels).first()
    ideal = 7 + 3 / 1.584962500721156
    assert abs(r.ndcg10 - 7 / 1.584962500721156 / ideal) < 1e-8
    assert (r.recall1, r.recall5, r.mrr10, r.n_relevant, r.n_judged, r.null_grade_top10) == (0, 0.5, 0.5, 2, 4, 1)


def test_kappa(spark):
    one = metrics.kappa(spark.createDataFrame([(0, 1), (1, 0), (0, 0), (1, 1)], "a int, b int")).first()
    assert (one.agreement, one.kappa) == (0.5, 0.0)


def test_percentile_rounds_half_to_even(spark):
    rows = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 5)], "v double")
    assert metrics.nearest_rank(rows, "v", {"p": 0.5}).first().p == 2.0


def test_replayed_upsert_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a", dt.date(2024, 1, 1), dt.date(2024, 1, 1))], "id long, status string, first_seen_at date, updated_at date")
    new = spark.createDataFrame([(1, "a"), (2, None)], "id long, status string")
    now = F.lit("2024-06-01").cast("date")
    once = merge.upsert(old, new, "id", ["status"], "status", now)
    twice = merge.upsert(once, new, "id", ["status"], "status", F.lit("2025-01-01").cast("date"))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_plans(spark):
    a, b = spark.range(10), spark.range(5)
    assert "LeftAnti" in merge.gap(a, b, "id")._jdf.queryExecution().executedPlan().toString()
    rows = spark.range(100).selectExpr("id % 3 AS qid", "id AS doc_id", "rand(1) AS score")
    assert "WindowGroupLimit" in top(rows, 2)._jdf.queryExecution().executedPlan().toString()
