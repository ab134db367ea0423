"""What larger and odd tables brought to light."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import bm25 as B
from tessella.operators import queryset as Q
from tessella.operators import search as S
from tessella.operators import vector_index as V
from tessella.plans import evaluation as E

TIES = [0.001953125, -0.005859375, 0.5000005, 1234567.5, 100000.5, 999999.5, 1e-5, 0.0001, 9.9999995e-05, 1e-40, 3.0, 0.0, -0.0, float("nan"), float("inf"), None]


def test_literals_round_as_printf(spark):
    rows = spark.createDataFrame([(1, TIES), (2, []), (3, None)], "id int, v array<float>")
    sparse = F.transform("v", lambda x, i: F.struct(i.alias("number"), x.alias("weight")))
    found = {r.id: (r.a, r.b) for r in rows.select("id", T.vector_literal(F.col("v")).alias("a"), T.sparse_literal(sparse, 20).alias("b")).collect()}
    con = duckdb.connect()
    plain = [con.execute("SELECT printf('%.6g', ?::FLOAT::DOUBLE)", [x]).fetchall()[0][0] for x in TIES]
    assert found[1][0] == f"[{','.join(p for p in plain if p is not None)}]"
    assert found[1][1] == f"{{{','.join(f'{i}:{p}' for i, p in enumerate(plain) if p is not None)}}}/20"
    assert found[2] == ("[]", "{}/20") and found[3] == (None, None)


@pytest.mark.parametrize("metric", ["cosine", "l2", "inner"])
def test_dense_search_holds_a_few_documents_at_once(spark, monkeypatch, metric):
    class Seen(S.Best):
        def add(self, ids, scores, *more, **named):
            if len(ids) > 3:
                raise ValueError(f"{len(ids)} documents at once")
            super().add(ids, scores, *more, **named)

    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(50, 4)).astype(np.float32)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "doc_id long, embedding array<float>").coalesce(1)
    queries = docs.where("doc_id < 6").withColumnRenamed("doc_id", "qid")
    whole = S.dense_top(queries, docs, 5, metric).select("qid", "rank", "doc_id", "score").collect()
    monkeypatch.setattr(S, "AT_ONCE", 3, raising=False)
    monkeypatch.setattr(S, "Best", Seen)
    assert sorted(S.dense_top(queries, docs, 5, metric).select("qid", "rank", "doc_id", "score").collect()) == sorted(whole)


def test_distances_of_near_copies_are_exact():
    x = np.array([[0.1, 0.7, -0.3], [0.1, 0.7, -0.3], [0.1 + 3e-9, 0.7, -0.3], [0.2, -0.5, 0.9]])
    assert np.allclose(S.distances(x, x), np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), rtol=1e-9, atol=0)


def test_cells_of_a_table_with_empty_partitions(spark, tmp_path):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "doc_id long, embedding array<float>").repartition(8)
    index = V.VectorIndex.create(vectors, f"file://{tmp_path}/cells")
    assert index.top(vectors.withColumnRenamed("doc_id", "qid"), 2).count() == 6


def test_counts_of_unique_ids_are_not_shuffled(spark):
    rows = [(1, "b a B c b"), (2, None), (3, ""), (4, "z"), (None, "a a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = B.term_counts(docs)
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    wanted = [(1, "a", 1, 5), (1, "b", 3, 5), (1, "c", 1, 5), (4, "z", 1, 1), (None, "a", 2, 2)]
    assert sorted(map(tuple, counts.select("doc_id", "term", "tf", "dl").collect()), key=str) == sorted(wanted, key=str)
    again = {(r.doc_id, r.term): r.tf for r in B.term_counts(docs.union(docs)).collect()}
    assert again == {(d, t): 2 * n for d, t, n, _ in wanted}


def test_matches_by_the_head_and_by_the_rest(spark, monkeypatch):
    frequency = spark.createDataFrame([("a", 9), ("b", 7), ("c", 7), ("d", 2)], "term string, df long")
    terms = spark.createDataFrame([(1, "d A"), (2, "c b"), (3, "d x"), (4, "x"), (5, "-"), (6, None), (7, "b d"), (7, "d")], "key long, term string").coalesce(1)
    wanted = {1: 9, 2: 7, 3: 2, 4: 0, 5: 0, 6: 0, 7: 7}
    for most in (0, 2, 10_000):
        monkeypatch.setattr(Q, "HEAD", most)
        assert {r.key: r.match for r in Q.match(terms, frequency).collect()} == wanted


def test_a_text_is_split_once(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d"), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = E.terms(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text") == 1 and "lambdafunction(array_join(slice(split" not in plan
    assert sorted(map(tuple, found.collect())) == [(1, 0, "a b c"), (1, 1, "d"), (3, 0, "")]


def test_document_counts_merge_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, None)], "doc_id long, text string")
    for rows in (docs, docs.union(docs)):
        assert {r.term: r.df for r in B.document_counts(rows).collect()} == {"a": 1, "b": 2}


def test_a_scan_takes_few_documents_and_terms_at_once():
    import pyarrow as pa

    from tessella.operators import bm25

    ts = [["a"] * 3] * 1500 + [["b"] * (bm25.TERMS_AT_ONCE + 1), None, []] + [["c"] * (bm25.TERMS_AT_ONCE // 2)] * 5
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(ts))), "ts": pa.array(ts, pa.list_(pa.string()))})
    parts = list(bm25._parts(batch))
    assert [i for p in parts for i in p.column("doc_id").to_pylist()] == list(range(len(ts)))
    assert all(p.num_rows <= bm25.DOCS_AT_ONCE and (p.num_rows == 1 or len(p.column("ts").flatten()) <= bm25.TERMS_AT_ONCE) for p in parts)
