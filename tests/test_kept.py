"""Indexes and tables that are kept, by what they read and write."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tessella.operators import bm25
from tessella.operators import search as S
from tessella.operators.ranged import Ranged
from tessella.operators.text_index import TextIndex
from tessella.operators.vector_index import VectorIndex, recall
from tessella.plans import kept
from tessella.plans import library as L

D = "/root/testdata/sf0.01"


def ranks(hits):
    return sorted((r.qid, r["rank"], r.doc_id, round(r.score, 6)) for r in hits.collect())


def test_most_blocks_of_short_queries_are_not_read(spark, tmp_path):
    index = TextIndex.create(L.docs(spark, D), f"{tmp_path}/index")
    asked = kept.short_items(spark, D)
    assert ranks(index.top(asked, 10)) == ranks(bm25.top_hits(asked, L.docs(spark, D), 10))
    read = index.blocks_read(asked, 10).agg(F.sum("blocks"), F.sum("read")).first()
    assert 0 < read[1] < read[0] / 2


@pytest.mark.parametrize("side", ["query", "doc", "both"])
def test_index_that_changes(spark, tmp_path, side):
    docs = L.docs(spark, SF)
    index = TextIndex.create(docs.where("doc_id < 100"), f"{tmp_path}/index", bm25.Bm25(idf_side=side))
    ids = {r.term: r.term_id for r in index.vocabulary().collect()}
    index.add(docs.where("doc_id >= 100"))
    index.remove(docs.where("doc_id < 20"))
    index.add(docs.where("doc_id < 10"))
    now = docs.where("doc_id < 10 or doc_id >= 20")
    index = TextIndex.open(spark, index.path)
    assert ranks(index.top(L.items(spark, SF), 5)) == ranks(bm25.top_hits(L.items(spark, SF), now, 5, bm25.Bm25(idf_side=side)))
    allowed = now.where("doc_id % 2 = 0").select("doc_id")
    assert ranks(index.top(L.items(spark, SF), 5, allowed)) == ranks(bm25.top_hits(L.items(spark, SF), now, 5, bm25.Bm25(idf_side=side), allowed))
    later = {r.term: r.term_id for r in index.vocabulary().collect()}
    assert all(later[t] == i for t, i in ids.items()) and sorted(later.values()) == list(range(1, len(later) + 1))
    assert tuple(index.statistics().first()) == tuple(bm25.statistics(now).first())


def test_segments_that_are_not_listed_are_not_read(spark, tmp_path):
    docs = L.docs(spark, SF)
    index = TextIndex.create(docs.where("doc_id < 50"), f"{tmp_path}/index")
    before = ranks(index.top(L.items(spark, SF), 5))
    left = docs.where("doc_id >= 50").select(F.lit("left").alias("term"), F.lit(3).cast("long").alias("df"), F.lit(None).cast("long").alias("term_id"))
    index._write("terms", 1, left)
    assert ranks(index.top(L.items(spark, SF), 5)) == before and "left" not in {r.term for r in index.vocabulary().collect()}
    assert index.add(docs.where("doc_id >= 50")) == 1
    assert ranks(index.top(L.items(spark, SF), 5)) == ranks(bm25.top_hits(L.items(spark, SF), docs, 5))
    empty = TextIndex.create(docs.limit(0), f"{tmp_path}/empty")
    assert empty.top(L.items(spark, SF), 5).count() == 0


def test_recall_of_cells(spark, tmp_path):
    vectors = L.vecs(spark, D)
    index = VectorIndex.create(vectors, f"{tmp_path}/cells")
    asked = L.every_20th(vectors)
    for metric in ("cosine", "l2", "inner"):
        assert ranks(index.top(asked, 10, metric=metric)) == ranks(S.dense_top(asked, vectors, 10, metric))
    exact = S.dense_top(asked, vectors, 10)
    probes = index.probes_for(10)
    found = recall(index.top(asked, 10, probes), exact).first()
    assert 0 < probes < len(index.centres())
    assert found.recall >= 0.9, found
    allowed = vectors.where("label < 5").select("doc_id")
    assert ranks(index.top(asked, 10, allowed=allowed)) == ranks(S.dense_top(asked, vectors.where("label < 5"), 10))


def test_ranges_without_a_change_are_not_written(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id"), F.col("id").cast("string").alias("v"), F.lit("2024-01-01").cast("date").alias("first_seen_at"), F.lit("2024-01-01").cast("date").alias("updated_at"))
    table = Ranged.create(rows, f"{tmp_path}/rows", "id", 10)
    new = spark.createDataFrame([(5, "x"), (7, "7"), (2000, "new"), (501, None)], "id long, v string")
    now = F.lit("2024-02-02").cast("date")
    first = table.merge(new, ["v"], now)
    assert len(first) == 3 and table.merge(new, ["v"], now) == [] and Ranged.open(spark, table.path).merge(new, ["v"], now) == []
    got = {r.id: (r.v, str(r.first_seen_at), str(r.updated_at)) for r in table.rows().collect()}
    assert len(got) == 1001 and got[5] == ("x", "2024-01-01", "2024-02-02") and got[7] == ("7", "2024-01-01", "2024-01-01") and got[501] == (None, "2024-01-01", "2024-02-02") and got[2000] == ("new", "2024-02-02", "2024-02-02")
    assert table.delete(spark.createDataFrame([(3,), (3000,)], "id long")) == [0] and table.rows().count() == 1000
    whole = table.rows().where("id < 90").select("id")
    table.delete(whole)
    assert table.rows().where("id < 90").count() == 0 and table.merge(new.limit(0), ["v"], now) == []


def test_a_term_has_one_row_a_piece_of_documents(spark, tmp_path):
    docs = L.docs(spark, SF).coalesce(1)
    index = TextIndex.create(docs, f"{tmp_path}/index")
    rows = index.blocks()
    assert rows.count() == rows.select("term").distinct().count() > 0
