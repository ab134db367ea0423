"""Queries over what is kept and changed: a text index, a vector index, a table by ranges of its key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as S
from ..operators.ranged import Ranged
from ..operators.text_index import TextIndex
from ..operators.vector_index import VectorIndex, recall
from . import catalogue as C
from . import library as L
from .scratch import folder


def text_index(s, d):
    return TextIndex.create(L.docs(s, d), f"{folder(s)}/index")


def changed_index(s, d):
    """An index of two of three documents and some that are no more, the third added and those removed later."""
    docs = L.docs(s, d)
    index = TextIndex.create(docs.where("doc_id % 3 <> 0"), f"{folder(s)}/index")
    index.add(docs.where("doc_id % 3 = 0"))
    index.remove(docs.where("doc_id % 5 = 0"))
    return TextIndex.open(s, index.path)


def short_items(s, d):
    """Four words of each item, as people ask."""
    return L.items(s, d).select("qid", F.concat_ws(" ", F.slice(F.split("text", " "), 3, 4)).alias("text"))


def vector_index(s, d):
    return VectorIndex.create(L.vecs(s, d), f"{folder(s)}/cells")


def cells_recall(s, d):
    """How many of the ten nearest a search finds that reads as many cells as measured on some vectors."""
    v = L.vecs(s, d)
    index = vector_index(s, d)
    queries = L.every_20th(v)
    return recall(index.top(queries, 10, index.probes_for(10)), S.dense_top(queries, v, 10))


def ranged_orders(s, d):
    table = Ranged.create(C.old_orders(s, d), f"{folder(s)}/orders", "id", 32)
    table.merge(C.new_orders(s, d), ["status"], C.now())
    table.merge(C.new_orders(s, d), ["status"], C.now())
    return Ranged.open(s, table.path).rows().select("id", "status", "price", F.col("first_seen_at").cast("string").alias("first_seen_at"), F.col("updated_at").cast("string").alias("updated_at"))


_LEFT = "documents AS (SELECT doc_id, text FROM main.documents WHERE doc_id % 5 <> 0)"
_SHORT = "benchmark AS (SELECT item_id, array_to_string(string_split(text, ' ')[3:6], ' ') AS text FROM main.benchmark)"

QUERIES = {
    "bm25_index_topk": lambda s, d: L.hits(text_index(s, d).top(L.items(s, d), 10)),
    "bm25_index_short": lambda s, d: L.hits(text_index(s, d).top(short_items(s, d), 10)),
    "bm25_index_changed": lambda s, d: L.hits(changed_index(s, d).top(L.items(s, d), 10)),
    "bm25_index_terms": lambda s, d: changed_index(s, d).vocabulary().where("df > 0").select("term", "df"),
    "dense_cells_all": lambda s, d: L.hits(vector_index(s, d).top(L.every_20th(L.vecs(s, d)), 10)),
    "dense_cells_recall": cells_recall,
    "upsert_ranged": ranged_orders,
}

ORACLES = {
    "bm25_index_topk": L.ORACLES["bm25_topk"],
    "bm25_index_short": f"WITH {_SHORT},\n{L.bm25_sql(10)} {L.HITS} FROM bm",
    "bm25_index_changed": f"WITH {_LEFT},\n{L.bm25_sql(10)} {L.HITS} FROM bm",
    "bm25_index_terms": f"WITH {_LEFT},\n{L.COUNTS} SELECT term, df FROM df",
    "dense_cells_all": L.ORACLES["dense_cosine_topk"],
    "upsert_ranged": C.ORACLES["upsert_changed"],
}
