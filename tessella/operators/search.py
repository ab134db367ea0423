"""Dense and hybrid search: arms, fusion by reciprocal ranks, hydration, exclusion."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .best import Best
from .bm25 import top

DEPTH, RRF_K = 100, 60


#: Query vectors that are held against the documents in one pass; documents whose scores are there at once.
QUERY_BLOCK, AT_ONCE = 4096, 512


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A row for each query. By lengths and products, and where these nearly cancel, by the differences themselves."""
    whole = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :]
    squares = whole - 2 * q @ x.T
    close = squares < 1e-3 * whole
    for j in np.flatnonzero(close.any(axis=0)):
        squares[close[:, j], j] = ((q[close[:, j]] - x[j]) ** 2).sum(axis=1)
    return np.sqrt(squares)


def dense_top(queries: DataFrame, docs: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """qid, doc_id, score, rank of the ``k`` nearest documents (doc_id, embedding) of every query (qid, embedding).

    Queries are read in blocks of bounded size; for each, tasks multiply AT_ONCE documents after another by the block and keep
    ``k`` a query and task, so pairs never become rows, and what a task holds depends on no table's size. Rows without vector are left out; larger scores are nearer.
    """
    docs = docs.where("embedding is not null").select("doc_id", "embedding")
    found, block = [], []
    for r in queries.where("embedding is not null").select("qid", "embedding").toLocalIterator():
        block.append((r.qid, r.embedding))
        if len(block) == QUERY_BLOCK:
            found.append(_block_top(block, docs, k, metric))
            block = []
    if block or not found:
        found.append(_block_top(block, docs, k, metric))
    return top(reduce(DataFrame.unionByName, found), k)


def _block_top(block: list, docs: DataFrame, k: int, metric: str) -> DataFrame:
    qids = np.array([q for q, _ in block], np.int64)
    m = np.array([v for _, v in block], np.float64).reshape(len(block), -1)
    shared = docs.sparkSession.sparkContext.broadcast((qids, m))

    def lengths(x):
        n = np.sqrt((x * x).sum(axis=1))
        return np.where(n == 0, 1, n)

    def run(batches):
        qids, q = shared.value
        best = Best(len(qids), k)
        for rows in batches:
            for at in range(0, len(rows) if len(qids) else 0, AT_ONCE):
                some = rows.iloc[at : at + AT_ONCE]
                ids, x = some["doc_id"].to_numpy(), np.stack(some["embedding"].to_list()).astype(np.float64)
                if metric == "cosine":
                    score = (q / lengths(q)[:, None]) @ (x / lengths(x)[:, None]).T
                elif metric == "inner":
                    score = q @ x.T
                else:
                    score = -distances(q, x)
                best.add(ids, np.round(score, 9))
        yield pd.DataFrame({"qid": qids[best.at], "doc_id": best.ids, "score": best.scores})

    return docs.mapInPandas(run, "qid long, doc_id long, score double")


def hard_filter(docs: DataFrame, orientation: str | None = None, min_duration: int | None = None, max_duration: int | None = None, min_width: int | None = None, license: str | None = None, unknown: bool = False) -> DataFrame:
    """Rows that meet all given conditions; a null fails. ``unknown``: a null orientation is the word 'unknown'."""
    side = F.coalesce("orientation", F.lit("unknown")) if unknown else F.col("orientation")
    conditions: list[Column] = []
    for value, holds in ((orientation, side == orientation), (min_duration, F.col("duration") >= min_duration), (max_duration, F.col("duration") <= max_duration), (min_width, F.col("width") >= min_width), (license, F.col("license") == license if license else None)):
        if value is not None:
            conditions.append(holds)
    return docs.where(reduce(Column.__and__, conditions)) if conditions else docs


def fuse(arms: dict[str, DataFrame], k: int, depth: int = DEPTH) -> DataFrame:
    """qid, doc_id, score, rank by the sum of 1 / (60 + rank) over the arms' ``depth`` best (qid, doc_id, score)."""
    ranked = [top(scored, max(depth, k)).select("qid", "doc_id", F.lit(name).alias("arm"), "rank") for name, scored in arms.items()]
    return fused(reduce(DataFrame.unionByName, ranked), k)


def fused(ranked: DataFrame, k: int) -> DataFrame:
    """:func:`fuse` of arms that are ranked: rows (qid, doc_id, rank) of all of them."""
    return top(ranked.groupBy("qid", "doc_id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("score")), k)


def hydrate(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits with their documents' columns; hits without document drop out."""
    return hits.join(docs, "doc_id")


def exclude(hits: DataFrame, urls: DataFrame, excluded: DataFrame, k: int) -> DataFrame:
    """The first ``k`` hits of which no URL (``urls``: doc_id, url) is in ``excluded`` (url); ranks are closed up."""
    bad = urls.join(excluded, "url", "left_semi").select("doc_id").distinct()
    return top(hits.join(bad, "doc_id", "left_anti").drop("rank"), k)
