"""A vector index that is kept: vectors in cells around centres, of which a search reads the nearest few, or all to be exact."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .best import Best
from .bm25 import top

#: Vectors that centres are fitted on at most, chosen by a hash of their ids; rounds of fitting; cells at most; queries of one pass.
SAMPLE, ROUNDS, MOST_CELLS, QUERY_BLOCK = 100_000, 8, 1024, 4096
#: Vectors whose scores are there at once; parts into which a cell is written, so that one that has most rows is several tasks.
#: Vectors by which the number of probes is set.
AT_ONCE, PARTS, TRIED = 512, 16, 64


def _rows(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n == 0, 1, n)


def scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """A row for each query, larger is nearer."""
    if metric == "cosine":
        return _unit(q) @ _unit(x).T
    if metric == "inner":
        return q @ x.T
    return -np.sqrt(np.maximum(0, (q * q).sum(axis=1)[:, None] - 2 * q @ x.T + (x * x).sum(axis=1)[None, :]))


def fit(vectors: DataFrame, cells: int) -> np.ndarray:
    """Centres of at most ``cells`` cells, by k-means over unit vectors in Spark: each round, tasks send sums and counts of their
    vectors by nearest centre. It starts from vectors of the sample and ends after ROUNDS, or when no centre moves."""
    spark = vectors.sparkSession
    n = vectors.count()
    sample = vectors if n <= SAMPLE else vectors.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(SAMPLE / n * (1 << 20)))
    first = sample.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(cells).toPandas()
    if not len(first):
        return np.empty((0, 0))
    centres = np.unique(_unit(_rows(first["embedding"])), axis=0)
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(centres)

        def sums(batches, shared=shared):
            c = shared.value
            total, count = np.zeros_like(c), np.zeros(len(c), np.int64)
            for rows in batches:
                if len(rows):
                    x = _unit(_rows(rows["embedding"]))
                    at = (x @ c.T).argmax(axis=1)
                    np.add.at(total, at, x)
                    count += np.bincount(at, minlength=len(c))
            had = np.flatnonzero(count)
            if len(had):  # a task without vectors has no lists, of which Arrow could not tell the type
                yield pd.DataFrame({"cell": had, "n": count[had], "total": [t.tolist() for t in total[had]]})

        found = sample.select("embedding").mapInPandas(sums, "cell long, n long, total array<double>")
        merged = found.select("cell", "n", F.posexplode("total").alias("k", "x")).groupBy("cell", "k").agg(F.sum("x").alias("x")).toPandas()
        moved = centres.copy()
        moved[merged["cell"], merged["k"]] = merged["x"]
        moved = _unit(moved)
        if np.allclose(moved, centres, atol=1e-6):
            break
        centres = moved
    return centres


@dataclass(frozen=True)
class VectorIndex:
    """The index in the folder ``path``: ``centres`` and ``vectors`` by cell."""

    spark: SparkSession
    path: str

    @staticmethod
    def create(vectors: DataFrame, path: str, cells: int | None = None) -> VectorIndex:
        """Of ``vectors`` (doc_id, embedding); ids are integers. By default about as many cells as the root of the number of
        vectors; every vector is indexed, rows without one are left out."""
        made = VectorIndex(vectors.sparkSession, path)
        vectors = vectors.where("embedding is not null").select("doc_id", "embedding")
        centres = fit(vectors, cells or max(1, min(MOST_CELLS, int(vectors.count() ** 0.5))))
        rows = [(k, c.tolist()) for k, c in enumerate(centres)]
        made.spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
        made.add(vectors)
        return made

    def centres(self) -> np.ndarray:
        found = self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").toPandas()
        return _rows(found["centre"]) if len(found) else np.empty((0, 0))

    def add(self, vectors: DataFrame) -> None:
        """More vectors go to the cells that there are."""
        shared = self.spark.sparkContext.broadcast(self.centres())

        def place(batches):
            c = shared.value
            for rows in batches:
                if len(rows):
                    yield rows.assign(cell=(_unit(_rows(rows["embedding"])) @ c.T).argmax(axis=1).astype(np.int32))

        placed = vectors.where("embedding is not null").select("doc_id", "embedding").mapInPandas(place, "doc_id long, embedding array<float>, cell int")
        placed.repartition("cell", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).write.mode("append").partitionBy("cell").parquet(f"{self.path}/vectors")

    def top(self, queries: DataFrame, k: int, probes: int | None = None, metric: str = "cosine", allowed: DataFrame | None = None) -> DataFrame:
        """qid, doc_id, score, rank of the ``k`` nearest vectors to every query (qid, embedding) among those of its ``probes`` nearest
        cells; exact if these are all (None). ``allowed`` (doc_id) limits what is ranked.

        Queries are read in blocks. Of the vectors, a pass reads only the folders of cells that a query of the block probes; a
        batch meets only the queries that probe its cell, and tasks keep ``k`` a query.
        """
        centres, found, block = self.centres(), None, []
        stored = self.spark.read.schema("doc_id long, embedding array<float>, cell int").parquet(f"{self.path}/vectors")
        if allowed is not None:
            stored = stored.join(allowed.select("doc_id"), "doc_id", "left_semi")

        def more(found, block):
            hits = self._block(block, centres, stored, k, probes, metric)
            return hits if found is None else found.unionByName(hits)

        for r in queries.where("embedding is not null").select("qid", "embedding").toLocalIterator():
            block.append((r.qid, r.embedding))
            if len(block) == QUERY_BLOCK:
                found, block = more(found, block), []
        if block:
            found = more(found, block)
        return top(self.spark.createDataFrame([], "qid long, doc_id long, score double") if found is None else found, k)

    def probes_for(self, k: int, least: float = 0.95, metric: str = "cosine") -> int:
        """How many cells a search for ``k`` has to probe to find a share ``least`` of the nearest, measured on TRIED vectors of the index:
        how far down each one's list of cells the cells of its exact hits are."""
        stored = self.spark.read.schema("doc_id long, embedding array<float>, cell int").parquet(f"{self.path}/vectors")
        tried = stored.orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id").limit(TRIED).select(F.col("doc_id").alias("qid"), "embedding")
        asked = tried.toPandas().set_index("qid")
        hits = self.top(tried, k, metric=metric).join(stored.select("doc_id", "cell"), "doc_id").toPandas()
        if not len(hits):
            return 1
        order = np.argsort(-scores(_rows(asked["embedding"]), self.centres(), metric), axis=1, kind="stable")
        place = np.argsort(order, axis=1)[asked.index.get_indexer(hits["qid"]), hits["cell"]]
        return int(np.quantile(place, least, method="inverted_cdf")) + 1

    def _block(self, block: list, centres: np.ndarray, stored: DataFrame, k: int, probes: int | None, metric: str) -> DataFrame:
        qids, q = np.array([i for i, _ in block], np.int64), np.array([v for _, v in block], np.float64)
        near = np.ones((len(block), len(centres)), bool)
        if probes and probes < len(centres):
            near[:] = False
            order = np.argsort(-scores(q, centres, metric), axis=1, kind="stable")[:, :probes]
            near[np.arange(len(block))[:, None], order] = True
            stored = stored.where(F.col("cell").isin([int(c) for c in np.flatnonzero(near.any(axis=0))]))
        shared = self.spark.sparkContext.broadcast((qids, q, near))

        def run(batches):
            qids, q, near = shared.value
            best = Best(len(qids), k)
            for rows in batches:
                for cell, own in rows.groupby("cell"):
                    asking = np.flatnonzero(near[:, cell])
                    for at in range(0, len(own), AT_ONCE):
                        part = own.iloc[at : at + AT_ONCE]
                        best.add(part["doc_id"].to_numpy(), np.round(scores(q[asking], _rows(part["embedding"]), metric), 9), of=asking)
            yield pd.DataFrame({"qid": qids[best.at], "doc_id": best.ids, "score": best.scores})

        return stored.mapInPandas(run, "qid long, doc_id long, score double")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: n (of the exact hits), found (of them), recall."""
    both = exact.select("qid", "doc_id").join(found.select("qid", "doc_id", F.lit(1).alias("hit")), ["qid", "doc_id"], "left")
    return both.agg(F.count("*").alias("n"), F.count("hit").alias("found")).withColumn("recall", F.col("found") / F.col("n"))
