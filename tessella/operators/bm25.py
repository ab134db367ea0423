"""BM25: statistics, vocabulary, weights, and set-at-a-time ranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .best import Best
from .ranks import numbered

#: Queries that are held against the documents in one pass; documents whose scores are there at once; terms of documents with which
#: fewer are.
QUERY_BLOCK, DOCS_AT_ONCE, TERMS_AT_ONCE = 256, 512, 1 << 18


@dataclass(frozen=True)
class Bm25:
    """``idf_side``: 'query' (textbook), 'doc', or 'both' (squared)."""

    k1: float = 1.2
    b: float = 0.75
    idf_side: str = "query"


def term_counts(docs: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """doc_id, term, tf, dl of ``docs`` (doc_id, text); with ``keep`` (term) of its terms only."""
    own = row_counts(docs)
    own = own if keep is None else own.join(keep, "term", "left_semi")
    if unique_ids(docs):
        return own
    return own.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))


def row_counts(docs: DataFrame) -> DataFrame:
    """:func:`term_counts` of each row by itself, so that nothing is shuffled: its terms in order, and where each one's run ends."""
    read = docs.select("doc_id", F.array_sort(tokens(F.col("text"))).alias("ts")).withColumn("dl", F.size("ts"))
    last = lambda i: (i == F.col("dl") - 1) | (F.get("ts", i) != F.get("ts", i + 1))
    places = F.when(F.col("dl") > 0, F.sequence(F.lit(0), F.col("dl") - 1))
    ends = read.withColumn("ends", F.filter(places, last))
    runs = F.transform("ends", lambda e, k: F.struct(F.get("ts", e).alias("term"), (e - F.coalesce(F.get("ends", k - 1), F.lit(-1))).cast("long").alias("tf")))
    return ends.select("doc_id", "dl", F.explode(runs).alias("r")).select("doc_id", "r.term", "r.tf", "dl")


def unique_ids(docs: DataFrame) -> bool:
    """Whether no doc_id is there twice, by a pass over the ids alone."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def statistics(docs: DataFrame) -> DataFrame:
    """One row: n_docs, total_len, avg_len; empty texts count."""
    s = docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.size(tokens(F.col("text")))), F.lit(0)).cast("long").alias("total_len"))
    return s.withColumn("avg_len", F.when(F.col("n_docs") > 0, F.col("total_len") / F.col("n_docs")).otherwise(0.0))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def document_counts(docs: DataFrame) -> DataFrame:
    """:func:`document_frequency` of ``docs`` (doc_id, text): tasks count the rows that have a term before terms are shuffled."""
    if not unique_ids(docs):
        return document_frequency(term_counts(docs))
    return docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def vocabulary(docs: DataFrame) -> DataFrame:
    """term, term_id (1 for the most frequent, ties by term), df, idf."""
    df = document_counts(docs)
    ranked = numbered(df, "df", "term", "term_id")
    return ranked.crossJoin(F.broadcast(statistics(docs).select("n_docs"))).select("term", "term_id", "df", idf(F.col("n_docs"), F.col("df")).alias("idf"))


def postings(docs: DataFrame, model: Bm25 = Bm25(), keep: DataFrame | None = None) -> DataFrame:
    """doc_id, term, weight, idf. ``keep`` (term): only these terms are looked at; they are broadcast by Spark if small."""
    counts = term_counts(docs, keep)
    rows = counts.join(document_frequency(counts), "term").crossJoin(F.broadcast(statistics(docs)))
    length = 1.0 - model.b + model.b * F.when(F.col("avg_len") > 0, F.col("dl") / F.col("avg_len")).otherwise(1.0)
    weight = F.col("tf") * (model.k1 + 1.0) / (F.col("tf") + model.k1 * length)
    i = idf(F.col("n_docs"), F.col("df"))
    return rows.select("doc_id", "term", (weight if model.idf_side == "query" else weight * i).alias("weight"), i.alias("idf"))


def scores(queries: DataFrame, docs: DataFrame, model: Bm25 = Bm25(), allowed: DataFrame | None = None) -> DataFrame:
    """qid, doc_id, score for all ``queries`` (qid, text) at once; only documents with a term in common. ``allowed`` (doc_id)
    limits what is scored, not the statistics."""
    terms = queries.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    found = postings(docs, model, terms.select("term").distinct())
    if allowed is not None:
        found = found.join(allowed, "doc_id", "left_semi")
    side = F.lit(1.0) if model.idf_side == "doc" else F.col("idf")
    return found.join(terms, "term").groupBy("qid", "doc_id").agg(F.round(F.sum(F.col("weight") * side), 9).alias("score"))


def top(scored: DataFrame, k: int, *within: str) -> DataFrame:
    """The ``k`` best of each query (of each of ``within`` besides): rank from 1, ties by doc_id."""
    w = Window.partitionBy("qid", *within).orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def weights(tf: np.ndarray, dl: np.ndarray, average: float, model: Bm25) -> np.ndarray:
    length = 1.0 - model.b + model.b * (dl / average if average > 0 else 1.0)
    return tf * (model.k1 + 1.0) / (tf + model.k1 * length)


def _blocks(queries: DataFrame) -> Iterator[list[tuple[int, list[str]]]]:
    block = []
    for r in queries.select("qid", F.array_distinct(tokens(F.col("text"))).alias("ts")).toLocalIterator():
        block.append((r.qid, r.ts))
        if len(block) == QUERY_BLOCK:
            yield block
            block = []
    if block:
        yield block


def top_hits(queries: DataFrame, docs: DataFrame, k: int, models: dict[str, Bm25] | Bm25 = Bm25(), allowed: DataFrame | None = None) -> DataFrame:
    """qid, doc_id, score, rank of the ``k`` best documents (doc_id, text) of every query (qid, text; ids are integers), as :func:`top` of :func:`scores` would have
    them; with several models (by name, of equal k1 and b) also the column run_id.

    Queries are read in blocks. For each, one pass counts the documents that have each of the block's terms, and one
    multiplies batches of documents by the block and keeps ``k`` a query and task, so neither the postings of common words
    nor pairs of queries and documents are ever shuffled. ``allowed`` (doc_id) limits what is ranked, not the statistics.
    """
    named = models if isinstance(models, dict) else {"": models}
    if len({(m.k1, m.b) for m in named.values()}) > 1:
        raise ValueError("models of one pass have one k1 and b")
    spark = docs.sparkSession
    stats = statistics(docs).first()
    read = docs.select("doc_id", tokens(F.col("text")).alias("ts"))
    ranked = read if allowed is None else read.join(allowed.select("doc_id"), "doc_id", "left_semi")
    parts = [_block_hits(spark, block, read, ranked, k, named, stats) for block in _blocks(queries)]
    schema = "qid long, doc_id long, score double, run_id string"
    found = spark.createDataFrame([], schema) if not parts else parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    found = top(found, k, "run_id")
    return found if isinstance(models, dict) else found.drop("run_id")


def _block_hits(spark: SparkSession, block: list, read: DataFrame, ranked: DataFrame, k: int, models: dict[str, Bm25], stats) -> DataFrame:
    terms = sorted({t for _, ts in block for t in ts})
    number = {t: i for i, t in enumerate(terms)}
    shared = spark.sparkContext.broadcast(terms)

    def count(batches):
        df = np.zeros(len(terms), np.int64)
        for batch in batches:
            for part in _parts(batch):
                _, term, _, _ = _postings(part, shared.value)
                df += np.bincount(term, minlength=len(df))
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.flatnonzero(df), pa.int64()), "n": pa.array(df[df > 0], pa.int64())})

    df = np.zeros(len(terms))
    for r in read.select("ts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r.term] = r.n
    idf = np.log(1.0 + (stats.n_docs - df + 0.5) / (df + 0.5))
    qids, runs = np.array([q for q, _ in block], np.int64), list(models)
    sides = np.zeros((len(terms), len(runs) * len(block)))
    for j, name in enumerate(runs):
        side = idf**2 if models[name].idf_side == "both" else idf
        for i, (_, ts) in enumerate(block):
            own = [number[t] for t in ts]
            sides[own, j * len(block) + i] = side[own]
    model, average = next(iter(models.values())), float(stats.avg_len)
    held = spark.sparkContext.broadcast((terms, sides))

    def rank(batches):
        terms, sides = held.value
        best = Best(sides.shape[1], k)
        for batch in batches:
            for part in _parts(batch):
                doc, term, tf, dl = _postings(part, terms)
                weight = weights(tf.astype(float), dl[doc].astype(float), average, model)
                used, column = np.unique(term, return_inverse=True)
                some = np.zeros((part.num_rows, len(used)))
                some[doc, column] = weight
                best.add(part.column("doc_id").to_numpy(zero_copy_only=False), np.round((some @ sides[used]).T, 9), 0.0)
        if len(best.at):
            yield pa.RecordBatch.from_pydict({"qid": qids[best.at % len(qids)], "doc_id": best.ids, "score": best.scores, "run_id": pa.array([runs[j] for j in best.at // len(qids)], pa.string())})

    return ranked.mapInArrow(rank, "qid long, doc_id long, score double, run_id string")


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` (ts) in parts of DOCS_AT_ONCE documents and some TERMS_AT_ONCE terms at most, one document at least."""
    ends = np.cumsum(batch.column("ts").value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TERMS_AT_ONCE, "right"))
        to = min(batch.num_rows, at + DOCS_AT_ONCE, max(at + 1, most))
        yield batch.slice(at, to - at)
        at = to


def _postings(batch: pa.RecordBatch, terms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch (ts): rows and numbers of its terms that are in ``terms``, each pair once and in order, how often each occurs, and
    the number of terms of each row."""
    ts = batch.column("ts")
    dl = ts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    kinds = ts.flatten().dictionary_encode()
    at = pa.compute.index_in(kinds.dictionary, pa.array(terms, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
    term = at[kinds.indices.to_numpy(zero_copy_only=False)] if len(at) else np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(dl)), dl)
    here = term >= 0
    pair, tf = np.unique(doc[here] * max(1, len(terms)) + term[here], return_counts=True)
    return pair // max(1, len(terms)), pair % max(1, len(terms)), tf, dl


def save(docs: DataFrame, path: str, model: Bm25 = Bm25(idf_side="both")) -> None:
    """A fitted model in a folder: its parameters and statistics, and the vocabulary with term ids and document frequencies."""
    spark = docs.sparkSession
    vocabulary(docs).select("term", "term_id", "df").write.parquet(f"{path}/vocabulary")
    s = statistics(docs).first()
    spark.createDataFrame([(*asdict(model).values(), s.n_docs, s.total_len)], "k1 double, b double, idf_side string, n_docs long, total_len long").write.parquet(f"{path}/model")


def load(spark: SparkSession, path: str) -> Fitted:
    r = spark.read.parquet(f"{path}/model").first()
    return Fitted(Bm25(r.k1, r.b, r.idf_side or "both"), r.n_docs, r.total_len, spark.read.parquet(f"{path}/vocabulary"))


@dataclass(frozen=True)
class Fitted:
    """A fitted model: weights of texts by the statistics of the corpus that it was fitted on."""

    model: Bm25
    n_docs: int
    total_len: int
    vocabulary: DataFrame

    @property
    def model_id(self) -> str:
        return f"local-bm25-{self.model.idf_side}-v1"

    @property
    def avg_len(self) -> float:
        return self.total_len / self.n_docs if self.n_docs else 0.0

    def _with_idf(self, counts: DataFrame) -> DataFrame:
        return counts.join(self.vocabulary, "term").withColumn("idf", idf(F.lit(float(self.n_docs)), F.col("df")))

    def sparse_text(self, rows: DataFrame) -> DataFrame:
        """doc_id, term_id, weight of ``rows`` (doc_id, text); terms outside the vocabulary have none."""
        length = 1.0 - self.model.b + self.model.b * (F.col("dl") / self.avg_len if self.avg_len > 0 else F.lit(1.0))
        weight = F.col("tf") * (self.model.k1 + 1.0) / (F.col("tf") + self.model.k1 * length)
        found = self._with_idf(term_counts(rows))
        return found.select("doc_id", "term_id", (weight if self.model.idf_side == "query" else weight * F.col("idf")).alias("weight"))

    def query_weights(self, queries: DataFrame) -> DataFrame:
        """qid, term_id, weight of ``queries`` (qid, text): each term once, its idf, or 1 if that is the documents'."""
        terms = queries.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
        return self._with_idf(terms).select("qid", "term_id", (F.lit(1.0) if self.model.idf_side == "doc" else F.col("idf")).alias("weight"))
