"""Search of a media library as one operator: filters, two arms, fusion, exclusion, hydration, and a log of what was asked."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import stored
from .bm25 import Bm25, top, top_hits
from .search import DEPTH, dense_top, fused, hard_filter


@dataclass(frozen=True)
class Filter:
    """Conditions that a document must meet; a null value of the document fails."""

    orientation: str | None = None
    min_duration: int | None = None
    max_duration: int | None = None
    min_width: int | None = None
    license: str | None = None


@dataclass(frozen=True)
class Found:
    """``hits`` (qid, rank, doc_id, score and the documents' columns), ``arms`` (qid, dense, sparse: how many hits each arm had)."""

    hits: DataFrame = field(repr=False)
    arms: DataFrame = field(repr=False)


def urls_of(page: Column, thumbnail: Column, files: Column) -> Column:
    """All URLs that a document is known by: its page, its thumbnail, and the link of every rendition (JSON array of objects)."""
    links = F.transform(F.coalesce(F.from_json(files, "array<struct<link:string>>"), F.array().cast("array<struct<link:string>>")), lambda f: f["link"])
    return F.array_distinct(F.filter(F.concat(F.array(page, thumbnail), links), lambda u: u.isNotNull() & (u != "")))


def search_library(queries: DataFrame, library: DataFrame, k: int = 30, depth: int = DEPTH, where: Filter = Filter(), excluded: DataFrame | None = None, model: Bm25 = Bm25(idf_side="both"), metric: str = "cosine") -> Found:
    """Hybrid search of all ``queries`` (qid, text, embedding) over a ``library`` (doc_id, text, embedding, orientation, duration, width,
    license, urls: an array, and more).

    Documents that meet the filter are ranked by their vectors and by BM25 (whose statistics are those of the whole
    library), ``depth`` each; reciprocal ranks are added up, ties by doc_id. With ``excluded`` (url), as many more hits are
    looked at as there are excluded URLs, ``k`` at most; hits of which any URL is excluded go, and the first ``k`` of what is
    left stay, ranks closed up. Rows without vector are in the text arm only. Both arms are ranked here, once, and stored:
    ``depth`` rows of each for a query, on which fusion, exclusion, counts and whatever reads the result rest.
    """
    kept = hard_filter(library, **asdict(where))
    dense = dense_top(queries.select("qid", "embedding"), kept.select("doc_id", "embedding"), depth, metric)
    sparse = top_hits(queries.select("qid", "text"), library.select("doc_id", "text"), depth, model, allowed=kept.select("doc_id"))
    margin = min(excluded.distinct().count(), k) if excluded is not None else 0
    ranked = stored(dense.select("qid", "doc_id", "rank", F.lit("dense").alias("arm")).unionByName(sparse.select("qid", "doc_id", "rank", F.lit("sparse").alias("arm"))))
    hits = fused(ranked, k + margin)
    if excluded is not None:
        named = hits.select("doc_id").distinct().join(library.select("doc_id", F.explode("urls").alias("url")), "doc_id")
        bad = named.join(excluded.select("url").distinct(), "url", "left_semi").select("doc_id").distinct()
        hits = top(hits.join(bad, "doc_id", "left_anti").drop("rank"), k)
    counts = ranked.groupBy("qid").agg(*[F.count_if(F.col("arm") == name).alias(name) for name in ("dense", "sparse")])
    arms = queries.select("qid").join(counts, "qid", "left").fillna(0, ["dense", "sparse"])
    return Found(hits.join(library.drop("text", "embedding"), "doc_id"), arms)


def rerank(hits: DataFrame, scores: DataFrame, first: int = 50) -> DataFrame:
    """The seam for a second stage: the ``first`` hits of each query in the order of ``scores`` (qid, doc_id, score), which may come
    from any model; hits without a new score, and those after the first, keep their order behind them."""
    rows = hits.join(scores.select("qid", "doc_id", F.col("score").alias("__again")), ["qid", "doc_id"], "left")
    again = F.when(F.col("rank") <= first, F.col("__again"))
    from pyspark.sql import Window

    order = Window.partitionBy("qid").orderBy(F.desc_nulls_last("__again"), "rank")
    return rows.withColumn("__again", again).withColumn("rank", F.row_number().over(order)).drop("__again")


def log_rows(queries: DataFrame, found: Found, k: int, where: Filter = Filter(), n_excluded: int = 0) -> DataFrame:
    """A row for each query as a log has it: when, what, with which conditions, the arms' counts, and the first ten hits."""
    first = found.hits.where("rank <= 10").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("top"))
    rows = queries.select("qid", F.col("text").alias("q")).join(found.arms, "qid").join(first, "qid", "left")
    asked = [F.lit(k).alias("k"), F.lit(where.orientation).cast("string").alias("orientation"), F.lit(where.min_duration).cast("int").alias("min_duration"), F.lit(n_excluded).alias("exclude")]
    return rows.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssZ").alias("ts"), "q", *asked, F.struct("dense", "sparse").alias("arms"), F.coalesce("top", F.array().cast("array<long>")).alias("top"))


def append_log(rows: DataFrame, path: str, enabled: bool = True) -> bool:
    """Append to a folder of JSON lines; whether that was done. A log that cannot be written must not break a search."""
    if not enabled:
        return False
    try:
        rows.write.mode("append").json(path)
    except Exception as e:  # noqa: BLE001
        print(f"query log: {re.sub(chr(10) + '.*', '', str(e))}")
        return False
    return True
