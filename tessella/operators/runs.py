"""Runs of retrieval strategies: kept, found again, scored, cut, and put on a leaderboard."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import content_hash
from .metrics import hashed_bootstrap, paired_bootstrap, per_query, summary

METRICS = ("ndcg10", "recall1", "recall5", "recall10", "mrr10")
#: Hits of a query that an export has.
EXPORTED = 50


def save(hits: DataFrame, timings: DataFrame, path: str, run_id: str, spec: dict, materials: str, queries: str) -> None:
    """A run in ``path``: hits (qid, doc_id, rank, score), timings (qid, search_ms, embed_ms) and its manifest, in folders by run_id. A run
    that is there already is an error."""
    spark = hits.sparkSession
    manifest = [(json.dumps(spec, sort_keys=True), spec["strategy"], content_hash(spec), materials, queries)]
    manifest = spark.createDataFrame(manifest, "spec string, strategy string, config_hash string, materials string, queries string")
    hits.select("qid", "doc_id", "rank", "score").write.parquet(f"{path}/hits/run_id={run_id}")
    timings.select("qid", "search_ms", "embed_ms").write.parquet(f"{path}/timings/run_id={run_id}")
    manifest.write.parquet(f"{path}/manifests/run_id={run_id}")


def find(spark: SparkSession, path: str, materials: str, queries: str) -> DataFrame:
    """The manifests (run_id, spec, strategy, config_hash, materials, queries) of runs of these versions."""
    runs = spark.read.option("basePath", f"{path}/manifests").parquet(f"{path}/manifests/*")
    return runs.withColumn("run_id", F.col("run_id").cast("string")).where((F.col("materials") == materials) & (F.col("queries") == queries))


def load(spark: SparkSession, path: str, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits and timings of the runs in ``runs`` (run_id)."""
    read = lambda kind: spark.read.parquet(f"{path}/{kind}").withColumn("run_id", F.col("run_id").cast("string")).join(runs.select("run_id"), "run_id", "left_semi")
    return read("hits"), read("timings")


def score(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """run_id, qid and the metrics of each query of all runs at once."""
    return per_query(hits, labels, "run_id")


def by_split(scored: DataFrame, queries: DataFrame, names: tuple[str, ...] = METRICS) -> DataFrame:
    """run_id, split, metric, mean, median, min, max, n: of each split of ``queries`` (qid, split) and of all."""
    rows = scored.join(queries.select("qid", "split"), "qid").withColumn("split", F.explode(F.array("split", F.lit("all"))))
    return reduce(DataFrame.unionByName, [summary(rows, name, "run_id", "split").withColumn("metric", F.lit(name)) for name in names])


def of_split(queries: DataFrame, split: str) -> DataFrame:
    """The queries of a split; 'all' has every query."""
    return queries if split == "all" else queries.where(F.col("split") == split)


def cut_keys() -> Column:
    """What a query (category, lang, source, difficulty, hard: a map, facets: an array) counts in: a list of ``name=value``."""
    named = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ("category", "lang", "source", "difficulty")]
    hard = F.when(F.size("hard") > 0, "hard=yes").otherwise("hard=no")
    return F.array_distinct(F.concat(F.array(*named, hard), F.transform("facets", lambda f: F.concat(F.lit("facet:"), f, F.lit("=yes")))))


def cuts(scored: DataFrame, queries: DataFrame, split: str = "all", metric: str = "ndcg10") -> DataFrame:
    """run_id, cut, mean, n of the queries of a split by every dimension and facet."""
    rows = scored.join(of_split(queries, split).select("qid", F.explode(cut_keys()).alias("cut")), "qid")
    return rows.groupBy("run_id", "cut").agg(F.avg(metric).alias("mean"), F.count("*").alias("n"))


def percentiles(rows: DataFrame, column: str, fractions: dict[str, float], *within: str) -> DataFrame:
    """Nearest-rank percentiles of each group, zero of none; a group is what a query set has, so it may be sorted."""
    place = F.row_number().over(Window.partitionBy(*within).orderBy(column))
    numbered = rows.where(F.col(column).isNotNull()).select(*within, column, place.alias("nth"), F.count("*").over(Window.partitionBy(*within)).alias("n"))
    at = lambda f: F.greatest(F.lit(1), F.least(F.col("n"), F.rint(F.lit(f) * F.col("n")).cast("long")))
    return numbered.groupBy(*within).agg(*[F.coalesce(F.max(F.when(F.col("nth") == at(f), F.col(column).cast("double"))), F.lit(0.0)).alias(name) for name, f in fractions.items()])


def leaderboard(scored: DataFrame, timings: DataFrame, runs: DataFrame, queries: DataFrame, split: str = "holdout", metric: str = "ndcg10") -> DataFrame:
    """place, run_id, strategy, config_hash, the metric's mean in the split and in all queries, recall and reciprocal rank, latencies,
    null grades among the first ten, judge_coverage (queries scored); the best mean of the split first, ties by run_id."""
    rows = scored.join(queries.select("qid", "split"), "qid", "left")
    inside = F.lit(True) if split == "all" else F.coalesce(F.col("split") == split, F.lit(False))
    mean = lambda c, where: F.round(F.coalesce(F.avg(F.when(where, F.col(c))), F.lit(0.0)), 9)
    known = F.col("split").isNotNull()
    means = rows.groupBy("run_id").agg(
        mean(metric, inside & known).alias(f"{metric}_split"), mean(metric, known).alias(f"{metric}_full"), mean("recall10", inside & known).alias("recall10"), mean("mrr10", inside & known).alias("mrr10"),
        F.sum("null_grade_top10").alias("null_grade_top10"), F.count("*").alias("judge_coverage"),
    )
    search = percentiles(timings, "search_ms", {"search_ms_p50": 0.5, "search_ms_p95": 0.95}, "run_id")
    embed = percentiles(timings, "embed_ms", {"embed_ms_p50": 0.5, "embed_ms_p95": 0.95}, "run_id")
    board = means.join(runs.select("run_id", "strategy", "spec", "config_hash"), "run_id").join(search, "run_id", "left").join(embed, "run_id", "left")
    return board.withColumn("place", F.row_number().over(Window.orderBy(F.desc(f"{metric}_split"), "run_id")))  # a row for each run


def pairwise(scored: DataFrame, queries: DataFrame, split: str = "holdout", metric: str = "ndcg10", hashed: bool = False) -> DataFrame:
    """pair (a-b, a before b by name), n, mean_diff, low, high, win of each pair of runs over the queries of a split that both have."""
    rows = scored.join(of_split(queries, split).select("qid"), "qid", "left_semi")
    one, two = (rows.select(F.col("run_id").alias(f"run_{x}"), "qid", F.col(metric).alias(x)) for x in ("a", "b"))
    pairs = one.join(two, "qid").where("run_a < run_b").withColumn("pair", F.concat_ws("-", "run_a", "run_b"))
    return (hashed_bootstrap if hashed else paired_bootstrap)(pairs.select("pair", "qid", "a", "b"))


def hit_rows(hits: DataFrame, runs: DataFrame, most: int = EXPORTED) -> DataFrame:
    """Hits of all runs as they are exported: at most 50 a query, scores with six places."""
    rows = hits.where(F.col("rank") <= most).join(runs.select("run_id", "strategy"), "run_id")
    return rows.select("run_id", "strategy", "qid", "rank", "doc_id", F.format_string("%.6f", F.col("score").cast("double")).alias("score"))
