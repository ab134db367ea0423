"""Retrieval quality: gains, per-query metrics, cuts, agreement of raters, resampling."""

from __future__ import annotations

import random
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import value_at

K, RELEVANT = 10, 2


def gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade) - 1.0


def per_query(run: DataFrame, labels: DataFrame, *within: str) -> DataFrame:
    """qid and its metrics: ``run`` (qid, doc_id, rank) against ``labels`` (qid, doc_id, grade or null); for each of ``within``, such
    as run_id, apart.

    A missing or null grade is 0 in the ranking and counted; the ideal takes nulls as 0; recall and reciprocal rank take
    grades of 2 and more.
    """
    hits = run.where(F.col("rank") <= K).join(labels, ["qid", "doc_id"], "left")
    g, good = F.coalesce("grade", F.lit(0)), F.col("grade") >= RELEVANT
    ranked = hits.groupBy(*within, "qid").agg(
        F.sum(gain(g) / F.log2(F.col("rank") + 1.0)).alias("dcg"),
        *[F.sum(F.when(good & (F.col("rank") <= k), 1).otherwise(0)).alias(f"good{k}") for k in (1, 5, 10)],
        F.coalesce(1.0 / F.min(F.when(good, F.col("rank"))), F.lit(0.0)).alias("mrr10"),
        F.sum(F.col("grade").isNull().cast("long")).alias("null_grade_top10"),
    )
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.coalesce("grade", F.lit(0))), "doc_id"))
    pool = labels.withColumn("place", place).groupBy("qid").agg(
        F.sum(F.when(F.col("place") <= K, gain(g) / F.log2(F.col("place") + 1.0)).otherwise(0.0)).alias("ideal"),
        F.sum(F.when(good, 1).otherwise(0)).alias("n_relevant"),
        F.count("*").alias("n_judged"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    both = ranked.join(pool, "qid", "left")
    return both.select(*within, "qid", F.round(ratio("dcg", "ideal"), 9).alias("ndcg10"), *[F.round(ratio(f"good{k}", "n_relevant"), 9).alias(f"recall{k}") for k in (1, 5, 10)], F.round("mrr10", 9).alias("mrr10"), F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"), F.coalesce("n_judged", F.lit(0)).alias("n_judged"), "null_grade_top10")


def nearest_rank(values: DataFrame, column: str, fractions: dict[str, float]) -> DataFrame:
    """One row of percentiles: the value at position round-half-even(fraction * n), 1 at least; null without values."""
    n = values.where(F.col(column).isNotNull()).count()
    found = [value_at(values, column, max(1, min(n, round(f * n)))) if n else None for f in fractions.values()]
    return values.sparkSession.createDataFrame([tuple(found)], ", ".join(f"{name} double" for name in fractions))


def kappa(pairs: DataFrame) -> DataFrame:
    """One row: n, agreement, kappa of the ratings a and b."""
    n = pairs.count()
    cells = pairs.groupBy("a", "b").agg(F.count("*").alias("c"))
    a = cells.groupBy(F.col("a").alias("label")).agg(F.sum("c").alias("na"))
    b = cells.groupBy(F.col("b").alias("label")).agg(F.sum("c").alias("nb"))
    chance = a.join(b, "label").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("chance"))
    seen = cells.agg(F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("c"))), F.lit(0)).alias("same"))
    po, pe = F.col("same") / F.lit(float(max(n, 1))), F.col("chance") / F.lit(float(max(n, 1)) ** 2)
    return seen.crossJoin(chance).select(F.lit(n).cast("long").alias("n"), F.round(po, 9).alias("agreement"), F.round(F.when(pe >= 1.0, 1.0).otherwise((po - pe) / (1.0 - pe)), 9).alias("kappa"))


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def resampled(differences: list[float], rounds: int = 1000, seed: str = "bootstrap", confidence: float = 0.95) -> tuple[float, float]:
    """The ends of the confidence interval of the mean: as many values of the sorted means of resamples lie below the one as above the
    other. Every pair of runs is resampled with the same draws."""
    if not differences:
        return 0.0, 0.0
    rng, n = random.Random(int.from_bytes(blake2b(seed.encode(), digest_size=8).digest(), "big")), len(differences)
    means = sorted(sum([differences[rng.randrange(n)] for _ in range(n)]) / n for _ in range(rounds))
    tail = int((1 - confidence) / 2 * rounds)
    return means[tail], means[rounds - 1 - tail]


def paired_bootstrap(pairs: DataFrame, rounds: int = 1000, seed: str = "bootstrap", confidence: float = 0.95) -> DataFrame:
    """pair, n, mean_diff, low, high, win of ``pairs`` (pair, qid, a, b): resamples of the queries of each pair of runs; win is 1 if a
    is better, -1 if b is, else 0.

    A pair's queries are one task's: they are at most a query set, never documents.
    """

    def resample(rows: pd.DataFrame) -> pd.DataFrame:
        d = (rows.sort_values("qid")["a"] - rows.sort_values("qid")["b"]).tolist()
        low, high = resampled(d, rounds, seed, confidence)
        return pd.DataFrame([(rows["pair"].iloc[0], len(d), sum(d) / len(d), low, high, int(low > 0) - int(high < 0))], columns=["pair", "n", "mean_diff", "low", "high", "win"])

    return pairs.groupBy("pair").applyInPandas(resample, "pair string, n long, mean_diff double, low double, high double, win int")


def hashed_bootstrap(pairs: DataFrame, rounds: int = 1000, confidence: float = 0.95) -> DataFrame:
    """As :func:`paired_bootstrap`, but the query that a resample draws at a place comes from the MD5 of resample and place, so that
    all is expressions and SQL draws the same."""
    place = F.row_number().over(Window.partitionBy("pair").orderBy("qid")) - 1
    rows = pairs.select("pair", place.alias("place"), (F.col("a") - F.col("b")).alias("d"), F.count("*").over(Window.partitionBy("pair")).alias("n"))
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("round").cast("string"), F.col("place").cast("string"))), 1, 15), 16, 10).cast("long") % F.col("n")
    drawn = rows.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).select("pair", "round", draw.cast("int").alias("place"))
    means = drawn.join(rows.select("pair", "place", "d"), ["pair", "place"]).groupBy("pair", "round").agg(F.round(F.avg("d"), 9).alias("m"))
    tail = int((1 - confidence) / 2 * rounds)
    nth = F.row_number().over(Window.partitionBy("pair").orderBy("m")) - 1
    ends = means.withColumn("nth", nth).groupBy("pair").agg(F.max(F.when(F.col("nth") == tail, F.col("m"))).alias("low"), F.max(F.when(F.col("nth") == rounds - 1 - tail, F.col("m"))).alias("high"))
    whole = rows.groupBy("pair").agg(F.count("*").alias("n"), F.round(F.avg("d"), 9).alias("mean_diff"))
    return whole.join(ends, "pair").withColumn("win", (F.col("low") > 0).cast("int") - (F.col("high") < 0).cast("int"))


def summary(rows: DataFrame, column: str, *within: str) -> DataFrame:
    """mean, median, min, max, n of a column; zeros of no values."""
    value = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.groupBy(*within).agg(value(F.avg(column)).alias("mean"), value(F.median(column)).alias("median"), value(F.min(column)).alias("min"), value(F.max(column)).alias("max"), F.count(column).alias("n"))


def pairwise_wins(scored: DataFrame, metric: str = "ndcg10") -> DataFrame:
    """a, b, n, wins, losses, ties of each pair of runs (a < b), over the queries that both have."""
    one, two = (scored.select(F.col("run_id").alias(name), "qid", F.col(metric).alias(f"{name}_value")) for name in ("a", "b"))
    diff = F.col("a_value") - F.col("b_value")
    return one.join(two, "qid").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if(diff > 0).alias("wins"), F.count_if(diff < 0).alias("losses"), F.count_if(diff == 0).alias("ties"))
